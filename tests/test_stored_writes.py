"""Writes into stored versions: buckets, conditions, concurrent writers, pinned runs, counters."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tableset.functions.layout import layout_id
from tableset.plans.change_set import planned_actions
from tableset.plans.migrate import MigrationError, apply_changes, migrate
from tableset.plans.stored_writes import get_documents, grow, put_documents, put_if
from tableset.session import durable
from tableset.sources import store as stores
from tableset.sources.store import SnapshotConflict, Store
from tests.test_change_set import desired_of
from tests.test_store import LONG, TEXT, content, documents, meta, put

ROWS = [(f"d{i}", str(i), "s") for i in range(40)]
UPDATES = "version_name STRING, _id STRING, n STRING, expected_seq LONG, entry_seq LONG"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def stored(store, *names):
    wanted = store.spark.createDataFrame([(n,) for n in names or ("v",)], "version_name STRING")
    return store.versions().join(wanted, "version_name", "left_semi")


def files(store):
    """Data files by bucket."""
    out = {}
    for folder, _, names in os.walk(f"{store.root}/data"):
        bucket = re.search(r"folder=([^/]+)/_bucket=(\d+)", folder)
        for name in names:
            if bucket and name.endswith(".parquet"):
                out.setdefault(int(bucket[2]), set()).add(f"{folder}/{name}")
    return out


def rows(store, name="v"):
    return {r._id: (r.n, r._seq_no) for r in store.documents(stored(store, name)).collect()}


def updates(spark, *given):
    return spark.createDataFrame([("v", *g) for g in given], UPDATES)


def test_a_write_rewrites_only_the_buckets_it_touches(spark, store):
    store.create_version("v", TEXT, documents(spark, ROWS), buckets=8)
    before = files(store)
    assert set(before) == set(range(8))
    new = spark.createDataFrame([("v", "d3", "new"), ("v", "x", "added")], "version_name STRING, _id STRING, n STRING")
    touched = {r[0] for r in new.select(stores.bucket_of(F.lit(8))).collect()}
    put_documents(store, stored(store), new)
    after = files(store)
    assert {b for b in after if after[b] != before[b]} == touched and all(before[b] <= after[b] for b in before)
    moved = {r.bucket for r in store.parts().collect() if r.bucket >= 0}
    assert moved == touched
    assert rows(store) == {f"d{i}": (str(i), 0) for i in range(40)} | {"d3": ("new", 1), "x": ("added", 0)}
    put_documents(store, stored(store), new)
    assert rows(store)["d3"] == ("new", 2) and rows(store)["x"] == ("added", 1)
    # The former folders of the buckets are no longer needed to read the version.
    for bucket in touched:
        for path in before[bucket] | (after[bucket] - before[bucket]):
            os.remove(path)
    assert len(rows(store)) == 41


def test_the_base_is_not_shuffled(spark, store, plan_of, monkeypatch):
    store.create_version("v", TEXT, documents(spark, ROWS), buckets=4)
    plans, write = [], store.write_folders

    def watched(df, definition):
        plans.append(plan_of(df))
        write(df, definition)

    monkeypatch.setattr(store, "write_folders", watched)
    put_documents(store, stored(store), spark.createDataFrame([("v", "d3", "new")], "version_name STRING, _id STRING, n STRING"))
    # What hangs below the joins with the keys of the updates: scans of the touched bucket, broadcasts, no shuffle.
    lines = [(re.search(r"[A-Z(*]", line).start(), line) for line in plans[0].split("\n") if re.search(r"[A-Z(*]", line)]
    joins = [i for i, (_, line) in enumerate(lines) if "LeftAnti" in line or "LeftSemi" in line]
    assert len(joins) == 1
    for i in joins:
        depth = lines[i][0]
        below = [line for at, line in lines[i + 1 : next((j for j in range(i + 1, len(lines)) if lines[j][0] <= depth), len(lines))]]
        assert "BroadcastHashJoin" in lines[i][1] and "LeftAnti" in lines[i][1], plans[0]
        assert not any("Exchange hashpartitioning" in line for line in below), plans[0]
        assert any("FileScan parquet" in line and "_bucket" in line.partition("PartitionFilters")[2] for line in below), plans[0]


def test_empty_buckets_and_versions(spark, store):
    store.create_version("v", TEXT, buckets=4)
    assert rows(store) == {}
    new = spark.createDataFrame([("v", "a", "1")], "version_name STRING, _id STRING, n STRING")
    put_documents(store, stored(store), new.limit(0))
    put_documents(store, stored(store), new)
    assert rows(store) == {"a": ("1", 0)}
    with pytest.raises(Exception, match="no such version"):
        put_documents(store, stored(store), new.withColumn("version_name", F.lit("w")))


def test_generated_ids_are_fixed_and_the_last_of_an_order_counts(spark, store):
    store.create_version("v", TEXT, buckets=4)
    new = spark.createDataFrame([("v", "", "1"), ("v", None, "2"), ("v", "a", "3"), ("v", "a", "4")], "version_name STRING, _id STRING, n STRING")
    written = put_documents(store, stored(store), new, order=[F.col("n")])
    want = {r._id: (r.n, 0) for r in written.collect()}
    assert len(want) == 3 and want["a"] == ("4", 0) and rows(store) == want


def test_conditional_writes(spark, store):
    store.create_version("v", TEXT, documents(spark, ROWS), buckets=4)
    conflicts = put_if(store, stored(store), updates(
        spark, ("d1", "a", 0, 1), ("d1", "b", 0, 2), ("d2", "c", 5, 3), ("new", "d", None, 4), ("new", "e", None, 5), ("d3", "f", None, 6)
    ))
    assert sorted((r._id, r.n, r.entry_seq) for r in conflicts.collect()) == [("d1", "b", 2), ("d2", "c", 3), ("d3", "f", 6), ("new", "e", 5)]
    now = rows(store)
    assert (now["d1"], now["d2"], now["d3"], now["new"]) == (("a", 1), ("2", 0), ("3", 0), ("d", 0)) and len(now) == 41
    assert put_if(store, stored(store), updates(spark, ("d1", "z", 1, 1))).count() == 0
    assert rows(store)["d1"] == ("z", 2)


@pytest.mark.parametrize("same", [True, False])
def test_two_writers(spark, store, monkeypatch, same):
    """The second reads before the first commits: of one id one wins, of different buckets both."""
    store.create_version("v", TEXT, documents(spark, ROWS), buckets=8)
    bucket = {r._id: r.b for r in documents(spark, ROWS).select("_id", stores.bucket_of(F.lit(8)).alias("b")).collect()}
    other = next(i for i in bucket if bucket[i] != bucket["d1"])
    neighbour = next(i for i in bucket if bucket[i] == bucket["d1"] and i != "d1")
    commit, rounds = Store.commit_parts, []

    def overtaken(self, planned, new, whole=False):
        rounds.append(planned.count())
        if len(rounds) == 1:
            put_if(store, stored(store), updates(spark, ("d1", "first", 0, 1)))
        return commit(self, planned, new, whole)

    monkeypatch.setattr(Store, "commit_parts", overtaken)
    mine = [("d1", "second", 0, 1), (neighbour, "beside", 0, 2)] if same else [(other, "second", 0, 1)]
    conflicts = put_if(store, stored(store), updates(spark, *mine))
    now = rows(store)
    assert now["d1"] == ("first", 1) and len(now) == 40
    if same:
        assert [r._id for r in conflicts.collect()] == ["d1"] and now[neighbour] == ("beside", 1)
        assert len(rounds) == 3  # mine, the other's, and mine again
    else:
        assert conflicts.count() == 0 and now[other] == ("second", 1) and len(rounds) == 2


def test_a_claimed_commit_is_waited_for(spark, store, monkeypatch):
    store.create_version("v", TEXT, documents(spark, ROWS), buckets=4)
    monkeypatch.setattr(stores, "COMMIT_WAIT", 0)
    monkeypatch.setattr(stores, "COMMIT_TRIES", 2)
    number = store._parts.current()[0] + 1
    os.makedirs(f"{store.root}/parts/claims", exist_ok=True)
    open(f"{store.root}/parts/claims/{number}", "w").close()
    with pytest.raises(SnapshotConflict):
        put_if(store, stored(store), updates(spark, ("d1", "a", 0, 1)))
    assert rows(store)["d1"] == ("1", 0)
    store._parts.release()
    assert put_if(store, stored(store), updates(spark, ("d1", "a", 0, 1))).count() == 0


def test_versions_grow_into_buckets(spark, store, monkeypatch):
    put(store, "env-x", "v", ROWS)
    put(store, "env-y", "w", ROWS[:3])
    monkeypatch.setattr(stores, "BUCKET_ROWS", 10)
    grow(store, store.versions())
    at = {(r.version_name, r.buckets) for r in store.pointers(store.versions()).collect()}
    assert at == {("v", 4), ("w", 1)}
    assert rows(store) == {f"d{i}": (str(i), 0) for i in range(40)} and len(rows(store, "w")) == 3
    put_documents(store, stored(store), spark.createDataFrame([("v", "d3", "new")], "version_name STRING, _id STRING, n STRING"))
    # Written anew as a whole: what the parts said before is of no use, and the document stays.
    folder = {r.root: r.base for r in store.pointers(stored(store)).collect()}
    planned = store.pointers(stored(store))
    all_rows = store.documents(stored(store)).withColumn("folder", F.lit("again"))
    store.write_folders(all_rows, TEXT)
    assert store.commit_parts(planned, [(next(iter(folder)), -1, "again", 1)], whole=True).count() == 0
    assert rows(store)["d3"] == ("new", 1) and len(rows(store)) == 40
    assert {r.bucket for r in store.parts().collect()} == {-1}


def test_get_reads_only_buckets_that_can_hold_the_ids(spark, store, plan_of):
    store.create_version("v", TEXT, documents(spark, ROWS), buckets=8)
    ids = spark.createDataFrame([("v", "d1"), ("v", "nope"), ("v", "d1")], "version_name STRING, _id STRING")
    held = {r[0] for r in ids.select(stores.bucket_of(F.lit(8))).distinct().collect()}
    for bucket, paths in files(store).items():
        if bucket not in held:
            for path in paths:
                os.remove(path)
    got = get_documents(store, stored(store), ids)
    assert sorted((r._id, r._present, r.n) for r in got.collect()) == [("d1", True, "1"), ("nope", False, None)]


def test_drop_deletes_the_folders_of_all_buckets(spark, store):
    store.create_version("v", TEXT, documents(spark, ROWS), buckets=4)
    put_documents(store, stored(store), spark.createDataFrame([("v", "d3", "new")], "version_name STRING, _id STRING, n STRING"))
    store.drop_version("v")
    assert files(store) == {} and store.versions().count() == 0


def test_a_run_planned_on_an_older_state_stops(spark, store):
    """Two runs from one state: the second publishes nothing, and the first's version stays."""
    put(store, "env-x", "old", [("a", "1", "S")])
    desired = desired_of(spark, sets=[("x", LONG, meta())])
    late = store.state()
    planned = durable(planned_actions(desired, store.changelog(), late.membership, late.pipelines, "2"))
    migrate(store, desired, "1")
    with pytest.raises(SnapshotConflict):
        apply_changes(store, planned, "env", late)
    assert [tuple(r) for r in store.membership().collect()] == [("env-x", "env-x_1")]
    assert sorted(r.version_name for r in store.versions().collect()) == ["env-x_1", "old"]
    assert store.changelog().count() == 1 and content(store, "env-x", "_id", "n") == [("a", 1)]


def test_pipelines_planned_on_an_older_state_stop(spark, store):
    one = '{"processors": [{"lowercase": {"field": "s"}}]}'
    late = store.state()
    desired = desired_of(spark, pipelines=[("p", one)])
    planned = durable(planned_actions(desired, store.changelog(), late.membership, late.pipelines, "2"))
    migrate(store, desired_of(spark, pipelines=[("q", one)]), "1")
    with pytest.raises(SnapshotConflict):
        apply_changes(store, planned, "env", late)
    assert [r.name for r in store.pipelines().collect()] == ["env-q"]


def test_a_copy_reads_its_source_once(spark, store, monkeypatch, plan_of):
    put(store, "env-x", "old", [("a", "1", "S"), ("b", "2", "T")])
    write, counts, plans = store.write_folders, store.counts, []

    def gone_afterwards(df, definition):
        write(df, definition)
        for path in {p for paths in files(store).values() for p in paths if "folder=old." in p}:
            os.remove(path)

    def counted(layout, folders):
        df = counts(layout, folders)
        plans.append(plan_of(df))
        return df

    monkeypatch.setattr(store, "write_folders", gone_afterwards)
    monkeypatch.setattr(store, "counts", counted)
    migrate(store, desired_of(spark, sets=[("x", LONG, meta())]), "7")
    assert content(store, "env-x", "_id", "n") == [("a", 1), ("b", 2)]
    assert len(plans) == 1 and "ReadSchema: struct<>" in plans[0]


def test_lost_files_stop_a_copy(spark, store, monkeypatch):
    put(store, "env-x", "old", [("a", "1", "S"), ("b", "2", "T")])
    write = store.write_folders

    def one_is_lost(df, definition):
        write(df, definition)
        path = sorted(p for paths in files(store).values() for p in paths if "folder=env-x_7." in p)[0]
        os.remove(path)

    monkeypatch.setattr(store, "write_folders", one_is_lost)
    with pytest.raises(MigrationError, match="2 documents read"):
        migrate(store, desired_of(spark, sets=[("x", LONG, meta())]), "7")
    assert content(store, "env-x", "_id", "n") == [("a", "1"), ("b", "2")]


def test_folders_are_found_at_run_time_when_they_are_many(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "NAMED_FOLDERS", 0)
    store.create_version("v", TEXT, documents(spark, ROWS), buckets=4)
    assert put_if(store, stored(store), updates(spark, ("d1", "a", 0, 1))).count() == 0
    assert rows(store)["d1"] == ("a", 1) and len(rows(store)) == 40
    counted = store.counts(layout_id(TEXT), store.pointers(stored(store)))
    assert counted.agg(F.sum("rows")).first()[0] >= 40
