"""The log in batches, its compacted latest entries, and the sweep of what nothing names."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tableset.operators.changes import change_status
from tableset.operators.latest import latest_entries
from tableset.plans.migrate import migrate
from tableset.plans.stored_writes import put_documents
from tableset.sources.store import SnapshotConflict, Store, ranges
from tests.test_change_set import desired_of
from tests.test_store import LONG, TEXT, content, documents, meta, put

ROW = "resource_type STRING, resource_identifier STRING, final_name STRING, env_name STRING, content STRING, meta STRING, entry_seq LONG"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def append(store, *entries):
    store.append_log(store.spark.createDataFrame([(*e[:2], "f", e[2], e[3], "{}", e[4]) for e in entries], ROW))


def latest(log):
    return {(r.resource_type, r.resource_identifier, r.env_name): r.content for r in latest_entries(log).collect()}



def test_latest_entries_after_any_appends_and_compactions(store):
    rng, want = random.Random(5), {}
    for step in range(7):
        entries = [(rng.choice(["index_set", "document"]), rng.choice("abcd"), rng.choice(["e1", "e2"]), f"{step}.{i}", i) for i in range(rng.choice([0, 1, 4]))]
        append(store, *entries)
        want |= {(t, k, e): c for t, k, e, c, _ in entries}
        if step in (2, 3, 5):
            store.compact_log()
        assert latest(store.recent_log()) == want == latest(store.changelog())
    assert not store.compact_log(after=2) and store.compact_log() and not store.compact_log()
    assert latest(store.recent_log()) == want


def test_only_the_compacted_rows_and_the_tail_are_read(store, plan_of):
    for i in range(4):
        append(store, ("index_set", "a", "e", str(i), i))
        if i == 2:
            assert store.compact_log(after=3)
    files = store.recent_log().inputFiles()
    assert len(files) == 2 and any("batch=4/" in f for f in files) and any("/latest_rows/" in f for f in files)
    assert len(store.changelog().inputFiles()) == 4
    mine = store.recent_log().filter((F.col("resource_type") == "index_set") & (F.col("env_name") == "e"))
    assert plan_of(mine).count("PartitionFilters: [isnotnull(resource_type") == 2


def test_a_batch_that_commits_late_is_not_lost(store):
    append(store, ("index_set", "a", "e", "1", 1))
    os.makedirs(f"{store.root}/changelog/batch=2")
    open(f"{store.root}/batches/2", "w").close()
    append(store, ("index_set", "b", "e", "3", 1))
    store.compact_log()
    assert store._latest.read().select("first", "last").collect() == [(1, 1), (3, 3)]
    row = store.spark.createDataFrame([("index_set", "c", "f", "e", "late", "{}", 1)], ROW).withColumn("timestamp", F.current_timestamp())
    row.write.mode("overwrite").partitionBy("resource_type", "env_name").parquet(f"{store.root}/changelog/batch=2")
    assert latest(store.recent_log()) == {("index_set", k, "e"): c for k, c in zip("abc", ("1", "3", "late"))}
    append(store, ("index_set", "a", "e", "5", 1))
    assert {p for p in os.listdir(f"{store.root}/changelog") if p.startswith("batch")} == {f"batch={i}" for i in range(1, 5)}


def test_covered_batches_are_kept_in_order_in_one_file(store):
    for i in range(1, 10):
        if i % 2:
            append(store, ("index_set", str(i), "e", str(i), 1))
        else:
            os.makedirs(f"{store.root}/changelog/batch={i}")
            open(f"{store.root}/batches/{i}", "w").close()
    assert store.compact_log()
    covered = store._latest.read()
    assert [tuple(r) for r in covered.select("first", "last").collect()] == [(i, i) for i in range(1, 10, 2)]
    assert len(covered.inputFiles()) == 1


def test_two_compactions_from_one_state(store, monkeypatch):
    append(store, ("index_set", "a", "e", "1", 1))
    write = store._latest.write

    def overtaken(df, base):
        monkeypatch.undo()
        assert store.compact_log()
        write(df, base)

    monkeypatch.setattr(store._latest, "write", overtaken)
    with pytest.raises(SnapshotConflict):
        store.compact_log()
    assert latest(store.recent_log()) == {("index_set", "a", "e"): "1"}


def test_ranges():
    assert ranges(set()) == [] and ranges({1, 2, 3, 7, 9, 10}) == [(1, 3), (7, 7), (9, 10)]


def test_runs_plan_from_the_compacted_log(spark, store, monkeypatch):
    monkeypatch.setattr("tableset.plans.migrate.COMPACT_AFTER", 1)
    desired = desired_of(spark, sets=[("x", TEXT, meta())])
    assert migrate(store, desired, "1").count() > 0 and store._latest.current()[0] == 1
    assert migrate(store, desired, "2").count() == 0


def test_sweep(spark, store):
    """After a broken run, a document write and a compaction only what is named remains."""
    put(store, "env-x", "v", [(f"d{i}", str(i), "s") for i in range(9)])
    put_documents(store, store.versions(), spark.createDataFrame([("v", "d3", "77")], "version_name STRING, _id STRING, n STRING"))
    store.write_folders(documents(spark, [("a", "1", "x")]).withColumn("folder", F.lit("broken")), TEXT)
    for i in range(2):
        append(store, ("index_set", "a", "e", str(i), i))
        store.compact_log()
    assert store.sweep(older_than=3600) == []
    live = {r.folder for r in store.pointers(store.versions()).collect()}
    assert len(live) == 1  # a version of one bucket, which the write moved
    time.sleep(0.1)
    gone = store.sweep(older_than=0)
    assert any("folder=broken" in p for p in gone)
    left = {f.removeprefix("folder=") for layout in os.listdir(f"{store.root}/data") for f in os.listdir(f"{store.root}/data/{layout}") if f.startswith("folder=")}
    assert left == live and len(os.listdir(f"{store.root}/latest_rows")) == 1
    assert len(content(store, "env-x", "_id")) == 9 and latest(store.recent_log()) == {("index_set", "a", "e"): "1"}
    assert {n for n in os.listdir(store._catalog.path) if n.startswith("snapshot")} == {f"snapshot={store._catalog.current()[0]}"}
    migrate(store, desired_of(spark, sets=[("x", LONG, meta())]), "7")
    assert len(content(store, "env-x", "_id")) == 9


def test_logged_texts_are_not_parsed_again(store, plan_of):
    """Digests are stored with the log; a batch without them gets them when it is compacted."""
    append(store, ("index_set", "a", "e", '{"b": 1, "a": 2}', 1), ("index_set", "b", "e", "", 2), ("index_set", "c", "e", "{", 3))
    row = store.spark.createDataFrame([("index_set", "d", "f", "e", '{"a":2.0,"b":1}', "{}", 1)], ROW).withColumn("timestamp", F.current_timestamp())
    row.write.partitionBy("resource_type", "env_name").parquet(f"{store.root}/changelog/batch=2")
    before = {r.resource_identifier: r.content_digest for r in store.recent_log().collect()}
    assert before["a"] == before["d"] and before["b"] == "" and before["c"] == "error"
    store.compact_log()
    log = store.recent_log()
    assert {r.resource_identifier: r.content_digest for r in log.collect()} == before
    desired = store.spark.createDataFrame([("a", '{"a":2,"b":1.0}', "{}"), ("b", "", "{}"), ("c", "{}", "{}"), ("d", "{}", "{}"), ("x", "{}", "{}")], "key STRING, content STRING, meta STRING")
    status = change_status(desired, latest_entries(log.withColumnRenamed("resource_identifier", "key"), keys=["key"]), keys=["key"])
    assert {r.key: r.status for r in status.collect()} == {"a": "same", "b": "same", "c": "error", "d": "changed", "x": "new"}
    plan = plan_of(status)
    scan = next(line for line in plan.split("\n") if "FileScan parquet" in line)
    assert "content_digest" in scan and not [c for c in ("content", "meta") if f",{c}:string" in scan.partition("ReadSchema")[2]]
    assert "parse_json" not in plan_of(log) and "variant" not in plan_of(log)
