import random

import pytest
from pyspark.sql import functions as F

from tableset.operators.aliases import alias_members, same_members, scan_alias, swap, unreferenced
from tableset.operators.latest import latest_entries
from tableset.operators.lookup import get_by_ids, require_keys, search
from tableset.operators.overlay import overlay
from tableset.operators.report import outcome_report
from tableset.operators.spread import fits_broadcast, lookup
from tableset.operators.upsert import cas_upsert, check_bodies, upsert, with_ids, write_outcomes

KEYS = "resource_type STRING, resource_identifier STRING, env_name STRING, timestamp STRING, entry_seq INT"


def test_latest_entry_and_ties(spark):
    log = spark.createDataFrame(
        [("t", "a", "e", "1", 1), ("t", "a", "e", "1", 2), ("t", "a", "e", "0", 3), ("t", "b", "e", "1", 4), ("t", "a", "f", "9", 5)],
        KEYS,
    )
    assert sorted(r.entry_seq for r in latest_entries(log).collect()) == [2, 4, 5]


def test_overlay(spark):
    rows = [("a", "prod", "1"), ("a", "default", "2"), ("b", "default", "3"), ("b", "default", "4"), ("c", "dev", "5"), ("d", "prod", "6"), ("d", "prod", "7")]
    df = spark.createDataFrame(rows, "id STRING, env STRING, path STRING")
    got = overlay(df, ["id"], "env", "prod", order=[F.col("path")])
    assert sorted((r.id, r.path) for r in got.collect()) == [("a", "1"), ("b", "4"), ("d", "7")]


def test_overlay_of_the_default_environment(spark):
    df = spark.createDataFrame([("a", "default", "1"), ("a", "prod", "2")], "id STRING, env STRING, path STRING")
    assert [r.path for r in overlay(df, ["id"], "env", "default").collect()] == ["1"]


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_lookup_agrees_with_a_plain_join(spark, broadcast, how):
    left = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k5", 3)], "k STRING, v INT")
    want = left.join(right, "k", how)
    got = lookup(left, right, ["k"], "id", how=how, broadcast=broadcast)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_broadcast_is_measured(spark, monkeypatch):
    from tableset.operators import spread

    df = spark.range(100).select(F.repeat(F.lit("x"), 100).alias("t"))
    assert fits_broadcast(df)
    monkeypatch.setattr(spread, "MAX_BROADCAST_BYTES", 9_000)
    assert not fits_broadcast(df)
    monkeypatch.setattr(spread, "MAX_BROADCAST_BYTES", 1 << 20)
    monkeypatch.setattr(spread, "MAX_BROADCAST_ROWS", 99)
    assert not fits_broadcast(df)


def test_upsert_last_update_wins(spark):
    base = spark.createDataFrame([("a", "0"), ("b", "0")], "_id STRING, v STRING")
    updates = spark.createDataFrame([("b", "1", 1), ("b", "2", 2), ("c", "3", 3)], "_id STRING, v STRING, n INT")
    got = upsert(base, updates, order=[F.col("n")])
    assert sorted(map(tuple, got.collect())) == [("a", "0"), ("b", "2"), ("c", "3")]


def test_blank_ids_are_generated(spark):
    got = with_ids(spark.createDataFrame([("",), (None,), ("x",)], "_id STRING")).collect()
    values = [r._id for r in got]
    assert len(set(values)) == 3 and all(values) and values[2] == "x"


def test_outcomes_of_writes(spark):
    base = spark.createDataFrame([("a",)], "_id STRING")
    updates = spark.createDataFrame([("a", "{}"), ("b", "{}"), ("c", "[]"), ("d", "{")], "_id STRING, _source STRING")
    outcomes = write_outcomes(base, check_bodies(updates))
    assert {r._id: r.outcome for r in outcomes.collect()} == {"a": "updated", "b": "created", "c": "rejected", "d": "rejected"}
    marked = outcomes.withColumn("_failure", F.lit(None).cast("struct<cause_type:string,cause_reason:string>"))
    assert tuple(outcome_report(marked).first())[:6] == (4, 1, 1, 2, 0, 2)


def sequential(base, updates):
    """Conditional writes one by one; an accepted write makes the number unknown to the batch."""
    state, written, conflicts = dict(base), set(), []
    for _id, expected, seq in sorted(updates, key=lambda u: u[2]):
        current = None if _id in written else base.get(_id)
        absent = _id not in base and _id not in written
        if _id not in written and (absent and expected is None or expected is not None and expected == current):
            written.add(_id)
            state[_id] = (-1 if expected is None else expected) + 1
        else:
            conflicts.append(seq)
    return state, sorted(conflicts)


@pytest.mark.parametrize("seed", range(4))
def test_conditional_upsert_against_one_by_one(spark, seed):
    rng = random.Random(seed)
    base = {f"d{i}": rng.randrange(4) for i in range(20)}
    # Half of the updates aim at one document.
    updates = [
        ("d0" if rng.random() < 0.5 else f"d{rng.randrange(30)}", rng.choice([None, 0, 1, 2, 3]), n) for n in range(200)
    ]
    base_df = spark.createDataFrame(list(base.items()), "_id STRING, _seq_no LONG")
    updates_df = spark.createDataFrame(updates, "_id STRING, expected_seq LONG, entry_seq LONG")
    state, conflicts = cas_upsert(base_df, updates_df)
    expected_state, expected_conflicts = sequential(base, updates)
    assert {r._id: r._seq_no for r in state.collect()} == expected_state
    assert sorted(r.entry_seq for r in conflicts.collect()) == expected_conflicts


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "alias STRING, version_name STRING")


def test_aliases(spark):
    now = pairs(spark, ("a", "v1"), ("a", "v2"), ("b", "v1"), ("a", "v1"))
    after = swap(now, pairs(spark, ("a", "v1"), ("a", "v2")), pairs(spark, ("a", "v3"), ("b", "v1")))
    assert sorted(map(tuple, after.collect())) == [("a", "v3"), ("b", "v1")]
    assert {r.alias: r.members for r in alias_members(now).collect()} == {"a": ["v1", "v2"], "b": ["v1"]}
    same = same_members(pairs(spark, ("a", "v2"), ("a", "v1"), ("b", "v2"), ("c", "v")), now)
    assert {r.alias: r.same for r in same.collect()} == {"a": True, "b": False, "c": False}
    versions = spark.createDataFrame([("v1",), ("v2",), ("v9",)], "version_name STRING")
    assert [r.version_name for r in unreferenced(versions, now).collect()] == ["v9"]
    rows = spark.createDataFrame([(1, "v1"), (2, "v2"), (3, "v3")], "n INT, version_name STRING")
    assert sorted(r.n for r in scan_alias(rows, now, "a").collect()) == [1, 2]
    assert scan_alias(rows, now, "unknown").count() == 0


def test_lookups(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "_id STRING, v INT")
    ids = spark.createDataFrame([("a",), ("z",), ("a",)], "_id STRING")
    assert sorted((r._id, r.v, r._present) for r in get_by_ids(ids, table).collect()) == [("a", 1, True), ("z", None, False)]
    found, missing = require_keys(ids, table, ["_id"])
    assert [r.v for r in found.collect()] == [1] and [r._id for r in missing.collect()] == ["z"]
    assert [r._id for r in search(table, F.col("v") > 0, [F.col("v").desc()], 1).collect()] == ["b"]
