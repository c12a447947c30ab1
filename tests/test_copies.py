import random

import pytest
from pyspark.sql import functions as F

import tableset.operators.cap as cap_module
from tableset.operators.cap import cap, cap_by_key, nth_ids
from tableset.operators.transforms import apply_steps, parse_steps
from tableset.plans.reindex import copy_rows, newest_per_id, reindex
from tableset.schemas import declared_schema

SCHEMA = declared_schema('{"mappings": {"properties": {"n": {"type": "long"}, "s": {"type": "text"}, "at": {"type": "date"}}}}')


def ids(df):
    return sorted(r._id for r in df.collect())


@pytest.mark.parametrize("top_n_limit", [0, 10_000])
@pytest.mark.parametrize("n", [-1, 0, 1, 7, 250, 999, 1000, 1001, 5000])
def test_cap(spark, n, top_n_limit):
    df = spark.range(1000).select(F.format_string("%05d", F.col("id")).alias("_id"), "id").repartition(7)
    expected = [f"{i:05d}" for i in range(1000)][: None if n == -1 else n]
    assert ids(cap(df, n, top_n_limit=top_n_limit)) == expected


def test_cap_rejects_nonsense(spark):
    with pytest.raises(ValueError):
        cap(spark.range(1).withColumnRenamed("id", "_id"), -2)


@pytest.mark.parametrize("broadcast", [True, False])
def test_cap_by_key_with_a_hot_key(spark, broadcast):
    # Key 0 holds most rows.
    key = F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 10)
    df = spark.range(3000).select(key.alias("k"), F.format_string("%05d", F.col("id")).alias("_id"), "id")
    limits = {0: 1234, 7: 0, 8: -1, 9: 100_000}
    got = cap_by_key(df, spark.createDataFrame(list(limits.items()), "k INT, n INT"), "k", "n", broadcast=broadcast)
    assert got.columns == ["k", "_id", "id"]
    rows = df.collect()
    expected = []
    for k, n in limits.items():
        mine = sorted(r._id for r in rows if r.k == k)
        expected += mine if n == -1 else mine[:n]
    assert ids(got) == sorted(expected)


def test_cap_by_key_keeps_other_keys(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), (None, "4")], "k STRING, _id STRING")
    limits = spark.createDataFrame([("a", 1)], "k STRING, n INT")
    assert ids(cap_by_key(df, limits, "k", "n")) == ["1", "3", "4"]


def docs(spark, rows):
    return spark.createDataFrame(rows, "_id STRING, n STRING, s STRING, at STRING")


def test_rejected_values_are_reported(spark):
    src = docs(spark, [("c", "x", "s", None), ("a", "1", "s", "2024-01-01 00:00:00"), ("b", "2", None, "never"), ("d", None, "t", None)])
    good, rejected, report = reindex(src, SCHEMA)
    assert sorted((r._id, r.n, r.s) for r in good.collect()) == [("a", 1, "s"), ("d", None, "t")]
    assert sorted((r._id, r._failure.cause_type) for r in rejected.collect()) == [
        ("b", "mapper_parsing_exception"), ("c", "mapper_parsing_exception"),
    ]
    row = report.first()
    assert (row.total, row.created, row.updated, row.rejected, row.dropped, row.done) == (4, 2, 0, 2, 0, 2)
    assert tuple(row.first_failure) == (
        "b", "mapper_parsing_exception", "failed to parse field [at] of type [timestamp]: never",
    )


def test_report_without_failures_and_without_rows(spark):
    _, _, report = reindex(docs(spark, [("a", "1", "s", None)]), SCHEMA)
    assert report.first().first_failure is None
    _, _, report = reindex(docs(spark, []), SCHEMA)
    assert tuple(report.first())[:6] == (0, 0, 0, 0, 0, 0)


def test_blank_pipeline_is_the_identity():
    assert parse_steps("") == [] and parse_steps(" ") == [] and parse_steps("{}") == []


def test_cap_applies_before_the_transform(spark):
    src = docs(spark, [(str(i), str(i), "s", None) for i in range(6)])
    good, _, report = reindex(src, SCHEMA, [{"drop": {"if": "n = '0'"}}], max_docs=3)
    assert ids(good) == ["1", "2"]
    assert (report.first().total, report.first().dropped) == (3, 1)


def test_same_id_in_two_members(spark):
    rows = [("a", "1", "old", None, "v1"), ("a", "2", "new", None, "v2"), ("b", "3", "old", None, "v1")]
    src = spark.createDataFrame(rows, "_id STRING, n STRING, s STRING, at STRING, version_name STRING")
    good, _, _ = reindex(src, SCHEMA, several_members=True)
    assert sorted((r._id, r.s) for r in good.collect()) == [("a", "new"), ("b", "old")]
    assert newest_per_id(src).count() == 2


def transformed(spark, steps, **values):
    columns = ", ".join(f"{k} STRING" for k in values)
    df = spark.createDataFrame([tuple(values.values())], columns)
    return apply_steps(df, steps).first().asDict(recursive=True)


@pytest.mark.parametrize(
    "step, before, field, after",
    [
        ({"set": {"field": "b", "value": 1}}, {"a": "x"}, "b", 1),
        ({"set": {"field": "a", "value": "y", "override": False}}, {"a": "x"}, "a", "x"),
        ({"set": {"field": "a", "value": "y", "override": False}}, {"a": None}, "a", "y"),
        ({"set": {"field": "b", "copy_from": "a"}}, {"a": "x"}, "b", "x"),
        ({"rename": {"field": "a", "target_field": "b"}}, {"a": "x"}, "b", "x"),
        ({"convert": {"field": "a", "type": "integer"}}, {"a": "12"}, "a", 12),
        ({"convert": {"field": "a", "type": "boolean", "target_field": "b"}}, {"a": "true"}, "b", True),
        ({"lowercase": {"field": "a"}}, {"a": "XY"}, "a", "xy"),
        ({"uppercase": {"field": "a", "target_field": "b"}}, {"a": "xy"}, "b", "XY"),
        ({"trim": {"field": "a"}}, {"a": " x "}, "a", "x"),
        ({"gsub": {"field": "a", "pattern": "[0-9]+", "replacement": "#"}}, {"a": "a1b22"}, "a", "a#b#"),
        ({"split": {"field": "a", "separator": ","}}, {"a": "x,y"}, "a", ["x", "y"]),
    ],
)
def test_steps(spark, step, before, field, after):
    row = transformed(spark, [step], **before)
    assert row[field] == after and row["_mark"] is None


def test_steps_that_take_fields_away(spark):
    assert "a" not in transformed(spark, [{"remove": {"field": ["a", "b"]}}], a="x", b="y", c="z")
    assert "a" not in transformed(spark, [{"rename": {"field": "a", "target_field": "b"}}], a="x")


def test_date_step(spark):
    step = {"date": {"field": "a", "formats": ["yyyy/MM/dd", "yyyy-MM-dd"]}}
    assert str(transformed(spark, [step], a="2024-02-03")["@timestamp"]) == "2024-02-03 00:00:00"
    assert transformed(spark, [step], a="soon")["_mark"]["cause_reason"] == "unable to parse date [soon]"


def test_missing_fields(spark):
    step = {"lowercase": {"field": "zz"}}
    assert transformed(spark, [step], a="x")["_mark"]["cause_reason"] == "field [zz] not present"
    assert transformed(spark, [{"lowercase": {"field": "zz", "ignore_missing": True}}], a="x")["_mark"] is None


def test_first_event_counts(spark):
    bad, drop = {"convert": {"field": "a", "type": "long"}}, {"drop": {"if": "true"}}
    assert transformed(spark, [bad, drop], a="x")["_mark"]["cause_type"] == "illegal_argument_exception"
    assert transformed(spark, [drop, bad], a="x")["_mark"]["cause_type"] == "dropped"


def test_unknown_step(spark):
    with pytest.raises(ValueError, match="unknown transform step"):
        transformed(spark, [{"grok": {"field": "a"}}], a="x")


def test_declared_schema():
    definition = '{"mappings": {"properties": {"a": {"type": "keyword"}, "b": {"type": "boolean"}, "c": {"type": "geo_point"}, "d": {}}}}'
    assert declared_schema(definition).simpleString() == "struct<a:string,b:boolean,c:string,d:string>"
    assert declared_schema("").simpleString() == declared_schema("{}").simpleString() == "struct<>"


def test_no_document_ends_a_copy(spark):
    """An array where a number is declared, and a condition that can't be compared, reject their documents only."""
    df = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", None), ("d", "9")], "_id STRING, v STRING")
    rows = {r._id: (r.v, r._failure and r._failure.cause_type, r.outcome) for r in reindex_rows(df, [{"drop": {"if": "v > 5"}}])}
    assert rows == {
        "a": (1, None, "created"), "b": (None, "illegal_argument_exception", "rejected"),
        "c": (None, None, "created"), "d": (9, "dropped", "dropped"),
    }
    rows = {r._id: r._failure.cause_type if r._failure else None for r in reindex_rows(df, [{"split": {"field": "v", "separator": ",", "ignore_missing": True}}])}
    assert rows == {"a": "mapper_parsing_exception", "b": "mapper_parsing_exception", "c": None, "d": "mapper_parsing_exception"}


def reindex_rows(df, steps):
    return copy_rows(df, declared_schema('{"mappings": {"properties": {"v": {"type": "long"}}}}'), steps).collect()


def nth(rows, limits):
    out = {}
    for key, n in limits.items():
        mine = sorted(i for k, i in rows if k == key)
        if 0 < n <= len(mine):
            out[key] = mine[n - 1]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_nth_ids_of_large_sets_are_narrowed(spark, seed):
    """One set holds most rows, one has few different ids, some have no n-th id."""
    rng = random.Random(seed)
    rows = [("hot", f"{rng.random():.9f}") for _ in range(4000)] + [("same", rng.choice("abc")) for _ in range(900)]
    rows += [("small", str(i)) for i in range(30)] + [("other", str(i)) for i in range(300)]
    limits = {"hot": rng.randint(1, 4000), "same": rng.randint(1, 900), "small": 7, "nothing": 3}
    ids = spark.createDataFrame(rows, "_set STRING, _id STRING")
    frame = spark.createDataFrame(list(limits.items()), "_set STRING, _limit LONG")
    got = nth_ids(ids, frame, sorted_rows=100, sample_rows=400)
    assert {r["_set"]: r["_last_id"] for r in got.collect()} == nth(rows, limits)
    edges = spark.createDataFrame([("hot", 4000), ("same", 1), ("small", 31)], "_set STRING, _limit LONG")
    got = nth_ids(ids, edges, sorted_rows=100, sample_rows=400)
    assert {r["_set"]: r["_last_id"] for r in got.collect()} == nth(rows, {"hot": 4000, "same": 1})


def test_few_ids_of_a_large_set_are_sorted(spark, monkeypatch):
    """Of 200,000 ids less than one in a hundred is left to sort."""
    sorted_ids = []
    final = cap_module._nth_of_sorted
    monkeypatch.setattr(cap_module, "_nth_of_sorted", lambda ids, limits: sorted_ids.append(ids.count()) or final(ids, limits))
    df = spark.range(200_000).select(F.format_string("%09d", "id").alias("_id"))
    got = nth_ids(df.select(F.lit(0).alias("_set"), "_id"), spark.createDataFrame([(0, 123_456)], "_set INT, _limit LONG"), 2000, 5000)
    assert [r["_last_id"] for r in got.collect()] == ["000123455"]
    assert sorted_ids[0] < 2000
