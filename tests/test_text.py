import pytest
from pyspark.sql import functions as F

from tableset.functions.names import split_document_id, split_meta_name, split_resource_name, pipeline_id, version_stamp
from tableset.functions.rules import valid_env, valid_resource_type
from tableset.functions.text import strip_comments
from tableset.operators.includes import expand_includes
from tableset.operators.lookup import split_valid, validate

INCLUDES = [("a", '"a": 1'), ("b", "B/* in\nb */"), ("nested", '{{{ include "a" }}}'), ("empty", "")]

TEMPLATES = {
    "two": ('{{{ include "a" }}},{{{include "b"}}}', '"a": 1,B', None),
    "none": ("x /* c */ y", "x  y", None),
    "missing": ('{{{ include "zz" }}}', None, "missing include: zz"),
    "missing twice": ('{{{ include "zz" }}}{{{ include "zz" }}}', None, "missing include: zz"),
    "nested": ('<{{{ include "nested" }}}>', '<{{{ include "a" }}}>', None),
    "empty": ('<{{{ include "empty" }}}>', "<>", None),
    "other": ("{{{ if x }}}", None, "unsupported action"),
    "single quotes": ("{{{ include 'a' }}}", None, "unsupported action"),
    "double braces": ('{"a":{"b":"{{c}}"}}', '{"a":{"b":"{{c}}"}}', None),
    "closing braces": ('{"a":{"b":{"c":1}}}', '{"a":{"b":{"c":1}}}', None),
    "across": ("a/* 1\n2 */b/**/c", "abc", None),
    "in string": ('{"a":"/* x */"}', '{"a":""}', None),
    "comment spans include": ('/* {{{ include "a" }}} */x', "x", None),
    "blank": ("", "", None),
    "null": (None, "", None),
    "repeated": ('{{{ include "a" }}}' * 3, '"a": 1' * 3, None),
}


@pytest.mark.parametrize("broadcast", [True, False])
def test_expand_includes(spark, broadcast):
    df = spark.createDataFrame([(k, v[0]) for k, v in TEMPLATES.items()], "key STRING, content STRING")
    includes = spark.createDataFrame(INCLUDES, "name STRING, content STRING")
    got = expand_includes(df, includes, "key", broadcast=broadcast)
    assert got.columns == ["key", "content", "include_error"]
    assert {r.key: (r.content, r.include_error) for r in got.collect()} == {k: v[1:] for k, v in TEMPLATES.items()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_expand_without_includes(spark, broadcast):
    df = spark.createDataFrame([("k", "text"), ("m", '{{{ include "a" }}}')], "key STRING, content STRING")
    includes = spark.createDataFrame([], "name STRING, content STRING")
    got = {r.key: (r.content, r.include_error) for r in expand_includes(df, includes, "key", broadcast=broadcast).collect()}
    assert got == {"k": ("text", None), "m": (None, "missing include: a")}


@pytest.mark.parametrize("broadcast", [True, False])
def test_includes_with_doubtful_names(spark, broadcast):
    """Both paths agree on names given twice (used or not), without name, without or with empty content."""
    rows = [("a", "A"), ("b", "B"), ("b", "C"), (None, "N"), (None, "M"), ("e", ""), ("n", None)]
    texts = {n: f'x{{{{{{ include "{n}" }}}}}}' for n in "aben"}
    df = spark.createDataFrame(list(texts.items()), "key STRING, content STRING")
    got = expand_includes(df, spark.createDataFrame(rows, "name STRING, content STRING"), "key", broadcast=broadcast)
    assert {r.key: (r.content, r.include_error) for r in got.collect()} == {
        "a": ("xA", None),
        "b": (None, "include with several texts: b"),
        "e": ("x", None),
        "n": (None, "missing include: n"),
    }


def test_comment_needs_an_end(spark):
    row = spark.range(1).select(strip_comments(F.lit("a /* b")), strip_comments(F.lit("/* a */ b */"))).first()
    assert tuple(row) == ("a /* b", " b */")


@pytest.mark.parametrize(
    "name, expected",
    [
        ("x-env1.json", ("x", "env1", True)),
        ("a-b-default.JSON", ("a-b", "default", True)),
        ("-env.json", ("", "env", True)),
        ("x-.json", ("x", "", True)),
        ("x.json", (None, None, False)),
        ("x-env.txt", (None, None, False)),
        ("x-env.json.bak", (None, None, False)),
    ],
)
def test_resource_names(spark, name, expected):
    assert tuple(spark.range(1).select(split_resource_name(F.lit(name)).alias("p")).first().p) == expected


def test_meta_names(spark):
    row = spark.range(1).select(split_meta_name(F.lit("x-y-env.meta.json")).alias("p")).first()
    assert tuple(row.p) == ("x-y", "env", True)


@pytest.mark.parametrize(
    "identifier, expected",
    [
        ("set-name", ("set", "name", True)),
        ("a-b-name", ("a-b", "name", True)),
        ("name", (None, None, False)),
        ("-name", (None, None, False)),
        ("set-", (None, None, False)),
    ],
)
def test_document_ids(spark, identifier, expected):
    assert tuple(spark.range(1).select(split_document_id(F.lit(identifier)).alias("p")).first().p) == expected


def test_derived_names(spark):
    row = spark.range(1).select(
        pipeline_id(F.lit(""), F.lit("e")), pipeline_id(F.lit("p"), F.lit("e")),
        version_stamp(F.lit("2020-12-07 10:45:30").cast("timestamp")),
    ).first()
    assert tuple(row) == ("", "e-p", "20201207104530")


ENVS = [("", False), (" x", False), ("x ", False), ("-x", False), ("x\n", False), ("x", True), ("x-y.z", True), ("é_1", True), ("1", True)]
TYPES = [("index_set", True), ("document", True), ("other", False), (None, False)]


def test_validation(spark):
    envs = spark.createDataFrame(ENVS, "v STRING, ok BOOLEAN")
    assert envs.filter(valid_env(F.col("v")) != F.col("ok")).count() == 0
    types = spark.createDataFrame(TYPES, "v STRING, ok BOOLEAN")
    assert types.filter(valid_resource_type(F.col("v")) != F.col("ok")).count() == 0


def test_rejected_rows_list_all_broken_rules(spark):
    df = spark.createDataFrame([("x", "document"), ("-", "other"), ("y", None)], "env STRING, kind STRING")
    rules = {"env": valid_env(F.col("env")), "kind": valid_resource_type(F.col("kind"))}
    valid, rejected = split_valid(validate(df, rules))
    assert [tuple(r) for r in valid.collect()] == [("x", "document")]
    assert {r.env: r.failed_rules for r in rejected.collect()} == {"-": ["env", "kind"], "y": ["kind"]}
