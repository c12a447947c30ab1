import pytest
from pyspark.sql import functions as F

from tableset.functions.json import canonical_json, json_path, json_status, single_value, task_status, valid_object

STATUSES = [
    ('{"a":1,"b":2}', '{ "b": 2, "a": 1 }', "same"),
    ('{"a":1}', '{"a":1.0}', "same"),
    ('{"a":1}', '{"a":1e0}', "same"),
    ('{"a":100}', '{"a":1e2}', "same"),
    ('{"a":1.5}', '{"a":1.50}', "same"),
    ('{"a":1.5}', '{"a":15e-1}', "same"),
    ('{"a":[1,2]}', '{"a":[2,1]}', "changed"),
    ('{"a":{"x":1,"y":[{"p":1,"q":2}]}}', '{"a":{"y":[{"q":2,"p":1}],"x":1}}', "same"),
    ('{"a":"1"}', '{"a":1}', "changed"),
    ('{"a":null}', "{}", "changed"),
    ('{"a":"x"}', '{"a":"\\u0078"}', "same"),
    ('{"a":"1.0,"}', '{"a":"1,"}', "changed"),
    ('{"a":"q\\"1.0,"}', '{"a":"q\\"1,"}', "changed"),
    ("", "", "same"),
    ("", "{}", "changed"),
    ("{}", "", "changed"),
    (None, "", "same"),
    ("{", "{", "error"),
    ("{}", "{", "error"),
    ('{"a":1} x', '{"a":1}', "error"),
    ('{"a":1}] x', '{"a":1}', "error"),
    ('{"a":1}} x', '{"a":1}', "error"),
    ('{"a":1},null', '{"a":1}', "error"),
    ('{"a":1},"b":2', '{"a":1}', "error"),
    ('{"a":1,"a":2}', '{"a":2}', "error"),
    (" ", "{}", "error"),
    ("[1]", "[1]", "error"),
    ("1", "1", "error"),
]


def test_json_status(spark):
    df = spark.createDataFrame([(i, *pair[:2]) for i, pair in enumerate(STATUSES)], "i INT, r STRING, c STRING")
    got = {row.i: row.s for row in df.select("i", json_status("r", "c").alias("s")).collect()}
    assert {STATUSES[i][:2]: s for i, s in got.items()} == {s[:2]: s[2] for s in STATUSES}


def test_status_is_symmetric(spark):
    df = spark.createDataFrame([p[:2] for p in STATUSES], "r STRING, c STRING")
    both = df.select(json_status("r", "c").alias("a"), json_status("c", "r").alias("b"))
    assert both.filter("a <> b").count() == 0


def test_canonical_form_of_a_very_long_string(spark):
    text = F.concat(F.lit('{"b":1.0,"a":"'), F.repeat(F.lit('x\\n\\"1.0,'), 300_000), F.lit('"}'))
    form = spark.range(1).select(canonical_json(text).alias("t")).select(F.length("t"), F.right("t", F.lit(8))).first()
    assert form[0] == 300_000 * 9 + len('{"a":"","b":1}')
    assert form[1].endswith('"b":1}')


@pytest.mark.parametrize(
    "text, value, failed",
    [
        ("", "", False),
        ('{"p":{"b":1,"a":[]}}', '{"a":[],"b":1}', False),
        ('{"p":1}', "1", False),
        ("[1]", "", False),
        ("{}", "", True),
        ('{"a":1,"b":2}', "", True),
        ('{"a":', "", True),
    ],
)
def test_single_value(spark, text, value, failed):
    df = spark.createDataFrame([(text,)], "t STRING")
    got, bad = single_value("t")
    assert tuple(df.select(got, bad).first()) == (value, failed)


def test_task_status_with_absent_parts(spark):
    bodies = [
        '{"completed":true,"task":{"status":{"created":3,"updated":2,"deleted":1,"total":9}},'
        '"response":{"failures":[{"id":"a","cause":{"type":"t","reason":"r"}},{"id":"b"}]}}',
        '{"task":{"status":{"total":4}}}',
        "{}",
    ]
    rows = spark.createDataFrame([(b,) for b in bodies], "b STRING").select(task_status("b").alias("t")).collect()
    assert [tuple(r.t) for r in rows] == [
        (True, 6, 9, "a", "t", "r"),
        (False, 0, 4, None, None, None),
        (False, 0, 0, None, None, None),
    ]


def test_paths_and_objects(spark):
    df = spark.createDataFrame([('{"a":[{"b":7}]}',), ("[]",), ("{} {}",)], "t STRING")
    got = df.select(json_path("t", "$.a[0].b", "long"), valid_object("t")).collect()
    assert [tuple(r) for r in got] == [(7, True), (None, False), (None, False)]


@pytest.mark.parametrize("a,b,status", [
    ('{"a":1e7}', '{"a":10000000}', "same"),
    ('{"a":2.5e8}', '{"a":250000000.0}', "same"),
    ('{"a":5e-4}', '{"a":0.0005}', "same"),
    ('{"a":[{"b":-1.5E+3}]}', '{"a":[{"b":-1500}]}', "same"),
    ('{"a":1e30}', '{"a":1000000000000000000000000000000}', "same"),
    ('{"a":1e-30}', '{"a":10e-31}', "same"),
    ('{"a":1e30}', '{"a":1000000000000000000000000000001}', "changed"),
    ('{"a":0e5}', '{"a":0}', "same"),
    ('{"a":"1e7"}', '{"a":"10000000"}', "changed"),
    ('{"a":1e7}', '{"a":10000001}', "changed"),
    ('{"a":01e7}', '{"a":10000000}', "error"),
    ('{"a":1e7.5}', '{"a":10000000.5}', "error"),
])
def test_spellings_of_numbers(spark, a, b, status):
    assert spark.range(1).select(json_status(F.lit(a), F.lit(b))).first()[0] == status
