"""Changelog, comparison, lookup and validation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableset.functions.json import json_status, single_value
from tableset.functions.rules import valid_env, valid_resource_type
from tableset.operators.changes import change_status, digest_status, with_digest
from tableset.operators.latest import entries_of, latest_entries
from tableset.operators.lookup import get_by_ids, live_definitions, require_keys, search, validate
from tableset.operators.overlay import overlay
from tableset.sources.store import log_rows
from workloads.registry import query, table


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events seen as a changelog."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("resource_type"),
        text("user_id").alias("resource_identifier"),
        F.lit("").alias("final_name"),
        F.lit("prod").alias("env_name"),
        F.col("props").alias("content"),
        F.lit('{"Ignored":false}').alias("meta"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("entry_seq"),
    )


@query("""
SELECT event_type AS resource_type, CAST(user_id AS VARCHAR) AS resource_identifier,
       event_id AS entry_seq, props AS content
FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_entries_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_entries(event_log(spark, sf_dir)).select(
        "resource_type", "resource_identifier", "entry_seq", "content"
    )


@query("""
SELECT CAST(user_id AS VARCHAR) AS resource_identifier, event_id AS entry_seq, props AS content
FROM events WHERE event_type = 'click'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_entries_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = entries_of(event_log(spark, sf_dir), resource_type="click", env="prod")
    return latest_entries(log).select("resource_identifier", "entry_seq", "content")


def _k() -> Column:
    """The number in ``{"k": n}``, as text."""
    return F.regexp_extract("content", r"(\d+)", 1)


@query("""
WITH d AS (
  SELECT event_type, user_id, event_id, regexp_extract(props, '(\\d+)', 1) AS k FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1),
l AS (
  SELECT event_type, user_id, regexp_extract(props, '(\\d+)', 1) AS k FROM events
  WHERE ts < TIMESTAMP '2024-01-05 00:00:00'
  QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT d.event_type AS resource_type, CAST(d.user_id AS VARCHAR) AS resource_identifier,
  CASE WHEN l.k IS NULL THEN 'new' WHEN d.event_id % 50 = 0 THEN 'error' WHEN d.k <> l.k THEN 'changed'
       WHEN d.event_id % 10 = 1 THEN 'changed' ELSE 'same' END AS status
FROM d LEFT JOIN l ON d.event_type = l.event_type AND d.user_id = l.user_id
""")
def change_status_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest of all events as desired state against the latest of the first days.

    The two sides write the same values differently (key order, spaces, 1.0 for 1).
    """
    log = event_log(spark, sf_dir)
    desired = (
        latest_entries(log)
        .withColumn("content", F.concat(F.lit('{"z":[1,2],"k":'), _k(), F.lit(".0}")))
        .withColumn("content", F.when(F.col("entry_seq") % 50 == 0, F.concat("content", F.lit(" x"))).otherwise(F.col("content")))
        .withColumn("meta", F.when(F.col("entry_seq") % 10 == 1, '{"Ignored": true}').otherwise('{"Ignored": false}'))
    )
    earlier = log.filter(F.col("timestamp") < F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))
    logged = latest_entries(earlier).withColumn("content", F.concat(F.lit('{"k": '), _k(), F.lit(', "z": [1, 2]}')))
    return change_status(desired, logged).select("resource_type", "resource_identifier", "status")


@query("""
SELECT event_id,
  CASE event_id % 12
    WHEN 0 THEN 'same' WHEN 1 THEN 'same' WHEN 2 THEN 'changed' WHEN 3 THEN 'changed'
    WHEN 4 THEN 'same' WHEN 5 THEN 'changed' WHEN 6 THEN 'error' WHEN 7 THEN 'error'
    WHEN 8 THEN 'error' WHEN 9 THEN 'same' WHEN 10 THEN 'error' ELSE 'changed' END AS status
FROM events
""")
def json_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the structural comparison, over rewritten event properties."""
    k = F.regexp_extract("props", r"(\d+)", 1)
    case = F.col("event_id") % 12

    def form(pattern: str) -> Column:
        before, mark, after = pattern.partition("#")
        return F.concat(F.lit(before), k, F.lit(after)) if mark else F.lit(pattern)

    pairs = {
        0: ('{"a":[1,2],"k":#}', '{ "k" : # , "a" : [ 1, 2 ] }'),  # key order and spaces
        1: ('{"k":#,"n":1}', '{"n":1e0,"k":#.0}'),  # forms of one number
        2: ('{"k":#,"a":[1,2]}', '{"k":#,"a":[2,1]}'),  # array order counts
        3: ('{"k":#}', '{"k":1#}'),  # another value
        4: ("", ""),  # empty against empty
        5: ('{"k":#}', ""),  # empty against something
        6: ('{"k":#', '{"k":#}'),  # malformed
        7: ('{"k":#,"k":1}', '{"k":#}'),  # a key twice
        8: ('{"k":#} x', '{"k":#} x'),  # trailing text, byte-equal
        9: ('{"s":"é 1.0,","k":#}', '{"k":#,"s":"\\u00e9 1.0,"}'),  # escapes; numbers in strings
        10: ("[#]", "[#]"),  # not an object
    }
    other = ('{"k":#,"s":"1.0,"}', '{"k":#,"s":"1,"}')
    left, right = form(other[0]), form(other[1])
    for number, (required, current) in pairs.items():
        left = F.when(case == number, form(required)).otherwise(left)
        right = F.when(case == number, form(current)).otherwise(right)
    df = table(spark, sf_dir, "events").select("event_id", left.alias("required"), right.alias("current"))
    both = with_digest(with_digest(df, "required", "r"), "current", "c")
    return both.select("event_id", digest_status("r", "c").alias("status"))


@query("""
SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
""")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    where = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000)
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return search(orders, where, order, 100).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("""
SELECT i._id, p.p_partkey IS NOT NULL AS present, p.p_name AS name, p.p_size AS size
FROM (SELECT DISTINCT l_partkey * 2 AS _id FROM lineitem) i LEFT JOIN part p ON p.p_partkey = i._id
""")
def get_by_ids_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part number of a line item, doubled: about half of them are unknown."""
    wanted = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("_id"))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("_id"), F.col("p_name").alias("name"), F.col("p_size").alias("size")
    )
    return get_by_ids(wanted, parts).withColumnRenamed("_present", "present")


@query("""
SELECT o_custkey AS identifier, o_orderpriority AS env, o_orderkey FROM orders
WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '1-URGENT' DESC, o_orderkey DESC) = 1
""")
def overlay_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    resources = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("identifier"), F.col("o_orderpriority").alias("env"), "o_orderkey"
    )
    return overlay(resources, ["identifier"], "env", "1-URGENT", default="5-LOW", order=[F.col("o_orderkey")])


@query("""
SELECT k AS _id, c_custkey IS NOT NULL AS found
FROM (SELECT DISTINCT o_custkey * 2 AS k FROM orders) LEFT JOIN customer ON c_custkey = k
""")
def require_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup by key that also lists the keys without a row."""
    wanted = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("_id"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_id"))
    found, missing = require_keys(wanted, known, ["_id"])
    return found.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


@query("""
WITH n AS (
  SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_brand WHEN 1 THEN '-' || p_type WHEN 2 THEN p_type
      WHEN 3 THEN p_type || '-' || p_size || '.x_y' WHEN 4 THEN '' ELSE p_type || ' ' END AS env,
    CASE WHEN p_size % 3 = 0 THEN 'index_set' WHEN p_size % 3 = 1 THEN 'document' ELSE 'other' END AS rt
  FROM part),
r AS (SELECT *, p_partkey % 6 IN (2, 3) AS env_ok, rt <> 'other' AS rt_ok FROM n)
SELECT p_partkey, env, rt AS resource_type, env_ok AND rt_ok AS valid,
  concat_ws(',', CASE WHEN NOT env_ok THEN 'env' END, CASE WHEN NOT rt_ok THEN 'resource_type' END) AS failed
FROM r
""")
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    case, size = F.col("p_partkey") % 6, F.col("p_size") % 3
    env = (
        F.when(case == 0, F.col("p_brand"))
        .when(case == 1, F.concat(F.lit("-"), "p_type"))
        .when(case == 2, F.col("p_type"))
        .when(case == 3, F.concat("p_type", F.lit("-"), text("p_size"), F.lit(".x_y")))
        .when(case == 4, F.lit(""))
        .otherwise(F.concat("p_type", F.lit(" ")))
    )
    kind = F.when(size == 0, "index_set").when(size == 1, "document").otherwise("other")
    rows = table(spark, sf_dir, "part").select("p_partkey", env.alias("env"), kind.alias("resource_type"))
    rules = {"env": valid_env(F.col("env")), "resource_type": valid_resource_type(F.col("resource_type"))}
    return validate(rows, rules).select(
        "p_partkey", "env", "resource_type", (F.size("failed_rules") == 0).alias("valid"),
        F.array_join("failed_rules", ",").alias("failed"),
    )


@query("""
SELECT event_type AS resource_type, CAST(user_id AS VARCHAR) AS resource_identifier, '' AS final_name,
  'prod' AS env_name, props AS content, '{"Ignored":false}' AS meta, event_id AS entry_seq, TRUE AS stamped
FROM events
""")
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows as they are appended. The time is the time of the run, so only its presence is compared."""
    rows = log_rows(event_log(spark, sf_dir).drop("timestamp"))
    return rows.withColumn("stamped", F.col("timestamp").isNotNull()).drop("timestamp")


@query("""
SELECT k AS _id,
  CASE WHEN p_partkey IS NULL THEN '' WHEN k % 5 = 1 THEN '' WHEN k % 5 = 2 THEN ''
       WHEN k % 5 = 3 THEN '{"processors":[],"size":' || p_size || '}' ELSE '' || p_size END AS definition,
  p_partkey IS NOT NULL AND k % 5 IN (1, 2) AS failed
FROM (SELECT DISTINCT l_partkey * 2 AS k FROM lineitem) LEFT JOIN part ON p_partkey = k
""")
def registry_def(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored definitions by name: absent ones are empty, answers are unwrapped from a one-key object."""
    size, case = text("p_size"), F.col("p_partkey") % 5
    body = (
        F.when(case == 1, F.concat(F.lit('{"a":1,"b":'), size, F.lit("}")))  # two keys
        .when(case == 2, F.concat(F.lit('{"a":'), size))  # malformed
        .when(case == 3, F.concat(F.lit('{"p": {"size": '), size, F.lit(', "processors": []}}')))
        .otherwise(F.concat(F.lit('{"p":'), size, F.lit("}")))
    )
    registry = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_id"), body.alias("definition"))
    wanted = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("_id")).distinct()
    found = live_definitions(wanted, registry, key="_id")
    value, failed = single_value("definition")
    return found.select("_id", value.alias("definition"), failed.alias("failed"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'changed' WHEN c_custkey % 4 = 1 THEN 'same'
  WHEN c_custkey % 4 = 2 THEN 'same' ELSE 'error' END AS status FROM customer
""")
def json_status_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison as one column expression, NULL counting as empty."""
    case = F.col("c_custkey") % 4
    body = F.to_json(F.struct("c_name", "c_nationkey", "c_mktsegment"))
    other = F.to_json(F.struct("c_mktsegment", "c_name", "c_nationkey"))
    required = F.when(case == 2, F.lit(None)).when(case == 3, F.concat(body, F.lit(",null"))).otherwise(body)
    current = F.when(case == 0, F.lit("{}")).when(case == 2, F.lit("")).otherwise(other)
    return table(spark, sf_dir, "customer").select("c_custkey", json_status(required, current).alias("status"))
