"""Shapes of physical plans that matter at scale."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tableset.operators.cap import cap
from tableset.operators.includes import expand_includes
from tableset.operators.latest import entries_of, latest_entries
from tableset.operators.spread import lookup
from tableset.operators.upsert import upsert
from tableset.plans.reindex import copy_rows
from tableset.schemas import declared_schema
from workloads import job_queries, log_queries, table_queries, text_queries  # noqa: F401
from workloads.log_queries import event_log
from workloads.registry import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SMALL = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"migrate_orders"}))
def test_no_python_and_no_nested_loops(spark, plan_of, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert not re.search(r"EvalPython|InPandas|InArrow|CartesianProduct|NestedLoopJoin", plan), plan


def test_latest_entry_is_limited_before_the_shuffle(spark, plan_of):
    plan = plan_of(latest_entries(event_log(spark, SF_DIR)))
    assert plan.index("Partial") > plan.index("Exchange hashpartitioning") > plan.index("Final")


def test_terms_reach_the_scan(spark, plan_of):
    plan = plan_of(entries_of(event_log(spark, SF_DIR), resource_type="click"))
    assert "EqualTo(event_type,click)" in plan


def test_small_cap_is_a_top_n_and_large_cap_a_filter(spark, plan_of):
    customers = spark.read.parquet(f"{SF_DIR}/customer.parquet").withColumnRenamed("c_name", "_id")
    small = plan_of(cap(customers, 10))
    main, _, subquery = small.partition("Subquery")
    assert "TakeOrderedAndProject" in subquery and "Exchange" not in main
    assert "ReadSchema: struct<c_name:string>" in subquery
    large = plan_of(cap(customers, 100, top_n_limit=0))
    assert "LessThanOrEqual(c_name," in large
    assert "Exchange" not in large and "TakeOrdered" not in large


def test_copy_needs_no_shuffle(spark, plan_of):
    src = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumnRenamed("doc_id", "_id")
    steps = [{"uppercase": {"field": "lang"}}, {"drop": {"if": "lang = 'DE'"}}, {"convert": {"field": "source", "type": "long"}}]
    schema = declared_schema('{"mappings": {"properties": {"lang": {"type": "keyword"}, "source": {"type": "long"}}}}')
    plan = plan_of(copy_rows(src, schema, steps))
    assert "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan


def test_upsert_leaves_the_base_where_it_is(spark, plan_of):
    base = spark.read.parquet(f"{SF_DIR}/customer.parquet").select(F.col("c_custkey").alias("_id"), "c_name")
    updates = spark.createDataFrame([(1, "x")], "_id LONG, c_name STRING")
    plan = plan_of(upsert(base, updates))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_broadcast_includes_leave_the_texts_where_they_are(spark, plan_of):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    includes = spark.createDataFrame([("a", "1")], "name STRING, content STRING")
    plan = plan_of(expand_includes(docs, includes, "doc_id"))
    main, _, _ = plan.partition("Subquery")
    assert "hashpartitioning" not in main and "Join" not in main


def test_hot_key_is_spread(spark):
    """One key holds all rows and the lookup table is large: the rows still meet it in many tasks."""
    left = spark.range(20_000).select("id", F.lit("hot").alias("k"))
    right = spark.createDataFrame([("hot", 1), ("cold", 2)], "k STRING, v INT")
    salted = lookup(left, right, ["k"], "id", broadcast=False, salts=16, hot_rows=1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = salted.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert max(r["count"] for r in sizes) < 20_000 * 0.6
        assert salted.filter("v = 1").count() == 20_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
