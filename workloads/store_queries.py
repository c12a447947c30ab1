"""Queries through the stored tables: writes of documents, lookups, reports, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableset.operators.latest import latest_entries
from tableset.plans.baseline import import_baseline
from tableset.plans.migrate import copy_group
from tableset.plans.stored_writes import get_documents, put_documents, put_if
from tableset.session import fresh_path
from tableset.sources.store import Store, new_folder
from workloads.job_queries import _KEYS_SQL, _desired, text
from workloads.log_queries import event_log
from workloads.registry import query, table

# Orders as documents of one version, in buckets by their keys.
ORDERS = '{"mappings": {"properties": {"customer": {"type": "long"}, "priority": {"type": "keyword"}}}}'
BUCKETS = 8


def _stored_orders(spark: SparkSession, sf_dir: str) -> Store:
    store = Store(spark, fresh_path(spark, "orders"))
    orders = table(spark, sf_dir, "orders").select(
        text("o_orderkey").alias("_id"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority")
    )
    store.create_version("orders", ORDERS, orders, buckets=BUCKETS)
    return store


def _as(status: str) -> Column:
    return F.col("o_orderstatus") == status


_STORED = "CAST(o_orderkey AS VARCHAR) AS _id, o_custkey AS customer, o_orderpriority AS priority"


@query(f"""
SELECT {_STORED}, CAST(0 AS BIGINT) AS _seq_no FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), -o_custkey, 'done', 1 FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'n' || o_orderkey, o_custkey, NULL, 0 FROM orders WHERE o_orderstatus = 'P'
""")
def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored orders after a write of all finished ones and of as many new ones as are pending."""
    store, orders = _stored_orders(spark, sf_dir), table(spark, sf_dir, "orders")
    done = orders.filter(_as("F")).select(text("o_orderkey").alias("_id"), (-F.col("o_custkey")).alias("customer"), F.lit("done").alias("priority"))
    new = orders.filter(_as("P")).select(F.concat(F.lit("n"), text("o_orderkey")).alias("_id"), F.col("o_custkey").alias("customer"))
    put_documents(store, store.versions(), done.unionByName(new, allowMissingColumns=True).withColumn("version_name", F.lit("orders")))
    return store.documents(store.versions()).select("_id", "customer", "priority", "_seq_no")


def _conditional(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame]:
    """Every order is updated: finished ones at the right number, others at a wrong one; new ids come twice."""
    store, orders = _stored_orders(spark, sf_dir), table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    known = orders.select(
        text(key).alias("_id"), F.when(_as("F"), 0).when(_as("O"), 3).cast("long").alias("expected_seq"), (3 * key).alias("entry_seq"), F.lit(1).cast("long").alias("customer")
    )
    fresh = orders.filter(_as("P")).select(
        F.concat(F.lit("n"), text(key)).alias("_id"), F.lit(None).cast("long").alias("expected_seq"),
        F.explode(F.array(3 * key + 1, 3 * key + 2)).alias("entry_seq"),
    ).withColumn("customer", F.col("entry_seq"))
    return store, put_if(store, store.versions(), known.unionByName(fresh).withColumn("version_name", F.lit("orders")))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS _id, CAST(CASE WHEN o_orderstatus = 'O' THEN 3 END AS BIGINT) AS expected_seq, 3 * o_orderkey AS entry_seq
FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'n' || o_orderkey, NULL, 3 * o_orderkey + 2 FROM orders WHERE o_orderstatus = 'P'
""")
def stored_cas_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional writes that the stored version does not take."""
    return _conditional(spark, sf_dir)[1].select("_id", "expected_seq", "entry_seq")


@query(f"""
SELECT {_STORED}, CAST(0 AS BIGINT) AS _seq_no FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, NULL, 1 FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'n' || o_orderkey, 3 * o_orderkey + 1, NULL, 0 FROM orders WHERE o_orderstatus = 'P'
""")
def stored_cas_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored version after the conditional writes that it takes."""
    store, _ = _conditional(spark, sf_dir)
    return store.documents(store.versions()).select("_id", "customer", "priority", "_seq_no")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS _id, true AS _present, o_custkey AS customer FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'n' || o_orderkey, false, NULL FROM orders WHERE o_orderstatus = 'P'
""")
def stored_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending orders by id out of the stored version, and as many ids that it does not have."""
    store = _stored_orders(spark, sf_dir)
    key = text("o_orderkey")
    ids = table(spark, sf_dir, "orders").filter(_as("P")).select(F.lit("orders").alias("version_name"), F.explode(F.array(key, F.concat(F.lit("n"), key))).alias("_id"))
    return get_documents(store, store.versions(), ids).select("_id", "_present", "customer")


@query("""
SELECT count(*) AS total, count(*) FILTER (o_orderpriority <> '5-LOW') AS created, CAST(0 AS BIGINT) AS rejected,
  count(*) FILTER (o_orderpriority = '5-LOW') AS dropped FROM orders
""")
def stored_copy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a copy of all stored orders into a new version, counted while it is written."""
    store = _stored_orders(spark, sf_dir)
    pair = spark.createDataFrame([("all", "orders")], "alias STRING, version_name STRING")
    store.swap(pair.limit(0), pair)
    copies = spark.createDataFrame([("all", new_folder("copy"), -1)], "alias STRING, folder STRING, max_docs INT")
    report = copy_group(store, copies, ORDERS, [{"drop": {"if": "priority = '5-LOW'"}}], store.state())
    names = ("total", "created", "rejected", "dropped")
    return spark.createDataFrame([tuple(report[n] for n in names)], ", ".join(f"{n} LONG" for n in names))


@query(
    _KEYS_SQL
    + """
SELECT 'index_set' AS resource_type, key AS resource_identifier, '' AS final_name, content, meta, 'prod' AS env_name FROM s2
UNION ALL SELECT 'document', key, name, content, '{"Ignored":' || ignored || '}', 'prod' FROM d
"""
)
def stored_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changelog after an import of all index sets and documents."""
    store, desired = Store(spark, fresh_path(spark, "baseline")), _desired(spark, sf_dir)
    sets = desired.index_sets.select(F.lit("index_set").alias("resource_type"), F.col("index_set").alias("resource_identifier"))
    documents = desired.documents.select(F.lit("document"), F.concat_ws("/", "index_set", "name"))
    import_baseline(store, desired, sets.union(documents))
    return store.changelog().drop("timestamp", "entry_seq")


@query("""
WITH e AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-05 00:00:00' THEN 1 WHEN event_type = 'click' THEN 2 ELSE 3 END AS batch FROM events)
SELECT event_type AS resource_type, CAST(user_id AS VARCHAR) AS resource_identifier, event_id AS entry_seq, props AS content FROM e
QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY batch DESC, event_id DESC) = 1
""")
def stored_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest entries out of the compacted log and the batches since; a later batch is the newer one."""
    store, events = Store(spark, fresh_path(spark, "log")), event_log(spark, sf_dir)
    early, clicks = F.col("timestamp") < F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), F.col("resource_type") == "click"
    for batch in (early, ~early & clicks, ~early & ~clicks):
        store.append_log(events.filter(batch))
        store.compact_log(after=2)
    return latest_entries(store.recent_log()).select("resource_type", "resource_identifier", "entry_seq", "content")
