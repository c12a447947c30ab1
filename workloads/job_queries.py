"""Whole jobs: change set, action text, document sync, baseline, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableset.functions.layout import layout_id
from tableset.functions.meta import index_set_meta_json
from tableset.plans.baseline import baseline
from tableset.plans.change_set import action_text, change_set, numbered, removals
from tableset.plans.desired import ERROR_COLUMNS, Desired
from tableset.plans.documents import sync_documents
from tableset.plans.migrate import migrate
from tableset.schemas import VERSION
from tableset.session import fresh_path
from tableset.sources.store import Store
from workloads.registry import query, table


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# The state of the change set queries. Every customer is an index set ``set<key>``, every
# order an entry of its log and an alias member (of this environment above a price), nations
# are the transforms, documents the documents, with their texts, and toxic labels mark those
# to ignore.


def _settings(key: Column) -> Column:
    """Settings of an index set by its number."""
    static = key % 5 == 0
    return F.struct(
        F.when(static, F.concat(F.lit("shared-"), text(key % 25))).otherwise("").alias("index"),
        F.struct(
            (~static & (key % 3 == 0)).alias("disabled"),
            F.when(~static & (key % 7 == 0), 100).otherwise(-1).cast("int").alias("max_docs"),
        ).alias("prototype"),
        F.struct(
            F.when(~static & (key % 2 == 0), F.concat(F.lit("p"), text(key % 25))).otherwise("").alias("pipeline")
        ).alias("reindex"),
    )


def _desired(spark: SparkSession, sf_dir: str) -> Desired:
    key = F.col("c_custkey")
    sets = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("set"), text(key)).alias("index_set"),
        F.lit("prod").alias("env"),
        F.concat(F.lit('{"n":'), text(key % 25), F.lit(',"v":1}'), F.when(key % 97 == 0, " x").otherwise("")).alias("content"),
        _settings(key).alias("meta"),
    )
    nation = F.col("n_nationkey")
    pipelines = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("p"), text(nation)).alias("name"),
        F.concat(F.lit('{"processors":[{"set":{"field":"r","value":'), text("n_regionkey"), F.lit("}}]}")).alias("definition"),
    )
    ignored = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("toxic"))
    documents = table(spark, sf_dir, "documents").join(ignored, "doc_id", "left").select(
        F.concat(F.lit("set"), text(F.col("doc_id") % 10)).alias("index_set"),
        F.concat(F.lit("d"), text("doc_id")).alias("name"),
        F.to_json(F.struct("lang", "source", "n_chars", "text")).alias("content"),
        F.struct(F.coalesce("toxic", F.lit(False)).alias("ignored")).alias("meta"),
    )
    none = spark.createDataFrame([], ", ".join(f"{c} STRING" for c in ERROR_COLUMNS))
    return Desired("prod", sets, pipelines, documents, none)


def _set_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as log of the sets, documents as log of the documents."""
    key = F.col("o_custkey")
    value = F.when(F.col("o_orderstatus") == "F", "2").otherwise("1.0")
    sets = table(spark, sf_dir, "orders").select(
        F.lit("index_set").alias("resource_type"),
        F.concat(F.lit("set"), text(key)).alias("resource_identifier"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "dev").otherwise("prod").alias("env_name"),
        F.concat(F.lit('{"v": '), value, F.lit(', "n": '), text(key % 25), F.lit("}")).alias("content"),
        F.when(F.col("o_orderpriority") == "5-LOW", "{}").otherwise(index_set_meta_json(_settings(key))).alias("meta"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_orderkey").alias("entry_seq"),
    )
    doc = F.col("doc_id")
    length = F.when(doc % 3 == 1, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    documents = table(spark, sf_dir, "documents").filter(doc % 3 != 0).select(
        F.lit("document").alias("resource_type"),
        F.concat(F.lit("set"), text(doc % 10), F.lit("/d"), text(doc)).alias("resource_identifier"),
        F.lit("prod").alias("env_name"),
        F.to_json(F.struct(length.alias("n_chars"), "text", "source", "lang")).alias("content"),
        F.lit('{"Ignored": false}').alias("meta"),
        F.lit("2024-01-01").cast("timestamp").alias("timestamp"),
        doc.alias("entry_seq"),
    )
    return sets.unionByName(documents)


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, low = F.col("o_custkey"), F.col("o_orderpriority") == "5-LOW"
    version = (
        F.when((key % 5 == 0) & (key % 4 != 0), F.concat(F.lit("shared-"), text(key % 25)))
        .when(low, "old")
        .otherwise(F.concat(F.lit("prod-set"), text(key), F.lit("_1998")))
    )
    # Cheaper orders are members of another environment's aliases, so these sets have none here.
    env = F.when(F.col("o_totalprice") > 250000, "prod-set").otherwise("past-set")
    return table(spark, sf_dir, "orders").select(F.concat(env, text(key)).alias("alias"), version.alias("version_name"))


def _live_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("n_nationkey")
    region = F.when(nation % 4 == 1, F.col("n_regionkey") + 1).otherwise(F.col("n_regionkey"))
    return table(spark, sf_dir, "nation").filter(nation % 4 != 0).select(
        F.concat(F.lit("prod-p"), text(nation)).alias("name"),
        F.concat(F.lit('{"processors": [{"set": {"value": '), text(region), F.lit('.0, "field": "r"}}]}')).alias("definition"),
    )


_STATE_SQL = """
WITH s AS (
  SELECT c_custkey AS k, 'set' || c_custkey AS key, c_custkey % 5 = 0 AS static,
    '{"n":' || (c_custkey % 25) || ',"v":1}' || CASE WHEN c_custkey % 97 = 0 THEN ' x' ELSE '' END AS content,
    CASE WHEN c_custkey % 5 = 0 THEN 'shared-' || (c_custkey % 25) ELSE '' END AS index,
    c_custkey % 5 <> 0 AND c_custkey % 3 = 0 AS disabled,
    CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 = 0 THEN 100 ELSE -1 END AS max_docs,
    CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN 'p' || (c_custkey % 25) ELSE '' END AS pipeline FROM customer),
s2 AS (SELECT *, '{"Index":"' || index || '","Prototype":{"Disabled":' || disabled || ',"MaxDocs":' || max_docs
    || '},"Reindex":{"Pipeline":"' || pipeline || '"}}' AS meta FROM s),
l AS (SELECT o_custkey AS k, o_orderstatus, o_orderpriority FROM orders WHERE o_orderpriority <> '3-MEDIUM'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
m0 AS (SELECT DISTINCT 'set' || o_custkey AS key, 'prod-set' || o_custkey AS alias,
  CASE WHEN o_custkey % 5 = 0 AND o_custkey % 4 <> 0 THEN 'shared-' || (o_custkey % 25)
    WHEN o_orderpriority = '5-LOW' THEN 'old' ELSE 'prod-set' || o_custkey || '_1998' END AS version_name
  FROM orders WHERE o_totalprice > 250000),
m AS (SELECT key, min(version_name) AS first_member, max(version_name) AS last_member FROM m0 GROUP BY key),
c AS (SELECT s2.*, m.first_member IS NOT NULL AS has, coalesce(first_member = index AND last_member = index, FALSE) AS only_it,
    CASE WHEN l.k IS NULL THEN 'new' WHEN s2.k % 97 = 0 THEN 'error' WHEN o_orderstatus = 'F' THEN 'changed'
      WHEN o_orderpriority = '5-LOW' THEN 'changed' ELSE 'same' END AS status,
    pipeline <> '' AND s2.k % 25 % 4 IN (0, 1) AS pipeline_changed,
    CASE WHEN static THEN index ELSE 'prod-' || s2.key || '_20010203040506' END AS target,
    CASE WHEN pipeline = '' THEN '' ELSE 'prod-' || pipeline END AS pipeline_id
  FROM s2 LEFT JOIN l ON l.k = s2.k LEFT JOIN m ON m.key = s2.key),
w AS (SELECT * FROM c WHERE status IN ('new', 'changed') OR (status = 'same' AND pipeline_changed)),
d AS (SELECT doc_id, 'set' || (doc_id % 10) AS index_set, 'set' || (doc_id % 10) || '/d' || doc_id AS key, 'd' || doc_id AS name,
    '{"lang":"' || lang || '","source":"' || source || '","n_chars":' || n_chars || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}' AS content, coalesce(toxic = 1, FALSE) AS ignored
  FROM documents LEFT JOIN labels USING (doc_id)),
dw AS (SELECT *, '{"Ignored":' || ignored || '}' AS meta FROM d WHERE doc_id % 3 <> 2 OR ignored)
"""

_ACTIONS_SQL = _STATE_SQL + """,
a AS (
  SELECT 2 AS stage, key, 0 AS pos, 'create_index' AS action, target, NULL AS source, NULL AS max_docs, NULL AS pipeline,
    content AS definition, NULL AS meta FROM w WHERE NOT static
  UNION ALL SELECT 2, key, 1, 'reindex', target, 'proto-' || key, max_docs, pipeline_id, NULL, NULL FROM w WHERE NOT static AND NOT has AND NOT disabled
  UNION ALL SELECT 2, key, 1, 'reindex', target, 'prod-' || key, -1, pipeline_id, NULL, NULL FROM w WHERE NOT static AND has
  UNION ALL SELECT 2, key, 2, 'create_alias', target, 'prod-' || key, NULL, NULL, NULL, NULL FROM w WHERE NOT has
  UNION ALL SELECT 2, key, 2, 'update_alias', target, 'prod-' || key, NULL, NULL, NULL, NULL FROM w WHERE has AND NOT (static AND only_it)
  UNION ALL SELECT 2, key, 3, 'write_changelog', target, 'index_set', NULL, NULL, content, meta FROM w
  UNION ALL SELECT 1, 'p' || n_nationkey, 0, 'put_pipeline', 'prod-p' || n_nationkey, NULL, NULL, NULL,
    '{"processors":[{"set":{"field":"r","value":' || n_regionkey || '}}]}', NULL FROM nation WHERE n_nationkey % 4 IN (0, 1)
  UNION ALL SELECT 3, key, 0, 'index_document', 'prod-' || index_set, name, NULL, NULL, content, NULL FROM dw WHERE NOT ignored
  UNION ALL SELECT 3, key, 1, 'write_changelog', name, 'document', NULL, NULL, content, meta FROM dw),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY stage, key ORDER BY pos) - 1 AS INTEGER) AS step FROM a)
"""


def _change_set(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return change_set(
        _desired(spark, sf_dir),
        _set_log(spark, sf_dir),
        _members(spark, sf_dir),
        _live_pipelines(spark, sf_dir),
        version="20010203040506",
        prototype_env="proto",
    )


@query(
    _ACTIONS_SQL
    + "SELECT stage, key, step, action, target, source, CAST(max_docs AS INTEGER) AS max_docs, pipeline, definition, meta FROM n"
)
def change_set_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All actions of all sets, transforms and documents."""
    return _change_set(spark, sf_dir)[0]


@query(_ACTIONS_SQL + "SELECT row_number() OVER (ORDER BY stage, key, step) AS position, stage, key, step, action FROM n")
def actions_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All actions with their place in the order of execution."""
    return numbered(_change_set(spark, sf_dir)[0]).select("position", "stage", "key", "step", "action")


@query(_STATE_SQL + "SELECT 'index_set' AS kind, key, 'definition is not a JSON object' AS reason FROM c WHERE status = 'error'")
def change_set_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps the change set from being carried out."""
    return _change_set(spark, sf_dir)[1]


@query(_ACTIONS_SQL + "SELECT alias, version_name FROM m0 WHERE alias IN (SELECT source FROM n WHERE action = 'update_alias')")
def change_set_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias members that the change set takes away."""
    return removals(_change_set(spark, sf_dir)[0], _members(spark, sf_dir))


@query(
    _ACTIONS_SQL
    + """, r AS (SELECT alias, string_agg(alias || ' -> ' || version_name, ', ' ORDER BY version_name) AS removed FROM m0 GROUP BY alias)
SELECT stage, key, step, CASE action
  WHEN 'create_index' THEN 'create index ' || target
  WHEN 'write_changelog' THEN 'write ' || source || ' changelog entry for prod:' || key
  WHEN 'reindex' THEN 'reindex ' || source || ' -> ' || target || CASE WHEN pipeline <> '' THEN ' via ' || pipeline ELSE '' END
    || CASE WHEN max_docs <> -1 THEN ' (' || max_docs || ' max docs)' ELSE '' END
  WHEN 'create_alias' THEN 'create alias ' || source || ' -> ' || target
  WHEN 'update_alias' THEN 'update alias ' || source || ' -> ' || target || coalesce('; removing ' || removed, '')
  WHEN 'put_pipeline' THEN 'put pipeline ' || target
  ELSE 'index document ' || target || '/' || source END AS text
FROM n LEFT JOIN r ON n.source = r.alias AND n.action = 'update_alias'
"""
)
def action_text_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, _ = _change_set(spark, sf_dir)
    return action_text(changes, _members(spark, sf_dir), "prod").select("stage", "key", "step", "text")


def _table_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents: two thirds of the desired ones, and one of each that is not desired."""
    doc = F.col("doc_id")
    alias = F.concat(F.lit("prod-set"), text(doc % 10)).alias("alias")
    documents = table(spark, sf_dir, "documents")
    stored = documents.filter(doc % 3 != 0).select(alias, F.concat(F.lit("d"), text(doc)).alias("_id"), F.lit("{}").alias("_source"))
    others = documents.select(alias, F.concat(F.lit("x"), text(doc)).alias("_id"), F.lit("{}").alias("_source"))
    return stored.unionByName(others)


@query(
    _STATE_SQL
    + """, b AS (SELECT 'prod-set' || (doc_id % 10) AS alias, 'd' || doc_id AS _id FROM documents WHERE doc_id % 3 <> 0
  UNION ALL SELECT 'prod-set' || (doc_id % 10), 'x' || doc_id FROM documents),
u AS (SELECT 'prod-' || index_set AS alias, name AS _id, content AS _source FROM dw WHERE NOT ignored)
SELECT * FROM u UNION ALL SELECT alias, _id, '{}' FROM b WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.alias = b.alias AND u._id = b._id)
"""
)
def document_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next state of the document tables."""
    desired = _desired(spark, sf_dir)
    state, _ = sync_documents(desired.documents, _set_log(spark, sf_dir), _table_of_documents(spark, sf_dir), "prod")
    return state


@query(
    _STATE_SQL
    + """
SELECT 'document' AS resource_type, key AS resource_identifier, name AS final_name, 'prod' AS env_name, content, meta FROM dw
"""
)
def document_sync_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows of the document sync: every changed document, ignored ones too."""
    desired = _desired(spark, sf_dir)
    _, log = sync_documents(desired.documents, _set_log(spark, sf_dir), _table_of_documents(spark, sf_dir), "prod")
    return log


_KEYS_SQL = _STATE_SQL + """,
keys AS (SELECT DISTINCT 'index_set' AS t, 'set' || (o_custkey * 2) AS id FROM orders
  UNION ALL SELECT 'document', 'set' || (doc_id * 3 % 10) || '/d' || (doc_id * 3) FROM documents)
"""


def _baseline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Keys of every second set and every third document, and as many that do not exist."""
    sets = table(spark, sf_dir, "orders").select(
        F.lit("index_set").alias("resource_type"), F.concat(F.lit("set"), text(F.col("o_custkey") * 2)).alias("resource_identifier")
    )
    doc = F.col("doc_id") * 3
    documents = table(spark, sf_dir, "documents").select(
        F.lit("document"), F.concat(F.lit("set"), text(doc % 10), F.lit("/d"), text(doc))
    )
    return baseline(_desired(spark, sf_dir), sets.union(documents))


@query(
    _KEYS_SQL
    + """
SELECT 'index_set' AS resource_type, key AS resource_identifier, '' AS final_name, content, meta, 'prod' AS env_name
FROM s2 JOIN keys ON t = 'index_set' AND id = key
UNION ALL SELECT 'document', key, name, content, '{"Ignored":' || ignored || '}', 'prod' FROM d JOIN keys ON t = 'document' AND id = key
"""
)
def baseline_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline(spark, sf_dir)[0]


@query(
    _KEYS_SQL
    + """
SELECT t AS resource_type, id AS resource_identifier FROM keys
WHERE NOT (t = 'index_set' AND id IN (SELECT key FROM s2)) AND NOT (t = 'document' AND id IN (SELECT key FROM d))
"""
)
def baseline_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline(spark, sf_dir)[1]


_OLD = '{"mappings": {"properties": {"customer": {"type": "keyword"}, "priority": {"type": "keyword"}, "cents": {"type": "long"}}}}'
_NEW = '{"mappings": {"properties": {"customer": {"type": "long"}, "priority": {"type": "keyword"}}}}'
_STEPS = '{"processors": [{"lowercase": {"field": "priority"}}, {"drop": {"if": "cents %% 10 = 0"}}]}'.replace("%%", "%")


@query("""
SELECT 'prod-' || o_orderstatus || '_2' AS version_name, CAST(o_orderkey AS VARCHAR) AS _id, o_custkey AS customer,
  lower(o_orderpriority) AS priority FROM orders WHERE o_custkey % 10 <> 0
UNION ALL SELECT 'prod-' || o_orderstatus || '_2', 'best', max(o_custkey), 'none' FROM orders GROUP BY o_orderstatus
""")
def migrate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole migration in the shared folder, read back through the aliases.

    Orders are stored as one version per status; the desired state asks for other columns
    and a transform, and for one document per set. All sets are copied by one job.
    """
    store = Store(spark, fresh_path(spark, "migrate"))
    orders, status = table(spark, sf_dir, "orders"), F.col("o_orderstatus")
    old = orders.select(F.concat(F.lit("old-"), status).alias("version_name"), F.concat(F.lit("prod-"), status).alias("alias")).distinct()
    rows = old.select(
        "version_name", F.lit(_OLD).alias("definition"), F.lit(layout_id(_OLD)).alias("layout"), F.col("version_name").alias("folder")
    )
    store.write_folders(
        orders.select(
            F.concat(F.lit("old-"), status).alias("folder"), text("o_orderkey").alias("_id"),
            text("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("cents"),
        ),
        _OLD,
    )
    store.register(rows.select(*VERSION.names))
    store.swap(old.limit(0), old)

    sets = orders.groupBy(status.alias("index_set")).agg(F.max("o_custkey").alias("best"))
    blank = F.struct(
        F.lit("").alias("index"),
        F.struct(F.lit(False).alias("disabled"), F.lit(-1).alias("max_docs")).alias("prototype"),
        F.struct(F.lit("clean").alias("pipeline")).alias("reindex"),
    )
    none = spark.createDataFrame([], ", ".join(f"{c} STRING" for c in ERROR_COLUMNS))
    desired = Desired(
        "prod",
        sets.select("index_set", F.lit("prod").alias("env"), F.lit(_NEW).alias("content"), blank.alias("meta")),
        spark.createDataFrame([("clean", _STEPS)], "name STRING, definition STRING"),
        sets.select(
            "index_set", F.lit("best").alias("name"),
            F.concat(F.lit('{"customer": '), text("best"), F.lit(', "priority": "none"}')).alias("content"),
            F.struct(F.lit(False).alias("ignored")).alias("meta"),
        ),
        none,
    )
    migrate(store, desired, version="2")
    members = store.membership().join(old.select("alias"), "alias", "left_semi")
    versions = store.versions().join(members.select("version_name"), "version_name", "left_semi")
    return store.documents(versions).select("version_name", "_id", "customer", "priority")
