"""Names, JSON access, text expansion and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableset.functions.json import search_hits, task_status
from tableset.functions.meta import document_meta, document_meta_json, index_set_meta, index_set_meta_errors, index_set_meta_json
from tableset.functions.names import (
    alias_name,
    document_identifier,
    pipeline_id,
    split_document_id,
    split_resource_name,
    version_name,
    version_stamp,
)
from tableset.functions.text import strip_comments
from tableset.operators.includes import expand_includes
from tableset.plans.desired import join_meta, resolve_rows
from tableset.sources.resources import parse_files
from workloads.registry import query, table


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query(r"""
WITH f AS (SELECT p_partkey, CASE p_partkey % 4
    WHEN 0 THEN replace(p_name, ' ', '-') || '-' || lower(p_type) || '.json'
    WHEN 1 THEN replace(p_name, ' ', '_') || '-' || p_size || '.JSON'
    WHEN 2 THEN replace(p_name, ' ', '_') || '.json'
    ELSE replace(p_name, ' ', '-') || '-' || lower(p_type) || '.txt' END AS file_name FROM part)
SELECT p_partkey, file_name, p_partkey % 4 IN (0, 1) AS valid,
  CASE WHEN p_partkey % 4 IN (0, 1) THEN regexp_extract(file_name, '(?is)^(.*)-([^-]*)\.json$', 1) END AS identifier,
  CASE WHEN p_partkey % 4 IN (0, 1) THEN regexp_extract(file_name, '(?is)^(.*)-([^-]*)\.json$', 2) END AS env
FROM f
""")
def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("p_partkey") % 4
    dashed, plain = F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    name = (
        F.when(case == 0, F.concat(dashed, F.lit("-"), F.lower("p_type"), F.lit(".json")))
        .when(case == 1, F.concat(plain, F.lit("-"), text("p_size"), F.lit(".JSON")))
        .when(case == 2, F.concat(plain, F.lit(".json")))
        .otherwise(F.concat(dashed, F.lit("-"), F.lower("p_type"), F.lit(".txt")))
    )
    parts = split_resource_name(F.col("file_name"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("file_name")).select(
        "p_partkey", "file_name", parts["valid"].alias("valid"),
        parts["head"].alias("identifier"), parts["tail"].alias("env"),
    )


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN lower(c_mktsegment) || '-x' WHEN 1 THEN 'set' END AS index_set,
  CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN c_name END AS name, c_custkey % 5 IN (0, 1) AS valid
FROM customer
""")
def split_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("c_custkey") % 5
    identifier = (
        F.when(case == 0, F.concat(F.lower("c_mktsegment"), F.lit("-x-"), "c_name"))
        .when(case == 1, F.concat(F.lit("set-"), "c_name"))
        .when(case == 2, F.concat(F.lit("-"), "c_name"))
        .when(case == 3, F.concat("c_name", F.lit("-")))
        .otherwise(F.col("c_name"))
    )
    parts = split_document_id(identifier)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", parts["head"].alias("index_set"), parts["tail"].alias("name"), parts["valid"].alias("valid")
    )


@query("""
SELECT o_orderkey, o_orderpriority || '-' || o_orderstatus AS alias,
  o_orderpriority || '-' || o_orderstatus || '_' || strftime(o_orderdate, '%Y%m%d%H%M%S') AS version_name,
  CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority || '-' || o_orderstatus END AS pipeline,
  o_orderstatus || '/' || o_custkey AS document
FROM orders
""")
def derived_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    env, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    stamp = version_stamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        alias_name(status, env).alias("alias"),
        version_name(status, env, stamp).alias("version_name"),
        pipeline_id(F.when(status == "F", "").otherwise(status), env).alias("pipeline"),
        document_identifier(status, text("o_custkey")).alias("document"),
    )


@query("""
SELECT o_orderkey, o_orderstatus = 'F' AS completed,
  CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_custkey + 2 * o_orderkey + 1 END AS done,
  CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_custkey + o_orderkey END AS total,
  CASE WHEN o_orderkey % 3 = 0 THEN 'id' || o_orderkey END AS failure_id,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS cause_type,
  CASE WHEN o_orderkey % 3 = 0 THEN 'say "no"' END AS cause_reason
FROM orders
""")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and first failure from copy task answers, parts of which may be absent."""
    key, cust = text("o_orderkey"), text("o_custkey")
    status = F.when(
        F.col("o_orderstatus") != "P",
        F.concat(
            F.lit(',"task":{"status":{"created":'), cust, F.lit(',"updated":'), key, F.lit(',"deleted":'),
            text(F.col("o_orderkey") + 1), F.lit(',"total":'), text(F.col("o_orderkey") + F.col("o_custkey")), F.lit("}}"),
        ),
    ).otherwise(F.lit(""))
    failures = F.when(
        F.col("o_orderkey") % 3 == 0,
        F.concat(
            F.lit(',"response":{"failures":[{"id":"id'), key, F.lit('","cause":{"type":"'), F.col("o_orderpriority"),
            F.lit('","reason":"say \\"no\\""}},{"id":"second"}]}'),
        ),
    ).otherwise(F.lit(',"response":{"failures":[]}'))
    body = F.concat(F.lit('{"completed":'), text(F.col("o_orderstatus") == "F"), status, failures, F.lit("}"))
    bodies = table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))
    return bodies.select("o_orderkey", task_status("body").alias("t")).select("o_orderkey", "t.*")


@query("""
SELECT conv_id, conv_id || '.' || turn || s AS _id, turn AS _seq_no, role, md5(text || s) AS text_md5
FROM conversations, (VALUES (''), ('b')) AS v(s)
""")
def json_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search answers with two hits each, unnested to documents."""

    def hit(suffix: str) -> Column:
        return F.struct(
            F.concat(F.concat_ws(".", text("conv_id"), text("turn")), F.lit(suffix)).alias("_id"),
            F.col("turn").alias("_seq_no"),
            F.lit(1).alias("_primary_term"),
            F.struct("role", F.concat("text", F.lit(suffix)).alias("text")).alias("_source"),
        )

    body = F.to_json(F.struct(F.struct(F.array(hit(""), hit("b")).alias("hits")).alias("hits")))
    bodies = table(spark, sf_dir, "conversations").select("conv_id", body.alias("body"))
    hits = bodies.select("conv_id", F.explode(search_hits("body")).alias("h"))
    source = F.col("h._source")
    return hits.select(
        "conv_id", "h._id", "h._seq_no",
        F.try_variant_get(source, "$.role", "string").alias("role"),
        F.md5(F.try_variant_get(source, "$.text", "string")).alias("text_md5"),
    )


@query("""
SELECT doc_id, CAST(length(text || lang || source) AS INTEGER) AS n, md5(text || lang || source) AS text_md5 FROM documents
""")
def strip_comments_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments over several lines and inside of strings, within whole texts."""
    marked = F.concat(
        F.lit("/* head\n *"), "source", F.lit("\n*/"), "text", F.lit("/**/"), "lang", F.lit("/* \" */"), "source"
    )
    return table(spark, sf_dir, "documents").select("doc_id", strip_comments(marked).alias("t")).select(
        "doc_id", F.length("t").alias("n"), F.md5("t").alias("text_md5")
    )


_EXPAND_SQL = """
WITH t AS (
  SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % ({n} * 5 // 4) END AS a, doc_id % 5 AS r,
         doc_id % 11 = 3 AS none, doc_id % 13 = 5 AS other FROM documents),
e AS (
  SELECT doc_id, none, other, a, text,
    CASE WHEN none THEN text ELSE text || coalesce(i.name, '') || text || '"' || r_name || '{{{{{{ include "R0" }}}}}}"' END AS expanded,
    i.key IS NULL AS missing
  FROM t LEFT JOIN ({includes}) i ON i.key = t.a JOIN region ON r_regionkey = r)
SELECT doc_id,
  CASE WHEN none THEN 'ok' WHEN other THEN 'unsupported action' WHEN missing THEN 'missing include: I' || a ELSE 'ok' END AS status,
  CASE WHEN none OR (NOT other AND NOT missing) THEN md5(expanded) END AS text_md5
FROM e
"""


def _templates(spark: SparkSession, sf_dir: str, n: Column | int) -> DataFrame:
    """Documents with two includes each; a third of them use one and the same include."""
    n = F.lit(n)
    name = F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.col("doc_id") % n)
    template = F.concat(
        "text", F.lit('{{{ include "I'), text(name), F.lit('" }}}/* gone */'), "text",
        F.lit('{{{include "R'), text(F.col("doc_id") % 5), F.lit('"}}}'),
    )
    other = F.concat(template, F.lit("{{{ if true }}}"))
    plain = F.col("text")
    content = F.when(F.col("doc_id") % 11 == 3, plain).when(F.col("doc_id") % 13 == 5, other).otherwise(template)
    return table(spark, sf_dir, "documents").select(text("doc_id").alias("_id"), content.alias("content"))


def _region_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region names in quotes, with a comment and an include action that must stay as it is."""
    body = F.concat(F.lit('/* region */"'), "r_name", F.lit('{{{ include "R0" }}}"'))
    return table(spark, sf_dir, "region").select(
        F.concat(F.lit("R"), text("r_regionkey")).alias("name"), body.alias("content")
    )


def _expanded(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("_id").cast("long").alias("doc_id"),
        F.coalesce("include_error", F.lit("ok")).alias("status"),
        F.md5("content").alias("text_md5"),
    )


@query(_EXPAND_SQL.format(n="25", includes="SELECT n_nationkey AS key, n_name AS name FROM nation"))
def expand_includes_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few includes: the texts are not shuffled."""
    nations = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("I"), text("n_nationkey")).alias("name"), F.col("n_name").alias("content")
    )
    includes = nations.unionByName(_region_includes(spark, sf_dir))
    return _expanded(expand_includes(_templates(spark, sf_dir, 31), includes, "_id"))


@query(
    _EXPAND_SQL.format(
        n="(SELECT count(*) FROM supplier)", includes="SELECT s_suppkey AS key, s_name AS name FROM supplier"
    )
)
def expand_includes_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An includes table that grows with the data: the uses are joined, the texts stay whole."""
    suppliers = table(spark, sf_dir, "supplier")
    n = suppliers.agg((F.count(F.lit(1)) * 5).alias("n")).select(F.expr("n div 4")).scalar()
    names = suppliers.select(
        F.concat(F.lit("I"), text("s_suppkey")).alias("name"), F.col("s_name").alias("content")
    )
    includes = names.unionByName(_region_includes(spark, sf_dir))
    return _expanded(expand_includes(_templates(spark, sf_dir, n), includes, "_id", broadcast=False))


_META_SQL = """
WITH res AS (SELECT 'doc' || doc_id AS id, text FROM documents),
meta AS (SELECT 'doc' || (doc_id * 2) AS id, quality, toxic FROM labels)
SELECT coalesce(res.id, meta.id) AS index_set, md5(coalesce(text, '')) AS content_md5,
  CASE WHEN toxic = 1 THEN 'static' ELSE '' END AS index,
  coalesce(toxic = 0 AND quality = 1, FALSE) AS disabled,
  CASE WHEN toxic = 0 AND quality = 0 THEN 7 ELSE -1 END AS max_docs,
  CASE WHEN toxic = 0 AND quality = 0 THEN 'p1' ELSE '' END AS pipeline
FROM res {how} JOIN meta ON res.id = meta.id
"""


def _resources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    resources = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), text("doc_id")).alias("identifier"), F.lit("e").alias("env"), F.col("text").alias("content")
    )
    settings = (
        F.when(F.col("toxic") == 1, F.lit('{"index": "static"}'))
        .when(F.col("quality") == 1, F.lit('{"prototype": {"disabled": true}}'))
        .otherwise(F.lit('{"prototype": {"maxDocs": 7}, "reindex": {"pipeline": "p1"}}'))
    )
    meta = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("doc"), text(F.col("doc_id") * 2)).alias("identifier"), F.lit("e").alias("env"), settings.alias("content")
    )
    return resources, meta


def _typed(joined: DataFrame) -> DataFrame:
    return joined.select(
        F.col("identifier").alias("index_set"), F.md5("content").alias("content_md5"),
        index_set_meta(F.col("meta_text")).alias("m"),
    ).select(
        "index_set", "content_md5", "m.index", "m.prototype.disabled", "m.prototype.max_docs", "m.reindex.pipeline"
    )


@query(_META_SQL.format(how="FULL"))
def join_meta_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings without a resource stay, with empty content."""
    return _typed(join_meta(*_resources(spark, sf_dir), "full"))


@query(_META_SQL.format(how="LEFT"))
def join_meta_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(join_meta(*_resources(spark, sf_dir), "left"))


@query("""
SELECT c_custkey,
  CASE c_custkey % 4 WHEN 0 THEN '{"Index":"i' || c_nationkey || '","Prototype":{"Disabled":false,"MaxDocs":-1},"Reindex":{"Pipeline":""}}'
    WHEN 1 THEN '{"Index":"","Prototype":{"Disabled":true,"MaxDocs":-1},"Reindex":{"Pipeline":"p' || c_nationkey || '"}}'
    WHEN 2 THEN '{"Index":"i","Prototype":{"Disabled":false,"MaxDocs":' || c_nationkey || '},"Reindex":{"Pipeline":""}}'
    ELSE '{"Index":"","Prototype":{"Disabled":false,"MaxDocs":-1},"Reindex":{"Pipeline":""}}' END AS meta,
  CASE WHEN c_custkey % 4 = 2 THEN 2 ELSE 0 END AS n_errors,
  CASE c_custkey % 4 WHEN 3 THEN '{"Ignored":true}' ELSE '{"Ignored":false}' END AS document_meta
FROM customer
""")
def typed_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings from JSON with defaults, their conflicts, and their logged form."""
    case, nation = F.col("c_custkey") % 4, text("c_nationkey")
    body = (
        F.when(case == 0, F.concat(F.lit('{"index": "i'), nation, F.lit('"}')))
        .when(case == 1, F.concat(F.lit('{"prototype": {"disabled": true}, "reindex": {"pipeline": "p'), nation, F.lit('"}}')))
        .when(case == 2, F.concat(F.lit('{"index": "i", "prototype": {"maxDocs": '), nation, F.lit('}, "reindex": {}}')))
        .otherwise(F.lit('{"ignored": true}'))
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", body.alias("b"))
    return rows.select(
        "c_custkey",
        index_set_meta_json(index_set_meta(F.col("b"))).alias("meta"),
        F.size(index_set_meta_errors(F.col("b"))).alias("n_errors"),
        document_meta_json(document_meta(F.col("b"))).alias("document_meta"),
    )


@query("""
WITH f AS (
  SELECT o_custkey AS id, o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 'e1' WHEN '2-HIGH' THEN 'default' ELSE 'e2' END AS env,
    o_orderstatus = 'F' AS is_meta FROM orders),
r AS (SELECT * FROM f WHERE NOT is_meta AND env IN ('e1', 'default')
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY env = 'e1' DESC, k DESC) = 1),
m AS (SELECT * FROM f WHERE is_meta AND env IN ('e1', 'default')
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY env = 'e1' DESC, k DESC) = 1)
SELECT 's' || coalesce(r.id, m.id) AS index_set, coalesce(r.env, m.env) AS env,
  coalesce('{"k":' || r.k || ',"r":"' || r_name || '"}', '') AS content, coalesce(m.k::INT, -1) AS max_docs
FROM r FULL JOIN m ON r.id = m.id LEFT JOIN region ON r_regionkey = r.k % 5
WHERE m.k IS NULL OR m.k % 7 <> 0
""")
def resolve_desired_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Desired state from file rows: names, overlay, settings, conflicts, includes, comments."""
    is_meta = F.col("o_orderstatus") == "F"
    env = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "e1")
        .when(F.col("o_orderpriority") == "2-HIGH", "default")
        .otherwise("e2")
    )
    suffix = F.when(is_meta, ".meta.json").otherwise(".json")
    key = text("o_orderkey")
    static = F.when(F.col("o_orderkey") % 7 == 0, F.lit(', "index": "x"')).otherwise(F.lit(""))
    content = F.when(
        is_meta, F.concat(F.lit('{"prototype": {"maxDocs": '), key, F.lit("}"), static, F.lit("}"))
    ).otherwise(
        F.concat(F.lit('{"k":'), key, F.lit('/* note */,"r":"{{{ include "R'), text(F.col("o_orderkey") % 5), F.lit('" }}}"}'))
    )
    name = F.concat(F.lit("s"), text("o_custkey"), F.lit("-"), env, suffix)
    files = table(spark, sf_dir, "orders").select(
        F.lpad(key, 20, "0").alias("path"), name.alias("file_name"), content.alias("content")
    )
    parsed = parse_files(files).filter("valid")
    none = parsed.limit(0)
    includes = table(spark, sf_dir, "region").select(
        F.concat(F.lit("R"), text("r_regionkey")).alias("name"), F.col("r_name").alias("content")
    )
    desired = resolve_rows("e1", parsed, none, none, includes)
    return desired.index_sets.select("index_set", "env", "content", "meta.prototype.max_docs")
