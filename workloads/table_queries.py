"""Copies, caps, upserts, aliases and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableset.operators.aliases import alias_members, same_members, scan_alias, swap, unreferenced
from tableset.operators.cap import cap, cap_by_key
from tableset.operators.changes import changed_only, using_changed
from tableset.operators.report import outcome_report
from tableset.operators.spread import lookup
from tableset.operators.transforms import parse_steps
from tableset.operators.upsert import cas_upsert, check_bodies, delete_keys, upsert, write_outcomes
from tableset.plans.change_set import pipeline_changes
from tableset.plans.documents import parse_documents
from tableset.plans.reindex import copy_rows, newest_per_id, reindex, seed_source
from tableset.schemas import declared_schema
from workloads.registry import query, table


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# copies

_DOCUMENTS = """{"mappings": {"properties": {
  "body": {"type": "text"}, "language": {"type": "keyword"}, "origin": {"type": "keyword"},
  "length": {"type": "long"}, "words": {"type": "long"}, "kind": {"type": "keyword"}, "long": {"type": "boolean"}}}}"""

_DOCUMENT_STEPS = """{"description": "clean up", "processors": [
  {"rename": {"field": "text", "target_field": "body"}},
  {"uppercase": {"field": "lang", "target_field": "language"}},
  {"remove": {"field": "lang"}},
  {"gsub": {"field": "source", "pattern": "^src", "replacement": " source "}},
  {"trim": {"field": "source", "target_field": "origin"}},
  {"set": {"field": "kind", "value": "Document"}},
  {"lowercase": {"field": "kind"}},
  {"convert": {"field": "n_chars", "type": "long", "target_field": "length"}},
  {"set": {"field": "long", "value": "true"}},
  {"drop": {"if": "language = 'DE' AND length > 2000"}}]}"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "_id").withColumn("_id", text("_id"))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS _id, md5(text) AS body_md5, upper(lang) AS language,
  'source ' || substr(source, 4) AS origin, n_chars AS length, CAST(NULL AS BIGINT) AS words, 'document' AS kind, TRUE AS long
FROM documents WHERE NOT (lang = 'de' AND n_chars > 2000)
""")
def reindex_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a transform into the columns of a new version."""
    good, _, _ = reindex(_documents(spark, sf_dir), declared_schema(_DOCUMENTS), parse_steps(_DOCUMENT_STEPS))
    return good.withColumn("body_md5", F.md5("body")).drop("body")


_EVENTS = """{"mappings": {"properties": {
  "k": {"type": "long"}, "at": {"type": "date"}, "event_type": {"type": "keyword"}}}}"""

_EVENT_STEPS = """{"processors": [
  {"date": {"field": "day", "formats": ["yyyy-MM-dd"], "target_field": "at"}},
  {"convert": {"field": "score", "type": "integer", "ignore_missing": true}},
  {"drop": {"if": "event_type = 'view'"}}]}"""


def _event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with text fields, some of which do not fit the declared columns."""
    case = F.col("event_id") % 100
    number = F.regexp_extract("props", r"(\d+)", 1)
    return table(spark, sf_dir, "events").select(
        F.lpad(text("event_id"), 12, "0").alias("_id"),
        F.when(case == 7, F.concat(number, F.lit("x"))).otherwise(number).alias("k"),
        F.when(case == 8, "2024-13-01").when(case == 9, F.lit(None)).otherwise(F.lit("2024-01-31")).alias("day"),
        F.when(case == 10, "ten").when(case == 11, F.lit(None)).otherwise(F.lit("10")).alias("score"),
        "event_type",
    )


_REJECTED_SQL = """
WITH e AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS _id, event_type, event_id % 100 AS c,
             regexp_extract(props, '(\\d+)', 1) AS k FROM events),
o AS (SELECT *, CASE WHEN c IN (8, 9, 10) THEN 'rejected' WHEN event_type = 'view' THEN 'dropped'
                     WHEN c = 7 THEN 'rejected' ELSE 'created' END AS outcome,
        CASE WHEN c = 7 THEN 'mapper_parsing_exception' ELSE 'illegal_argument_exception' END AS cause_type,
        CASE c WHEN 7 THEN 'failed to parse field [k] of type [bigint]: ' || k || 'x'
          WHEN 8 THEN 'unable to parse date [2024-13-01]' WHEN 9 THEN 'field [day] not present'
          ELSE 'unable to convert [ten] to integer' END AS cause_reason FROM e)
"""


@query(_REJECTED_SQL + "SELECT _id, cause_type, cause_reason FROM o WHERE outcome = 'rejected'")
def reindex_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that could not be copied, with the cause."""
    source, schema = _event_documents(spark, sf_dir), declared_schema(_EVENTS)
    _, rejected, _ = reindex(source, schema, parse_steps(_EVENT_STEPS))
    return rejected.select("_id", "_failure.cause_type", "_failure.cause_reason")


@query(
    _REJECTED_SQL
    + """
SELECT count(*) AS total, count(*) FILTER (outcome = 'created') AS created, CAST(0 AS BIGINT) AS updated,
  count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'dropped') AS dropped,
  count(*) FILTER (outcome = 'created') AS done,
  min(_id) FILTER (outcome = 'rejected') AS failure_id,
  arg_min(cause_type, _id) FILTER (outcome = 'rejected') AS cause_type,
  arg_min(cause_reason, _id) FILTER (outcome = 'rejected') AS cause_reason
FROM o
"""
)
def reindex_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, schema = _event_documents(spark, sf_dir), declared_schema(_EVENTS)
    _, _, report = reindex(source, schema, parse_steps(_EVENT_STEPS))
    return report.select(
        "total", "created", "updated", "rejected", "dropped", "done",
        F.col("first_failure.id").alias("failure_id"), "first_failure.cause_type", "first_failure.cause_reason",
    )


def _order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        text("o_orderkey").alias("_id"), "o_custkey", "o_orderstatus", "o_orderpriority"
    )


@query("""
SELECT _id, o_custkey, o_orderstatus FROM (SELECT CAST(o_orderkey AS VARCHAR) AS _id, * FROM orders)
ORDER BY _id LIMIT 9000
""")
def reindex_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large cap: the last id is looked up, the documents are filtered."""
    schema = declared_schema(
        '{"mappings": {"properties": {"o_custkey": {"type": "long"}, "o_orderstatus": {"type": "keyword"}}}}'
    )
    good, _, _ = reindex(_order_documents(spark, sf_dir), schema, max_docs=9000, top_n_limit=0)
    return good


@query("""
SELECT _id, o_custkey FROM (SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_custkey FROM orders) ORDER BY _id LIMIT 50
""")
def reindex_small_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap(_order_documents(spark, sf_dir).select("_id", "o_custkey"), 50)


@query("""
WITH m AS (SELECT l_orderkey AS id, 'v' || l_linenumber AS version_name, sum(l_partkey) AS parts FROM lineitem GROUP BY ALL)
SELECT CAST(id AS VARCHAR) AS _id, version_name, CAST(parts AS BIGINT) AS parts FROM m
QUALIFY row_number() OVER (PARTITION BY id ORDER BY version_name DESC) = 1
""")
def reindex_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several members with the same ids: the document of the newest version name is copied."""
    members = table(spark, sf_dir, "lineitem").groupBy(
        text("l_orderkey").alias("_id"), F.concat(F.lit("v"), text("l_linenumber")).alias("version_name")
    ).agg(F.sum("l_partkey").alias("parts"))
    return newest_per_id(members)


@query("""
WITH s AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE n_nationkey * 2 END AS max_docs,
             n_nationkey % 7 = 0 AS disabled, CASE WHEN n_nationkey % 11 = 1 THEN 'static' ELSE '' END AS index FROM nation)
SELECT 'dev-set' || n_nationkey || '_20240101000000' AS version_name, CAST(c_custkey AS VARCHAR) AS _id, c_name AS name
FROM s JOIN customer ON c_nationkey = n_nationkey WHERE NOT disabled AND index = ''
QUALIFY max_docs = -1 OR row_number() OVER (PARTITION BY n_nationkey ORDER BY CAST(c_custkey AS VARCHAR)) <= max_docs
""")
def seed_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First versions of one environment from another, each set with its own cap, in one job."""
    n = F.col("n_nationkey")
    sets = table(spark, sf_dir, "nation").select(
        n.alias("set_key"),
        F.concat(F.lit("dev-set"), text(n), F.lit("_20240101000000")).alias("version_name"),
        F.when(n % 4 == 0, -1).when(n % 4 == 1, 0).otherwise(n * 2).alias("max_docs"),
        (n % 7 == 0).alias("disabled"),
        F.when(n % 11 == 1, "static").otherwise("").alias("index"),
    )
    seeded = sets.filter(seed_source("dev", "proto", F.col("disabled"), F.col("index"), F.lit(False)))
    source = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("set_key"), text("c_custkey").alias("_id"), F.col("c_name").alias("name")
    )
    mine = lookup(source, seeded.select("set_key", "version_name"), ["set_key"], "_id", how="inner")
    capped = cap_by_key(mine, seeded, "version_name", "max_docs")
    schema = declared_schema('{"mappings": {"properties": {"name": {"type": "text"}}}}')
    return copy_rows(capped, schema, carry=("version_name", "_id")).select("version_name", "_id", "name")


# upserts

_UPDATES_SQL = """
WITH b AS (SELECT CAST(c_custkey AS VARCHAR) AS _id, c_nationkey AS _seq_no, c_name AS body FROM customer),
u AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'n' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS _id,
        o_orderkey AS entry_seq, o_orderpriority AS body,
        CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey % 25 END AS expected_seq FROM orders)
"""


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        text("c_custkey").alias("_id"), F.col("c_nationkey").cast("long").alias("_seq_no"), F.col("c_name").alias("body")
    )


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = F.col("o_orderstatus") == "P"
    return table(spark, sf_dir, "orders").select(
        F.when(fresh, F.concat(F.lit("n"), text("o_custkey"))).otherwise(text("o_custkey")).alias("_id"),
        F.col("o_orderkey").alias("entry_seq"),
        F.col("o_orderpriority").alias("body"),
        F.when(~fresh, F.col("o_orderkey") % 25).alias("expected_seq"),
    )


@query(
    _UPDATES_SQL
    + """, l AS (SELECT _id, body FROM u QUALIFY row_number() OVER (PARTITION BY _id ORDER BY entry_seq DESC) = 1)
SELECT _id, body FROM l UNION ALL SELECT _id, body FROM b WHERE _id NOT IN (SELECT _id FROM l)
"""
)
def upsert_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _base(spark, sf_dir).select("_id", "body")
    return upsert(base, _updates(spark, sf_dir), order=[F.col("entry_seq")])


_JUDGED_SQL = _UPDATES_SQL + """, w AS (
  SELECT u._id, min(entry_seq) AS entry_seq FROM u LEFT JOIN b ON u._id = b._id
  WHERE u.expected_seq IS NOT DISTINCT FROM b._seq_no GROUP BY u._id)
"""


@query(
    _JUDGED_SQL
    + """
SELECT u._id, coalesce(u.expected_seq, -1) + 1 AS _seq_no, u.body FROM u JOIN w ON u._id = w._id AND u.entry_seq = w.entry_seq
UNION ALL SELECT _id, _seq_no, body FROM b WHERE _id NOT IN (SELECT _id FROM w)
"""
)
def cas_upsert_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional writes: the next state of the table."""
    state, _ = cas_upsert(_base(spark, sf_dir), _updates(spark, sf_dir))
    return state


@query(
    _JUDGED_SQL
    + """
SELECT u._id, u.entry_seq FROM u LEFT JOIN w ON u._id = w._id AND u.entry_seq = w.entry_seq WHERE w._id IS NULL
"""
)
def cas_upsert_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional writes: the updates that were refused."""
    _, conflicts = cas_upsert(_base(spark, sf_dir), _updates(spark, sf_dir))
    return conflicts.select("_id", "entry_seq")


@query("""
WITH o AS (SELECT 'p' || p_partkey AS _id, CASE WHEN p_partkey % 10 = 3 THEN 'rejected'
    WHEN p_partkey IN (SELECT c_custkey FROM customer) THEN 'updated' ELSE 'created' END AS outcome FROM part)
SELECT count(*) AS total, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'updated') AS updated,
  count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome <> 'rejected') AS done,
  min(_id) FILTER (outcome = 'rejected') AS failure_id FROM o
""")
def upsert_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a write by id: created, updated, and bodies that are not a JSON object."""
    body = F.when(F.col("p_partkey") % 10 == 3, F.lit("[1]")).otherwise(F.to_json(F.struct("p_name", "p_size")))
    updates = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), text("p_partkey")).alias("_id"), body.alias("_source"))
    base = table(spark, sf_dir, "customer").select(F.concat(F.lit("p"), text("c_custkey")).alias("_id"))
    outcomes = write_outcomes(base, check_bodies(updates)).withColumn(
        "_failure", F.lit(None).cast("struct<cause_type:string,cause_reason:string>")
    )
    return outcome_report(outcomes).select(
        "total", "created", "updated", "rejected", "done", F.col("first_failure.id").alias("failure_id")
    )


@query("""
SELECT CAST(doc_id AS VARCHAR) AS _id, md5(text) AS text_md5, n_chars,
  CASE WHEN doc_id % 9 = 4 THEN 'mapper_parsing_exception' WHEN doc_id % 9 = 5 THEN 'mapper_parsing_exception' END AS cause_type
FROM documents
""")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole JSON bodies as typed columns; what does not fit is marked."""
    case = F.col("doc_id") % 9
    length = F.when(case == 4, F.lit("many")).otherwise(text("n_chars"))
    body = F.to_json(F.struct("text", length.alias("n_chars"), "lang"))
    body = F.when(case == 5, F.concat(body, F.lit(" x"))).otherwise(body)
    writes = table(spark, sf_dir, "documents").select(text("doc_id").alias("_id"), body.alias("_source"), "n_chars")
    schema = declared_schema(
        '{"mappings": {"properties": {"text": {"type": "text"}, "n_chars": {"type": "long"}}}}'
    )
    parsed = parse_documents(writes.drop("n_chars"), schema)
    return parsed.join(writes.select("_id", F.col("n_chars").alias("n")), "_id").select(
        "_id", F.md5("text").alias("text_md5"),
        F.when(F.col("_failure").isNull(), F.col("n_chars")).otherwise(F.col("n")).alias("n_chars"),
        "_failure.cause_type",
    )


@query("""
SELECT p_name || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS definition
FROM part WHERE p_size % 5 <> 0 OR p_partkey % 3 = 0
""")
def registry_put_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry after deleting some names and putting others (which may be new again)."""
    part = table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", text("p_partkey")))
    registry = part.select("name", F.col("p_size").alias("definition"))
    deleted = delete_keys(registry, part.filter(F.col("p_size") % 5 == 0), on=("name",))
    puts = part.filter(F.col("p_partkey") % 3 == 0).select("name", (F.col("p_size") + 1).alias("definition"))
    return upsert(deleted, puts, keys=("name",))


# aliases

_MEMBERSHIP_SQL = """
WITH m AS (SELECT 'prod-' || o_custkey AS alias, 'prod-' || o_custkey || '_' || o_orderstatus AS version_name FROM orders)
"""


def _membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alias per customer; at most three versions each, repeated per order."""
    alias = F.concat(F.lit("prod-"), text("o_custkey"))
    return table(spark, sf_dir, "orders").select(
        alias.alias("alias"), F.concat(alias, F.lit("_"), "o_orderstatus").alias("version_name")
    )


@query(_MEMBERSHIP_SQL + "SELECT alias, string_agg(DISTINCT version_name, ',' ORDER BY version_name) AS members FROM m GROUP BY alias")
def alias_members_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alias_members(_membership(spark, sf_dir)).withColumn("members", F.array_join("members", ","))


@query(
    _MEMBERSHIP_SQL
    + """
SELECT DISTINCT alias, version_name FROM m
WHERE NOT (alias IN (SELECT 'prod-' || c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD') AND version_name LIKE '%\\_F' ESCAPE '\\')
UNION SELECT 'prod-' || c_custkey, 'prod-' || c_custkey || '_new' FROM customer WHERE c_mktsegment = 'HOUSEHOLD'
"""
)
def alias_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old members go and new ones come, for many aliases at once."""
    alias = F.concat(F.lit("prod-"), text("c_custkey"))
    household = table(spark, sf_dir, "customer").filter("c_mktsegment = 'HOUSEHOLD'").select(alias.alias("alias"))
    removes = household.withColumn("version_name", F.concat("alias", F.lit("_F")))
    adds = household.withColumn("version_name", F.concat("alias", F.lit("_new")))
    return swap(_membership(spark, sf_dir), removes, adds)


@query(
    _MEMBERSHIP_SQL
    + """, c AS (SELECT alias, string_agg(DISTINCT version_name, ',' ORDER BY version_name) AS v FROM m GROUP BY alias),
w AS (SELECT 'prod-' || c_custkey AS alias, 'prod-' || c_custkey || '_O' || CASE WHEN c_custkey % 2 = 0
  THEN ',prod-' || c_custkey || '_P' ELSE '' END AS v FROM customer)
SELECT coalesce(c.alias, w.alias) AS alias, coalesce(c.v = w.v, FALSE) AS same FROM c FULL JOIN w ON c.alias = w.alias
"""
)
def alias_same_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether wanted and present members are equal (then a swap is not needed)."""
    alias = F.concat(F.lit("prod-"), text("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", alias.alias("alias"))
    suffixes = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("_O"), F.lit("_P"))).otherwise(F.array(F.lit("_O")))
    wanted = customers.select("alias", F.explode(suffixes).alias("s")).select(
        "alias", F.concat("alias", "s").alias("version_name")
    )
    return same_members(wanted, _membership(spark, sf_dir))


@query("""
SELECT o_orderkey, 'orders_' || o_orderstatus AS version_name FROM orders
WHERE 'orders_' || o_orderstatus IN (SELECT 'orders_' || substr('FOP', CAST(s_suppkey % 3 AS INT) + 1, 1) FROM supplier WHERE s_nationkey = 7)
""")
def alias_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("orders_"), "o_orderstatus").alias("version_name"))
    letter = F.substring(F.lit("FOP"), (F.col("s_suppkey") % 3 + 1).cast("int"), F.lit(1))
    membership = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("nation-"), text("s_nationkey")).alias("alias"), F.concat(F.lit("orders_"), letter).alias("version_name")
    )
    return scan_alias(rows, membership, "nation-7")


@query(
    _MEMBERSHIP_SQL
    + """
SELECT 'prod-' || c_custkey || '_' || s AS version_name FROM customer, (VALUES ('F'), ('O'), ('P'), ('X')) AS v(s)
WHERE 'prod-' || c_custkey || '_' || s NOT IN (SELECT version_name FROM m)
"""
)
def unreferenced_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.explode(F.array(*[F.lit(s) for s in "FOPX"]))
    versions = table(spark, sf_dir, "customer").select("c_custkey", letters.alias("s")).select(
        F.concat(F.lit("prod-"), text("c_custkey"), F.lit("_"), "s").alias("version_name")
    )
    return unreferenced(versions, _membership(spark, sf_dir))


# stored transforms

_PARTS_SQL = """
WITH p AS (SELECT 'p' || p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN 'new' WHEN p_partkey % 5 = 1 THEN 'changed'
  WHEN p_partkey % 50 = 2 THEN 'error' ELSE 'same' END AS status FROM part)
"""


def _pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as transforms: some without a stored definition, some stored with another size."""
    part, size = table(spark, sf_dir, "part"), text("p_size")
    name = F.concat(F.lit("p"), text("p_partkey"))
    wanted = F.concat(F.lit('{"processors":[{"set":{"field":"size","value":'), size, F.lit("}}]}"))
    live_size = F.when(F.col("p_partkey") % 5 == 1, text(F.col("p_size") + 1)).otherwise(size)
    live = F.concat(F.lit('{"processors": [ {"set": {"value": '), live_size, F.lit('.0, "field": "size"}} ]}'))
    live = F.when(F.col("p_partkey") % 50 == 2, F.lit("{")).otherwise(live)
    desired = part.select(name.alias("name"), wanted.alias("definition"))
    stored = part.filter(F.col("p_partkey") % 5 != 0).select(
        F.concat(F.lit("env-"), name).alias("name"), live.alias("definition")
    )
    return pipeline_changes(desired, stored, "env")


@query(_PARTS_SQL + "SELECT key, 'env-' || key AS name, status FROM p")
def transform_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pipelines(spark, sf_dir).select("key", "name", "status")


@query(
    _PARTS_SQL
    + """
SELECT o_orderkey, o_orderstatus <> 'F' AND CASE WHEN o_orderstatus = 'P' THEN 'p0' ELSE 'p' || o_custkey END IN
  (SELECT key FROM p WHERE status IN ('new', 'changed')) AS pipeline_changed FROM orders
"""
)
def transform_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sets use a changed transform; a third use none, a third use one and the same."""
    status = F.col("o_orderstatus")
    name = F.when(status == "F", "").when(status == "P", "env-p0").otherwise(F.concat(F.lit("env-p"), text("o_custkey")))
    sets = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("pipeline"))
    changed = changed_only(_pipelines(spark, sf_dir)).select("name")
    return using_changed(sets, changed, F.col("pipeline"), "o_orderkey").select("o_orderkey", "pipeline_changed")
