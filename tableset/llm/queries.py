"""The registered queries of the operators, with SQL where it can state their results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableset.llm import ann, bpe, filter_audit, license_scan, line_dedup, minmax_dedup, mixing, packing, prefix_trie, quality_rules, secret_scan, top_k, toxicity
from tableset.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query(r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM documents),
keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
    SELECT k.doc_id, k.pos, k.line, coalesce(s.keeper <> k.doc_id, false) AS gone
    FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least three of them share."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256)
    return out.select("row.doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


@query()
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("word_bpe_49k.json"))
    tokens = table(spark, sf_dir, "documents").select("doc_id", tokenizer.round_trip(F.col("text")).alias("tokens"))
    return tokens.select("doc_id", "tokens.*").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query(r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, list_distinct(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w
        ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
""")
def op6_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, on word pairs."""
    out = minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)
    return out.withColumnRenamed("id", "doc_id")


@query()
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, scanned from an empty ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = secret_scan.scan(docs)
    all_spans = F.concat_ws(",", F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in secret_scan.RULES]
    return found.select("row.doc_id", *counts, F.sha2(all_spans.cast("binary"), 256).alias("base_sha256"), all_spans.alias("spans"))


@query()
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query()
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of nearly equal bytes, equal texts together."""
    out = packing.shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return out.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    classifier = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), classifier.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query()
def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours of every twentieth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query(r"""
WITH v AS (
    SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
""")
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest integer inner products of every hundredth vector."""
    return top_k.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


@query()
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence passages of all documents."""
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    spans = F.concat_ws(",", F.transform("spans", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))))
    best = F.array_max(F.transform("spans", lambda x: x["dice"]))
    names = F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("spans", lambda x: x["license"]))))
    return found.select(F.col("id").alias("doc_id"), F.size("spans").cast("long").alias("n_spans"), names.alias("licenses"), best.alias("best_dice"), spans.alias("spans"))


@query(r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
windows AS (SELECT r, i, w[i:i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM windows QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
repeated AS (SELECT r, count(DISTINCT pos) AS n FROM again GROUP BY r),
held AS (SELECT r, line, count(*) - 1 AS n FROM (SELECT r, unnest(lines) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
doubled AS (SELECT r, CAST(sum(n) AS BIGINT) AS n FROM held GROUP BY r),
m AS (
    SELECT d.r, doc_id, len(w) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
           length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
           coalesce(doubled.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
    FROM d LEFT JOIN repeated ON d.r = repeated.r LEFT JOIN doubled ON d.r = doubled.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_upper > 50 * word_chars
            OR 100 * word_chars < 250 * n_words OR 100 * word_chars > 1200 * n_words) AS kept
FROM b
""")
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdicts of all documents, from the ledger of rule bits."""
    entries, failed = quality_rules.ledger(table(spark, sf_dir, "documents")), F.col("failed")
    return entries.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.rejects(failed, quality_rules.BASE).alias("base_failed"),
        (~quality_rules.rejects(failed, quality_rules.POLICY)).alias("kept"),
    )


@query(r"""
WITH RECURSIVE t AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
           + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT
           + 8 * (regexp_matches(text, '[#$%&*|]'))::INT
           + 16 * coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)::INT AS mask
    FROM t LEFT JOIN marks ON t.doc_id = marks.doc_id),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
orders AS (
    SELECT '' AS prefix, 0 AS applied
    UNION ALL SELECT prefix || letter, applied | bit FROM orders, f WHERE applied & bit = 0),
steps AS (
    SELECT o.prefix AS filter_order, s.step::INT AS step, f.letter, f.bit,
           coalesce((SELECT applied FROM orders p WHERE p.prefix = left(o.prefix, s.step - 1)), 0) AS applied
    FROM orders o, range(1, 6) s(step), f WHERE length(o.prefix) = 5 AND f.letter = o.prefix[s.step]),
each AS (
    SELECT part, filter_order, step, letter, CAST(sum(n) FILTER (mask & (applied | bit) = 0) AS BIGINT) AS kept,
           CAST(sum(n) FILTER (mask & applied = 0 AND mask & bit <> 0) AS BIGINT) AS removed,
           CAST(sum(n) FILTER (mask & applied <> 0 AND mask & bit <> 0) AS BIGINT) AS redundant,
           CAST(sum(n) FILTER (mask = bit) AS BIGINT) AS unique_fails,
           CAST(sum(good) FILTER (mask & applied = 0 AND mask & bit <> 0) AS BIGINT) AS good_lost,
           CAST(sum(toxic) FILTER (mask & applied = 0 AND mask & bit <> 0) AS BIGINT) AS toxic_lost
    FROM steps, cells GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
       coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley
FROM each
""")
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all orders of the five filters, for each source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(r"""
WITH t AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT c, n, c - c % 5 AS base, xor(4294967295, list_reduce(
        list_concat([4294967295::BIGINT], [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]), lambda a, x: list_reduce(
            list_concat([xor(a, x)], range(8)), lambda b, i: xor(b >> 1, 3988292384 * (b & 1))))) % 9 AS h
    FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
shifts AS (SELECT convs.c, convs.base, convs.h, least(convs.h, coalesce(b.n, 0)) - convs.h AS shift FROM convs LEFT JOIN convs b ON b.c = convs.base),
r AS (
    SELECT s.c, t.pos AS p, t.role, t.text FROM shifts s JOIN t ON t.c = s.base AND t.pos <= s.h
    UNION ALL SELECT s.c, t.pos + s.shift, t.role, t.text FROM shifts s JOIN t ON t.c = s.c AND t.pos > s.h),
prefixes AS (
    SELECT c, p AS d, strlen(text) AS bytes,
           sha256(string_agg(sha256(length(role) || ':' || role || text), '/') OVER (PARTITION BY c ORDER BY p)) AS node FROM r),
mem AS (
    SELECT c, d, bytes, node, coalesce(lag(node) OVER (PARTITION BY c ORDER BY d), '') AS parent FROM prefixes
    UNION ALL SELECT c, 0, 0, '', NULL FROM convs),
ends AS (SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM (SELECT c, arg_max(node, d) AS node FROM mem GROUP BY c) GROUP BY node),
nodes AS (SELECT node, any_value(parent) AS parent, any_value(d) AS depth, any_value(bytes) AS bytes, min(c) AS conv_id, count(*) AS n_convs FROM mem GROUP BY node),
full_nodes AS (SELECT nodes.*, (SELECT count(*) FROM nodes k WHERE k.parent = nodes.node) AS n_children FROM nodes),
below AS (SELECT DISTINCT a.node AS top, b.node AS node FROM mem a JOIN mem b ON a.c = b.c AND b.d >= a.d),
sums AS (
    SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens
    FROM below JOIN full_nodes f ON f.node = below.node GROUP BY top)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM full_nodes f JOIN sums ON sums.top = f.node LEFT JOIN nodes p ON p.node = f.parent LEFT JOIN ends ON ends.node = f.node
""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all conversations, rebuilt with the first turns of their groups."""
    convs, turns = prefix_trie.rebuilt(prefix_trie.turns_of(table(spark, sf_dir, "conversations")))
    return prefix_trie.trie(convs, turns)
