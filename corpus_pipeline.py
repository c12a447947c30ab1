"""Documents to tokens: toxic texts go, shared lines go, near copies go, sources are mixed, the rest is encoded.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame;
all but the last return the columns of ``docs``, whatever others there are beside doc_id,
text and source.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableset.llm import bpe, line_dedup, minmax_dedup, mixing, toxicity
from tableset.llm.common import stored, table

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _with_text(docs: DataFrame, row: str, text: Column) -> list[Column]:
    """The columns of ``docs`` out of the struct ``row``, with a new text and its length."""
    out = []
    for field in docs.schema.fields:
        new = {"text": text, "n_chars": F.length(text)}.get(field.name)
        out.append(F.col(f"{row}.`{field.name}`") if new is None else new.cast(field.dataType).alias(field.name))
    return out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier scores 0.5 or more; it learns from the labels of the rest of the table."""
    classifier = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(F.struct("*").alias("row"), classifier.score(F.col("text")).alias("score"))
    return scored.filter("score < 0.5").select("row.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines of 20 characters or more that three documents share, but from one of them. Every document stays."""
    kept = line_dedup.dedup_lines(docs).select("row", "kept")
    return kept.select(*_with_text(docs, "row", F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of every component of near duplicates, on shingles of five words.

    Of rows equal in id and text one stays; documents without id link with nothing.
    """
    kept = minmax_dedup.near_duplicates(docs).filter("kept").select("id").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col("doc_id").cast("long").alias("id")).alias("key"), F.xxhash64("text").alias("h"))
    rows = rows.join(kept.select(F.struct("id").alias("key")), "key", "left_semi")
    return rows.dropDuplicates(["key", "h"]).select("row.*")


def taken_text(texts: pa.Array, pieces: pa.Array) -> pa.Array:
    """The words of the pieces: the text itself if they are all of it, else runs of words as they stand, a line each."""
    out = []
    for text, parts in zip(texts, pieces):
        text, runs = text.as_py(), []
        for p in parts.as_py():
            if runs and runs[-1][1] == p["from"]:
                runs[-1][1] = p["to"]
            else:
                runs.append([p["from"], p["to"]])
        words = [m.span() for m in _WORD.finditer(text)]
        whole = runs == [[0, len(words)]]
        out.append(text if whole else "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in runs))
    return pa.array(out, pa.string())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each time, with the words that are taken that often at least."""
    mixed = mixing.mix(docs).filter("taken > 0").select(F.struct("id", "source", "text_hash").alias("key"), "pieces")
    key = F.struct(F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key")).dropDuplicates(["key"])
    often = F.array_max(F.transform("pieces", lambda p: p["times"]))
    both = rows.join(mixed, "key").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), often)))
    cut = F.arrow_udf(taken_text, "string")(F.col("row.text"), F.filter("pieces", lambda p: p["times"] >= F.col("turn")))
    return both.select("row", cut.alias("cut")).select(*_with_text(docs, "row", F.col("cut")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and what they decode to."""
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("word_bpe_49k.json"))
    tokens = docs.select("doc_id", "source", tokenizer.round_trip(F.col("text")).alias("tokens"))
    return tokens.select("doc_id", "source", F.size("tokens.ids").cast("long").alias("n_tokens"), "tokens.ids", "tokens.decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learnt scores and a vocabulary file are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = stored(docs, name)
    return docs
