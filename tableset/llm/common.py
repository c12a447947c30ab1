"""Helpers of the operators: written intermediate tables, words, hashes."""

from __future__ import annotations

import string

import xxhash
from pyspark.sql import DataFrame, SparkSession

from tableset.session import fresh_path, setting

#: Rows that a Python worker gets at once where a written table is made.
BATCH_ROWS = 1000
#: Maps the bytes A-Z to a-z and nothing else, so UTF-8 texts of any script stay valid.
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost
    executor costs no more than reading it again. Python functions of ``df`` get their rows
    in batches of ``batch_rows``, so that whole texts take little memory."""
    path = fresh_path(df.sparkSession, label)
    with setting(df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows)):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and return, with A-Z lower-cased."""
    return text.encode().translate(LOWER).split() if text else []


class WordHashes(dict):
    """64-bit hash of a word, kept for words seen lately; at most ``limit`` are kept."""

    def __init__(self, limit: int = 100_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found
