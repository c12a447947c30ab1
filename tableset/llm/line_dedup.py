"""Lines that many documents share, dropped from all but one of them.

Lines become 128-bit hashes in one pass; 64 bits are the key, 64 the fingerprint. One
aggregation counts the documents of each key and finds the largest id. All keys go to
shards by key; a shard is one minimal perfect hash and, at its indexes, arrays of
fingerprints, counts and largest ids. The documents' lines are dealt to the shards by key
and probe the arrays, whose counts decide; texts meet the positions of the lines to drop. A
key in so many documents that its shard would become large is probed where the lines are: at
most ``HEAVY_KEYS`` such keys exist by the way their limit is set, and their arrays are
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableset.llm.common import LOWER, stored
from tableset.llm.perfect_hash import PerfectHash

SPACE = b" \t\n\v\f\r"
#: Lines probed by one group, about.
SHARD_LINES = 4096
#: Bound of the keys that are broadcast (28 bytes each).
HEAVY_KEYS = 65_536
_LINES = "id long, text_hash long, pos int, first int, key long, mark long"
_ARRAYS = "shard long, hash binary, marks binary, counts binary, keepers binary, more binary"


def line_keys(text: str | None, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """Position and key of the lines whose keys have ``min_chars`` code points at least."""
    for pos, line in enumerate((text or "").encode().translate(LOWER).split(b"\n")):
        key = line.strip(SPACE)
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            yield pos, key


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _lines(min_chars: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text_hash, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2)):
                seen = set()
                for pos, key in line_keys(text.as_py(), min_chars):
                    h = xxhash.xxh3_128_intdigest(key)
                    rows.append((doc, text_hash, pos, int(h not in seen), _signed(h & 0xFFFFFFFFFFFFFFFF), _signed(h >> 64)))
                    seen.add(h)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, kinds)], names=["id", "text_hash", "pos", "first", "key", "mark"]
            )

    return lines


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    """One shard's arrays. Of keys with the same 64 bits the most frequent stands in the arrays,
    the others in a list of (key, mark, count, keeper)."""
    shard = shard.sort_values(["docs", "mark"], ascending=False)
    again, number = shard.duplicated("key").to_numpy(), shard["shard"].iloc[:1].to_numpy()
    keeper = shard["keeper"].astype("float").isna().to_numpy()
    # A key held by documents without id only: no id is the largest, none of them is dropped.
    keepers = np.where(keeper, np.iinfo(np.int64).min, shard["keeper"].fillna(0).to_numpy(np.int64))
    whole = np.column_stack([*(shard[c].to_numpy(np.int64) for c in ("key", "mark", "docs")), keepers])
    keys, marks, counts, keepers = np.ascontiguousarray(whole[~again].T)
    perfect = PerfectHash.build(keys)
    order = np.argsort(perfect.index(keys))
    return pd.DataFrame({
        "shard": number,
        "hash": [perfect.to_bytes()],
        "marks": [marks[order].tobytes()],
        "counts": [counts[order].tobytes()],
        "keepers": [keepers[order].tobytes()],
        "more": [whole[again].tobytes()],
    })


class Arrays:
    """A shard's perfect hash with its arrays."""

    def __init__(self, row):
        self.hash = PerfectHash.from_bytes(row.hash)
        self.marks, self.counts, self.keepers = (np.frombuffer(x, np.int64) for x in (row.marks, row.counts, row.keepers))
        self.more = np.frombuffer(row.more, np.int64).reshape(-1, 4)

    def probe(self, lines: pd.DataFrame, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Which lines the arrays know, and which of them go."""
        keys, marks = (lines[c].to_numpy(np.int64) for c in ("key", "mark"))
        if not self.hash.n:
            return np.zeros(len(lines), bool), np.zeros(len(lines), bool)
        at = self.hash.index(keys)
        known = (at >= 0) & (self.marks[at] == marks)
        ids = lines["id"].fillna(np.iinfo(np.int64).min).to_numpy(np.int64)
        go = known & (self.counts[at] >= min_docs) & (self.keepers[at] != ids)
        for key, mark, count, keeper in self.more:
            same = (keys == key) & (marks == mark)
            known |= same
            go |= same & (count >= min_docs) & (keeper != ids)
        return known, go


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Positions of the lines to drop, for each document that has any.

    Columns ``id``, ``text_hash`` (of the text they count in), ``dropped`` (array of int).
    """
    spark = docs.sparkSession
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    lines = stored(thin.mapInArrow(_lines(min_chars), _LINES), "lines")
    # Rows of one id are one document; each row without id is one.
    held = lines.groupBy("key", "mark", "id").agg(F.sum("first").alias("texts"), F.count("*").alias("rows"))
    docs_of = F.sum(F.when(F.col("id").isNull(), F.col("texts")).otherwise(1))
    keys = held.groupBy("key", "mark").agg(docs_of.alias("docs"), F.sum("rows").alias("rows"), F.max("id").alias("keeper"))
    keys = stored(keys, "line-keys")
    n = lines.count()
    shards = max(1, n // SHARD_LINES)
    # Keys above this limit hold n lines together at most, so there are HEAVY_KEYS of them at most.
    heavy = F.col("rows") > max(SHARD_LINES // 2, n // HEAVY_KEYS)
    shard = F.pmod("key", F.lit(shards)).alias("shard")
    light = keys.filter(~heavy).select(shard, "key", "mark", "docs", "keeper").groupBy("shard").applyInPandas(_build, _ARRAYS)
    top = keys.filter(heavy).select(F.lit(0).cast("long").alias("shard"), "key", "mark", "docs", "keeper").groupBy("shard").applyInPandas(_build, _ARRAYS)
    shared = spark.sparkContext.broadcast([r.asDict() for r in top.collect()])

    def probe_heavy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [Arrays(pd.Series(x)) for x in shared.value]
        for frame in frames:
            frame["state"] = 0
            for arrays in known:
                found, go = arrays.probe(frame, min_docs)
                frame["state"] = np.where(go, 2, np.where(found, 1, 0))
            yield frame[["id", "text_hash", "pos", "key", "mark", "state"]]

    def probe_shard(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left.iloc[:0][["id", "text_hash", "pos"]]
        return left.loc[Arrays(right.iloc[0]).probe(left, min_docs)[1], ["id", "text_hash", "pos"]]

    probed = lines.mapInPandas(probe_heavy, "id long, text_hash long, pos int, key long, mark long, state int")
    rest = probed.filter("state = 0").withColumn("shard", shard).select("shard", "id", "text_hash", "pos", "key", "mark")
    routed = rest.groupBy("shard").cogroup(light.groupBy("shard")).applyInPandas(probe_shard, "id long, text_hash long, pos int")
    hits = probed.filter("state = 2").select("id", "text_hash", "pos").union(routed)
    return hits.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("dropped"))


def without_lines(texts: pa.Array, dropped: pa.Array) -> pa.Array:
    out = []
    for text, gone in zip(texts, dropped):
        gone, text = set(gone.as_py() or ()), text.as_py()
        out.append(None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop every line whose key is found in ``min_docs`` documents, except in the document of the largest id.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased; shorter
    keys than ``min_chars`` code points never count. Returns ``row`` (the document's row with
    all its columns, whatever their names), ``n_lines``, ``n_dropped``, ``kept`` (text).

    NULL and empty texts have one empty line and stay as they are. Rows with one id are one
    document. Documents without id count, a row each, and are never the largest beside one with
    an id; lines found only in documents without id stay in all of them.
    """
    gone = dropped_lines(docs, id_col, text_col, min_chars, min_docs)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    gone = gone.select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "dropped")
    both = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left")
    cut = F.arrow_udf(without_lines, "string")(F.when(F.col("dropped").isNotNull(), F.col("text")), "dropped")
    return both.select(
        "row",
        (F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(cut, F.col("text")).alias("kept"),
    )
