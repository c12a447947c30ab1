"""Searches of a query set against all rows of a vector table, in blocks.

Queries come in chunks of bounded size, which are broadcast; the rows stay where they are
read. A task gathers its rows to blocks, keeps the best rows so far of each query, and
returns them at its end, so what a later block must beat is known early and a query sends
``k`` rows a task, however many it met.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a chunk (a query has a few hundred bytes), rows of a block, queries handled at once.
CHUNK, BLOCK, BATCH = 8192, 4096, 512


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` of the rows that have an id and a vector of finite components only."""
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & finite)
    return kept.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def matrix(ids: pa.Array, vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a batch; vectors of another length than ``width`` take no part."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    fits = pa.array(sizes == width)
    ids, vectors = ids.filter(fits), vectors.filter(fits)
    return np.asarray(ids.to_numpy(zero_copy_only=False), np.int64), np.asarray(vectors.flatten()).astype(np.float64).reshape(-1, width)


class Best:
    """The ``k`` best rows so far of each query: by score, ties to the smaller id."""

    def __init__(self, queries: int, k: int, kind: type):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.scores = [np.empty(0, kind) for _ in range(queries)]
        self.ids = [np.empty(0, np.int64) for _ in range(queries)]

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores[query], scores), np.append(self.ids[query], ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[query] = scores[order[-1]]


#: Search of one block: (query ids, queries, row ids, rows, best rows so far of each query).
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Best], None]


def search(rows: DataFrame, queries: Column, k: int, score_type: str, block_search: Callable[[], Search]) -> DataFrame:
    """The ``k`` best of ``rows`` (``id``, ``v``) for each of those for which ``queries`` holds.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``. Each row that is a query
    is one, also if ids repeat. Vectors of each length are searched on their own.
    """
    spark = rows.sparkSession
    asked = rows.filter(queries)
    kind = np.int64 if score_type == "long" else np.float64
    found = spark.createDataFrame([], f"chunk int, q int, query_id long, vec_id long, score {score_type}")
    first = 0
    for width, n in sorted(asked.groupBy(F.size("v")).count().collect()):
        chunks = -(-n // CHUNK)
        for chunk in range(chunks):
            part = asked.filter(F.size("v") == width).filter(F.pmod(F.xxhash64("id", "v"), F.lit(chunks)) == chunk).toArrow()
            names, values = matrix(part["id"], part["v"], width)
            shared = spark.sparkContext.broadcast((names, values))
            found = found.union(rows.mapInArrow(_task(shared, width, k, kind, block_search, first + chunk), found.schema))
        first += chunks
    order = Window.partitionBy("chunk", "q").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _task(shared, width: int, k: int, kind: type, block_search: Callable[[], Search], chunk: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values = shared.value
        best, step = Best(len(names), k, kind), block_search()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if held:
                ids, rows = (np.concatenate(x) for x in zip(*held))
                step(names, values, ids, rows, best)
                held.clear()

        for batch in batches:
            ids, rows = matrix(batch.column(0), batch.column(1), width)
            for i in range(0, len(ids), BLOCK):
                room = BLOCK - sum(len(x) for x, _ in held)
                part = slice(i, i + BLOCK)
                if len(ids[part]) > room:
                    flush()
                held.append((ids[part], rows[part]))
        flush()
        sizes = [len(x) for x in best.ids]
        at = np.repeat(np.arange(len(names)), sizes)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(at), chunk, np.int32)),
                pa.array(at.astype(np.int32)),
                pa.array(names[at]),
                pa.array(np.concatenate([np.empty(0, np.int64), *best.ids])),
                pa.array(np.concatenate([np.empty(0, kind), *best.scores])),
            ],
            names=["chunk", "q", "query_id", "vec_id", "score"],
        )

    return task
