"""Exact top-k by integer inner product, with sorted access only.

Every component of a block of vectors is a sorted list. Lists are read from the end that a
query's sign prefers, to the same depth in all of them. A vector's lower bound takes the worst
value of a list for what isn't read of it yet, its upper bound the value at the reading
position. When few vectors can still reach the k-th best lower bound, or score of an earlier
block, reading stops and the scores of those few are resolved. Depths grow by fixed shares; at
the last one both bounds are the score, so the result is exact whatever the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableset.llm.vectors import BATCH, Best, search, usable

#: Shares of the lists read before each test; vectors that may be left for a query.
DEPTHS, FEW = (0.25, 0.5, 0.75), 64
#: Scores up to this are exact as doubles.
_EXACT = 1 << 53


class Lists:
    """Sorted lists of a block's components: for each vector its position in every list."""

    def __init__(self, rows: np.ndarray):
        self.rows, n = rows, len(rows)
        order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, order, 0)
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(n)[:, None], order.shape), 0)

    def bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """What lower and upper bounds multiply with a query's positive and negative parts."""
        n, v = len(self.rows), self.values
        high, low = self.place >= n - depth, self.place < depth
        worst = np.hstack([np.where(high, self.rows, v[0]), np.where(low, self.rows, v[-1])])
        frontier = np.hstack([np.where(high, self.rows, v[n - depth]), np.where(low, self.rows, v[depth - 1])])
        return worst, frontier


def _block(k: int):
    def step(names: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, best: Best) -> None:
        if not len(ids):
            return
        if np.abs(rows).max(initial=1) * np.abs(queries).max(initial=1) * rows.shape[1] >= _EXACT:
            _large(names, queries, ids, rows, best)
            return
        lists = Lists(rows)
        depths = [max(1, int(share * len(ids))) for share in DEPTHS]
        read = [lists.bounds(d) for d in depths]
        for low in range(0, len(names), BATCH):
            left = np.arange(low, min(low + BATCH, len(names)))
            for worst, frontier in [*read, (None, None)]:
                own = ids[:, None] == names[left]
                signed = np.hstack([np.maximum(queries[left], 0), np.minimum(queries[left], 0)]).T
                if frontier is None:
                    lower = upper = rows @ queries[left].T
                else:
                    lower, upper = worst @ signed, frontier @ signed
                lower, upper = np.where(own, -np.inf, lower), np.where(own, -np.inf, upper)
                floor = best.least[left]
                if len(ids) > k:
                    floor = np.maximum(floor, np.partition(lower, len(ids) - k, axis=0)[len(ids) - k])
                able = (upper >= floor) & (upper > -np.inf)
                done = able.sum(0) <= FEW if frontier is not None else np.ones(len(left), bool)
                for i in np.flatnonzero(done):
                    rivals = np.flatnonzero(able[:, i])
                    if len(rivals):
                        best.add(left[i], (rows[rivals] @ queries[left[i]]).astype(np.int64), ids[rivals])
                left = left[~done]
                if not len(left):
                    break

    return lambda: step


def _large(names: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, best: Best) -> None:
    """Components so large that doubles would round: whole numbers of any size, all lists read to their ends."""
    limit = (1 << 63) - 1
    rows = np.array([[int(x) for x in r] for r in rows], object)
    for i, (name, query) in enumerate(zip(names, queries)):
        scores = rows @ np.array([int(x) for x in query], object)
        other = np.flatnonzero(ids != name)
        best.add(i, np.array([max(-limit, min(limit, scores[j])) for j in other], np.int64), ids[other])


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """The ``k`` rows of the largest integer inner product with each row whose id is divisible by ``every``.

    Components count as floor(scale * x). Candidates are all rows but those with the query's
    id; ties go to the smaller id. Returns ``query_id``, ``rank``, ``vec_id``, ``score``.
    Vectors that are NULL, empty, or hold NULL or non-finite components take no part, nor rows
    without id; each of repeated rows is a candidate, and a query. An empty table gives no row.
    Scores outside 64 bits stop at the largest number there is.
    """
    rows = usable(vectors, id_col, vector_col)
    # floor() of a double gives a long in Spark, which large components don't fit.
    whole = rows.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < 1e15, F.floor(x * scale).cast("double")).otherwise(x * scale)))
    return search(whole, F.col("id") % every == 0, k, "long", _block(k))
