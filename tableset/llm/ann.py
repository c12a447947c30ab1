"""Approximate nearest neighbours by few stable projections in a kd-tree.

Rows are projected to ``m`` Gaussian (2-stable) coordinates, so the squared distance of two
projections is the squared distance of the vectors times a chi-square variable of m degrees.
A block's projections lie in a kd-tree. A query takes the leaves in order of their projected
distance and verifies their vectors, until the chi-square test holds: a vector nearer than the
k-th best would be projected beyond the next leaf with probability 1 - ``certainty`` at most.
The largest inner product becomes the smallest distance by one more coordinate, which gives
all rows of a block the same length.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableset.llm.vectors import BATCH, Best, search, usable

#: Rows of a leaf, and numbers of leaves after which the test is made.
LEAF, ROUNDS = 64, (2, 8, 16, 24, 32, 40, 48, 56)


def chi_square_quantile(p: float, degrees: int) -> float:
    """Quantile for an even number of degrees, whose distribution function is a finite sum."""
    if degrees % 2:
        raise ValueError("the number of projections must be even")
    low, high = 0.0, 100.0 * degrees
    for _ in range(100):
        x = (low + high) / 4
        below = 1 - math.exp(-x) * sum(x**i / math.factorial(i) for i in range(degrees // 2))
        low, high = (2 * x, high) if below < p else (low, 2 * x)
    return high


class KdTree:
    """Leaves of a kd-tree: ``order`` of the points, ``ends`` of the leaves, and their boxes."""

    def __init__(self, points: np.ndarray):
        todo, leaves = [np.arange(len(points))], []
        while todo:
            part = todo.pop()
            if len(part) <= LEAF:
                leaves.append(part)
                continue
            axis = int(np.ptp(points[part], axis=0).argmax())
            half = len(part) // 2
            part = part[np.argpartition(points[part, axis], half)]
            todo += [part[half:], part[:half]]
        self.order, self.ends = np.concatenate(leaves), np.cumsum([len(x) for x in leaves])
        self.low = np.array([points[x].min(0) for x in leaves])
        self.high = np.array([points[x].max(0) for x in leaves])

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each leaf's box."""
        out = np.zeros((len(queries), len(self.ends)))
        for i in range(queries.shape[1]):
            q = queries[:, i, None]
            out += np.maximum(0, np.maximum(self.low[:, i] - q, q - self.high[:, i])) ** 2
        return out


def _block(k: int, m: int, certainty: float, seed: int):
    stop = chi_square_quantile(certainty, m)

    def step(names: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, best: Best) -> None:
        if not len(ids):
            return
        length = (rows**2).sum(1)
        longest = length.max()
        axes = np.random.default_rng(seed).standard_normal((rows.shape[1] + 1, m))
        points = np.hstack([rows, np.sqrt(longest - length)[:, None]]) @ axes
        tree = KdTree(points)
        ids, rows = ids[tree.order], rows[tree.order]
        starts = np.append(0, tree.ends[:-1])
        for low in range(0, len(names), BATCH):
            batch = np.arange(low, min(low + BATCH, len(names)))
            asked = queries[batch]
            near = tree.distances(asked @ axes[:-1])
            turn = np.argsort(np.argsort(near, axis=1, kind="stable"), axis=1)
            scores = np.full((len(batch), len(ids)), -np.inf)
            floor, before = best.least[batch].copy(), 0
            for after in (*[r for r in ROUNDS if r < len(tree.ends)], len(tree.ends)):
                # The test: distance**2 of the k-th best is |q|**2 + longest - 2 * its score.
                kth = (asked**2).sum(1) + longest - 2 * floor
                reach = np.where(np.isfinite(kth), np.maximum(kth, 0) * stop * (1 + 1e-9) + 1e-12, np.inf)
                open_leaves = (turn >= before) & (turn < after) & (near <= reach[:, None])
                if not open_leaves.any() and before:
                    break
                for leaf in np.flatnonzero(open_leaves.any(0)):
                    who, part = np.flatnonzero(open_leaves[:, leaf]), slice(starts[leaf], tree.ends[leaf])
                    found = asked[who] @ rows[part].T
                    found[ids[part] == names[batch[who], None]] = -np.inf
                    scores[who, part] = found
                if len(ids) > k:
                    floor = np.maximum(floor, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
                before = after
            slack = 1e-9 * np.sqrt((asked**2).sum(1) * longest)
            for i, q in enumerate(batch):
                rivals = np.flatnonzero((scores[i] >= floor[i] - slack[i]) & (scores[i] > -np.inf))
                if len(rivals):
                    # Summed component by component, so equal vectors have equal scores wherever they lie.
                    best.add(q, np.cumsum(rows[rivals] * asked[i], axis=1)[:, -1], ids[rivals])

    return lambda: step


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, m: int = 8, certainty: float = 0.95, seed: int = 1) -> DataFrame:
    """The ``k`` nearest rows found, by inner product, of each row whose id is divisible by ``every``.

    Candidates are all rows but those with the query's id; ties go to the smaller id. Returns
    ``query_id``, ``rank``, ``vec_id``, ``score`` (inner product in doubles). Vectors that are
    NULL, empty, zero, or hold NULL or non-finite components take no part, nor rows without id;
    each of repeated rows is a candidate, and a query. An empty table gives no row. Every row
    is indexed, by the task that reads it; the projections are the same everywhere.
    """
    rows = usable(vectors, id_col, vector_col).filter(F.exists("v", lambda x: x != 0))
    return search(rows, F.col("id") % every == 0, k, "double", _block(k, m, certainty, seed))
