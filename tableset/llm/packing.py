"""Shards of indivisible groups by best-fit-decreasing bin packing.

Groups of one size are interchangeable, so sizes and their counts are packed instead of
groups. A class of many groups of one size is split into parts, so that ranks within a part
are found in many tasks. The packing itself is one pass over the classes in one task: n
different sizes take n * n / 2 bytes at least, so 100 TB have fewer than 15 million. Bins
lie in a balanced tree by remaining capacity; the tightest that fits takes as many groups of
the class as it has room for, which is where best fit would put them one by one.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableset.llm.common import stored

#: Groups of one size that are ranked in one task; rows of a shard that are.
PART_GROUPS, PART_ROWS = 4096, 1024
_PLAN = "bytes long, part int, bin int, low long, high long"


class Tree:
    """Ordered set as a treap: the random priorities keep it balanced."""

    def __init__(self):
        self._random, self._root = random.Random(0), None

    def add(self, key: tuple) -> None:
        left, right = self._split(self._root, key)
        self._root = self._merge(self._merge(left, [key, self._random.random(), None, None]), right)

    def take_ceiling(self, key: tuple) -> tuple | None:
        """Remove and return the smallest element that isn't less than ``key``."""
        left, right = self._split(self._root, key)
        found, right = self._take_first(right)
        self._root = self._merge(left, right)
        return found

    def _take_first(self, node):
        if node is None:
            return None, None
        if node[2] is None:
            return node[0], node[3]
        found, node[2] = self._take_first(node[2])
        return found, node

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, left, right):
        if left is None or right is None:
            return left or right
        if left[1] > right[1]:
            left[3] = self._merge(left[3], right)
            return left
        right[2] = self._merge(left, right[2])
        return right


def best_fit_decreasing(classes: list[tuple[int, int, int]], capacity: int, bins: int | None = None) -> list[tuple] | None:
    """``classes``: (size, part, count). Returns (size, part, bin, low, high): the groups of the
    part with ranks low to high (exclusive) go to the bin. A group above the capacity has a bin
    of its own. None if more than ``bins`` bins are needed."""
    tree, out, used = Tree(), [], 0
    for size, part, count in sorted(classes, key=lambda x: (-x[0], x[1])):
        low = 0
        while low < count:
            room, at = tree.take_ceiling((size, -1)) or (max(capacity, size), used)
            if at == used:
                if used == bins:
                    return None
                used += 1
            fit = min(count - low, room // size)
            out.append((size, part, at, low, low + fit))
            tree.add((room - fit * size, at))
            low += fit
    return out


def even_bins(classes: list[tuple[int, int, int]], bins: int) -> list[tuple]:
    """Pack into ``bins`` bins at nearly the smallest capacity that does."""
    total, rest = sum(s * n for s, _, n in classes), bins
    # Groups above the mean of what is left have bins of their own; the others share the rest.
    for size, _, count in sorted(classes, reverse=True):
        while count and rest > 1 and size * rest > total:
            total, rest, count = total - size, rest - 1, count - 1
    mean = -(-total // rest)
    slack, step = 0, max(1, mean // 10_000)
    while (found := best_fit_decreasing(classes, mean + slack, bins)) is None:
        slack, step = slack + step, 2 * step
    low, high = slack - step // 2, slack
    while high - low > max(1, mean // 1000):
        middle = (low + high) // 2
        closer = best_fit_decreasing(classes, mean + middle, bins)
        found, low, high = (closer, low, middle) if closer else (found, middle, high)
    return found


def pack(groups: DataFrame, bins: int | None = None, capacity: int | None = None) -> DataFrame:
    """Add the column ``bin`` to ``groups`` (``bytes`` long above 0; ``h1`` and ``h2``, longs that order equal sizes).

    Either ``bins`` evenly filled bins, or as few bins of ``capacity`` as best fit decreasing needs.
    """
    if (bins is None) == (capacity is None):
        raise ValueError("give bins or capacity")
    classes = groups.groupBy("bytes").agg(F.count("*").alias("n"))
    classes = classes.select(F.col("bytes").alias("b"), F.ceil(F.col("n") / PART_GROUPS).cast("int").alias("parts"))
    parted = groups.join(classes, F.col("bytes") == F.col("b")).withColumn("part", F.pmod("h1", "parts").cast("int")).drop("b", "parts")
    counts = parted.groupBy("bytes", "part").agg(F.count("*").alias("n"))

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [x for f in frames for x in f[["bytes", "part", "n"]].itertuples(index=False, name=None)]
        if rows:
            found = even_bins(rows, bins) if bins else best_fit_decreasing(rows, capacity)
            yield pd.DataFrame(found, columns=["bytes", "part", "bin", "low", "high"])

    planned = stored(counts.repartition(1).mapInPandas(plan, _PLAN), "packing")
    rank = F.row_number().over(Window.partitionBy("bytes", "part").orderBy("h1", "h2")) - 1
    ranked = parted.withColumn("rank", rank)
    return ranked.join(planned, ["bytes", "part"]).filter("rank >= low and rank < high").drop("part", "rank", "low", "high")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """Deal documents to ``shards`` shards of nearly equal bytes; equal texts stay together.

    Returns ``id``, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``, ``shard`` and
    ``slot`` (0 to n - 1 in each shard), a row for each row of ``docs``. NULL texts count as
    empty and share a group with empty ones. Repeated rows have slots of their own. A group
    above the mean size has a shard of its own, and the others share the rest evenly.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(text, F.lit(1)).alias("h2"),
    )
    thin = stored(thin, "sizes")
    groups = thin.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"))
    groups = pack(groups, bins=shards).select("h1", "h2", F.col("bin").alias("shard"))
    placed = thin.join(groups, ["h1", "h2"])
    buckets = max(1, thin.count() // (shards * PART_ROWS))
    placed = stored(placed.withColumn("bucket", F.pmod(F.xxhash64("id", "h1"), F.lit(buckets))), "placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "h1", "h2")) - 1
    slots = placed.withColumn("own", own).join(offsets, ["shard", "bucket"])
    return slots.select("id", "size", "text_crc32", "shard", (F.col("own") + F.col("offset")).cast("long").alias("slot"))
