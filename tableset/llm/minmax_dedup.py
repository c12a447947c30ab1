"""Near duplicates by min-max hashing, confirmed on full shingle sets.

Each permutation of the shingle hashes gives two values of the signature, its smallest and
its largest, so half the permutations are evaluated that a signature of minima needs. The
values form bands (the minima first, then the maxima, so no band holds both values of one
permutation); documents that agree in a band are candidates. With the defaults, 100
permutations give 40 bands of 5 values: a pair of similarity 0.8 meets in no band with
probability (1 - 0.8**5)**40, about 1e-7.

Texts with equal shingle sets become one node first, so copies take no part in the pairing.
A band's bucket is settled in two steps. First
all its members are compared with one leader, so a bucket of n texts that are all alike
takes n comparisons, not their square; a text in many buckets meets the smallest of their
leaders first, and the others only if they are in another component by then. A bucket of more than a block whose members lie in
different components afterwards gets further leaders, one a round, from outside its largest
component. What is in different components still is compared in blocks of bounded size: two
blocks of a bucket meet in one task, which counts all intersections at once and returns a
spanning forest of the links it finds, never the pairs. Members of the bucket's largest
component meet the others' blocks only, not one another's. So no link between candidates is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableset.llm.common import WordHashes, stored, words_of
from tableset.llm.components import merged, moves, roots, with_moves
from tableset.operators.spread import by_keys, lookup

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Shingles whose values are computed at once.
_BLOCK = 8192
#: Shingles of sets that a worker keeps between pairs.
SHINGLES_HELD = 500_000
#: Members of a block.
BLOCK = 512
#: Further leaders of a bucket of more than a block.
LEADERS = 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the different runs of ``width`` words; of fewer words, one hash of all of them."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out * _M2 + h[i : i + len(out)])
    return np.unique(out)


class Signer:
    """Band hashes of a shingle set."""

    def __init__(self, bands: int, rows: int, seed: int):
        if bands * rows % 2:
            raise ValueError("bands * rows must be even: each permutation gives two values")
        random = np.random.default_rng(seed)
        n = bands * rows // 2
        self.bands, self.rows = bands, rows
        self.flip = random.integers(0, 1 << 63, (n, 1), dtype=np.uint64)
        self.factor = random.integers(0, 1 << 63, (n, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def values(self, keys: np.ndarray) -> np.ndarray:
        low, high = [], []
        for i in range(0, len(keys), _BLOCK):
            x = (keys[i : i + _BLOCK] ^ self.flip) * self.factor
            low.append(x.min(1))
            high.append(x.max(1))
        return np.concatenate([np.min(low, 0), np.max(high, 0)])

    def band_keys(self, values: np.ndarray) -> np.ndarray:
        """For each row of signatures, a 64-bit key of each band; the band's number is part of it."""
        parts = values.reshape(len(values), self.bands, self.rows)
        out = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), parts.shape[:2])
        for i in range(self.rows):
            out = _mix(out * _M1 + parts[:, :, i])
        return out.astype(np.uint64).view(np.int64)


def _signatures(width: int, bands: int, rows: int, seed: int):
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, hashes = Signer(bands, rows, seed), WordHashes()
        for batch in batches:
            sizes, digests, values = [], [], []
            for text in batch.column(1):
                keys = shingles(text.as_py(), width, hashes)
                sizes.append(len(keys))
                d = xxhash.xxh3_128_intdigest(keys.tobytes())
                digests.append((d & 0x7FFFFFFFFFFFFFFF, d >> 65))
                if len(keys):
                    values.append(signer.values(keys))
            keys = signer.band_keys(np.array(values, np.uint64).reshape(-1, bands * rows))
            ends = np.append(0, np.cumsum(np.array(sizes) > 0)) * bands
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel(), pa.int64())),
                ],
                names=["id", "n", "d1", "d2", "bands"],
            )

    return signatures


def _linked(width: int, percent: int):
    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, sets, held = WordHashes(), {}, 0

        def of(node, text):
            nonlocal held
            if (node, text) not in sets:
                if held > SHINGLES_HELD:
                    sets.clear()
                    held = 0
                sets[node, text] = shingles(text, width, hashes)
                held += len(sets[node, text])
            return sets[node, text]

        for frame in frames:
            out = []
            for a, b, x, y in zip(frame["a"], frame["b"], frame["text_a"], frame["text_b"]):
                x, y = of(a, x), of(b, y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield frame[["a", "b"]].assign(linked=np.array(out, bool))

    return linked


def forest(sets: list[np.ndarray], side: np.ndarray, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that span what links between sets of different labels join; with two sides only across."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    at, owner = shared[column[count[column] > 1]], owner[count[column] > 1]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    both = np.zeros((n, n), np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        i, j = np.searchsorted(at, (low, low + 4096))
        part = np.zeros((n, 4096), np.float32)
        part[owner[i:j], at[i:j] - low] = 1
        both += part @ part.T
    size = np.array([len(x) for x in sets])
    link = (100 * both >= percent * (size[:, None] + size - both)) & (both > 0) & (labels[:, None] != labels)
    if side.any() and not side.all():
        link &= side[:, None] != side
    found, fresh = [], np.ones(n, bool)
    for root in range(n):
        todo = [root] if fresh[root] else []
        fresh[root] = False
        while todo:
            x = todo.pop()
            near = np.flatnonzero(link[x] & fresh)
            fresh[near] = False
            found += [(x, int(y)) for y in near]
            todo += near.tolist()
    return found


def _block_links(width: int, percent: int):
    """Links within groups of rows that follow each other: columns key, i, j, block, node, label, text."""

    def settle(rows: list[tuple], hashes: WordHashes) -> Iterator[tuple[int, int]]:
        nodes, labels, sides = (np.array([r[i] for r in rows]) for i in (4, 5, 3))
        if len(np.unique(labels)) > 1:
            sets = [shingles(r[6], width, hashes) for r in rows]
            for x, y in forest(sets, sides != sides[0], labels, percent):
                yield min(nodes[x], nodes[y]), max(nodes[x], nodes[y])

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, group, rows = WordHashes(), None, []
        for frame in frames:
            found = []
            for row in frame[["key", "i", "j", "block", "node", "label", "text"]].itertuples(index=False, name=None):
                if row[:3] != group:
                    found += settle(rows, hashes) if rows else ()
                    group, rows = row[:3], []
                rows.append(row)
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        if rows:
            yield pd.DataFrame(settle(rows, hashes), columns=["a", "b"], dtype="int64")

    return links


def _open(left: DataFrame) -> DataFrame:
    """Members (``key``, ``node``, ``label``) of the buckets with two labels or more, with number of ``members``,
    ``top`` (label of the most members), their number ``tops``, and ``lead`` (in buckets of more than a block the
    first member outside of them, and its label). Bands often gather the same members: one bucket of them is enough."""
    digest = (F.sum(F.xxhash64("node").cast("decimal(38,0)")), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")))
    each = left.groupBy("key", "label").agg(F.count("*").alias("n"), F.min("node").alias("node"), *(d.alias(f"s{i}") for i, d in enumerate(digest)))
    buckets = each.groupBy("key").agg(
        F.sum("n").alias("members"), F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("most"), *(F.sum(f"s{i}").alias(f"s{i}") for i in (0, 1))
    )
    buckets = buckets.filter("labels > 1").groupBy("members", "s0", "s1").agg(F.min(F.struct("key", "most")).alias("one"))
    buckets = stored(buckets.select("one.key", "members", F.col("one.most.label").alias("top"), F.col("one.most.n").alias("tops")), "open")
    # Leaders are found among components of buckets, so only one join takes all members.
    outside = lookup(each, buckets.filter(F.col("members") > BLOCK).select("key", "top"), ["key"], "label", how="inner").filter("label <> top")
    leads = outside.groupBy("key").agg(F.min(F.struct("node", "label")).alias("lead"))
    return lookup(left.select("key", "node", "label"), stored(buckets.join(leads, "key", "left"), "open-led"), ["key"], "node", how="inner")


def _blocks(left: DataFrame) -> DataFrame:
    """Members in the pairs ``i``, ``j`` of blocks that meet. A bucket of one block has one pair.
    In larger ones the members outside the largest component fill the first ``few`` blocks,
    which meet all blocks; those of the largest component fill the others, which meet these only."""
    few = F.when(F.col("members") <= BLOCK, 1).otherwise(F.ceil((F.col("members") - F.col("tops")) / BLOCK)).cast("int")
    many = F.when(F.col("members") <= BLOCK, 0).otherwise(F.ceil(F.col("tops") / BLOCK)).cast("int")
    in_many = (F.col("label") == F.col("top")) & (F.col("many") > 0)
    hashed = F.xxhash64("node", F.lit(2))
    block = F.when(in_many, F.col("few") + F.pmod(hashed, F.greatest("many", F.lit(1)))).otherwise(F.pmod(hashed, "few")).cast("int")
    members = left.withColumn("few", few).withColumn("many", many).withColumn("block", block)
    others = F.sequence(F.lit(0), F.when(in_many, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    members = members.withColumn("other", F.explode(others))
    return members.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, seed: int = 1
) -> DataFrame:
    """Components of documents whose shingle sets have ``percent`` or more of their union in common.

    Returns ``id``, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``
    (``id`` is the smallest), a row for each row of ``docs``. Words are runs without ASCII white
    space, A-Z lower-cased; a text of fewer words than ``width`` has its whole sequence as its
    only shingle. Texts that are NULL, empty or without words have no shingle and no link.
    Rows of one id are one document: its links are those of all its texts. A row without id
    links with nothing and is kept, ``component_id`` NULL.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = stored(thin.mapInArrow(_signatures(width, bands, rows, seed), "id long, n long, d1 long, d2 long, bands array<long>"), "sets")
    usable = sets.filter("n > 0 and id is not null")
    classes = stored(usable.groupBy("d1", "d2").agg(F.min("id").alias("node")), "classes")
    firsts = usable.join(classes.withColumnRenamed("node", "id"), ["d1", "d2", "id"]).select(F.col("id").alias("node"), F.explode("bands").alias("key"))
    shared = firsts.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    rest = stored(firsts.join(shared, "key").select("key", "node"), "buckets")
    nodes = rest.select(F.col("node").alias("id")).distinct()
    # Only texts of nodes are shuffled, if there are not very many nodes; a text that an id has several times goes once.
    some = by_keys(thin, nodes, ["id"], "left_semi").groupBy("id", F.xxhash64("text").alias("h"))
    texts = stored(some.agg(F.first("text").alias("text")).select("id", "text"), "texts")
    text_a, text_b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")

    lead = rest.groupBy("key").agg(F.min("node").alias("lead"))
    led = stored(lookup(rest, lead, ["key"], "node", how="inner").filter("node > lead"), "led")

    def compared(pairs: DataFrame) -> DataFrame:
        with_texts = pairs.join(text_a, "a").join(text_b, "b").select("a", "b", "text_a", "text_b")
        return stored(with_texts.mapInPandas(_linked(width, percent), "a long, b long, linked boolean"), "pairs").filter("linked").select("a", "b")

    # Every node meets the smallest of its leaders first. Alike members are in one component
    # then, and of the other leaders only those of other components are left to compare.
    found = compared(led.groupBy(F.col("node").alias("b")).agg(F.min("lead").alias("a")).select("a", "b"))
    labels = roots(found.select(F.col("b").alias("node"), F.col("a").alias("parent")).distinct())
    other = labels.select(F.col("node").alias("lead"), F.col("label").alias("of_lead"))
    # A member meets the same leader in many bands: labels are looked up for pairs, not for bands.
    pairs = lookup(stored(led.select("lead", "node").distinct(), "led-pairs").join(labels, "node", "left"), other, ["lead"], "node")
    apart = stored(pairs.filter(F.coalesce("label", "node") != F.coalesce("of_lead", "lead")).select("lead", "node"), "apart")
    labels = merged(labels, compared(apart.select(F.col("lead").alias("a"), F.col("node").alias("b"))))

    # Leaders have met all other members. A bucket with two labels or more among the rest is open.
    still = by_keys(led, apart, ["lead", "node"], "left_semi").select("key").distinct()
    left = by_keys(led, still, ["key"], "left_semi").select("key", "node")
    # All members of all bands get labels once; later rounds touch them only if labels have changed.
    left = stored(left.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "labelled")
    left = stored(_open(left), "left")
    for _ in range(LEADERS):
        large = left.filter("lead is not null")
        if large.isEmpty():
            break
        met = large.filter("label <> lead.label").select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))
        changed = moves(labels, compared(met.distinct()))
        left = left.filter("lead is null or node <> lead.node").select("key", "node", "label")
        if changed is not None:
            labels = with_moves(labels, changed)
            left = lookup(left, changed, ["label"], "node").select("key", "node", F.coalesce("least", "label").alias("label"))
            left = stored(left, "labelled")
        left = stored(_open(left), "left")
    members = _blocks(left).join(texts.withColumnRenamed("id", "node"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    more = stored(members.mapInPandas(_block_links(width, percent), "a long, b long").distinct(), "more-links")
    labels = merged(labels, more)

    named = sets.select("id", "n", "d1", "d2").join(classes, ["d1", "d2"], "left")
    named = named.join(labels.select(F.col("node").alias("at"), "label"), F.col("node") == F.col("at"), "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("label", "node")).otherwise(F.col("id"))
    return named.select("id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
