"""The prefix trie of conversations, grouped by blocks of turns first.

A conversation is cut into blocks of ``block`` turns. Blocks have digests, and the digests of
all blocks before one name the class of conversations that agree so far: first those classes
are grouped, a row for each different next block. A class with one next block has no branch
in it, so each of its turns is a node with the members of the class. Only where siblings
diverge, or a conversation ends, are the different blocks (not the conversations) opened, and
their turns grouped one by one.

Sums over subtrees come from sums over members, so no step walks the trie level by level.
A conversation is the smallest member of all nodes from some depth on: the node where that
begins is found by comparing nodes with their parents. What the texts before that depth
weigh is what the conversation saves, and the smallest member of a leaf stands for the leaf.
Both are added up over members, in the same grouping by blocks.

A conversation of any length, a first turn that a third of all have and a node where a
third of all end are spread: rows are numbered within ranges and joined to the few
conversations that span several, counts combine in the map tasks, and ids are joined to
pieces in ranges before one task reads the pieces of a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableset.llm.common import stored
from tableset.operators.spread import lookup

#: Turns of a block.
BLOCK = 4
#: Blocks that one window runs over.
CHUNK = 1024
#: Ids of a piece of a node's list.
PIECE = 4096
#: First turns that a conversation may take over from the first of its group of GROUP ids.
HEAD, GROUP = 8, 5
NODE = ("depth", "key1", "key2")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation in a sorted partition, from 1."""
    last, before = None, 0
    for batch in batches:
        conv = batch.column("conv").to_numpy()
        if not len(conv):
            continue
        at = np.arange(len(conv))
        starts = np.append(True, conv[1:] != conv[:-1])
        place = at - np.maximum.accumulate(np.where(starts, at, 0)) + 1
        if conv[0] == last:
            place[: np.append(np.flatnonzero(starts[1:]) + 1, len(conv))[0]] += before
        last, before = conv[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "task")), pa.array(place), *(batch.column(c) for c in ("digest", "bytes"))], names=["conv", "task", "place", "digest", "bytes"])


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv``, ``pos`` (from 1), ``digest`` (128 bits of role and text) and ``bytes`` of the text, of every turn.

    Turns are in order of ``turn``, NULL first, equal numbers in order of the digest; repeated
    rows are turns of their own. NULL roles and texts are empty. Rows without ``conv_id``
    belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    thin = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), F.substring(digest, 1, 16).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    ranged = thin.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id())
    places = stored(ranged.mapInArrow(_number, "conv long, task int, place long, digest binary, bytes long"), "places")
    # Only a range's first and last conversation go on in another, so at most two rows a task are broadcast.
    ends = places.groupBy("conv", "task").agg(F.max("place").alias("n"))
    spread = ends.groupBy("conv").agg(F.collect_list(F.struct("task", "n")).alias("parts")).filter(F.size("parts") > 1)
    before = Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(spread.select("conv", F.inline("parts")).withColumn("before", F.sum("n").over(before)).filter("before > 0").select("conv", "task", "before"), "offsets")
    return places.join(F.broadcast(offsets), ["conv", "task"], "left").select(
        "conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "bytes"
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conversations, turns)`` after each took the first turns of the first of its group.

    Conversation c begins with h turns of conversation c - c % GROUP (all if it has fewer,
    none if there is none), h being crc32(c in decimal) % (HEAD + 1); its own turns after its
    first h follow. ``conversations`` has ``conv`` and ``length``, also of those without a turn.
    """
    turns = stored(turns, "turns")
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    heads = turns.filter((F.col("conv") % GROUP == 0) & (F.col("pos") <= HEAD)).groupBy(F.col("conv").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("head"))
    convs = turns.groupBy("conv").agg(F.max("pos").alias("n")).withColumn("base", F.col("conv") - F.col("conv") % GROUP)
    convs = convs.join(heads, "base", "left").withColumn("h", taken)
    none = F.array().cast("array<struct<pos:bigint,digest:binary,bytes:bigint>>")
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))).otherwise(none)
    convs = convs.select("conv", "n", "h", head.alias("head")).withColumn("shift", F.size("head") - F.col("h"))
    length = F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = stored(convs.select("conv", "head", "shift", length.cast("long").alias("length")), "conversations")
    own = turns.filter(F.col("pos") > taken).join(convs.select("conv", "shift"), "conv")
    own = own.select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "digest", "bytes")
    return convs.select("conv", "length"), convs.select("conv", F.inline("head")).union(own)


def _pair(first: int, *parts: Column) -> tuple[Column, Column]:
    """128 bits of hash, as two longs that don't depend on each other."""
    return tuple(F.xxhash64(F.lit(first + i), *parts) for i in (0, 1))


def _chain(turns: Column) -> Column:
    """For each turn of a block, the hash of the block's turns up to it and its bytes."""

    def step(done: Column, turn: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        one, two = (F.xxhash64(F.lit(i), F.coalesce(last[c], F.lit(0).cast("long")), turn["digest"]) for i, c in ((1, "c1"), (2, "c2")))
        upto = F.coalesce(last["upto"], F.lit(0).cast("long")) + turn["bytes"]
        return F.concat(done, F.array(F.struct(one.alias("c1"), two.alias("c2"), turn["bytes"].alias("bytes"), upto.alias("upto"))))

    return F.aggregate(turns, F.array().cast("array<struct<c1:bigint,c2:bigint,bytes:bigint,upto:bigint>>"), step)


def blocks_of(conversations: DataFrame, turns: DataFrame, block: int) -> DataFrame:
    """Blocks of all conversations, with the class they come from: ``x1``, ``x2`` (of all blocks before) and ``b0`` (their bytes).

    The last block of a conversation is short, maybe empty. The hashes of blocks and their
    numbers are combined by exclusive or, which chunks of blocks do on their own.
    """
    cut = turns.groupBy("conv", F.floor((F.col("pos") - 1) / block).alias("k")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("turns"))
    empty = conversations.filter(F.col("length") % block == 0).select("conv", F.floor(F.col("length") / block).alias("k"))
    cut = cut.select("conv", "k", _chain(F.col("turns")).alias("steps"))
    cut = cut.unionByName(empty.withColumn("steps", F.array().cast(cut.schema["steps"].dataType)))
    last = F.try_element_at("steps", F.lit(-1))
    zero = F.lit(0).cast("long")
    h1, h2 = _pair(5, F.col("k"), last["c1"], last["c2"])
    rows = cut.withColumns({"chunk": F.floor(F.col("k") / CHUNK), "h1": h1, "h2": h2, "size": F.coalesce(last["upto"], zero)})
    before = Window.partitionBy("conv", "chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    named = {"x1": F.bit_xor("h1"), "x2": F.bit_xor("h2"), "b0": F.sum("size")}
    rows = stored(rows.withColumns({c: F.coalesce(a.over(before), zero) for c, a in named.items()}), "chunks")
    long = rows.filter("chunk > 0").select("conv").distinct()
    whole = rows.join(long, "conv", "left_semi").groupBy("conv", "chunk").agg(*(a.alias(f"o_{c}") for c, a in named.items()))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("conv", "chunk", F.bit_xor("o_x1").over(earlier).alias("o_x1"), F.bit_xor("o_x2").over(earlier).alias("o_x2"), F.sum("o_b0").over(earlier).alias("o_b0"))
    rows = lookup(rows, stored(whole.filter("chunk > 0"), "offsets"), ["conv", "chunk"], "k")
    return stored(rows.select(
        "conv", "k", *(F.col(c).bitwiseXOR(F.coalesce(f"o_{c}", zero)).alias(c) for c in ("x1", "x2")), (F.col("b0") + F.coalesce("o_b0", zero)).alias("b0"), "steps"
    ), "blocks")


def _node_keys(t: Column, c1: Column, c2: Column, block: int) -> Column:
    """Key of the node after turn ``t`` of a block of class (k, x1, x2); after the last one it is that of the next class."""
    within = _pair(3, F.col("x1"), F.col("x2"), c1, c2)
    across = [F.col(x).bitwiseXOR(h) for x, h in zip(("x1", "x2"), _pair(5, F.col("k"), c1, c2))]
    key = [F.when(t == block, a).when(t == 0, F.col(x)).otherwise(w) for a, w, x in zip(across, within, ("x1", "x2"))]
    return F.struct(key[0].alias("key1"), key[1].alias("key2"))


def nodes_of(rows: DataFrame, block: int) -> DataFrame:
    """Nodes but the root, from blocks with ``saves`` and ``leaf`` of their conversations.

    Columns of NODE, ``p1`` and ``p2`` (key of the parent), ``bytes``, ``upto`` (bytes from the
    root on), ``n_convs``, ``saves``, ``leaf`` (sums over members), ``least`` (conv, saves).
    """
    sums = [F.sum(c).alias(c) for c in ("n_convs", "saves", "leaf")] + [F.min("least").alias("least")]
    rows = rows.withColumns({"n_convs": F.lit(1).cast("long"), "least": F.struct("conv", "saves"), "last": F.try_element_at("steps", F.lit(-1))})
    rows = rows.withColumns({"v1": F.col("last.c1"), "v2": F.col("last.c2"), "turns": F.size("steps")})
    variants = rows.groupBy("k", "x1", "x2", "v1", "v2", "turns").agg(*sums, F.any_value("steps").alias("steps"), F.any_value("b0").alias("b0"))
    variants = stored(variants, "variants")
    classes = variants.groupBy("k", "x1", "x2").agg((F.count("*") > 1).alias("branches"))
    variants = lookup(variants.filter("turns > 0").withColumn("own", F.col("least.conv")), stored(classes, "classes"), ["k", "x1", "x2"], "own", how="inner")
    at = variants.select("*", F.posexplode("steps").alias("i", "step"))
    before = F.try_element_at("steps", F.col("i"))
    at = at.withColumn("before", F.when(F.col("i") > 0, before)).select(
        (F.col("k") * block + F.col("i") + 1).alias("depth"), "branches", "n_convs", "saves", "leaf", "least",
        _node_keys(F.col("i") + 1, F.col("step.c1"), F.col("step.c2"), block).alias("node"),
        _node_keys(F.col("i"), F.col("before.c1"), F.col("before.c2"), block).alias("parent"),
        F.col("step.bytes").alias("bytes"), (F.col("b0") + F.col("step.upto")).alias("upto"),
    )
    at = at.select("depth", "node.*", F.col("parent.key1").alias("p1"), F.col("parent.key2").alias("p2"), "bytes", "upto", "n_convs", "saves", "leaf", "least", "branches")
    rest = ("p1", "p2", "bytes", "upto")
    opened = at.filter("branches").groupBy(*NODE).agg(*(F.any_value(c).alias(c) for c in rest), *sums)
    return at.filter("not branches").drop("branches").unionByName(opened)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a sorted partition, joined for each node, at most PIECE of them a row."""

    def row(node, ids):
        return [pa.array([v], pa.int64()) for v in (*node, ids[0])] + [pa.array([",".join(map(str, ids))])]

    node, ids, names = None, [], [*NODE, "first", "ids"]
    for batch in batches:
        out = [[] for _ in names]
        for *new, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if ids and (new != node or len(ids) == PIECE):
                for column, value in zip(out, (*node, ids[0], ",".join(map(str, ids)))):
                    column.append(value)
                ids = []
            node = new
            ids.append(conv)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string())], names=names)
    if ids:
        yield pa.RecordBatch.from_arrays(row(node, ids), names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which follow each other; no more than a piece is held."""
    names, node, sha = [*NODE, "ends_sha256"], None, None
    for batch in batches:
        out = []
        for *new, piece in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
            if new == node:
                sha.update(b"," + piece.encode())
            else:
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = new, hashlib.sha256(piece.encode())
        columns = zip(*out) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()])], names=names)
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, sha.hexdigest())], names=names)


def _ends(blocks: DataFrame, block: int) -> DataFrame:
    """The node where each conversation ends, and the ``total`` bytes of its texts."""
    last = F.try_element_at("steps", F.lit(-1))
    short = blocks.filter(F.size("steps") < block)
    key = _node_keys(F.size("steps"), last["c1"], last["c2"], block)
    return short.select(
        (F.col("k") * block + F.size("steps")).alias("depth"), key.alias("key"), "conv", (F.col("b0") + F.coalesce(last["upto"], F.lit(0))).alias("total")
    ).select("depth", "key.*", "conv", "total")


def trie(conversations: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each node of the trie of all ``conversations`` (conv, length) by their ``turns`` (conv, pos, digest, bytes).

    Columns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (NULL at the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. Equal conversations end at one
    node. Without conversations there is no node.
    """
    blocks = blocks_of(conversations, turns, block)
    zero = F.lit(0).cast("long")
    ends = stored(_ends(blocks, block), "ends")

    def all_nodes(rows: DataFrame) -> DataFrame:
        top = rows.filter("k = 0").agg(F.count("*").alias("n_convs"), F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf"), F.min(F.struct("conv", "saves")).alias("least"))
        top = top.filter("n_convs > 0").select(*(zero.alias(c) for c in (*NODE, "p1", "p2", "bytes", "upto")), "n_convs", "saves", "leaf", "least")
        return nodes_of(rows, block).unionByName(top)

    plain = stored(all_nodes(blocks.withColumns({"saves": zero, "leaf": zero})).select(*NODE, "p1", "p2", "bytes", "upto", F.col("least.conv").alias("conv_id")), "nodes")
    parents = plain.select((F.col("depth") + 1).alias("depth"), F.col("key1").alias("p1"), F.col("key2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    children = plain.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("key1"), F.col("p2").alias("key2")).agg(F.count("*").alias("n_children"))
    linked = lookup(plain, parents, ["depth", "p1", "p2"], "key1").join(children, list(NODE), "left")
    linked = stored(linked.withColumn("n_children", F.coalesce("n_children", zero)), "linked")

    births = linked.filter(~F.col("conv_id").eqNullSafe(F.col("parent_conv_id"))).select(F.col("conv_id").alias("conv"), (F.col("upto") - F.col("bytes")).alias("before"))
    leaves = linked.filter("n_children = 0").select(F.col("conv_id").alias("conv"), F.lit(1).cast("long").alias("leaf"))
    shares = ends.select("conv", "total").join(births, "conv", "left").join(leaves, "conv", "left")
    shares = stored(shares.select("conv", F.coalesce("before", "total").alias("saves"), F.coalesce("leaf", zero).alias("leaf")), "shares")
    summed = all_nodes(blocks.join(shares, "conv")).select(*NODE, "n_convs", "saves", "leaf", F.col("least.saves").alias("least_saves"))

    pieces = ends.select(*NODE, "conv").repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")
    pieces = stored(pieces.mapInArrow(_pieces, "depth long, key1 long, key2 long, first long, ids string"), "pieces")
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    shas = pieces.mapInArrow(_digests, "depth long, key1 long, key2 long, ends_sha256 string")
    saved = F.col("saves") - F.col("least_saves") - (F.col("n_convs") - 1) * (F.col("upto") - F.col("bytes"))
    return linked.join(summed, list(NODE)).join(shas, list(NODE), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaf").alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
