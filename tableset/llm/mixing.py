"""A mix of sources at target weights, by Sainte-Laguë apportionment of equal-token blocks.

A source's words are dealt to shards by document and lie there in a seeded order, cut into
blocks of equal length. Sources get integer numbers of blocks by the highest quotients
weight / (2 k + 1); a source's blocks are apportioned to its shards in the same way. In a
shard the quota takes every block as often as it goes into the number of blocks, and the rest
of it takes blocks once more in a seeded order. So no block is taken more than ``repeat``
times, a rerun takes the same ones, and no group is larger than a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableset.llm.common import stored

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Shards unless they would be larger than MOST_WORDS or smaller than LEAST_WORDS; blocks of a shard.
SHARDS, LEAST_WORDS, MOST_WORDS, BLOCKS, LEAST_BLOCK = 256, 512, 1 << 22, 256, 16


def targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeat: int = 2) -> DataFrame:
    """Add ``target`` to ``source``, ``source_size``: ``share`` of all sizes by weight.

    Sources by code point (NULL last) have the weights in turn. A target stops at ``repeat``
    times the size, and what is above goes to the others by weight: with sources in order of
    size / weight, the common level is the largest that any prefix of full sources leaves.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    sized = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (turn + 1).cast("int")))
    cap = F.col("source_size") * F.lit(repeat)
    by_ratio = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    all_sources = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(all_sources) - before) / rest
    levelled = sized.withColumn("level", level)
    target = F.least(cap.cast("double"), F.col("weight") * F.max("level").over(all_sources))
    return levelled.select("source", "source_size", target.alias("target"))


def apportion(parties: DataFrame, group: list[str], order: list[Column], due: Column, seats: Column, most: Column) -> DataFrame:
    """Add ``quota``: the group's ``seats`` by the highest quotients due / (2 k + 1), ``most`` each at most.

    ``due`` is a party's share of the seats, no more than ``most``; in a group they add up to the
    seats, but for rounding. Seat k of a party is taken at the level (k + 1/2) / due, and the
    seats of the lowest levels win, in the order of ``order`` where levels tie. With n parties,
    the seats up to a level are at most n / 2 from level * all dues, so those up to the lower
    bound are sure. The upper one is the first of 1 + 2**j * n / 2 / dues up to which there are
    enough seats, so none beyond it wins, and only the seats between them, some three for
    each party at most, are ranked.
    """
    rivals = parties.withColumns({"due": due.cast("double"), "seats": seats, "most": most})
    whole = Window.partitionBy(*group)
    half = F.count(F.lit(1)).over(whole) / 2 + 1
    # Parties that have all they may have leave what is beyond to the others.
    able = F.sum(F.when(F.col("due") < F.col("most"), F.col("due"))).over(whole)
    rivals = rivals.withColumns({"low": F.greatest((F.col("seats") - half) / F.sum("due").over(whole), F.lit(0)), "wide": half / able})

    def upto(level: Column) -> Column:
        return F.least(F.floor(level * F.col("due") + 0.5).cast("long"), F.col("most"))

    rivals = rivals.withColumn("sure", F.coalesce(upto(F.col("low")), F.lit(0).cast("long")))
    rivals = rivals.withColumn("free", F.col("seats") - F.sum("sure").over(whole))
    levels = [1 + F.col("wide") * 2**j for j in range(24)]
    rivals = rivals.withColumn("enough", F.array(*(F.sum(upto(x)).over(whole) >= F.col("seats") for x in levels)))
    high = F.coalesce(*(F.when(F.col("enough")[j], x) for j, x in enumerate(levels)))
    last = F.coalesce(upto(high), F.col("most"))
    seat = rivals.withColumn("k", F.explode_outer(F.when((F.col("due") > 0) & (last > F.col("sure")), F.sequence(F.col("sure"), last - 1))))
    ahead = F.row_number().over(whole.orderBy(F.col("k").isNull(), (F.col("k") + 0.5) / F.col("due"), *order, "k"))
    won = seat.withColumn("won", (F.col("k").isNotNull() & (ahead <= F.col("free"))).cast("long"))
    return won.groupBy(*parties.columns, "sure").agg(F.sum("won").alias("won")).select(*parties.columns, (F.col("sure") + F.col("won")).alias("quota"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeat: int = 2, seed: int = 1) -> DataFrame:
    """What the mix takes of every document.

    Returns ``id``, ``source``, ``text_hash``, ``size`` (words), ``source_size``, ``target``, ``taken`` (words,
    repeats counted) and ``pieces`` (array of from, to, times: the words from to to (exclusive) are
    taken so often), a row for each row of ``docs``. Texts that are NULL or have no words have
    size 0 and nothing is taken of them. Rows with equal id and source are placed by size and
    text; rows that are equal in these have pieces of their own.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    thin = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("text_hash"), size.alias("size")), "sizes")
    sources = stored(targets(thin.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeat), "sources")
    words = thin.agg(F.sum("size")).first()[0] or 0
    shard_words = min(max(words // SHARDS, LEAST_WORDS), MOST_WORDS)
    block_words = max(shard_words // BLOCKS, LEAST_BLOCK)
    shards = max(1, words // shard_words)

    full = thin.filter("size > 0").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id", "text_hash"), F.lit(shards)))
    shard = Window.partitionBy("source", "shard")
    ordered = shard.orderBy(F.xxhash64(F.lit(seed + 1), "id", "text_hash"), "id", "size", "text_hash")
    stop = F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    placed = full.withColumn("stop", stop).withColumn("n", F.sum("size").over(shard))
    blocks = F.greatest(F.round(F.col("n") / block_words).cast("long"), F.lit(1).cast("long"))
    placed = stored(placed.withColumn("start", F.col("stop") - F.col("size")).withColumn("blocks", blocks), "placed")

    same = lambda left, right: left["source"].eqNullSafe(right["source"])
    shares = placed.groupBy("source", "shard").agg(F.first("n").alias("n"), F.first("blocks").alias("blocks"))
    seated = shares.groupBy("source").agg(F.sum("blocks").alias("all_blocks"))
    seated = seated.join(sources, same(seated, sources)).select(seated["source"], "all_blocks", (F.col("target") / F.col("source_size") * F.col("all_blocks")).alias("due_blocks"))
    every = Window.partitionBy()
    seated = apportion(seated, [], [F.col("source").asc_nulls_last()], F.col("due_blocks"), F.round(F.sum("due_blocks").over(every)).cast("long"), repeat * F.col("all_blocks"))
    seated = seated.select(F.col("source").alias("of"), "all_blocks", F.col("quota").alias("source_quota"))
    dealt = shares.join(seated, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    dealt = apportion(dealt, ["source"], [F.xxhash64(F.lit(seed), "shard"), F.col("shard")], F.col("source_quota") * F.col("blocks") / F.col("all_blocks"), F.col("source_quota"), repeat * F.col("blocks"))
    chosen = dealt.select("source", "shard", "n", "blocks", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    rank = F.row_number().over(shard.orderBy(F.xxhash64(F.lit(seed + 2), "source", "shard", "block"), "block")) - 1
    times = F.floor(F.col("quota") / F.col("blocks")) + (rank < F.col("quota") % F.col("blocks")).cast("long")
    edge = lambda j: F.floor(j * F.col("n") / F.col("blocks")).cast("long")
    chosen = chosen.select(F.col("source").alias("of"), "shard", "block", times.alias("times"), edge(F.col("block")).alias("low"), edge(F.col("block") + 1).alias("high"))

    inside = lambda word: F.floor(((word + 1) * F.col("blocks") - 1) / F.col("n")).cast("long")
    cut = placed.withColumn("block", F.explode(F.sequence(inside(F.col("start")), inside(F.col("stop") - 1))))
    cut = cut.join(chosen, ["shard", "block"]).filter(F.col("source").eqNullSafe(F.col("of")))
    piece = F.struct((F.greatest("start", "low") - F.col("start")).alias("from"), (F.least("stop", "high") - F.col("start")).alias("to"), "times")
    taken = cut.withColumn("piece", piece).groupBy("id", "source", "text_hash", "size", "shard", "start")
    taken = taken.agg(F.sum((F.col("piece.to") - F.col("piece.from")) * F.col("times")).cast("long").alias("taken"), F.array_sort(F.collect_list("piece")).alias("pieces"))
    none = thin.filter("size = 0").select("id", "source", "text_hash", "size", F.lit(0).cast("long").alias("taken"), F.array().cast(taken.schema["pieces"].dataType).alias("pieces"))
    both = taken.select(*none.columns).union(none)
    named = sources.select(F.col("source").alias("of"), "source_size", "target")
    return both.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
