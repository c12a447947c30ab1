"""Capped copies: the first n documents by id, over a whole table or per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableset.operators.spread import lookup
from tableset.session import durable

# Up to this size the last id of a cap is found by a plain top-n of ids.
TOP_N_LIMIT = 10_000

UNLIMITED = -1

# Sets of more ids than this are narrowed before they are sorted, by samples of about so many
# ids, in so many rounds at most.
SORTED_ROWS, SAMPLE_ROWS, NARROWINGS = 1_000_000, 20_000, 8

# monotonically_increasing_id keeps the row number of a partition in its low 33 bits.
ROW_BITS = 33


def cap(df: DataFrame, n: int, id_col: str = "_id", top_n_limit: int = TOP_N_LIMIT) -> DataFrame:
    """The first ``n`` rows by ``id_col`` (unique); -1 keeps all.

    The n-th id is looked up among the ids alone and becomes a filter; the rows are never
    moved. For a small cap the lookup is a top-n of ids within the query. For a large one
    see ``nth_ids``.
    """
    if n == UNLIMITED:
        return df
    if n < 0:
        raise ValueError(f"cap must be -1 or at least 0, got {n}")
    if n <= top_n_limit:
        last = df.select(id_col).orderBy(id_col).limit(n).agg(F.max(id_col)).scalar()
        return df.filter(F.col(id_col) <= last)
    ids = df.select(F.lit(0).alias("_set"), F.col(id_col).alias("_id"))
    limits = df.sparkSession.range(1).select(F.lit(0).alias("_set"), F.lit(n).cast("long").alias("_limit"))
    last = nth_ids(ids, limits).first()
    return df if last is None else df.filter(F.col(id_col) <= F.lit(last["_last_id"]))


def cap_by_key(
    df: DataFrame, limits: DataFrame, key: str, limit_col: str, id_col: str = "_id", broadcast: bool = True
) -> DataFrame:
    """Per ``key`` the first ``limit_col`` rows by ``id_col`` (unique per key); -1 keeps all.

    ``limits`` has one row per key; rows of other keys are kept whole. Only ids of
    capped keys are shuffled, few of those of large keys. The cut of a key is one id, so the rows meet a table with
    one row per capped key, broadcast when small (see ``lookup``).
    """
    capped = limits.filter(F.col(limit_col) != UNLIMITED).select(
        F.col(key).alias("_set"), F.col(limit_col).cast("long").alias("_limit")
    )
    ids = lookup(
        df.select(F.col(key).alias("_set"), F.col(id_col).alias("_id")),
        capped.filter("_limit > 0"), ["_set"], "_id", how="inner", broadcast=broadcast,
    )
    cuts = durable(
        nth_ids(ids, capped.filter("_limit > 0"))
        .withColumn("_none", F.lit(False))
        .unionByName(
            capped.filter("_limit = 0").select("_set", F.lit(True).alias("_none")), allowMissingColumns=True
        )
        .withColumnRenamed("_set", key)
    )
    joined = lookup(df, cuts, [key], id_col, broadcast=broadcast)
    keep = ~F.coalesce(F.col("_none"), F.lit(False)) & (
        F.col("_last_id").isNull() | (F.col(id_col) <= F.col("_last_id"))
    )
    return joined.filter(keep).drop("_last_id", "_none")


def nth_ids(ids: DataFrame, limits: DataFrame, sorted_rows: int = SORTED_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(_set, _last_id)``: the ``_limit``-th id of every ``_set`` that has so many.

    Sets of more than ``sorted_rows`` ids are narrowed first: about ``sample_rows`` of a set's
    ids, chosen by a hash, give two bounds around the wanted rank, and one pass counts the ids
    up to each. Only ids between them are left, and the rank among them is known, so this is
    exact whatever the sample was. What is left of all sets at last is sorted.
    """
    known = limits.select("_set", "_limit")
    counted = lookup(ids, known, ["_set"], "_id", how="inner").groupBy("_set").agg(F.count(F.lit(1)).alias("_inside"))
    none = F.lit(None).cast(ids.schema["_id"].dataType)
    open_ = durable(known.join(counted, "_set").filter("_limit <= _inside").withColumns({"_low": none, "_high": none, "_below": F.lit(0).cast("long")}))
    for step in range(NARROWINGS):
        large = open_.filter(F.col("_inside") > sorted_rows)
        if large.isEmpty():
            break
        left = open_.filter(F.col("_inside") <= sorted_rows)
        narrower = durable(_narrowed(ids, large, sample_rows, step))
        # Ids that are equal many times may keep a set from becoming smaller; it is sorted then.
        stuck = narrower.join(large.select("_set", F.col("_inside").alias("_was")), "_set").filter(F.col("_inside") >= F.col("_was")).select("_set")
        open_ = durable(left.unionByName(narrower, allowMissingColumns=True))
        if not stuck.isEmpty():
            break
    inside = _inside(ids, open_)
    return _nth_of_sorted(inside.select("_set", "_id"), open_.select("_set", (F.col("_limit") - F.col("_below")).alias("_limit")))


def _inside(ids: DataFrame, bounds: DataFrame) -> DataFrame:
    """Ids above ``_low`` and up to ``_high`` of their set; NULL is no bound."""
    both = lookup(ids, bounds, ["_set"], "_id", how="inner")
    above = F.col("_low").isNull() | (F.col("_id") > F.col("_low"))
    return both.filter(above & (F.col("_high").isNull() | (F.col("_id") <= F.col("_high"))))


def _narrowed(ids: DataFrame, sets: DataFrame, sample_rows: int, step: int) -> DataFrame:
    """The sets with closer bounds around the wanted id."""
    chance = F.pmod(F.xxhash64(F.lit(step), "_id"), F.lit(1 << 30)) / (1 << 30)
    sample = _inside(ids, sets).filter(chance * F.col("_inside") < sample_rows)
    by_id, whole = Window.partitionBy("_set").orderBy("_id"), Window.partitionBy("_set")
    at = (F.col("_limit") - F.col("_below")) / F.col("_inside") * F.count(F.lit(1)).over(whole)
    ranked = sample.select("_set", "_id", F.row_number().over(by_id).alias("_rank"), at.alias("_at"))
    # Four standard deviations of the wanted id's rank in the sample.
    margin = 2 * F.sqrt(F.lit(float(sample_rows))) + 1
    picked = ranked.groupBy("_set").agg(
        F.max(F.when(F.col("_rank") <= F.col("_at") - margin, F.col("_id"))).alias("_first"),
        F.min(F.when(F.col("_rank") >= F.col("_at") + margin, F.col("_id"))).alias("_second"),
    )
    cuts = durable(sets.join(picked, "_set", "left"))
    counts = _inside(ids, cuts).groupBy("_set").agg(
        F.count_if(F.col("_id") <= F.col("_first")).alias("_upto_first"), F.count_if(F.col("_id") <= F.col("_second")).alias("_upto_second")
    )
    now, rank = cuts.join(counts, "_set"), F.col("_limit") - F.col("_below")
    lower = F.col("_first").isNotNull() & (rank <= F.col("_upto_first"))
    higher = F.col("_second").isNotNull() & (rank > F.col("_upto_second"))
    first, second = F.coalesce("_first", "_low"), F.coalesce("_second", "_high")
    upto_first = F.when(F.col("_first").isNull(), 0).otherwise(F.col("_upto_first"))
    upto_second = F.when(F.col("_second").isNull(), F.col("_inside")).otherwise(F.col("_upto_second"))
    begin = F.when(lower, 0).when(higher, upto_second).otherwise(upto_first)
    end = F.when(lower, upto_first).when(higher, F.col("_inside")).otherwise(upto_second)
    return now.select(
        "_set", "_limit", F.when(lower, F.col("_low")).when(higher, second).otherwise(first).alias("_low"),
        F.when(lower, first).when(higher, F.col("_high")).otherwise(second).alias("_high"),
        (F.col("_below") + begin).alias("_below"), (end - begin).alias("_inside"),
    )


def _nth_of_sorted(ids: DataFrame, limits: DataFrame) -> DataFrame:
    """The ``_limit``-th id of every ``_set``, by sorting all ids.

    The ids are range-partitioned by (set, id), so a set with very many ids spans many
    tasks. Sorted inside each task, the row number there plus the number of ids of the set
    in earlier tasks is the rank. The sorted ids are materialised once, so that counts and
    ranks see the same split; the table of counts has one row per task and set.
    """
    ordered = durable(
        ids.select("_set", "_id")
        .repartitionByRange("_set", "_id")
        .sortWithinPartitions("_set", "_id")
        .withColumn("_position", F.monotonically_increasing_id())
    )
    task = F.shiftright("_position", ROW_BITS)
    counts = ordered.groupBy(task.alias("_task"), "_set").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_position").alias("_start")
    )
    before = Window.partitionBy("_set").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    holder = (
        ranges.join(limits, "_set")
        .filter((F.col("_before") < F.col("_limit")) & (F.col("_limit") <= F.col("_before") + F.col("_rows")))
        .select("_set", (F.col("_start") + F.col("_limit") - F.col("_before") - 1).alias("_position"))
    )
    # One row per set is looked up, so the ids stay where they are.
    found = lookup(ordered, holder, ["_set", "_position"], "_id", how="inner", salts=1)
    return found.select("_set", F.col("_id").alias("_last_id"))
