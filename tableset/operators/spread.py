"""Many-to-one lookups whose key may be shared by a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableset.session import durable

# A lookup table is broadcast only when measured to stay below both bounds.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 32 << 20

# Tasks over which one key is spread when the lookup table is larger, and the rows from which
# a key is spread at all.
SALTS = 64
HOT_ROWS = 100_000


def measure(df: DataFrame) -> tuple[int, int]:
    """``(rows, text bytes)`` of a table, by one aggregate without moving the rows."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return row["rows"], row["bytes"]


def fits_broadcast(df: DataFrame) -> bool:
    rows, size = measure(df)
    return rows <= MAX_BROADCAST_ROWS and size <= MAX_BROADCAST_BYTES


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread_by: str,
    how: str = "left",
    broadcast: bool = True,
    salts: int = SALTS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``left`` to ``right``, which has one row per key.

    ``right`` is measured. A small one is broadcast, and ``left`` stays where it is
    (``broadcast=False`` forbids that). For a larger one the keys with more than
    ``hot_rows`` rows in ``left``, the NULL key included, are found by one aggregate. Only
    these are salted by ``spread_by``, a column with many values, and repeated per salt in
    ``right``; all other keys take part in the join once.
    """
    if broadcast and fits_broadcast(right):
        return left.join(F.broadcast(right), list(on), how)
    if salts == 1:
        return left.join(right, list(on), how)
    names = [f"_hot_{i}" for i in range(len(on))]
    rows_of = left.groupBy(*[F.col(c).alias(n) for c, n in zip(on, names)]).agg(F.count(F.lit(1)).alias("_rows"))
    hot = durable(rows_of.filter(F.col("_rows") > hot_rows).select(*names))
    if hot.isEmpty():
        return left.join(right, list(on), how)
    # At most rows / hot_rows keys are hot; beyond the broadcast bounds the flags are joined.
    hot = hot.withColumn("_is_hot", F.lit(True))
    flags = F.broadcast(hot) if fits_broadcast(hot) else hot

    def flagged(df: DataFrame) -> DataFrame:
        same = [df[c].eqNullSafe(flags[n]) for c, n in zip(on, names)]
        return df.join(flags, same, "left").drop(*names)

    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    all_salts = F.sequence(F.lit(0), F.lit(salts - 1))
    salted_left = flagged(left).withColumn("_salt", F.when(F.col("_is_hot"), salt).otherwise(0)).drop("_is_hot")
    salted_right = flagged(right).withColumn(
        "_salt", F.explode(F.when(F.col("_is_hot"), all_salts).otherwise(F.array(F.lit(0))))
    ).drop("_is_hot")
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def by_keys(left: DataFrame, keys: DataFrame, on: Sequence[str], how: str, broadcast: bool = True) -> DataFrame:
    """Semi- or anti-join of a table against a list of keys.

    The list is measured: a short one is broadcast, so the table is not shuffled whatever
    the optimizer knows about the list. For a long one both sides are shuffled by key; rows
    of ``left`` are about unique per key here, so nothing is salted.
    """
    return lookup(left, keys, on, on[0], how=how, broadcast=broadcast, salts=1)
