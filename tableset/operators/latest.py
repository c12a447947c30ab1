"""Latest entry per key, and its mirror image, the first entry per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableset.schemas import CHANGELOG_KEYS


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``.

    The rank is limited inside each map task before the shuffle (``WindowGroupLimit``),
    so a key that holds a large share of all rows sends one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def latest_entries(
    log: DataFrame,
    keys: Sequence[str] = CHANGELOG_KEYS,
    order: Sequence[str] = ("timestamp", "entry_seq"),
) -> DataFrame:
    """Newest changelog row of every key at once; ``entry_seq`` settles equal times."""
    return first_by(log, keys, [F.col(c).desc() for c in order])


def entries_of(log: DataFrame, resource_type: str | None = None, env: str | None = None,
               identifier: str | None = None) -> DataFrame:
    """Changelog rows by exact terms. The equalities reach the Parquet scan."""
    terms = {"resource_type": resource_type, "env_name": env, "resource_identifier": identifier}
    for column, value in terms.items():
        if value is not None:
            log = log.filter(F.col(column) == value)
    return log
