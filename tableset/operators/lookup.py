"""Search and lookup over document tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableset.functions.rules import failed_rules
from tableset.operators.spread import by_keys


def search(df: DataFrame, where: Column, order: Sequence[Column], size: int) -> DataFrame:
    """The first ``size`` documents by ``order`` among those matching ``where``.

    Filter reaches the scan, and every task keeps only its own first ``size`` rows.
    """
    return df.filter(where).orderBy(*order).limit(size)


def get_by_ids(ids: DataFrame, df: DataFrame, id_col: str = "_id", broadcast: bool = True) -> DataFrame:
    """One row per requested id, ``_present`` false when there is no such document.

    Requests are made unique first. The documents are reduced to the requested ones before
    they join, without a shuffle when the requests are few.
    """
    requested = ids.select(id_col).distinct()
    found = by_keys(df, requested, [id_col], "left_semi", broadcast).withColumn("_present", F.lit(True))
    return requested.join(found, id_col, "left").withColumn(
        "_present", F.coalesce(F.col("_present"), F.lit(False))
    )


def require_keys(
    wanted: DataFrame, table: DataFrame, keys: Sequence[str], broadcast: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``(found rows, missing keys)`` of requested keys."""
    requested = wanted.select(*keys).distinct()
    found = by_keys(table, requested, list(keys), "left_semi", broadcast)
    return found, requested.join(found.select(*keys), list(keys), "left_anti")


def live_definitions(wanted: DataFrame, registry: DataFrame, key: str = "name") -> DataFrame:
    """Stored definition of every requested name; an unknown name has an empty one."""
    return wanted.join(registry.select(key, "definition"), key, "left").withColumn(
        "definition", F.coalesce(F.col("definition"), F.lit(""))
    )


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``failed_rules``; a row is valid when the list is empty."""
    return df.withColumn("failed_rules", failed_rules(rules))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)`` of a validated frame."""
    return (
        df.filter(F.size("failed_rules") == 0).drop("failed_rules"),
        df.filter(F.size("failed_rules") > 0),
    )
