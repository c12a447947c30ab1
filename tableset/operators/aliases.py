"""Alias membership as a relation ``(alias, version_name)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableset.operators.spread import lookup


def alias_members(membership: DataFrame) -> DataFrame:
    """Alias -> sorted distinct member names, for reports. Duplicates go before the shuffle."""
    return membership.groupBy("alias").agg(
        F.array_sort(F.collect_set("version_name")).alias("members")
    )


def alias_bounds(membership: DataFrame) -> DataFrame:
    """Alias with its least and greatest member.

    Enough to know that an alias exists and whether one given version is its only member,
    without gathering the members.
    """
    return membership.groupBy("alias").agg(
        F.min("version_name").alias("first_member"), F.max("version_name").alias("last_member")
    )


def swap(membership: DataFrame, removes: DataFrame, adds: DataFrame) -> DataFrame:
    """Membership after one change: ``(membership - removes) + adds``, without duplicates.

    One aggregation per pair: repeated pairs combine inside the map tasks.
    """

    def tagged(pairs: DataFrame, tag: str) -> DataFrame:
        return pairs.select(
            "alias", "version_name", *[F.lit(tag == t).alias(t) for t in ("member", "removed", "added")]
        )

    pairs = (
        tagged(membership, "member")
        .unionByName(tagged(removes, "removed"))
        .unionByName(tagged(adds, "added"))
        .groupBy("alias", "version_name")
        .agg(*[F.max(t).alias(t) for t in ("member", "removed", "added")])
    )
    return pairs.filter("added OR (member AND NOT removed)").select("alias", "version_name")


def same_members(wanted: DataFrame, current: DataFrame) -> DataFrame:
    """Per alias of either side: whether both have exactly the same members.

    Pairs are reduced first, so an alias with very many members is spread over tasks and
    arrives at its own row already combined.
    """
    w = wanted.select("alias", "version_name", F.lit(1).alias("w"), F.lit(0).alias("c"))
    c = current.select("alias", "version_name", F.lit(0).alias("w"), F.lit(1).alias("c"))
    pairs = w.unionByName(c).groupBy("alias", "version_name").agg(F.max("w").alias("w"), F.max("c").alias("c"))
    return pairs.groupBy("alias").agg((F.min(F.least("w", "c")) == 1).alias("same"))


def scan_alias(rows: DataFrame, membership: DataFrame, alias: str, spread_by: str = "_id") -> DataFrame:
    """Rows of all versions an alias points at; ``rows`` carries ``version_name``.

    A semi-join with the measured list of members: a short one is broadcast, and over a
    table partitioned by version name Spark prunes the other versions at run time; for a
    long one hot versions are spread by ``spread_by``. An unknown alias gives no rows.
    """
    members = membership.filter(F.col("alias") == alias).select("version_name").distinct()
    return lookup(rows, members, ["version_name"], spread_by, how="left_semi")


def unreferenced(versions: DataFrame, membership: DataFrame) -> DataFrame:
    """Versions that no alias points at."""
    return versions.join(membership.select("version_name").distinct(), "version_name", "left_anti")
