"""Expansion of include actions, then removal of comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableset.functions.text import ACTION_OPEN, include_names, include_segments, strip_comments
from tableset.operators.spread import lookup, measure

# An includes table up to this size is handed to every task as one map.
MAX_MAP_BYTES = 8 << 20
MAX_MAP_ROWS = 1000


def _fits_in_a_map(includes: DataFrame) -> bool:
    rows, size = measure(includes.select("name", "content"))
    return rows <= MAX_MAP_ROWS and size <= MAX_MAP_BYTES


def _defined(includes: DataFrame) -> DataFrame:
    """One row per name: its content, and whether it has several. A NULL name is never used."""
    return (
        includes.filter(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.struct(F.min("content").alias("content"), (F.count(F.lit(1)) > 1).alias("several")).alias("include"))
    )


_FOUND = "map<string,struct<content:string,several:boolean>>"


def _rebuild(df: DataFrame, text: str) -> DataFrame:
    """Texts with an action, from ``_found``: the includes by name that they use."""
    df = df.withColumn("_names", include_names(text)).withColumn("_segments", include_segments(text))
    found = F.col("_found")
    pieces = F.transform(F.col("_names"), lambda n: found[n]["content"])
    joined = F.when(
        F.size("_names") > 0,
        F.array_join(
            F.zip_with(F.col("_segments"), pieces, lambda s, p: F.concat(s, F.coalesce(p, F.lit("")))), ""
        ),
    ).otherwise(F.col(text))
    several = F.array_distinct(F.filter(F.col("_names"), lambda n: F.coalesce(found[n]["several"], F.lit(False))))
    missing = F.array_distinct(F.filter(F.col("_names"), lambda n: found[n]["content"].isNull()))
    other_action = F.exists(F.col("_segments"), lambda s: s.contains(ACTION_OPEN))
    error = (
        F.when(other_action, F.lit("unsupported action"))
        .when(F.size(several) > 0, F.concat(F.lit("include with several texts: "), F.array_join(several, ", ")))
        .when(F.size(missing) > 0, F.concat(F.lit("missing include: "), F.array_join(missing, ", ")))
    )
    return (
        df.withColumn("include_error", error)
        .withColumn(text, F.when(F.col("include_error").isNull(), strip_comments(joined)))
        .drop("_names", "_segments", "_found")
    )


def expand_includes(df: DataFrame, includes: DataFrame, key: str, text: str = "content", broadcast: bool = True) -> DataFrame:
    """Replace ``{{{ include "NAME" }}}`` in ``text`` and strip comments afterwards.

    ``includes`` has a ``name`` and its ``content``. Included text is not expanded again. A
    missing include, one whose name is given several times, or any other action makes
    ``text`` NULL and fills ``include_error``; a NULL text counts as empty, and so does an
    empty include. Names that no text uses may be missing content or be given several times.

    The size of ``includes`` is measured. A small table becomes one map (unless
    ``broadcast=False``). Beyond that, the distinct (``key``, name) pairs, without the
    texts, are joined to the includes, spread where one name is used everywhere, and each
    key gets back only what it uses. Texts without an action are never shuffled.
    """
    defined = _defined(includes)
    filled = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    action = F.col(text).contains(ACTION_OPEN)
    plain = filled.filter(~action).withColumn("include_error", F.lit(None).cast("string")).withColumn(text, strip_comments(text))
    acting = filled.filter(action)
    entries = F.map_from_entries(F.collect_list(F.struct("name", "include"))).cast(_FOUND)
    if broadcast and _fits_in_a_map(includes):
        table = defined.agg(entries.alias("found")).scalar()
        return plain.unionByName(_rebuild(acting.withColumn("_found", table), text))
    uses = acting.select(key, F.explode(F.array_distinct(include_names(text))).alias("name"))
    found = (
        lookup(uses, defined, ["name"], key, how="inner", broadcast=False, salts=16)
        .groupBy(key)
        .agg(entries.alias("_found"))
    )
    joined = acting.join(found, key, "left").withColumn(
        "_found", F.coalesce(F.col("_found"), F.create_map().cast(_FOUND))
    )
    return plain.unionByName(_rebuild(joined, text))
