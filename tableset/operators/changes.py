"""Change detection: desired state against the log, live definitions and transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableset.functions.json import compare_digests, object_digest
from tableset.operators.spread import lookup
from tableset.schemas import CHANGELOG_KEYS

ERROR_DIGEST = "error"


def with_digest(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add what a comparison needs of a JSON text: ``{into}_empty`` and ``{into}_digest``."""
    value = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({f"{into}_empty": value == "", f"{into}_digest": object_digest(value)})


def with_stored_digests(log: DataFrame) -> DataFrame:
    """Log rows with ``content_digest`` and ``meta_digest``, computed for those that were stored without.

    A stored digest is empty for an empty text and ``error`` for what isn't one JSON object.
    """
    for text in ("content", "meta"):
        value = F.coalesce(F.col(text), F.lit(""))
        found = F.when(value == "", F.lit("")).otherwise(F.coalesce(object_digest(value), F.lit(ERROR_DIGEST)))
        stored = F.col(f"{text}_digest") if f"{text}_digest" in log.columns else F.lit(None)
        log = log.withColumn(f"{text}_digest", F.coalesce(stored, found))
    return log


def _logged(latest: DataFrame, text: str, into: str) -> DataFrame:
    """``with_digest``, from the stored digest where the log has one for every row."""
    if f"{text}_digest" not in latest.columns:
        return with_digest(latest, text, into)
    digest = F.col(f"{text}_digest")
    return latest.withColumns({f"{into}_empty": digest == "", f"{into}_digest": F.when(~digest.isin("", ERROR_DIGEST), digest)})


def digest_status(required: str, current: str) -> Column:
    return compare_digests(
        *[F.col(f"{side}_{part}") for part in ("empty", "digest") for side in (required, current)]
    )


def change_status(
    desired: DataFrame, latest: DataFrame, keys: Sequence[str] = CHANGELOG_KEYS
) -> DataFrame:
    """Desired rows with ``status`` against the latest log rows: new, changed, same or error.

    ``desired`` holds the keys, ``content`` and ``meta`` (text); ``latest`` holds at most
    one row per key. Content decides first, then meta. Every text is parsed once, on its
    own side of the join, and a logged one not at all if its digest is stored.
    """
    logged = _logged(_logged(latest, "content", "_log_c"), "meta", "_log_m").select(
        *keys, F.lit(True).alias("_logged"), "_log_c_empty", "_log_c_digest", "_log_m_empty", "_log_m_digest"
    )
    wanted = with_digest(with_digest(desired, "content", "_c"), "meta", "_m")
    content = digest_status("_c", "_log_c")
    status = (
        F.when(F.col("_logged").isNull(), F.lit("new"))
        .when(content != "same", content)
        .otherwise(digest_status("_m", "_log_m"))
    )
    joined = wanted.join(logged, list(keys), "left").withColumn("status", status)
    return joined.select(*desired.columns, "status")


def definition_status(desired: DataFrame, live: DataFrame, key: str = "name") -> DataFrame:
    """Desired definitions with ``status`` against live ones: new, changed, same or error.

    Both hold ``key`` and ``definition``. A blank live definition counts as absent.
    """
    current = with_digest(live, "definition", "_live").select(key, "_live_empty", "_live_digest")
    joined = with_digest(desired, "definition", "_d").join(current, key, "left")
    absent = F.coalesce(F.col("_live_empty"), F.lit(True))
    status = F.when(absent, F.lit("new")).otherwise(digest_status("_d", "_live"))
    return joined.withColumn("status", status).select(*desired.columns, "status")


def using_changed(
    sets: DataFrame,
    changed: DataFrame,
    set_pipeline: Column,
    spread_by: str,
    key: str = "name",
    broadcast: bool = True,
) -> DataFrame:
    """Add ``pipeline_changed``: whether the pipeline of a row is among ``changed``.

    ``changed`` is unique per ``key``, so no row is multiplied. A blank pipeline becomes a
    NULL key, which never matches. One pipeline may serve very many sets, see ``lookup``.
    """
    flags = changed.select(F.col(key).alias("_pipeline"), F.lit(True).alias("pipeline_changed"))
    marked = sets.withColumn("_pipeline", F.when(set_pipeline != "", set_pipeline))
    return (
        lookup(marked, flags, ["_pipeline"], spread_by, broadcast=broadcast)
        .withColumn("pipeline_changed", F.coalesce(F.col("pipeline_changed"), F.lit(False)))
        .drop("_pipeline")
    )


def _changed(df: DataFrame) -> Column:
    needed = F.col("status").isin("new", "changed")
    if "pipeline_changed" in df.columns:
        needed = needed | ((F.col("status") == "same") & F.col("pipeline_changed"))
    return needed


def changed_only(df: DataFrame) -> DataFrame:
    """Rows with work to do: new or changed, or using a changed pipeline."""
    return df.filter(_changed(df))


def needs_action(df: DataFrame) -> DataFrame:
    """Rows with work to do or with an error; unchanged rows go before anything is built for them."""
    return df.filter(_changed(df) | (F.col("status") == "error"))
