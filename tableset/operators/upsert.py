"""Writing documents by id into the next state of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableset.functions.json import valid_object
from tableset.operators.latest import first_by
from tableset.operators.spread import by_keys


def check_bodies(updates: DataFrame, body: str = "_source") -> DataFrame:
    """Add ``valid``: whether the body is one JSON object. Callers split on it once."""
    return updates.withColumn("valid", valid_object(body))


def with_ids(updates: DataFrame, id_col: str = "_id") -> DataFrame:
    """A blank id asks for a new document: it gets a generated id."""
    blank = F.coalesce(F.col(id_col), F.lit("")) == ""
    return updates.withColumn(id_col, F.when(blank, F.expr("uuid()")).otherwise(F.col(id_col)))


def upsert(
    base: DataFrame,
    updates: DataFrame,
    keys: Sequence[str] = ("_id",),
    order: Sequence[Column] = (),
    broadcast: bool = True,
) -> DataFrame:
    """Next state: updated rows replace rows of the same key, new keys are added.

    Of several updates of one key the last by ``order`` wins; without ``order`` the updates
    must be unique. Only the update *keys* meet the base: when they are measured to be few,
    the base is not shuffled (see ``by_keys``).
    """
    kept = by_keys(base, updates.select(*keys), list(keys), "left_anti", broadcast)
    if order:
        updates = first_by(updates, keys, [c.desc() for c in order])
    return kept.unionByName(updates.select(*base.columns))


def judge_updates(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Conditional writes: add ``accepted`` to every update.

    ``updates`` holds ``_id``, ``expected_seq`` and ``entry_seq`` (unique in the batch);
    ``base`` holds ``_id`` and ``_seq_no``. An update is accepted when the stored number
    equals the expected one; NULL expects that the id is absent. The number moves with the
    first accepted write, so of several matching updates of one id the lowest ``entry_seq``
    is accepted and the rest conflict.

    Claims are reduced to one per (id, expected number) before they meet the base, and the
    verdict joins back on (id, entry_seq): no step groups by a possibly hot id alone. The
    base is reduced to the ids of the updates first, without a shuffle when these are few.
    """
    claims = updates.groupBy("_id", "expected_seq").agg(F.min("entry_seq").alias("entry_seq"))
    asked = by_keys(base.select("_id", "_seq_no"), claims.select("_id"), ["_id"], "left_semi")
    stored = asked.select(F.col("_id").alias("_stored_id"), "_seq_no")
    winners = (
        claims.join(stored, F.col("_id") == F.col("_stored_id"), "left")
        .filter(F.col("expected_seq").eqNullSafe(F.col("_seq_no")))
        .select("_id", "entry_seq", F.lit(True).alias("accepted"))
    )
    return updates.join(winners, ["_id", "entry_seq"], "left").withColumn(
        "accepted", F.coalesce(F.col("accepted"), F.lit(False))
    )


def cas_upsert(base: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(next state, conflicts)`` of conditional writes. Accepted rows count their number up.

    Both come from the same verdicts; give a durable ``updates`` when both are written.
    """
    judged = judge_updates(base, updates)
    accepted = judged.filter("accepted").withColumn(
        "_seq_no", F.coalesce(F.col("expected_seq"), F.lit(-1)) + 1
    )
    conflicts = judged.filter("NOT accepted").drop("accepted")
    return upsert(base, accepted), conflicts


def delete_keys(base: DataFrame, keys: DataFrame, on: Sequence[str] = ("_id",)) -> DataFrame:
    """Base without the given keys."""
    return by_keys(base, keys.select(*on), list(on), "left_anti")


def write_outcomes(base: DataFrame, updates: DataFrame, keys: Sequence[str] = ("_id",)) -> DataFrame:
    """Updates with ``outcome``: rejected (``valid`` is false), updated (key is stored) or created."""
    stored = by_keys(base.select(*keys), updates.select(*keys), list(keys), "left_semi").withColumn("_stored", F.lit(True))
    return (
        updates.join(stored, list(keys), "left")
        .withColumn(
            "outcome",
            F.when(~F.col("valid"), F.lit("rejected"))
            .when(F.col("_stored"), F.lit("updated"))
            .otherwise(F.lit("created")),
        )
        .drop("_stored")
    )
