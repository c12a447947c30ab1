"""Outcome counters of a copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tableset.schemas import REPORT


def report_columns() -> list[Column]:
    """The counters as aggregates, for ``agg`` or for ``observe`` while the rows are written."""
    o = F.col("outcome")
    failed = F.struct(
        F.col("_id").cast("string").alias("id"),
        F.col("_failure.cause_type").alias("cause_type"),
        F.col("_failure.cause_reason").alias("cause_reason"),
    )
    return [
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(o == name).alias(name) for name in ("created", "updated", "rejected", "dropped")],
        F.min_by(failed, F.when(o == "rejected", F.col("_id"))).alias("first_failure"),
    ]


def report_of(counted: Row) -> Row:
    """The report out of observed counters."""
    values = counted.asDict() | {"done": counted["created"] + counted["updated"]}
    return Row(**{name: values[name] for name in REPORT.names})


def outcome_report(outcomes: DataFrame) -> DataFrame:
    """One row of counters from one row per document: ``_id``, ``outcome``, ``_failure``.

    ``outcome`` is created, updated, dropped or rejected. ``done`` counts written rows.
    The first failure is the one with the lowest id. Every counter combines inside the
    tasks; one row per task is shuffled.
    """
    return outcomes.agg(*report_columns()).select(
        "total", "created", "updated", "rejected", "dropped",
        (F.col("created") + F.col("updated")).alias("done"),
        F.col("first_failure").cast(REPORT["first_failure"].dataType).alias("first_failure"),
    )
