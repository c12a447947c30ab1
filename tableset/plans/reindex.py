"""Copying documents into new versions: transform, cap, fit to the declared columns, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableset.operators.cap import TOP_N_LIMIT, UNLIMITED, cap
from tableset.operators.latest import first_by
from tableset.operators.report import outcome_report
from tableset.operators.transforms import Step, apply_steps, fit_to_schema, outcome


def newest_per_id(src: DataFrame, version_col: str = "version_name", also: Sequence[str] = ()) -> DataFrame:
    """One document per id of an alias with several members: that of the newest version name."""
    return first_by(src, [*also, "_id"], [F.col(version_col).desc()])


def copy_rows(
    src: DataFrame, schema: T.StructType, steps: Sequence[Step] = (), carry: tuple[str, ...] = ("_id",), rest: bool = False
) -> DataFrame:
    """Every source document with its new columns, ``_failure`` and ``outcome``. No shuffle.

    With ``rest`` also ``_rest``, the fields that the schema doesn't declare.
    """
    fitted = fit_to_schema(apply_steps(src, steps), schema, carry, rest)
    return fitted.withColumn("outcome", outcome()).withColumnRenamed("_mark", "_failure")


def reindex(
    src: DataFrame,
    schema: T.StructType,
    steps: Sequence[Step] = (),
    max_docs: int = UNLIMITED,
    several_members: bool = False,
    top_n_limit: int = TOP_N_LIMIT,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(good, rejected, report)`` of one copy.

    ``src`` has ``_id`` and columns; with ``several_members`` also ``version_name``. The
    cap counts documents read, so it can become a filter on the scan, and transforms run
    on the kept documents only. All three results come from one frame: write it once
    (``copy_rows``) where more than one of them is needed.
    """
    if several_members:
        src = newest_per_id(src).drop("version_name")
    rows = copy_rows(cap(src, max_docs, top_n_limit=top_n_limit), schema, steps)
    good = rows.filter("outcome = 'created'").drop("_failure", "outcome")
    rejected = rows.filter("outcome = 'rejected'").drop("outcome")
    return good, rejected, outcome_report(rows)


def seed_source(env: str, prototype_env: str, disabled: Column, static_index: Column, exists: Column) -> Column:
    """Whether an index set starts with a copy from the prototype environment."""
    possible = bool(prototype_env) and prototype_env != env
    return F.lit(possible) & ~exists & ~disabled & (static_index == "")
