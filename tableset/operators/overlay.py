"""Environment overlay: the exact environment, else the default one, else nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableset.functions.names import DEFAULT_ENV
from tableset.operators.latest import first_by


def overlay(
    df: DataFrame,
    keys: Sequence[str],
    env_col: str,
    env: str,
    default: str = DEFAULT_ENV,
    order: Sequence[Column] = (),
) -> DataFrame:
    """One row per key; among rows of equal rank the one that comes last by ``order`` stays.

    ``order`` is given in reading order and is turned round here. Other environments are
    filtered out first, so they are never shuffled.
    """
    rank = F.when(F.col(env_col) == env, F.lit(0)).otherwise(F.lit(1))
    candidates = df.filter(F.col(env_col).isin(env, default))
    return first_by(candidates, keys, [rank, *[c.desc() for c in order]])
