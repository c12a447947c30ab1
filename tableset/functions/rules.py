"""Validation rules as named boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tableset.schemas import RESOURCE_TYPES

# Fixed value: a letter or digit first, then letters, digits, dash, underscore, dot.
ENV_PATTERN = r"^[\p{L}\p{N}][\p{L}\p{N}\-_.]*\z"


def valid_env(env: Column) -> Column:
    return F.coalesce(env.rlike(ENV_PATTERN), F.lit(False))


def valid_resource_type(resource_type: Column) -> Column:
    return F.coalesce(resource_type.isin(*RESOURCE_TYPES), F.lit(False))


def failed_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks; a NULL outcome counts as broken."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
