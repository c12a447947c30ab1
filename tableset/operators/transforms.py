"""Document transforms: an ordered list of named steps applied to columns.

A step is a one-key mapping, ``{"lowercase": {"field": "lang"}}``. Steps are declared in
JSON as ``{"description": ..., "processors": [...]}``, stored by name, and applied while
documents are copied. The first thing that happens to a document, a failure or a drop, is
kept in ``_mark``; what comes after it does not count. Marked documents stay in the frame
so that they can be counted and reported.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableset.schemas import FAILURE
from tableset.session import setting

Step = dict[str, dict]

# Target types of a conversion.
CONVERT_TYPES = {
    "string": "string",
    "boolean": "boolean",
    "integer": "int",
    "long": "bigint",
    "float": "float",
    "double": "double",
}
DATE_TARGET = "@timestamp"

# Column of the fields that a stored definition doesn't declare, and columns that are no fields.
REST = "_rest"
SYSTEM = ("_id", "_seq_no", REST, "folder", "version_name", "outcome", "_failure")
_ENTRIES = "map<string,variant>"

# The mark of a dropped document.
DROPPED = "dropped"


def parse_steps(definition: str) -> list[Step]:
    """Steps of one stored definition; a blank definition is the identity."""
    return json.loads(definition).get("processors", []) if definition.strip() else []


def failure(cause_type: str, reason: Column | str) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(cause_type).alias("cause_type"), reason.alias("cause_reason")).cast(FAILURE)


def mark(df: DataFrame, broken: Column, cause_type: str, reason: Column | str) -> DataFrame:
    """Mark rows, unless something happened to them before."""
    return df.withColumn("_mark", F.coalesce(F.col("_mark"), F.when(broken, failure(cause_type, reason))))


def with_marks(df: DataFrame) -> DataFrame:
    return df if "_mark" in df.columns else df.withColumn("_mark", F.lit(None).cast(FAILURE))


def _field(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def _require(df: DataFrame, spec: dict) -> DataFrame:
    """Unless the step tolerates it, a missing or NULL field fails the document."""
    if spec.get("ignore_missing", False):
        return df
    name = spec["field"]
    return mark(df, _field(df, name).isNull(), "illegal_argument_exception", f"field [{name}] not present")


def _map_field(change: Callable[[Column, dict], Column]) -> Callable[[DataFrame, dict], DataFrame]:
    def apply(df: DataFrame, spec: dict) -> DataFrame:
        df = _require(df, spec)
        return df.withColumn(spec.get("target_field", spec["field"]), change(_field(df, spec["field"]), spec))

    return apply


def _set(df: DataFrame, spec: dict) -> DataFrame:
    value = _field(df, spec["copy_from"]) if "copy_from" in spec else F.lit(spec["value"])
    name = spec["field"]
    if not spec.get("override", True) and name in df.columns:
        value = F.coalesce(_field(df, name), value)
    return df.withColumn(name, value)


def _rename(df: DataFrame, spec: dict) -> DataFrame:
    df = _require(df, spec)
    value = _field(df, spec["field"])
    return df.withColumn(spec["target_field"], value).drop(spec["field"])


def _remove(df: DataFrame, spec: dict) -> DataFrame:
    names = spec["field"] if isinstance(spec["field"], list) else [spec["field"]]
    for name in names:
        df = _require(df, {**spec, "field": name})
    return df.drop(*names)


def _convert(df: DataFrame, spec: dict) -> DataFrame:
    df = _require(df, spec)
    value = _field(df, spec["field"])
    converted = value.try_cast(CONVERT_TYPES[spec["type"]])
    reason = F.concat(F.lit("unable to convert ["), value.cast("string"), F.lit(f"] to {spec['type']}"))
    df = mark(df, value.isNotNull() & converted.isNull(), "illegal_argument_exception", reason)
    return df.withColumn(spec.get("target_field", spec["field"]), converted)


def _date(df: DataFrame, spec: dict) -> DataFrame:
    df = _require(df, spec)
    value = _field(df, spec["field"]).cast("string")
    parsed = F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in spec["formats"]])
    reason = F.concat(F.lit("unable to parse date ["), value, F.lit("]"))
    df = mark(df, value.isNotNull() & parsed.isNull(), "illegal_argument_exception", reason)
    return df.withColumn(spec.get("target_field", DATE_TARGET), parsed)


def _drop(df: DataFrame, spec: dict) -> DataFrame:
    """Drop where the condition holds. A document whose fields are there, but of a kind the
    condition can't compare (a word where it wants a number), fails."""
    # Without ANSI casts a failed one is NULL instead of an error that ends the job.
    with setting(df.sparkSession, "spark.sql.ansi.enabled", "false"):
        judged = df.withColumn("_holds", F.expr(spec["if"]).cast("boolean"))
    used = [c for c in df.columns if c != "_mark" and re.search(rf"(?<!\w){re.escape(c)}(?!\w)", spec["if"])]
    present = reduce(lambda a, b: a & b, [_field(df, c).isNotNull() for c in used], F.lit(bool(used)))
    reason = f"unable to evaluate [{spec['if']}]"
    judged = mark(judged, F.col("_holds").isNull() & present, "illegal_argument_exception", reason)
    return mark(judged, F.col("_holds"), DROPPED, F.lit(None)).drop("_holds")


STEPS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "set": _set,
    "rename": _rename,
    "remove": _remove,
    "convert": _convert,
    "lowercase": _map_field(lambda c, s: F.lower(c)),
    "uppercase": _map_field(lambda c, s: F.upper(c)),
    "trim": _map_field(lambda c, s: F.trim(c)),
    "gsub": _map_field(lambda c, s: F.regexp_replace(c, s["pattern"], s["replacement"])),
    "split": _map_field(lambda c, s: F.split(c, s["separator"])),
    "date": _date,
    "drop": _drop,
}


def apply_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Apply the steps in order; no step shuffles. Adds ``_mark``."""
    df = with_marks(df)
    for step in steps:
        ((name, spec),) = step.items()
        if name not in STEPS:
            raise ValueError(f"unknown transform step {name!r}")
        df = STEPS[name](df, spec)
    return df


def rest_of(entries: Column, declared: Sequence[str]) -> Column:
    """JSON text of the entries (map of variants) that aren't declared; NULL without any."""
    left = F.map_filter(entries, lambda k, v: v.isNotNull() & ~k.isin(list(declared)) if declared else v.isNotNull())
    return F.when(F.size(left) > 0, F.to_json(left))


def _as_variant(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    value = _field(df, name)
    return F.to_variant_object(value) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else value.cast("variant")


def _rest(df: DataFrame, schema: T.StructType, carry: Sequence[str]) -> Column:
    """Fields of the documents that the schema doesn't declare: undeclared columns, and those of ``_rest`` before."""
    known = {*schema.names, *carry, *SYSTEM, "_mark"}
    own = [c for c in df.columns if c not in known]
    pairs = [x for c in own for x in (F.lit(c), _as_variant(df, c))]
    entries = F.create_map(*pairs) if pairs else F.create_map().cast(_ENTRIES)
    if REST in df.columns:
        before = F.coalesce(F.from_json(REST, _ENTRIES), F.create_map().cast(_ENTRIES))
        # A column of the same name, where there is one, holds what the document has now.
        kept = F.map_filter(before, lambda k, v: ~k.isin(own)) if own else before
        entries = F.map_concat(kept, entries)
    return rest_of(entries, schema.names)


def fit_to_schema(df: DataFrame, schema: T.StructType, carry: Sequence[str] = ("_id",), rest: bool = False) -> DataFrame:
    """Columns of the declared schema, by name; a value that does not fit fails the row.

    Absent columns are taken from ``_rest``, or are NULL. With ``rest`` the undeclared fields
    are kept in ``_rest`` (JSON text), else they are left out. A rejected row keeps its typed
    columns NULL where the cast failed.
    """
    df = with_marks(df)
    undeclared = [_rest(df, schema, carry).alias(REST)] if rest else []
    columns = []
    for field in schema.fields:
        before = F.try_variant_get(F.try_parse_json(REST), f"$['{field.name}']", "string") if REST in df.columns else None
        if field.name not in df.columns and before is None:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        value = before if field.name not in df.columns else _field(df, field.name)
        kind = T.StringType() if field.name not in df.columns else df.schema[field.name].dataType
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            value, kind = F.to_json(value), None
        if before is not None and field.name in df.columns:
            value, kind = F.coalesce(value.cast("string"), before) if kind != T.StringType() else F.coalesce(value, before), T.StringType()
        if kind == field.dataType:
            columns.append(value.alias(field.name))
            continue
        fitted = value.try_cast(field.dataType)
        reason = F.concat(
            F.lit(f"failed to parse field [{field.name}] of type [{field.dataType.simpleString()}]: "),
            value.cast("string"),
        )
        df = mark(df, value.isNotNull() & fitted.isNull(), "mapper_parsing_exception", reason)
        columns.append(fitted.alias(field.name))
    return df.select(*carry, *columns, *undeclared, "_mark")


def outcome(mark_col: str = "_mark") -> Column:
    """created, dropped or rejected."""
    kind = F.col(mark_col)["cause_type"]
    return (
        F.when(kind.isNull(), F.lit("created"))
        .when(kind == DROPPED, F.lit("dropped"))
        .otherwise(F.lit("rejected"))
    )
