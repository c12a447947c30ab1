"""Names: splitting file names and document identifiers, deriving table names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name formats.
DEFAULT_ENV = "default"
VERSION_FORMAT = "yyyyMMddHHmmss"
META_SUFFIX = ".meta.json"

_RESOURCE_NAME = r"(?is)^(.*)-([^-]*)\.json\z"
_META_NAME = r"(?is)^(.*)-([^-]*)\.meta\.json\z"
_DOCUMENT_ID = r"(?s)^(.+)-([^-]+)\z"


def _split(name: Column, pattern: str) -> Column:
    ok = name.rlike(pattern)
    return F.struct(
        F.when(ok, F.regexp_extract(name, pattern, 1)).alias("head"),
        F.when(ok, F.regexp_extract(name, pattern, 2)).alias("tail"),
        F.coalesce(ok, F.lit(False)).alias("valid"),
    )


def split_resource_name(name: Column) -> Column:
    """``{identifier}-{env}.json`` at the last dash: struct<head, tail, valid>."""
    return _split(name, _RESOURCE_NAME)


def split_meta_name(name: Column) -> Column:
    """``{identifier}-{env}.meta.json`` at the last dash: struct<head, tail, valid>."""
    return _split(name, _META_NAME)


def split_document_id(identifier: Column) -> Column:
    """``{set}-{name}`` at the last dash; neither part may be empty: struct<head, tail, valid>."""
    return _split(identifier, _DOCUMENT_ID)


def alias_name(index_set: Column, env: Column) -> Column:
    return F.concat_ws("-", env, index_set)


def version_name(index_set: Column, env: Column, version: Column) -> Column:
    return F.concat_ws("_", alias_name(index_set, env), version)


def pipeline_id(name: Column, env: Column) -> Column:
    """Stored id of a pipeline; a blank name stays blank."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("")).otherwise(F.concat_ws("-", env, name))


def document_identifier(index_set: Column, name: Column) -> Column:
    return F.concat_ws("/", index_set, name)


def version_stamp(moment: Column) -> Column:
    """Version suffix of a moment in time, to the second, in the session time zone (UTC)."""
    return F.date_format(moment, VERSION_FORMAT)
