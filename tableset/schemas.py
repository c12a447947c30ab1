"""Schemas shared by the whole library, and the declared schema of a version."""

from __future__ import annotations

import json

from pyspark.sql import types as T

STRING, LONG, INT, BOOLEAN, TIMESTAMP = (
    T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()
)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, type_) for name, type_ in fields.items()])


RESOURCE = struct(path=STRING, file_name=STRING, identifier=STRING, env=STRING, content=STRING)
INDEX_SET_META = struct(
    index=STRING, prototype=struct(disabled=BOOLEAN, max_docs=INT), reindex=struct(pipeline=STRING)
)
DOCUMENT_META = struct(ignored=BOOLEAN)
INDEX_SET = struct(index_set=STRING, env=STRING, content=STRING, meta=INDEX_SET_META)
DOCUMENT = struct(index_set=STRING, name=STRING, content=STRING, meta=DOCUMENT_META)
PIPELINE = struct(name=STRING, definition=STRING)
INCLUDE = struct(name=STRING, content=STRING)
CHANGELOG = struct(
    resource_type=STRING, resource_identifier=STRING, final_name=STRING, env_name=STRING,
    content=STRING, meta=STRING, timestamp=TIMESTAMP, entry_seq=LONG,
)
# The log as stored: with the digests of its texts.
LOGGED = T.StructType([*CHANGELOG.fields, *struct(content_digest=STRING, meta_digest=STRING).fields])
MEMBERSHIP = struct(alias=STRING, version_name=STRING)
# Which batches of the log a table of latest entries covers, as ranges of numbers, and its folder.
COVERED = struct(folder=STRING, first=LONG, last=LONG)
CHANGE_SET = struct(
    stage=INT, key=STRING, step=INT, action=STRING, target=STRING, source=STRING,
    max_docs=INT, pipeline=STRING, definition=STRING, meta=STRING,
)
VERSION = struct(version_name=STRING, definition=STRING, layout=STRING, folder=STRING)
# Versions and the members of aliases as rows of one table; a version has no alias.
CATALOG = struct(alias=STRING, version_name=STRING, definition=STRING, layout=STRING, folder=STRING)
# Where documents are that a write moved out of the folder their version was created in: a
# bucket's folder, or in bucket -1 the folder and number of buckets that all went to.
PART = struct(base=STRING, bucket=INT, folder=STRING, buckets=INT)
FAILURE = struct(cause_type=STRING, cause_reason=STRING)
REPORT = struct(
    total=LONG, created=LONG, updated=LONG, rejected=LONG, dropped=LONG, done=LONG,
    first_failure=struct(id=STRING, cause_type=STRING, cause_reason=STRING),
)

CHANGELOG_KEYS = ("resource_type", "resource_identifier", "env_name")

# The resource types that have a changelog.
RESOURCE_TYPES = ("index_set", "document")

# Declared field type -> Spark type. Any other type is kept as text.
FIELD_TYPES = {
    "keyword": T.StringType(),
    "text": T.StringType(),
    "date": T.TimestampType(),
    "boolean": T.BooleanType(),
    "long": T.LongType(),
}


def declared_schema(definition: str) -> T.StructType:
    """Columns declared by one table definition, ``{"mappings": {"properties": {...}}}``.

    A blank definition, or one without properties, declares no columns.
    """
    body = json.loads(definition) if definition.strip() else {}
    properties = body.get("mappings", {}).get("properties", {})
    return T.StructType(
        [
            T.StructField(name, FIELD_TYPES.get(field.get("type"), T.StringType()))
            for name, field in properties.items()
        ]
    )


def layout_text(schema: T.StructType) -> str:
    """Declared columns as text; versions with the same text share a layout."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema.fields)
