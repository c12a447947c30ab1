"""Layout of a table definition: versions with the same declared columns are stored together."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from tableset.schemas import FIELD_TYPES, declared_schema, layout_text

_ID_LENGTH = 16
_DEFINITION = "mappings struct<properties: map<string, struct<type: string>>>"


def layout_id(definition: str) -> str:
    """Layout of one definition."""
    return hashlib.sha256(layout_text(declared_schema(definition)).encode()).hexdigest()[:_ID_LENGTH]


def layout_of(definition: Column) -> Column:
    """Layout of a column of definitions; the same as ``layout_id`` of each."""
    types = F.create_map(*[F.lit(x) for name, type_ in FIELD_TYPES.items() for x in (name, type_.simpleString())])
    fields = F.map_entries(F.from_json(definition, _DEFINITION)["mappings"]["properties"])
    columns = F.transform(
        fields,
        lambda f: F.concat(
            f["key"], F.lit(":"), F.coalesce(F.element_at(types, F.coalesce(f["value"]["type"], F.lit(""))), F.lit("string"))
        ),
    )
    return F.left(F.sha2(F.coalesce(F.array_join(columns, ","), F.lit("")), 256), F.lit(_ID_LENGTH))
