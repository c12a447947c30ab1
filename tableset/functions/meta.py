"""Typed settings of resources: reading with defaults, and writing for the changelog."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The defaults of unset settings.
DEFAULT_INDEX = ""
DEFAULT_DISABLED = False
DEFAULT_MAX_DOCS = -1
DEFAULT_PIPELINE = ""
DEFAULT_IGNORED = False

# The field paths of a settings file, and the groups among them.
_PATHS = {
    "index": "$.index",
    "disabled": "$.prototype.disabled",
    "max_docs": "$.prototype.maxDocs",
    "pipeline": "$.reindex.pipeline",
    "ignored": "$.ignored",
}
_GROUPS = ("prototype", "reindex")
_TYPES = {"disabled": "boolean", "max_docs": "int", "ignored": "boolean"}


def _raw(text: Column, name: str) -> Column:
    """A setting as text, whether written as text or not; NULL when unset."""
    return F.try_variant_get(F.try_parse_json(text), _PATHS[name], "string")


def _typed(text: Column, name: str) -> Column:
    raw = _raw(text, name)
    return F.trim(raw).try_cast(_TYPES[name]) if name in _TYPES else raw


def _group(text: Column, name: str) -> Column:
    """A group of settings, NULL when unset."""
    group = F.try_variant_get(F.try_parse_json(text), f"$.{name}", "variant")
    return F.when(~F.is_variant_null(group), group)


def _wrong_types(text: Column, names: tuple[str, ...], groups: tuple[str, ...] = ()) -> list[Column]:
    """An error for each setting that is there but can't be read as its type."""
    settings = [
        F.when(_raw(text, n).isNotNull() & _typed(text, n).isNull(), F.lit(f"{_PATHS[n][2:]} isn't of type {_TYPES[n]}"))
        for n in names
    ]
    return settings + [
        F.when(_group(text, g).isNotNull() & F.try_variant_get(_group(text, g), "$", "map<string,variant>").isNull(), F.lit(f"{g} isn't a group of settings"))
        for g in groups
    ]


def _index_set(index: Column, disabled: Column, max_docs: Column, pipeline: Column) -> Column:
    return F.struct(
        F.coalesce(index, F.lit(DEFAULT_INDEX)).alias("index"),
        F.struct(
            F.coalesce(disabled, F.lit(DEFAULT_DISABLED)).alias("disabled"),
            F.coalesce(max_docs, F.lit(DEFAULT_MAX_DOCS)).cast("int").alias("max_docs"),
        ).alias("prototype"),
        F.struct(F.coalesce(pipeline, F.lit(DEFAULT_PIPELINE)).alias("pipeline")).alias("reindex"),
    )


def index_set_meta(text: Column) -> Column:
    """Settings of an index set from JSON text; NULL text and unset keys give the defaults.

    Numbers and truth values may be written as text. What can't be read is an error of
    ``index_set_meta_errors``; the default that stands here for it must not be used.
    """
    return _index_set(*(_typed(text, n) for n in ("index", "disabled", "max_docs", "pipeline")))


def document_meta(text: Column) -> Column:
    return F.struct(F.coalesce(_typed(text, "ignored"), F.lit(DEFAULT_IGNORED)).alias("ignored"))


def document_meta_errors(text: Column) -> Column:
    return F.array_compact(F.array(*_wrong_types(text, ("ignored",))))


def index_set_meta_errors(text: Column) -> Column:
    """What is wrong with an index set's settings: unreadable values, and groups beside a static index."""
    static = F.coalesce(_raw(text, "index"), F.lit("")) != ""
    beside = [F.when(static & _group(text, g).isNotNull(), F.lit(f"a static index takes no {g} settings")) for g in _GROUPS]
    return F.array_compact(F.array(*beside, *_wrong_types(text, ("disabled", "max_docs"), _GROUPS)))


def index_set_meta_json(meta: Column) -> Column:
    """Settings of an index set as logged."""
    return F.to_json(
        F.struct(
            meta["index"].alias("Index"),
            F.struct(
                meta["prototype"]["disabled"].alias("Disabled"),
                meta["prototype"]["max_docs"].alias("MaxDocs"),
            ).alias("Prototype"),
            F.struct(meta["reindex"]["pipeline"].alias("Pipeline")).alias("Reindex"),
        )
    )


def document_meta_json(meta: Column) -> Column:
    """Settings of a document as logged."""
    return F.to_json(F.struct(meta["ignored"].alias("Ignored")))
