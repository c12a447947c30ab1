"""Desired state of one environment, resolved from resource rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableset.functions.json import valid_object
from tableset.functions.meta import document_meta, document_meta_errors, index_set_meta, index_set_meta_errors
from tableset.functions.names import split_document_id
from tableset.operators.includes import expand_includes
from tableset.operators.overlay import overlay
from tableset.session import durable
from tableset.sources.resources import read_includes, read_resources

# The folders of a resource tree, and the text of a load error.
INDEX_SETS, PIPELINES, DOCUMENTS, INCLUDES = "indexSets", "pipelines", "documents", "includes"
BAD_DOCUMENT_NAME = "document filenames should look like {indexSet}-{name}-{environment}.json"

ERROR_COLUMNS = ("kind", "key", "reason")


@dataclass
class Desired:
    """Tables of one environment. ``errors`` has one row per problem; nothing is hidden."""

    env: str
    index_sets: DataFrame
    pipelines: DataFrame
    documents: DataFrame
    errors: DataFrame


def resolve_kind(files: DataFrame, kind: str, env: str) -> DataFrame:
    """The files of one kind that count in an environment, one per identifier.

    Of several files with one name the last by path stays.
    """
    return overlay(files.filter(F.col("kind") == kind), ["identifier"], "env", env, order=[F.col("path")])


def join_meta(resources: DataFrame, meta: DataFrame, how: str) -> DataFrame:
    """Attach settings texts by identifier; ``full`` keeps settings without a resource."""
    settings = meta.select("identifier", F.col("content").alias("meta_text"), F.col("env").alias("_meta_env"))
    joined = resources.select("identifier", "env", "content").join(settings, "identifier", how)
    return (
        joined.withColumn("env", F.coalesce("env", "_meta_env"))
        .withColumn("content", F.coalesce("content", F.lit("")))
        .drop("_meta_env")
    )


def _bad_meta(text: Column) -> Column:
    return F.when((F.trim(F.coalesce(text, F.lit(""))) != "") & ~valid_object(text), F.lit("unreadable settings"))


def resolve_index_sets(files: DataFrame, env: str) -> DataFrame:
    """Index sets with typed ``meta`` and ``errors``; content and settings overlay independently."""
    joined = join_meta(resolve_kind(files, "resource", env), resolve_kind(files, "meta", env), "full")
    errors = F.array_compact(F.array_append(index_set_meta_errors(F.col("meta_text")), _bad_meta(F.col("meta_text"))))
    return joined.select(
        F.col("identifier").alias("index_set"),
        "env",
        "content",
        index_set_meta(F.col("meta_text")).alias("meta"),
        errors.alias("errors"),
    )


def resolve_documents(files: DataFrame, env: str) -> DataFrame:
    """Documents with typed ``meta`` and ``errors``; settings without a document are left out."""
    joined = join_meta(resolve_kind(files, "resource", env), resolve_kind(files, "meta", env), "left")
    parts = split_document_id(F.col("identifier"))
    named = F.array(F.when(~parts["valid"], F.lit(BAD_DOCUMENT_NAME)), _bad_meta(F.col("meta_text")))
    errors = F.array_compact(F.concat(named, document_meta_errors(F.col("meta_text"))))
    return joined.select(
        "identifier",
        parts["head"].alias("index_set"),
        parts["tail"].alias("name"),
        "content",
        document_meta(F.col("meta_text")).alias("meta"),
        errors.alias("errors"),
    )


def resolve_pipelines(files: DataFrame, env: str) -> DataFrame:
    resources = resolve_kind(files, "resource", env)
    return resources.select(F.col("identifier").alias("name"), F.col("content").alias("definition"))


def _row_errors(df: DataFrame, kind: str, key: str) -> DataFrame:
    listed = df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.explode("errors").alias("reason"))
    return listed.select(*ERROR_COLUMNS)


def _include_errors(df: DataFrame, kind: str, key: str) -> DataFrame:
    failed = df.filter(F.col("include_error").isNotNull())
    return failed.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col("include_error").alias("reason"))


def resolve_rows(
    env: str, set_files: DataFrame, pipeline_files: DataFrame, document_files: DataFrame, includes: DataFrame,
    broadcast_includes: bool = True, keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> Desired:
    """Desired state from parsed file rows (``kind``, ``identifier``, ``env``, ``path``, ``content``).

    ``keep`` is applied to each resolved table before it is split into rows and errors.
    """
    sets = expand_includes(resolve_index_sets(set_files, env), includes, "index_set", broadcast=broadcast_includes)
    pipelines = expand_includes(
        resolve_pipelines(pipeline_files, env), includes, "name", text="definition", broadcast=broadcast_includes
    )
    documents = expand_includes(
        resolve_documents(document_files, env), includes, "identifier", broadcast=broadcast_includes
    )
    sets, pipelines, documents = keep(sets), keep(pipelines), keep(documents)
    errors = reduce(
        DataFrame.unionByName,
        [
            _row_errors(sets, "index_set", "index_set"),
            _include_errors(sets, "index_set", "index_set"),
            _include_errors(pipelines, "pipeline", "name"),
            _row_errors(documents, "document", "identifier"),
            _include_errors(documents, "document", "identifier"),
        ],
    )
    sound = F.col("include_error").isNull()
    faultless = sound & (F.size("errors") == 0)
    return Desired(
        env,
        sets.filter(faultless).select("index_set", "env", "content", "meta"),
        pipelines.filter(sound).select("name", "definition"),
        documents.filter(faultless).select("index_set", "name", "content", "meta"),
        errors,
    )


def resolve(spark: SparkSession, root: str, env: str) -> tuple[Desired, DataFrame]:
    """``(desired state, skipped files)`` of a resource tree.

    A tree is many small files, so each table is resolved once and kept.
    """
    root = root.rstrip("/")
    found = [read_resources(spark, f"{root}/{folder}") for folder in (INDEX_SETS, PIPELINES, DOCUMENTS)]
    skipped = reduce(DataFrame.unionByName, [s for _, s in found])
    includes = read_includes(spark, f"{root}/{INCLUDES}")
    desired = resolve_rows(env, *[rows for rows, _ in found], includes, keep=durable)
    return desired, skipped
