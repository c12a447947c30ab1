"""Document sync: desired documents against the log, written by name into their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableset.functions.json import valid_object
from tableset.operators.transforms import REST, failure, fit_to_schema, rest_of
from tableset.operators.upsert import upsert
from tableset.plans.change_set import document_actions, document_changes, split_errors
from tableset.session import durable


def sync_documents(desired: DataFrame, log: DataFrame, table: DataFrame, env: str) -> tuple[DataFrame, DataFrame]:
    """``(next table, log rows)``.

    ``table`` holds ``alias``, ``_id`` and ``_source``. Changed documents that are not
    ignored are written by name; every changed document is logged. One write each, however
    many documents there are. What changed is found once, and kept for both.
    """
    actions, _ = split_errors(durable(document_actions(document_changes(desired, log, env), env)))
    return upsert(table, document_writes(actions), keys=("alias", "_id")), log_entries(actions, env)


def document_writes(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("action") == "index_document").select(
        F.col("target").alias("alias"), F.col("source").alias("_id"), F.col("definition").alias("_source")
    )


def log_entries(changes: DataFrame, env: str) -> DataFrame:
    """Log rows of a change set (sets and documents)."""
    return changes.filter(F.col("action") == "write_changelog").select(
        F.col("source").alias("resource_type"),
        F.col("key").alias("resource_identifier"),
        F.col("target").alias("final_name"),
        F.lit(env).alias("env_name"),
        F.col("definition").alias("content"),
        "meta",
    )


def parse_documents(writes: DataFrame, schema: T.StructType, carry: tuple[str, ...] = ("_id",)) -> DataFrame:
    """JSON bodies as columns of a declared schema, and ``_rest``; bad bodies and values fail the row."""
    body = F.try_parse_json("_source")
    columns = [F.try_variant_get(body, f"$['{f.name}']", "string").alias(f.name) for f in schema.fields]
    entries = F.coalesce(F.try_variant_get(body, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    rest = rest_of(entries, schema.names).alias(REST)
    parsed = writes.select(*carry, *columns, valid_object("_source").alias("_valid"), rest)
    # Declared fields have come from the body already, so none is left to be taken from the rest.
    fitted = fit_to_schema(parsed, schema, carry=(*carry, "_valid"), rest=True)
    bad = failure("mapper_parsing_exception", "document to index wasn't valid json")
    return fitted.withColumn("_failure", F.when(~F.col("_valid"), bad).otherwise(F.col("_mark"))).drop(
        "_valid", "_mark"
    )
