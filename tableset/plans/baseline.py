"""Baseline import: log present definitions as applied, without changing data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableset.functions.meta import document_meta_json, index_set_meta_json
from tableset.functions.names import document_identifier
from tableset.operators.lookup import require_keys
from tableset.plans.desired import Desired
from tableset.session import durable
from tableset.sources.store import Store


class MissingKeys(Exception):
    """A key to import is not among the desired state; nothing was logged."""


def baseline(desired: Desired, keys: DataFrame, legacy: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(log rows, missing keys)`` for a table of ``(resource_type, resource_identifier)``.

    An index set is logged without a final name. A document is logged under its name with
    its settings, so that the next change run finds it unchanged; ``legacy`` logs documents
    with empty settings, after which the next run writes them once more.
    """
    sets = desired.index_sets.select(
        F.lit("index_set").alias("resource_type"),
        F.col("index_set").alias("resource_identifier"),
        F.lit("").alias("final_name"),
        "content",
        index_set_meta_json(F.col("meta")).alias("meta"),
    )
    documents = desired.documents.select(
        F.lit("document").alias("resource_type"),
        document_identifier(F.col("index_set"), F.col("name")).alias("resource_identifier"),
        F.col("name").alias("final_name"),
        "content",
        (F.lit("") if legacy else document_meta_json(F.col("meta"))).alias("meta"),
    )
    found, missing = require_keys(keys, sets.unionByName(documents), ["resource_type", "resource_identifier"])
    return found.withColumn("env_name", F.lit(desired.env)), missing


def import_baseline(store: Store, desired: Desired, keys: DataFrame, legacy: bool = False) -> DataFrame:
    """Log present definitions as applied, all keys or none; returns the log rows.

    Everything is logged by one append. A desired state with errors, or a key without a
    definition, stops the import before it.
    """
    problem = desired.errors.orderBy("kind", "key", "reason").first()
    if problem is not None:
        raise MissingKeys(f"{problem['kind']} {problem['key']}: {problem['reason']}")
    rows, missing = baseline(desired, durable(keys), legacy)
    lost = missing.orderBy("resource_type", "resource_identifier").first()
    if lost is not None:
        raise MissingKeys(f"no such {lost['resource_type']} {lost['resource_identifier']!r}")
    rows = durable(rows)
    store.append_log(rows)
    return rows
