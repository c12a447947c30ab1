"""Carrying out a change set: copy, verify, publish by one swap, write documents, log last.

The order makes a broken run harmless. New versions are invisible until the swap, and the
log is written last, so whatever was not finished is found changed by the next run.
Table-level work is grouped: one Spark job per layout and transform, however many index
sets there are.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from tableset.functions.json import valid_object
from tableset.functions.layout import layout_id, layout_of
from tableset.operators.cap import UNLIMITED, cap_by_key
from tableset.operators.report import report_columns, report_of
from tableset.operators.spread import lookup
from tableset.operators.transforms import Step, parse_steps
from tableset.plans.change_set import planned_actions, removals, split_errors
from tableset.plans.desired import Desired
from tableset.plans.documents import document_writes, log_entries, parse_documents
from tableset.plans.reindex import copy_rows, newest_per_id
from tableset.plans.stored_writes import grow, put_documents
from tableset.schemas import declared_schema
from tableset.session import durable
from tableset.sources.store import SnapshotConflict, State, Store


# Batches of the log after which a run keeps its latest entries apart.
COMPACT_AFTER = 32


class MigrationError(Exception):
    """The run stopped; nothing that readers see has changed unless said otherwise."""


def migrate(store: Store, desired: Desired, version: str, prototype_env: str = "") -> DataFrame:
    """Bring the stored tables to the desired state; returns the actions that were carried out.

    What is published starts from the snapshots that the plan was made from. If another run has
    published since, this one fails with ``SnapshotConflict`` and readers see nothing of it.
    """
    state = store.state()
    # The tables read here are changed below, so the actions are fixed first, once.
    planned = durable(
        planned_actions(desired, store.recent_log(), state.membership, state.pipelines, version, prototype_env)
    )
    changes, errors = split_errors(planned)
    problem = errors.orderBy("kind", "key", "reason").first()
    if problem is not None:
        raise MigrationError(f"{problem['kind']} {problem['key']}: {problem['reason']}")
    apply_changes(store, changes, desired.env, state)
    return changes


def apply_changes(store: Store, changes: DataFrame, env: str, state: State | None = None) -> None:
    """Carry out the actions that were planned from ``state``, stage by stage; stages without actions are left out."""
    state = store.state() if state is None else state
    kinds = {row["action"] for row in changes.select("action").distinct().collect()}
    if "put_pipeline" in kinds:
        put_pipelines(store, changes, state)
    created = new_versions(store, changes) if "create_index" in kinds else None
    if "reindex" in kinds:
        copy_documents(store, changes, created, state)
    if kinds & {"create_alias", "update_alias"}:
        publish(store, changes, created, state)
    if "index_document" in kinds:
        write_documents(store, changes)
    if "write_changelog" in kinds:
        store.append_log(log_entries(changes, env))
        with contextlib.suppress(SnapshotConflict):  # another run is at it
            store.compact_log(COMPACT_AFTER)


def put_pipelines(store: Store, changes: DataFrame, state: State) -> None:
    puts = changes.filter(F.col("action") == "put_pipeline").select(F.col("target").alias("name"), "definition")
    store.put_pipelines(puts, state.pipelines_number)


def new_versions(store: Store, changes: DataFrame) -> DataFrame:
    """Rows of the versions to create, each with a folder of this run."""
    wanted = changes.filter(F.col("action") == "create_index").select(F.col("target").alias("version_name"), "definition")
    store.check_new(wanted)
    broken = wanted.filter((F.trim("definition") != "") & ~valid_object("definition")).first()
    if broken is not None:
        raise MigrationError(f"definition of {broken['version_name']} is not a JSON object")
    run = uuid.uuid4().hex
    return wanted.withColumn("layout", layout_of(F.col("definition"))).withColumn(
        "folder", F.concat_ws(".", "version_name", F.lit(run))
    )


def copy_documents(store: Store, changes: DataFrame, created: DataFrame, state: State) -> None:
    """Copy every source alias into its new version, one job per layout and transform."""
    copies = changes.filter(F.col("action") == "reindex").select(
        F.col("source").alias("alias"), F.col("target").alias("version_name"), "max_docs",
        F.coalesce("pipeline", F.lit("")).alias("pipeline"),
    ).join(created, "version_name")
    check_sources(state, copies)
    groups = copies.groupBy("layout", "pipeline").agg(F.min("definition").alias("definition")).collect()
    for group in groups:
        mine = copies.filter(
            (F.col("layout") == group["layout"]) & (F.col("pipeline") == group["pipeline"])
        ).select("alias", "folder", "max_docs")
        copy_group(store, mine, group["definition"], stored_steps(store, group["pipeline"]), state)


def check_sources(state: State, copies: DataFrame) -> None:
    """Every alias to copy from has members, and every member is a known version: else a copy would be empty."""
    members = copies.select("alias").distinct().join(state.membership, "alias", "left")
    members = members.join(state.versions.select("version_name", F.lit(True).alias("known")), "version_name", "left")
    lost = members.filter(F.col("known").isNull()).orderBy("alias", "version_name").first()
    if lost is not None and lost["version_name"] is None:
        raise MigrationError(f"no such alias {lost['alias']!r} to copy from")
    if lost is not None:
        raise MigrationError(f"alias {lost['alias']!r} has a member {lost['version_name']!r} that isn't stored")


def stored_steps(store: Store, pipeline: str) -> list[Step]:
    if not pipeline:
        return []
    row = store.pipelines().filter(F.col("name") == pipeline).first()
    if row is None:
        raise MigrationError(f"no such pipeline {pipeline!r}")
    return parse_steps(row["definition"])


def copy_group(store: Store, copies: DataFrame, definition: str, steps: list[Step], state: State) -> Row:
    """Copies ``(alias, folder, max_docs)`` into versions of one layout; returns their report.

    The documents are read and transformed once: what the report says is counted while they
    are written.
    """
    members = durable(
        copies.join(state.membership, "alias").select(F.col("version_name").alias("source"), "folder", "max_docs")
    )
    sources = state.versions.join(
        members.select(F.col("source").alias("version_name")).distinct(), "version_name", "left_semi"
    )
    read = store.documents(sources).withColumnRenamed("version_name", "source").drop("_seq_no")
    rows = lookup(read, members.select("source", "folder"), ["source"], "_id", how="inner")
    several = not members.groupBy("folder").count().filter("count > 1").isEmpty()
    if several:
        rows = newest_per_id(rows, "source", also=["folder"])
    rows = rows.drop("source")
    limits = members.select("folder", "max_docs").distinct()
    if not limits.filter(F.col("max_docs") != UNLIMITED).isEmpty():
        rows = cap_by_key(rows, limits, "folder", "max_docs")
    if several:
        # The documents have been shuffled by id, so every task has some of every folder: give each folder tasks by its size.
        rows = rows.hint("rebalance", "folder")
    seen = Observation()
    copied = copy_rows(rows, declared_schema(definition), steps, carry=("folder", "_id"), rest=True)
    store.write_folders(copied.observe(seen, *report_columns()), definition)
    report = report_of(Row(**seen.get))
    verify_copy(store, report, limits, layout_id(definition))
    return report


def verify_copy(store: Store, report: Row, copies: DataFrame, layout: str) -> None:
    """Every document read must be stored, and none rejected. Stored ones are counted from the files' footers."""
    failed = report["first_failure"]
    if failed is not None:
        raise MigrationError(f"{failed['id']}: [{failed['cause_type']}] {failed['cause_reason']}")
    stored = store.counts(layout, copies).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    if stored != report["total"]:
        raise MigrationError(f"{report['total']} documents read, {stored} stored")


def publish(store: Store, changes: DataFrame, created: DataFrame | None, state: State) -> None:
    """Register the new versions and change all aliases in one write, on the state of the plan."""
    adds = changes.filter(F.col("action").isin("create_alias", "update_alias")).select(
        F.col("source").alias("alias"), F.col("target").alias("version_name")
    )
    known = state.versions.select("version_name")
    if created is not None:
        known = known.unionByName(created.select("version_name"))
    unknown = adds.join(known, "version_name", "left_anti").first()
    if unknown is not None:
        raise MigrationError(f"no such version {unknown['version_name']!r}")
    store.publish(created, removals(changes, state.membership), adds, state.catalog_number)


def write_documents(store: Store, changes: DataFrame) -> None:
    """Upsert documents through their aliases: of each version touched, the buckets that are.

    Names of versions and their rows in the catalog stay; see ``put_documents``.
    """
    writes = document_writes(changes)
    state = store.state()
    touched = state.membership.join(writes.select("alias").distinct(), "alias", "left_semi")
    targets = durable(touched.join(state.versions, "version_name"))
    several = targets.groupBy("alias").count().filter("count > 1").first()
    if several is not None:
        raise MigrationError(f"alias {several['alias']!r} has more than one version to write to")
    missing = writes.join(targets.select("alias"), "alias", "left_anti").first()
    if missing is not None:
        raise MigrationError(f"no such alias {missing['alias']!r}")
    for group in targets.groupBy("layout").agg(F.min("definition").alias("definition")).collect():
        schema = declared_schema(group["definition"])
        mine = targets.filter(F.col("layout") == group["layout"])
        # Two aliases may share a version; the version is written once.
        versions = mine.dropDuplicates(["version_name"]).drop("alias")
        updates = durable(
            parse_documents(
                lookup(writes, mine.select("alias", "version_name"), ["alias"], "_id", how="inner"),
                schema, carry=("version_name", "_id"),
            )
        )
        bad = updates.filter(F.col("_failure").isNotNull()).first()
        if bad is not None:
            raise MigrationError(f"couldn't index document {bad['_id']}: {bad['_failure']['cause_reason']}")
        grow(store, versions)
        put_documents(store, versions, updates.drop("_failure"))
