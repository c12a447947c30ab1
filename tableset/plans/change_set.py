"""The change set: what has to be done to bring the stored tables to the desired state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableset.functions.meta import document_meta_json, index_set_meta_json
from tableset.functions.names import alias_name, document_identifier, pipeline_id, version_name
from tableset.operators.aliases import alias_bounds
from tableset.operators.cap import ROW_BITS
from tableset.operators.changes import change_status, changed_only, definition_status, needs_action, using_changed
from tableset.operators.latest import entries_of, latest_entries
from tableset.operators.spread import lookup
from tableset.plans.desired import Desired
from tableset.plans.reindex import seed_source
from tableset.schemas import CHANGE_SET
from tableset.session import durable

# The order of the stages.
PIPELINE_STAGE, INDEX_SET_STAGE, DOCUMENT_STAGE = 1, 2, 3
STAGES = {"pipeline": PIPELINE_STAGE, "index_set": INDEX_SET_STAGE, "document": DOCUMENT_STAGE}

ERROR, NOT_COMPARABLE = "error", "definition is not a JSON object"

_ACTION_FIELDS = [f.name for f in CHANGE_SET.fields if f.name not in ("stage", "key", "step")]


def _action(name: str, applies: str = "TRUE", **values: str) -> str:
    """SQL of one action with all fields of the change set, or of NULL where it does not apply.

    ``values`` are SQL expressions; fields not given are NULL.
    """
    values["action"] = f"'{name}'"
    fields = ", ".join(
        f"'{f}', CAST({values.get(f, 'NULL')} AS {CHANGE_SET[f].dataType.simpleString()})" for f in _ACTION_FIELDS
    )
    return f"IF({applies}, named_struct({fields}), NULL)"


def _as_rows(statuses: DataFrame, stage: int, *actions: str) -> DataFrame:
    """Actions of every row with work to do, in order, and one error row where nothing could be compared."""
    error = _action(ERROR, definition=f"'{NOT_COMPARABLE}'")
    listed = f"IF(status = 'error', array({error}), array_compact(array({', '.join(actions)})))"
    exploded = needs_action(statuses).select("key", F.posexplode(F.expr(listed)).alias("step", "_a"))
    return exploded.select(F.lit(stage).alias("stage"), "key", "step", "_a.*")


def pipeline_changes(desired: DataFrame, live: DataFrame, env: str) -> DataFrame:
    """Desired pipelines with stored id and ``status``; there is no log for pipelines."""
    named = desired.withColumn("key", F.col("name")).withColumn("name", pipeline_id(F.col("key"), F.lit(env)))
    return definition_status(named, live)


def pipeline_actions(statuses: DataFrame) -> DataFrame:
    return _as_rows(statuses, PIPELINE_STAGE, _action("put_pipeline", target="name", definition="definition"))


def members_by_set(membership: DataFrame, env: str) -> DataFrame:
    """Least and greatest member per index set of an environment.

    The alias prefix is stripped, so this has the key of the desired state and of the log;
    the prefix test reaches the scan.
    """
    prefix = f"{env}-"
    mine = membership.filter(F.col("alias").startswith(prefix))
    return alias_bounds(mine).withColumn("key", F.substring("alias", len(prefix) + 1, 1 << 30)).drop("alias")


def index_set_changes(
    desired: DataFrame,
    log: DataFrame,
    membership: DataFrame,
    changed_pipelines: DataFrame,
    env: str,
    broadcast_pipelines: bool = True,
) -> DataFrame:
    """Desired index sets with ``status``, ``pipeline_changed`` and their alias' members.

    Log, membership and desired state are all keyed by the set name, so each is shuffled
    once and the joins line up.
    """
    sets = desired.select(
        F.col("index_set").alias("key"),
        "content",
        F.col("meta").alias("settings"),
        index_set_meta_json(F.col("meta")).alias("meta"),
    )
    pipeline = pipeline_id(F.col("settings.reindex.pipeline"), F.lit(env))
    flagged = using_changed(sets, changed_pipelines, pipeline, "key", broadcast=broadcast_pipelines)
    logged = entries_of(log, "index_set", env).withColumnRenamed("resource_identifier", "key")
    latest = latest_entries(logged, keys=["key"])
    return change_status(flagged, latest, keys=["key"]).join(members_by_set(membership, env), "key", "left")


def index_set_actions(changes: DataFrame, env: str, version: str, prototype_env: str = "") -> DataFrame:
    """Ordered actions of every index set with work to do."""
    static = F.col("settings.index") != ""
    index = F.when(static, F.col("settings.index")).otherwise(
        version_name(F.col("key"), F.lit(env), F.lit(version))
    )
    named = changes.withColumns(
        {
            "static": static,
            "index": index,
            "alias": alias_name(F.col("key"), F.lit(env)),
            "prototype": alias_name(F.col("key"), F.lit(prototype_env)),
            "pipeline": pipeline_id(F.col("settings.reindex.pipeline"), F.lit(env)),
            "present": F.col("first_member").isNotNull(),
            "seeded": seed_source(
                env, prototype_env, F.col("settings.prototype.disabled"), F.col("settings.index"), F.col("first_member").isNotNull()
            ),
        }
    )
    only_member = "(first_member = index AND last_member = index)"
    return _as_rows(
        named,
        INDEX_SET_STAGE,
        _action("create_index", "NOT static", target="index", definition="content"),
        _action(
            "reindex", "seeded",
            source="prototype", target="index", max_docs="settings.prototype.max_docs", pipeline="pipeline",
        ),
        _action(
            "reindex", "NOT static AND present", source="alias", target="index", max_docs="-1", pipeline="pipeline"
        ),
        _action("create_alias", "NOT present", source="alias", target="index"),
        _action("update_alias", f"present AND NOT (static AND {only_member})", source="alias", target="index"),
        _action("write_changelog", source="'index_set'", target="index", definition="content", meta="meta"),
    )


def document_changes(desired: DataFrame, log: DataFrame, env: str) -> DataFrame:
    """Desired documents with their log key and ``status``."""
    documents = desired.select(
        document_identifier(F.col("index_set"), F.col("name")).alias("key"),
        "index_set",
        "name",
        "content",
        F.col("meta.ignored").alias("ignored"),
        document_meta_json(F.col("meta")).alias("meta"),
    )
    logged = entries_of(log, "document", env).withColumnRenamed("resource_identifier", "key")
    return change_status(documents, latest_entries(logged, keys=["key"]), keys=["key"])


def document_actions(changes: DataFrame, env: str) -> DataFrame:
    """Changed documents: written unless ignored, logged in any case."""
    return _as_rows(
        changes.withColumn("alias", alias_name(F.col("index_set"), F.lit(env))),
        DOCUMENT_STAGE,
        _action("index_document", "NOT ignored", source="name", target="alias", definition="content"),
        _action("write_changelog", source="'document'", target="name", definition="content", meta="meta"),
    )


def planned_actions(
    desired: Desired,
    log: DataFrame,
    membership: DataFrame,
    live_pipelines: DataFrame,
    version: str,
    prototype_env: str = "",
    broadcast_pipelines: bool = True,
) -> DataFrame:
    """Change set and errors as one frame, so that both come from one evaluation.

    An error row has the action ``error`` and its reason as ``definition``.
    """
    env = desired.env
    pipelines = pipeline_changes(desired.pipelines, live_pipelines, env)
    sets = index_set_changes(
        desired.index_sets, log, membership, changed_only(pipelines).select("name"), env, broadcast_pipelines
    )
    documents = document_changes(desired.documents, log, env)
    stage = F.element_at(F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair]), F.col("kind"))
    loading = desired.errors.select(
        stage.alias("stage"), "key", F.lit(-1).alias("step"), F.expr(_action(ERROR, definition="reason")).alias("_a")
    ).select("stage", "key", "step", "_a.*")
    return reduce(
        DataFrame.unionByName,
        [
            loading,
            pipeline_actions(pipelines),
            index_set_actions(sets, env, version, prototype_env),
            document_actions(documents, env),
        ],
    ).select(*CHANGE_SET.names)


def split_errors(planned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(changes, errors)`` of planned actions."""
    kind = F.element_at(F.create_map(*[F.lit(x) for k, v in STAGES.items() for x in (v, k)]), F.col("stage"))
    errors = planned.filter(F.col("action") == ERROR)
    return (
        planned.filter(F.col("action") != ERROR),
        errors.select(kind.alias("kind"), "key", F.col("definition").alias("reason")),
    )


def change_set(
    desired: Desired,
    log: DataFrame,
    membership: DataFrame,
    live_pipelines: DataFrame,
    version: str,
    prototype_env: str = "",
    broadcast_pipelines: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """``(changes, errors)``: one row per action, and every reason not to go on.

    In a ``write_changelog`` row ``source`` is the resource type and ``target`` the final
    name; in an ``index_document`` row they are document id and alias; in alias rows the
    alias and the new member. The members to remove follow from ``removals``.
    """
    return split_errors(
        planned_actions(desired, log, membership, live_pipelines, version, prototype_env, broadcast_pipelines)
    )


def removals(changes: DataFrame, membership: DataFrame) -> DataFrame:
    """``(alias, version_name)`` rows that the update actions take away: all present members."""
    updated = changes.filter(F.col("action") == "update_alias").select(F.col("source").alias("alias"))
    return membership.join(updated, "alias", "left_semi").select("alias", "version_name").distinct()


def in_order(changes: DataFrame) -> DataFrame:
    """Actions in the order of execution."""
    return changes.orderBy("stage", "key", "step")


def numbered(changes: DataFrame) -> DataFrame:
    """Actions with their ``position`` in the order of execution, from 1.

    The sorted actions are kept once; a position is the row number in its task plus the
    number of rows in the tasks before, so no task sees all actions.
    """
    ordered = durable(in_order(changes).withColumn("_place", F.monotonically_increasing_id()))
    task = F.shiftright("_place", ROW_BITS)
    counts = ordered.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    before = F.sum("_rows").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_task", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    placed = lookup(ordered.withColumn("_task", task), starts, ["_task"], "key", how="inner")
    return placed.withColumn("position", F.col("_place") + F.col("_shift")).drop("_place", "_task", "_shift")


# The sentence of every action.
CREATE_INDEX = "create index %s"
WRITE_CHANGELOG = "write %s changelog entry for %s:%s"
REINDEX, VIA, MAX_DOCS = "reindex %s -> %s", " via %s", " (%d max docs)"
CREATE_ALIAS, UPDATE_ALIAS, ALIAS_STRING, REMOVING = "create alias %s", "update alias %s", "%s -> %s", "; removing "
PUT_PIPELINE = "put pipeline %s"
INDEX_DOCUMENT = "index document %s/%s"


def action_text(changes: DataFrame, membership: DataFrame, env: str) -> DataFrame:
    """Add the readable ``text`` of every action.

    The line of an alias update names all members it removes, so for this report (only)
    the members of an alias are gathered into its line.
    """
    pair = F.format_string(ALIAS_STRING, "alias", "version_name")
    removed = (
        membership.filter(F.col("alias").startswith(f"{env}-"))
        .groupBy(F.col("alias").alias("_line"))
        .agg(F.array_join(F.array_sort(F.collect_set(pair)), ", ").alias("_removed"))
    )
    a, via = F.col("action"), F.coalesce("pipeline", F.lit(""))
    alias = F.format_string(ALIAS_STRING, "source", "target")
    text = (
        F.when(a == "create_index", F.format_string(CREATE_INDEX, "target"))
        .when(a == "write_changelog", F.format_string(WRITE_CHANGELOG, "source", F.lit(env), "key"))
        .when(
            a == "reindex",
            F.concat(
                F.format_string(REINDEX, "source", "target"),
                F.when(via != "", F.format_string(VIA, via)).otherwise(""),
                F.when(F.col("max_docs") != -1, F.format_string(MAX_DOCS, "max_docs")).otherwise(""),
            ),
        )
        .when(a == "create_alias", F.format_string(CREATE_ALIAS, alias))
        .when(
            a == "update_alias",
            F.concat(
                F.format_string(UPDATE_ALIAS, alias),
                F.coalesce(F.concat(F.lit(REMOVING), "_removed"), F.lit("")),
            ),
        )
        .when(a == "put_pipeline", F.format_string(PUT_PIPELINE, "target"))
        .when(a == "index_document", F.format_string(INDEX_DOCUMENT, "target", "source"))
    )
    # Only alias updates look something up; every other row has a key of its own, so that
    # the many rows with one and the same source do not meet in one task.
    own = F.concat_ws("/", F.lit(""), "stage", "key", "step")
    lines = changes.withColumn("_line", F.when(a == "update_alias", F.col("source")).otherwise(own))
    return lines.join(removed, "_line", "left").withColumn("text", text).drop("_removed", "_line")
