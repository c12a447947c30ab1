"""Writes of documents into stored versions: only the buckets that they touch are read and rewritten.

A write reads the touched buckets, makes their next state, stores it in a new folder and
points the buckets to it. If another writer has moved one of them meanwhile, the documents
of that bucket, and no others, are judged and written again on what it left. So of two
conditional writes of one document one wins, and writers of different buckets both do.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableset.operators.latest import first_by
from tableset.operators.lookup import get_by_ids
from tableset.operators.spread import by_keys, lookup
from tableset.operators.upsert import judge_updates, with_ids
from tableset.schemas import PART, declared_schema
from tableset.session import durable
from tableset.sources import store as stores
from tableset.sources.store import SnapshotConflict, Store, bucket_of, column_or_null

#: Rounds in which documents are written again because their bucket was moved.
ROUNDS = 20
KEYS = ["version_name", "_id"]


def put_documents(store: Store, versions: DataFrame, documents: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """Insert or replace documents by id in stored ``versions`` (of one layout); returns them as written.

    ``documents`` has ``version_name``, ``_id`` and columns; declared ones that it lacks become
    NULL. A blank id gets a generated one, fixed before it is used. Of several documents of one
    id the last by ``order`` counts; without ``order`` they must be unique. ``_seq_no`` of a
    new document is 0, of a replaced one a step more.
    """
    documents = with_ids(documents)
    if order:
        documents = first_by(documents, KEYS, [c.desc() for c in order])
    documents = durable(documents)
    _write(store, versions, documents, conditional=False)
    return documents


def put_if(store: Store, versions: DataFrame, updates: DataFrame) -> DataFrame:
    """Conditional writes into stored ``versions`` (of one layout); returns the updates that conflict.

    ``updates`` has ``version_name``, ``_id``, ``expected_seq``, ``entry_seq`` and columns. The rules
    are those of ``judge_updates``, against the state that the write replaces.
    """
    return _write(store, versions, durable(updates), conditional=True)


def get_documents(store: Store, versions: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each requested ``version_name`` and ``_id``, ``_present`` false when there is no such document.

    Only the buckets that can hold the ids are read.
    """
    definition = _definition(versions)
    schema = declared_schema(definition)
    wanted = durable(ids.select(*KEYS).distinct())
    touched = _touched(_placed(wanted, at := durable(store.pointers(versions))), at)
    rows = store.bucket_rows(stores.layout_id(definition), schema, touched).drop("_bucket").withColumn("_key", F.struct(*KEYS))
    return get_by_ids(wanted.select(F.struct(*KEYS).alias("_key")), rows.drop(*KEYS), id_col="_key").select("_key.*", "*").drop("_key")


def grow(store: Store, versions: DataFrame) -> None:
    """Give versions of one bucket and very many documents more buckets, by one rewrite of each.

    Their documents are counted from the footers of the files.
    """
    at = durable(store.pointers(versions).filter("buckets = 1"))
    for row in at.groupBy("layout").agg(F.min("definition").alias("definition")).collect():
        mine = at.filter(F.col("layout") == row["layout"])
        counted = mine.join(store.counts(row["layout"], mine).filter("outcome = 'created'"), "folder").filter(F.col("rows") > stores.BUCKET_ROWS)
        wanted = F.least(F.ceil(F.col("rows") / stores.BUCKET_ROWS), F.lit(stores.MAX_BUCKETS)).cast("int")
        large = durable(counted.withColumn("wanted", wanted).drop("rows", "outcome"))
        if large.isEmpty():
            continue
        run = uuid.uuid4().hex
        rows = store.bucket_rows(row["layout"], declared_schema(row["definition"]), large.drop("wanted")).drop("_bucket")
        rows = lookup(rows, large.select("version_name", F.col("wanted").alias("_wanted")), ["version_name"], "_id", how="inner")
        rows = rows.withColumns({"_bucket": bucket_of(F.col("_wanted")), "folder": F.concat_ws(".", "version_name", F.lit(run))})
        store.write_folders(rows.hint("rebalance", "folder", "_bucket"), row["definition"])
        moves = large.select(F.col("root").alias("base"), F.lit(-1).alias("bucket"), F.concat_ws(".", "version_name", F.lit(run)).alias("folder"), F.col("wanted").alias("buckets"))
        # A version that someone has written to meanwhile stays as it is until its next write.
        store.commit_parts(large.drop("wanted"), moves)


def _definition(versions: DataFrame) -> str:
    row = versions.agg(F.count_distinct("layout").alias("layouts"), F.min("definition").alias("definition")).first()
    if row["layouts"] != 1:
        raise ValueError(f"versions of one layout are wanted, got {row['layouts']}")
    return row["definition"]


def _placed(documents: DataFrame, at: DataFrame) -> DataFrame:
    """Documents with their ``_bucket``; a document of an unknown version is an error."""
    found = lookup(documents, at.select("version_name", F.col("buckets").alias("_buckets")).distinct(), ["version_name"], "_id")
    unknown = F.raise_error(F.concat(F.lit("no such version "), F.coalesce("version_name", F.lit("")))).cast("int")
    return found.withColumn("_bucket", F.when(F.col("_buckets").isNull(), unknown).otherwise(bucket_of(F.col("_buckets")))).drop("_buckets")


def _touched(placed: DataFrame, at: DataFrame) -> DataFrame:
    return durable(at.join(placed.select("version_name", F.col("_bucket").alias("bucket")).distinct(), ["version_name", "bucket"]))


def _write(store: Store, versions: DataFrame, todo: DataFrame, conditional: bool) -> DataFrame:
    """Writes ``todo``; returns the conflicts, without rows unless ``conditional``."""
    definition = _definition(versions)
    layout, schema = stores.layout_id(definition), declared_schema(definition)
    conflicts = todo.limit(0)
    for _ in range(ROUNDS):
        at = durable(store.pointers(versions))
        placed = durable(_placed(todo, at))
        if conditional:
            stored = store.bucket_rows(layout, schema, _touched(placed, at)).select(*KEYS, "_seq_no")
            judged = durable(_judged(stored, placed))
            accepted = judged.filter("accepted").withColumn("_seq_no", F.coalesce(F.col("expected_seq"), F.lit(-1)) + 1)
        else:
            judged = accepted = placed
        touched = _touched(accepted, at)
        lost = touched.limit(0)
        if not touched.isEmpty():
            base = store.bucket_rows(layout, schema, touched)
            if not conditional:
                old = by_keys(base, accepted.select(*KEYS), KEYS, "left_semi").select(*KEYS, F.col("_seq_no").alias("_old_seq"))
                accepted = durable(accepted.drop("_seq_no").join(old, KEYS, "left").withColumn("_seq_no", F.coalesce(F.col("_old_seq") + 1, F.lit(0))))
            # The few new documents are dealt to their buckets; those that stay are written where they are read.
            kept = by_keys(base, accepted.select(*KEYS), KEYS, "left_anti")
            fresh = accepted.select("version_name", "_bucket", "_id", F.col("_seq_no").cast("long").alias("_seq_no"), *[column_or_null(f, accepted.schema) for f in schema.fields],
                                    (F.col("_rest") if "_rest" in accepted.columns else F.lit(None).cast("string")).alias("_rest")).hint("rebalance", "_bucket")
            run = uuid.uuid4().hex
            folder = F.concat_ws(".", "version_name", F.lit(run))
            store.write_folders(kept.unionByName(fresh).withColumn("folder", folder), definition)
            rows = touched.select("base", "bucket", folder.alias("folder"), F.lit(None).cast("int").alias("buckets")).select(*PART.names)
            lost = store.commit_parts(touched, rows)
        moved = lost.select("version_name", F.col("bucket").alias("_bucket"))
        again = None if lost.isEmpty() else by_keys(judged, moved, ["version_name", "_bucket"], "left_semi")
        if conditional:
            settled = judged.filter("NOT accepted")
            if again is not None:
                settled = by_keys(settled, moved, ["version_name", "_bucket"], "left_anti")
            conflicts = durable(conflicts.unionByName(settled.select(*todo.columns)))
        if again is None:
            return conflicts
        todo = durable(again.select(*todo.columns))
    raise SnapshotConflict("documents were overtaken by other writers too often")


def _judged(stored: DataFrame, placed: DataFrame) -> DataFrame:
    """``judge_updates`` for the documents of several versions."""
    key = F.struct(*KEYS)
    judged = judge_updates(stored.select(key.alias("_id"), "_seq_no"), placed.withColumns({"_key": F.col("_id"), "_id": key}))
    return judged.withColumn("_id", F.col("_key")).drop("_key")
