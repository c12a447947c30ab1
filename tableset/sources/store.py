"""The stored tables: changelog, registries, alias membership and table versions.

Everything is Parquet below one root folder:

``changelog/batch=<n>/``              append-only log rows, by type and environment
``latest/ latest_rows/``              the latest log row of every key, up to some batches
``pipelines/ catalog/ parts/``        small tables, one complete snapshot per change
``data/layout=<id>/folder=<f>/``      documents, split by ``bucket`` and ``outcome``

The catalog holds the versions and the members of aliases, so that both change in one
write. A data folder is written once and never changed; a version names the folder it was
created in. Documents are in buckets by a hash of their id, and a write of documents puts
only the buckets it touches into a new folder, which the table of parts points to. A
version starts with one bucket unless more are asked for.

A snapshot is written next to the former ones and counts from the moment its job is
committed, so readers see the old or the new table and nothing between. A writer claims the
number after the snapshot it has read by creating a file of that name, which only one can;
any other that started from the same snapshot fails. That needs a file system where
creating a file that exists fails, as on HDFS and local disks; not all object stores do
that. Versions with the same declared columns share a layout, so that one job can read or
write many of them.
"""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableset.functions.layout import layout_id
from tableset.operators.aliases import swap, unreferenced
from tableset.operators.changes import with_stored_digests
from tableset.operators.latest import latest_entries
from tableset.operators.spread import lookup
from tableset.operators.upsert import delete_keys, upsert
from tableset.schemas import (
    CATALOG,
    CHANGELOG,
    COVERED,
    FAILURE,
    INT,
    LOGGED,
    LONG,
    MEMBERSHIP,
    PART,
    PIPELINE,
    STRING,
    VERSION,
    declared_schema,
    struct,
)
from tableset.session import durable, setting

LOG_FOLDERS = ("resource_type", "env_name")

# Files a task may have open at once. Up to so many folders per task are written without
# sorting the documents by folder first.
OPEN_WRITERS = 64

# Up to so many folders are named to the reader; of more all folders are listed and the
# right ones found at run time.
NAMED_FOLDERS = 100

# A version of more documents gets buckets of about so many at its next write, at most so many.
BUCKET_ROWS, MAX_BUCKETS = 250_000, 4096

# Commits of parts that another writer came before are tried so often, so many seconds apart.
COMMIT_TRIES, COMMIT_WAIT = 20, 0.25

_SNAPSHOT = re.compile(r"snapshot=(\d+)$")


class SnapshotConflict(Exception):
    """Another writer has changed the table, or is about to, since it was read."""


class Snapshots:
    """A small table kept as complete snapshots."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def _folders(self) -> list[tuple[int, bool]]:
        """Snapshot numbers with whether the write was committed."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            match = _SNAPSHOT.search(status.getPath().getName())
            if match:
                done = fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
                found.append((int(match.group(1)), bool(done)))
        return sorted(found)

    def current(self) -> tuple[int, DataFrame]:
        """Number of the newest committed snapshot (0: none), and its rows."""
        number = max((number for number, committed in self._folders() if committed), default=0)
        if not number:
            return 0, self.spark.createDataFrame([], self.schema)
        return number, self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshot={number}")

    def read(self) -> DataFrame:
        return self.current()[1]

    def write(self, df: DataFrame, base: int) -> None:
        """The snapshot after number ``base``, which ``df`` was made from."""
        number = base + 1
        fs, claim = self._hadoop(f"{self.path}/claims/{number}")
        fs.mkdirs(claim.getParent())
        if not fs.createNewFile(claim):
            raise SnapshotConflict(f"{self.path} has been changed since snapshot {base}; after a broken run call release()")
        df.select(*self.schema.names).write.mode("errorifexists").parquet(f"{self.path}/snapshot={number}")

    def release(self) -> None:
        """Forget the claim, and the parts, of a write that broke off. Only when no writer is at work."""
        number = self.current()[0] + 1
        for path in (f"{self.path}/snapshot={number}", f"{self.path}/claims/{number}"):
            fs, at = self._hadoop(path)
            fs.delete(at, True)

    def _hadoop(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at


@dataclass(frozen=True)
class State:
    """The small tables as one run reads them, with the numbers that its writes start from."""

    catalog_number: int
    versions: DataFrame
    membership: DataFrame
    pipelines_number: int
    pipelines: DataFrame


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._pipelines = Snapshots(spark, f"{self.root}/pipelines", PIPELINE)
        self._catalog = Snapshots(spark, f"{self.root}/catalog", CATALOG)
        self._parts = Snapshots(spark, f"{self.root}/parts", PART)
        self._latest = Snapshots(spark, f"{self.root}/latest", COVERED)

    def state(self) -> State:
        """Versions, members and pipelines of this moment."""
        number, catalog = self._catalog.current()
        pipelines_number, pipelines = self._pipelines.current()
        return State(number, versions_of(catalog), members_of(catalog), pipelines_number, pipelines)

    # changelog

    def changelog(self) -> DataFrame:
        """All log rows; an absent log is empty, with the fixed schema."""
        if not self._exists(f"{self.root}/changelog"):
            return self.spark.createDataFrame([], CHANGELOG)
        return self.spark.read.schema(CHANGELOG).parquet(f"{self.root}/changelog").select(*CHANGELOG.names)

    def append_log(self, rows: DataFrame) -> None:
        """Append log rows (one batch for all of them), stamped with the present time.

        Type and environment are folders, so that a run reads the log of its own
        environment only, however long the log of the others is. The digests of the texts are
        stored with them, so no later run parses them.
        """
        number = max([0, *self._numbers("changelog", "batch="), *self._numbers("batches", "")]) + 1
        while not self._claim(f"{self.root}/batches/{number}"):
            number += 1
        with_stored_digests(log_rows(rows)).write.partitionBy(*LOG_FOLDERS).parquet(f"{self.root}/changelog/batch={number}")

    def recent_log(self) -> DataFrame:
        """Log rows that hold the latest entry of every key: the compacted ones and the batches since.

        Whoever looks for latest entries finds the same here as in the whole log. The digests
        of the texts stand beside them (``with_stored_digests``).
        """
        _, folder, _, tail = self._covered()
        return self._log_rows(folder, tail)

    def compact_log(self, after: int = 1) -> bool:
        """Keep the latest entry of every key apart, if ``after`` batches or more came since that was done last.

        Batches stay in the log. Those not committed yet are left for the next time, whatever their number.
        """
        base, folder, covered, tail = self._covered()
        if len(tail) < max(after, 1):
            return False
        fresh = uuid.uuid4().hex
        rows = latest_entries(self._log_rows(folder, tail))
        rows.write.partitionBy(*LOG_FOLDERS).parquet(f"{self.root}/latest_rows/folder={fresh}")
        whole = [(fresh, first, last) for first, last in ranges({*covered, *tail})]
        # A row per run of batches: one file keeps them in order, several are listed in any.
        self._latest.write(self.spark.createDataFrame(whole, COVERED).coalesce(1), base)
        return True

    def _covered(self) -> tuple[int, str | None, set[int], list[int]]:
        """Number of the snapshot, folder of the compacted rows, batches they cover, committed batches beyond."""
        base, rows = self._latest.current()
        rows = rows.collect()
        covered = {n for r in rows for n in range(r["first"], r["last"] + 1)}
        tail = [n for n in self._numbers("changelog", "batch=") if n not in covered and self._exists(f"{self.root}/changelog/batch={n}/_SUCCESS")]
        return base, rows[0]["folder"] if rows else None, covered, tail

    def _log_rows(self, folder: str | None, tail: list[int]) -> DataFrame:
        log, parts = f"{self.root}/changelog", []
        read = self.spark.read.schema(LOGGED)
        # The compacted folder has no files if no batch had a row.
        if folder is not None:
            parts.append(read.parquet(f"{self.root}/latest_rows/folder={folder}"))
        if len(tail) > NAMED_FOLDERS:
            parts.append(read.parquet(log).filter(F.col("batch").isin(tail)))
        elif tail:
            parts.append(read.option("basePath", log).parquet(*(f"{log}/batch={n}" for n in tail)))
        # Compacted rows all have digests; batches that were written without get them here, until they are compacted.
        whole = folder is not None
        parts = [p.select(*LOGGED.names) if whole and i == 0 else with_stored_digests(p.select(*LOGGED.names)) for i, p in enumerate(parts)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], LOGGED)

    # registry of pipelines

    def pipelines(self) -> DataFrame:
        return self._pipelines.read()

    def put_pipelines(self, definitions: DataFrame, base: int | None = None) -> None:
        """Add or replace pipelines; with ``base`` only if the registry is still that snapshot."""
        number, rows = self._pipelines.current()
        self._pipelines.write(upsert(rows, definitions, keys=("name",)), number if base is None else base)

    def delete_pipelines(self, names: DataFrame) -> None:
        base, rows = self._pipelines.current()
        self._pipelines.write(delete_keys(rows, names, on=("name",)), base)

    # alias membership

    def membership(self) -> DataFrame:
        return members_of(self._catalog.read())

    def swap(self, removes: DataFrame, adds: DataFrame) -> None:
        """Remove and add members of any number of aliases in one write."""
        self.publish(None, removes, adds)

    def publish(self, created: DataFrame | None, removes: DataFrame, adds: DataFrame, base: int | None = None) -> None:
        """Add versions, or point known ones at other folders, and change members of aliases, in one write.

        With ``base`` only if the catalog is still that snapshot: a plan made from an older one fails.
        """
        number, catalog = self._catalog.current()
        versions, members = versions_of(catalog), swap(members_of(catalog), removes, adds)
        if created is not None:
            versions = upsert(versions, created, keys=("version_name",))
        rows = versions.unionByName(members, allowMissingColumns=True)
        self._catalog.write(rows, number if base is None else base)

    def publish_view(self, alias: str, schema: T.StructType) -> None:
        """Point the reader view of an alias at its present members.

        The view keeps them: call again after a swap. No migration calls it.
        """
        self.scan(alias, schema).createOrReplaceTempView(f"`{alias}`")

    # table versions

    def versions(self) -> DataFrame:
        return versions_of(self._catalog.read())

    def check_new(self, names: DataFrame) -> None:
        """Creating a version under an existing name is an error."""
        taken = self.versions().join(names.select("version_name"), "version_name", "left_semi").first()
        if taken is not None:
            raise ValueError(f"version {taken['version_name']!r} exists already")

    def register(self, rows: DataFrame) -> None:
        """Add versions, or point known ones at other folders, in one write."""
        none = self.spark.createDataFrame([], MEMBERSHIP)
        self.publish(rows, none, none)

    def create_version(self, name: str, definition: str, documents: DataFrame | None = None, buckets: int = 1) -> None:
        """A new version with the declared columns, from good ``documents`` or empty, in ``buckets`` by a hash of the id."""
        row = self.spark.createDataFrame([(name, definition, layout_id(definition), new_folder(name))], VERSION)
        self.check_new(row)
        folder = row.first()["folder"]
        if documents is not None:
            placed = documents.withColumn("folder", F.lit(folder)).withColumn("_bucket", bucket_of(F.lit(buckets)))
            self.write_folders(placed if buckets == 1 else placed.hint("rebalance", "_bucket"), definition)
        if buckets > 1:
            self.commit_parts(self.pointers(row), [(folder, -1, folder, buckets)])
        self.register(row)

    def data_path(self, layout: str) -> str:
        return f"{self.root}/data/layout={layout}"

    def write_folders(self, df: DataFrame, definition: str) -> None:
        """Write documents of one layout; ``folder``, ``_bucket`` (0 unless given) and ``outcome`` become folders.

        Folders are new for every run, so the leftovers of a broken run are never read.
        """
        schema = stored_schema(declared_schema(definition))
        for field in schema.fields:
            if field.name not in df.columns:
                default = {"_seq_no": F.lit(0), "_bucket": F.lit(0), "outcome": F.lit("created")}.get(field.name, F.lit(None))
                df = df.withColumn(field.name, default)
        columns = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields]
        with setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_WRITERS)):
            df.select(*columns).write.mode("append").partitionBy("folder", "_bucket", "outcome").parquet(
                self.data_path(layout_id(definition))
            )

    def read_layout(self, layout: str, schema: T.StructType, folders: list[str] | None = None) -> DataFrame:
        """Stored rows of a layout, in the given columns, with ``folder``, ``_bucket`` and ``outcome``.

        With ``folders`` only these are listed, whatever else was ever written in the layout.
        """
        stored, path = stored_schema(schema), self.data_path(layout)
        paths = [path] if folders is None else [f"{path}/folder={f}" for f in folders]
        there = [p for p in paths if self._exists(p)]
        if not there:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).option("basePath", path).parquet(*there)

    def counts(self, layout: str, folders: DataFrame) -> DataFrame:
        """Stored rows of each ``folder`` and ``outcome``, from the footers of its files."""
        rows = self._rows_in(layout, struct(), folders.select("folder").distinct())
        return rows.groupBy("folder", "outcome").agg(F.count(F.lit(1)).alias("rows"))

    def _rows_in(self, layout: str, schema: T.StructType, at: DataFrame) -> DataFrame:
        """Stored rows of the folders, or folders and buckets, of ``at``, with its further columns.

        Of few folders the names, and the buckets of each, are constants of the scan.
        """
        on = [c for c in ("folder", "_bucket") if c in at.columns]
        few = at.groupBy("folder").agg(F.collect_set("_bucket" if "_bucket" in on else F.lit(0)).alias("buckets")).limit(NAMED_FOLDERS + 1).collect()
        if len(few) > NAMED_FOLDERS:
            return lookup(self.read_layout(layout, schema), at, on, "_id", how="inner")
        rows = self.read_layout(layout, schema, [r["folder"] for r in few])
        if "_bucket" in on and few:
            rows = rows.filter(reduce(Column.__or__, ((F.col("folder") == r["folder"]) & F.col("_bucket").isin(*r["buckets"]) for r in few)))
        return rows if len(on) == len(at.columns) else lookup(rows, at, on, "_id", how="inner")

    def documents(self, versions: DataFrame, schema: T.StructType | None = None) -> DataFrame:
        """Accepted documents of the given versions, with ``version_name``.

        One scan per layout, pruned to the folders of the versions at run time. Without a
        schema the columns of all layouts are united by name; a column with several types
        becomes text. A column that a version does not have is NULL. ``_rest`` is the JSON
        text of the fields that a document's definition does not declare, NULL without any.
        """
        layouts = versions.groupBy("layout").agg(F.min("definition").alias("definition")).orderBy("layout")
        # One row per distinct set of declared columns.
        declared = {row["layout"]: declared_schema(row["definition"]) for row in layouts.collect()}
        wanted = schema if schema is not None else united(list(declared.values()))
        result = None
        at = self.pointers(versions)
        for layout, columns in declared.items():
            folders = at.filter(F.col("layout") == layout).select("folder", F.col("bucket").alias("_bucket"), "version_name")
            rows = self.read_layout(layout, columns).filter(F.col("outcome") == "created")
            part = lookup(rows, folders, ["folder", "_bucket"], "_id", how="inner").select(
                "_id", "_seq_no", *[column_or_null(f, columns) for f in wanted.fields], "_rest", "version_name"
            )
            result = part if result is None else result.unionByName(part)
        if result is None:
            shape = T.StructType([*struct(_id=STRING, _seq_no=LONG).fields, *wanted.fields, *struct(_rest=STRING, version_name=STRING).fields])
            return self.spark.createDataFrame([], shape)
        return result

    def members(self, alias: str) -> DataFrame:
        """Version rows an alias points at; none for an unknown alias."""
        mine = self.membership().filter(F.col("alias") == alias)
        return self.versions().join(mine.select("version_name"), "version_name", "left_semi")

    def scan(self, alias: str, schema: T.StructType | None = None) -> DataFrame:
        """Documents of all versions an alias points at. An unknown alias gives no rows."""
        return self.documents(self.members(alias), schema)

    def unreferenced(self) -> DataFrame:
        return unreferenced(self.versions(), self.membership())

    def drop_version(self, name: str) -> None:
        """Delete a version that no alias points at. The only call that deletes data."""
        base, catalog = self._catalog.current()
        known = versions_of(catalog)
        mine = unreferenced(known, members_of(catalog)).filter(F.col("version_name") == name)
        row = mine.first()
        if row is None:
            raise ValueError(f"version {name!r} is unknown or in use")
        folders = {row["folder"], *(r["folder"] for r in self.pointers(mine).select("folder").distinct().collect())}
        self._catalog.write(catalog.filter(F.col("alias").isNotNull() | (F.col("version_name") != name)), base)
        for folder in sorted(folders):
            self._delete(f"{self.data_path(row['layout'])}/folder={folder}")

    def sweep(self, older_than: float = 7 * 24 * 3600) -> list[str]:
        """Delete what no committed table names any more; returns the paths.

        Data folders that no version and no part points to, compacted log rows that were replaced,
        and former snapshots with their claims; only what has been there for ``older_than`` seconds,
        so that runs at work and readers of an older state keep theirs. An interrupted write's claim
        is not touched: see ``release``.
        """
        latest, rows = self._latest.current()
        live = self.pointers(self.versions()).select("folder").distinct()
        found = [(path, name) for layout in self._children(f"{self.root}/data") for path, name in self._old(layout, "folder=", older_than)]
        known = self.spark.createDataFrame(found, "path STRING, folder STRING")
        dead = [r["path"] for r in known.join(live, "folder", "left_anti").collect()]
        kept = {r["folder"] for r in rows.collect()}
        dead += [path for path, name in self._old(f"{self.root}/latest_rows", "folder=", older_than) if name not in kept]
        for table in (self._pipelines, self._catalog, self._parts, self._latest):
            number = table.current()[0]
            dead += [path for path, n in self._old(table.path, "snapshot=", older_than) if int(n) < number]
            dead += [path for path, n in self._old(f"{table.path}/claims", "", older_than) if n.isdigit() and int(n) < number]
        for path in dead:
            self._delete(path)
        return dead

    # buckets

    def pointers(self, versions: DataFrame, parts: DataFrame | None = None) -> DataFrame:
        """Where the documents of versions are: a row for each bucket.

        ``version_name``, ``definition``, ``layout``, ``root`` (the version's folder), ``base`` (the folder
        that all its buckets were written to last), ``buckets`` (their number), ``bucket`` and ``folder``.
        """
        if parts is None:
            parts = self._parts.read()
        moved = parts.filter("bucket = -1").select(F.col("base").alias("root"), F.col("folder").alias("_moved"), "buckets")
        own = parts.filter("bucket >= 0").select("base", "bucket", F.col("folder").alias("_own"))
        at = versions.withColumnRenamed("folder", "root").join(moved, "root", "left")
        at = at.withColumns({"base": F.coalesce("_moved", "root"), "buckets": F.coalesce("buckets", F.lit(1))})
        at = at.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).join(own, ["base", "bucket"], "left")
        return at.select("version_name", "definition", "layout", "root", "base", "buckets", "bucket", F.coalesce("_own", "base").alias("folder"))

    def parts(self) -> DataFrame:
        return self._parts.read()

    def bucket_rows(self, layout: str, schema: T.StructType, touched: DataFrame) -> DataFrame:
        """Accepted documents of some buckets (rows of ``pointers``), with ``version_name`` and ``_bucket``."""
        rows = self._rows_in(layout, schema, touched.select("folder", F.col("bucket").alias("_bucket"), "version_name")).filter(F.col("outcome") == "created")
        return rows.select("version_name", "_bucket", "_id", "_seq_no", *[F.col(f"`{f.name}`") for f in schema.fields], "_rest")

    def commit_parts(self, planned: DataFrame, rows: list[tuple] | DataFrame, whole: bool = False) -> DataFrame:
        """Point buckets at the folders of ``rows`` (PART), compared with the state they were written from.

        ``planned`` holds the ``pointers`` of these buckets when they were read. Returns those that
        another writer has moved since; their rows don't count, all others do, in one write. With
        ``whole`` none counts then. Writers of other buckets don't disturb: the write is
        tried again on what they left.
        """
        rows = self.spark.createDataFrame(rows, PART) if isinstance(rows, list) else rows
        for _ in range(COMMIT_TRIES):
            number, parts = self._parts.current()
            versions = planned.select("version_name", "definition", "layout", F.col("root").alias("folder")).distinct()
            now = self.pointers(versions, parts).select("version_name", "bucket", F.col("base").alias("_base"), F.col("folder").alias("_folder"))
            lost = planned.join(now, ["version_name", "bucket"], "left")
            lost = durable(lost.filter(~(F.col("base").eqNullSafe(F.col("_base")) & F.col("folder").eqNullSafe(F.col("_folder")))).drop("_base", "_folder"))
            if not lost.isEmpty():
                if whole:
                    return lost
                rows = rows.join(lost.select("base", "bucket"), ["base", "bucket"], "left_anti")
                if rows.isEmpty():
                    return lost
            # A version whose buckets are all written anew has a new base, so its former parts are of no use.
            dead = rows.filter("bucket = -1").join(planned.select("root", F.col("base").alias("_old")).distinct(), F.col("base") == F.col("root")).select(F.col("_old").alias("base"))
            kept = parts.join(dead.withColumn("_dead", F.lit(True)), "base", "left").filter(F.col("_dead").isNull() | (F.col("bucket") == -1)).drop("_dead")
            try:
                self._parts.write(upsert(kept, rows, keys=("base", "bucket")), number)
                return lost
            except SnapshotConflict:
                time.sleep(COMMIT_WAIT)
        raise SnapshotConflict(f"{self._parts.path} is claimed by another writer; after a broken run call release()")

    def _fs(self, path: str):
        hadoop_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path

    def _claim(self, path: str) -> bool:
        """Create an empty file, unless it is there."""
        fs, hadoop_path = self._fs(path)
        fs.mkdirs(hadoop_path.getParent())
        return bool(fs.createNewFile(hadoop_path))

    def _listed(self, path: str):
        fs, hadoop_path = self._fs(path)
        return fs.listStatus(hadoop_path) if fs.exists(hadoop_path) else []

    def _children(self, path: str) -> list[str]:
        return sorted(s.getPath().toString() for s in self._listed(path))

    def _old(self, path: str, prefix: str, age: float) -> list[tuple[str, str]]:
        """Path, and name behind ``prefix``, of what was last changed ``age`` seconds ago or more."""
        limit = (time.time() - age) * 1000
        found = [(s.getPath().toString(), s.getPath().getName()) for s in self._listed(path) if s.getModificationTime() <= limit]
        return sorted((p, name.removeprefix(prefix)) for p, name in found if name.startswith(prefix))

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        names = [s.getPath().getName() for s in self._listed(f"{self.root}/{folder}")]
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit())

    def _exists(self, path: str) -> bool:
        fs, hadoop_path = self._fs(path)
        return bool(fs.exists(hadoop_path))

    def _delete(self, path: str) -> None:
        fs, hadoop_path = self._fs(path)
        fs.delete(hadoop_path, True)


def log_rows(rows: DataFrame) -> DataFrame:
    """Complete log rows: stamped now, and numbered unless they are; numbers of one write differ, in no order of keys."""
    if "entry_seq" not in rows.columns:
        rows = rows.withColumn("entry_seq", F.monotonically_increasing_id())
    return rows.withColumn("timestamp", F.current_timestamp()).select(*CHANGELOG.names)


def stored_schema(schema: T.StructType) -> T.StructType:
    """Columns of a stored version: id, sequence number, declared columns, undeclared fields, failure, folders."""
    head = struct(_id=STRING, _seq_no=LONG)
    tail = struct(_rest=STRING, _failure=FAILURE, folder=STRING, _bucket=INT, outcome=STRING)
    return T.StructType([*head.fields, *schema.fields, *tail.fields])


def ranges(numbers: set[int]) -> list[tuple[int, int]]:
    """First and last of every run of consecutive numbers."""
    firsts, lasts = sorted(n for n in numbers if n - 1 not in numbers), sorted(n for n in numbers if n + 1 not in numbers)
    return list(zip(firsts, lasts))


def versions_of(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("alias").isNull()).select(*VERSION.names)


def members_of(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("alias").isNotNull()).select(*MEMBERSHIP.names)


def bucket_of(buckets: Column) -> Column:
    """Bucket of a document, by its ``_id``."""
    return F.pmod(F.xxhash64("_id"), buckets).cast("int")


def united(schemas: list[T.StructType]) -> T.StructType:
    """Columns of several schemas by name, in order of appearance; differing types become text."""
    fields: dict[str, T.DataType] = {}
    for field in (f for schema in schemas for f in schema.fields):
        known = fields.setdefault(field.name, field.dataType)
        if known != field.dataType:
            fields[field.name] = STRING
    return struct(**fields)


def column_or_null(field: T.StructField, available: T.StructType) -> Column:
    value = F.col(f"`{field.name}`") if field.name in available.names else F.lit(None)
    return value.cast(field.dataType).alias(field.name)


def new_folder(version: str) -> str:
    return f"{version}.{uuid.uuid4().hex}"
