import json
import uuid

import pytest
from pyspark.sql import functions as F

from tableset.functions.layout import layout_id, layout_of
from tableset.operators.latest import entries_of
from tableset.plans.change_set import in_order
from tableset.plans.migrate import MigrationError, migrate
from tableset.schemas import CHANGELOG
from tableset.sources.store import SnapshotConflict, Store
from tests.test_change_set import desired_of

TEXT = '{"mappings": {"properties": {"n": {"type": "keyword"}, "s": {"type": "text"}}}}'
LONG = '{"mappings": {"properties": {"n": {"type": "long"}, "s": {"type": "text"}, "extra": {"type": "keyword"}}}}'


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def meta(pipeline="", index="", max_docs=-1, disabled=False):
    return (index, (disabled, max_docs), (pipeline,))


def documents(spark, rows):
    return spark.createDataFrame(rows, "_id STRING, n STRING, s STRING")


def content(store, alias, *columns):
    return sorted(tuple(r[c] for c in columns) for r in store.scan(alias).collect())


def put(store, alias, name, rows, definition=TEXT):
    """A stored version behind an alias, as left by an earlier run."""
    store.create_version(name, definition, documents(store.spark, rows))
    pair = store.spark.createDataFrame([(alias, name)], "alias STRING, version_name STRING")
    store.swap(pair.limit(0), pair)


def actions(changes):
    return [r.action for r in in_order(changes).collect()]


def test_absent_tables_are_empty_with_their_columns(store):
    assert store.changelog().schema == CHANGELOG
    for df in (store.changelog(), store.pipelines(), store.membership(), store.versions(), store.scan("nope")):
        assert df.count() == 0


def test_changelog_is_appended_and_stamped(spark, store):
    row = spark.createDataFrame(
        [("index_set", "x", "f", "e", "{}", "{}")],
        "resource_type STRING, resource_identifier STRING, final_name STRING, env_name STRING, content STRING, meta STRING",
    )
    store.append_log(row)
    store.append_log(row)
    rows = store.changelog().collect()
    assert len(rows) == 2 and all(r.timestamp is not None for r in rows)
    assert rows[0].timestamp != rows[1].timestamp


def test_registry_put_and_delete(spark, store):
    put_rows = lambda *rows: store.put_pipelines(spark.createDataFrame(list(rows), "name STRING, definition STRING"))
    put_rows(("p", "1"), ("q", "1"))
    put_rows(("q", "2"))
    assert sorted(map(tuple, store.pipelines().collect())) == [("p", "1"), ("q", "2")]
    store.delete_pipelines(spark.createDataFrame([("p",), ("zz",)], "name STRING"))
    assert sorted(map(tuple, store.pipelines().collect())) == [("q", "2")]


def test_uncommitted_snapshot_is_not_read(spark, store, tmp_path):
    store.put_pipelines(spark.createDataFrame([("p", "1")], "name STRING, definition STRING"))
    (tmp_path / "store" / "pipelines" / "snapshot=2").mkdir()
    assert [r.definition for r in store.pipelines().collect()] == ["1"]
    store._pipelines.release()
    store.put_pipelines(spark.createDataFrame([("p", "3")], "name STRING, definition STRING"))
    assert [r.definition for r in store.pipelines().collect()] == ["3"]


def test_a_version_is_created_once(spark, store):
    store.create_version("v", TEXT, documents(spark, [("a", "1", "x")]))
    with pytest.raises(ValueError, match="exists already"):
        store.create_version("v", TEXT)
    assert [r.version_name for r in store.versions().collect()] == ["v"]


def test_alias_over_versions_with_different_columns(spark, store):
    put(store, "al", "v1", [("a", "1", "x")])
    put(store, "al", "v2", [("b", "2", "y")], LONG)
    put(store, "other", "v3", [("c", "3", "z")])
    assert content(store, "al", "_id", "n", "extra") == [("a", "1", None), ("b", "2", None)]
    store.publish_view("al", spark.createDataFrame([], "s STRING").schema)
    assert sorted(r.s for r in spark.sql("SELECT s FROM al").collect()) == ["x", "y"]


def test_scan_reads_only_the_folders_of_its_versions(spark, store):
    for i in range(4):
        put(store, f"al{i}", f"v{i}", [(f"d{i}", "1", "x")])
    df = store.scan("al2")
    assert df.count() == 1
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_drop_only_what_no_alias_uses(spark, store):
    put(store, "al", "v1", [("a", "1", "x")])
    store.create_version("v2", TEXT, documents(spark, [("b", "2", "y")]))
    assert [r.version_name for r in store.unreferenced().collect()] == ["v2"]
    with pytest.raises(ValueError):
        store.drop_version("v1")
    store.drop_version("v2")
    assert [r.version_name for r in store.versions().collect()] == ["v1"]
    assert content(store, "al", "_id") == [("a",)]


def test_layouts_follow_the_columns(spark):
    settings = TEXT[:-1] + ', "settings": {"x": 1}}'
    assert layout_id(TEXT) == layout_id(settings) != layout_id(LONG)
    odd = '{"mappings": {"properties": {"b": {"type": "geo"}, "a": {}, "c": {"type": "date"}, "d": {"type": "boolean"}}}}'
    definitions = [TEXT, settings, LONG, odd, "{}", "", '{"mappings": {}}']
    rows = spark.createDataFrame([(d,) for d in definitions], "d STRING").select("d", layout_of(F.col("d")).alias("l"))
    assert {r.d: r.l for r in rows.collect()} == {d: layout_id(d) for d in definitions}


def test_log_of_other_environments_is_not_read(spark, store, plan_of):
    rows = spark.createDataFrame(
        [("index_set", "x", "f", e, "{}", "{}") for e in ("e1", "e2")],
        "resource_type STRING, resource_identifier STRING, final_name STRING, env_name STRING, content STRING, meta STRING",
    )
    store.append_log(rows)
    mine = entries_of(store.changelog(), "index_set", "e1")
    assert [r.env_name for r in mine.collect()] == ["e1"]
    assert "PartitionFilters: [isnotnull(resource_type" in plan_of(mine)


def test_documents_are_written_without_a_sort(spark, store):
    df = documents(spark, [("a", "1", "x"), ("b", "2", "y")]).withColumn("folder", F.concat(F.lit("f"), "_id"))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    store.write_folders(df, TEXT)
    listed = sorted(r.folder for r in store.read_layout(layout_id(TEXT), df.select("n", "s").schema).collect())
    assert listed == ["fa", "fb"]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_broken_definition_is_an_error(spark, store):
    with pytest.raises(MigrationError, match="not a JSON object"):
        migrate(store, desired_of(spark, sets=[("x", "{", meta())]), "1")
    assert store.versions().count() == 0


def test_first_run_then_nothing_to_do(spark, store):
    desired = desired_of(spark, sets=[("x", TEXT, meta())], documents=[("x", "d", '{"n": "1", "s": "t"}', False), ("x", "e", "{}", True)])
    changes = migrate(store, desired, "1")
    assert actions(changes) == ["create_index", "create_alias", "write_changelog", "index_document", "write_changelog", "write_changelog"]
    assert content(store, "env-x", "_id", "n", "s") == [("d", "1", "t")]
    assert [tuple(r) for r in store.membership().collect()] == [("env-x", "env-x_1")]
    assert sorted(r.resource_identifier for r in store.changelog().collect()) == ["x", "x/d", "x/e"]
    assert actions(migrate(store, desired, "2")) == []


def test_changed_definition_copies_and_swaps(spark, store):
    put(store, "env-x", "old", [("a", "1", "S"), ("b", "2", "T")])
    put(store, "env-y", "oldy", [("c", "3", "U")])
    pipelines = [("p", '{"processors": [{"lowercase": {"field": "s"}}]}')]
    desired = desired_of(spark, sets=[("x", LONG, meta("p")), ("y", LONG, meta("p"))], pipelines=pipelines)
    migrate(store, desired, "7")
    assert content(store, "env-x", "_id", "n", "s", "extra") == [("a", 1, "s", None), ("b", 2, "t", None)]
    assert content(store, "env-y", "_id", "n", "s") == [("c", 3, "u")]
    assert sorted(map(tuple, store.membership().collect())) == [("env-x", "env-x_7"), ("env-y", "env-y_7")]
    assert sorted(r.version_name for r in store.unreferenced().collect()) == ["old", "oldy"]
    # The same definitions with another transform: the sets move once more.
    again = desired_of(
        spark, sets=[("x", LONG, meta("p")), ("y", LONG, meta("p"))],
        pipelines=[("p", '{"processors": [{"uppercase": {"field": "s"}}, {"drop": {"if": "n = 2"}}]}')],
    )
    migrate(store, again, "8")
    assert content(store, "env-x", "_id", "s") == [("a", "S")]


def test_rejected_document_stops_before_publishing(spark, store):
    put(store, "env-x", "old", [("a", "1", "S"), ("b", "two", "T"), ("c", "three", "T")])
    desired = desired_of(spark, sets=[("x", LONG, meta())])
    with pytest.raises(MigrationError, match=r"b: \[mapper_parsing_exception\] failed to parse field \[n\]"):
        migrate(store, desired, "7")
    assert content(store, "env-x", "_id", "n") == [("a", "1"), ("b", "two"), ("c", "three")]
    assert [r.version_name for r in store.versions().collect()] == ["old"]
    assert store.changelog().count() == 0
    # After the source is put right the same run goes through.
    put_right = desired_of(spark, sets=[("x", LONG, meta("p"))], pipelines=[("p", '{"processors": [{"convert": {"field": "n", "type": "long"}}, {"set": {"field": "n", "value": 0}}]}')])
    with pytest.raises(MigrationError, match="unable to convert"):
        migrate(store, put_right, "7")
    fixed = desired_of(spark, sets=[("x", LONG, meta("q"))], pipelines=[("q", '{"processors": [{"set": {"field": "n", "value": "0"}}]}')])
    migrate(store, fixed, "7")
    assert content(store, "env-x", "_id", "n") == [("a", 0), ("b", 0), ("c", 0)]


def test_seeding_with_caps(spark, store):
    put(store, "proto-x", "px", [(f"d{i}", str(i), "s") for i in range(9)])
    put(store, "proto-y", "py", [(f"d{i}", str(i), "s") for i in range(9)])
    put(store, "proto-z", "pz", [(f"d{i}", str(i), "s") for i in range(9)])
    desired = desired_of(spark, sets=[("x", TEXT, meta(max_docs=4)), ("y", TEXT, meta()), ("z", TEXT, meta(max_docs=0)), ("w", TEXT, meta(disabled=True))])
    migrate(store, desired, "1", prototype_env="proto")
    assert content(store, "env-x", "_id") == [(f"d{i}",) for i in range(4)]
    assert len(content(store, "env-y", "_id")) == 9
    assert content(store, "env-z", "_id") == [] == content(store, "env-w", "_id")


def test_alias_with_two_members_becomes_one_version(spark, store):
    put(store, "env-x", "v1", [("a", "1", "old"), ("b", "2", "old")])
    put(store, "env-x", "v2", [("a", "3", "new")], LONG)
    migrate(store, desired_of(spark, sets=[("x", TEXT, meta())]), "1")
    assert content(store, "env-x", "_id", "n", "s") == [("a", "3", "new"), ("b", "2", "old")]
    assert [tuple(r) for r in store.membership().collect()] == [("env-x", "env-x_1")]


def test_static_index(spark, store):
    store.create_version("common", TEXT, documents(spark, [("a", "1", "x")]))
    desired = desired_of(
        spark, sets=[("x", "", meta(index="common")), ("y", "", meta(index="common"))],
        documents=[("x", "d", '{"n": "5"}', False), ("y", "e", '{"n": "6"}', False), ("y", "a", '{"n": "7"}', False)],
    )
    migrate(store, desired, "1")
    assert content(store, "env-x", "_id", "n", "_seq_no") == [("a", "7", 1), ("d", "5", 0), ("e", "6", 0)]
    assert content(store, "env-y", "_id") == content(store, "env-x", "_id")
    assert actions(migrate(store, desired, "2")) == []


def test_missing_targets_are_errors(spark, store):
    with pytest.raises(MigrationError, match="no such version 'gone'"):
        migrate(store, desired_of(spark, sets=[("x", "", meta(index="gone"))]), "1")
    with pytest.raises(MigrationError, match="no such alias 'env-q'"):
        migrate(store, desired_of(spark, documents=[("q", "d", "{}", False)]), "1")
    put(store, "env-x", "old", [("a", "1", "S")])
    with pytest.raises(MigrationError, match="no such pipeline 'env-p'"):
        migrate(store, desired_of(spark, sets=[("x", TEXT, meta("p"))]), "1")
    assert content(store, "env-x", "_id") == [("a",)] and store.changelog().count() == 0


def test_bad_documents_are_errors(spark, store):
    desired = desired_of(spark, sets=[("x", LONG, meta())], documents=[("x", "d", '{"n": "many"}', False)])
    with pytest.raises(MigrationError, match="couldn't index document d"):
        migrate(store, desired, "1")
    assert store.changelog().count() == 0


def test_runs_are_found_after_a_break(spark, store):
    """A run that stopped before logging is planned again and comes to the same state."""
    put(store, "env-x", "old", [("a", "1", "S")])
    desired = desired_of(spark, sets=[("x", LONG, meta())])
    original, store.append_log = store.append_log, lambda rows: (_ for _ in ()).throw(RuntimeError(uuid.uuid4().hex))
    with pytest.raises(RuntimeError):
        migrate(store, desired, "1")
    store.append_log = original
    assert actions(migrate(store, desired, "2")) == ["create_index", "reindex", "update_alias", "write_changelog"]
    assert content(store, "env-x", "_id", "n") == [("a", 1)]
    assert store.changelog().filter(F.col("final_name") == "env-x_2").count() == 1


def test_second_writer_from_one_state_fails(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    pipelines = spark.createDataFrame([("p0", "{}")], "name STRING, definition STRING")
    a.put_pipelines(pipelines)
    base, rows = b._pipelines.current()
    a.put_pipelines(pipelines.withColumn("name", F.lit("pa")))
    with pytest.raises(SnapshotConflict):
        b._pipelines.write(rows, base)
    b.put_pipelines(pipelines.withColumn("name", F.lit("pb")))
    assert sorted(r.name for r in a.pipelines().collect()) == ["p0", "pa", "pb"]


def test_release_after_a_broken_write(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("p0", "{}")], "name STRING, definition STRING")
    broken = rows.withColumn("definition", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        store._pipelines.write(broken, 0)
    with pytest.raises(SnapshotConflict):
        store.put_pipelines(rows)
    store._pipelines.release()
    store.put_pipelines(rows)
    assert store.pipelines().count() == 1


def test_a_source_without_members_stops_the_run(spark, store):
    """A prototype that isn't stored would give an empty version that no later run repairs."""
    wanted = desired_of(spark, sets=[("x", TEXT, ("", (False, -1), ("",)))])
    with pytest.raises(MigrationError, match="no such alias"):
        migrate(store, wanted, "1", prototype_env="proto")
    assert store.membership().count() == 0 and store.changelog().count() == 0


def test_undeclared_fields_survive_copies_and_writes(spark, store):
    """A definition that declares less loses nothing, and a later one takes its fields back, typed."""
    typed = '{"mappings": {"properties": {"v": {"type": "long"}, "w": {"type": "keyword"}}}}'
    for version, definition in (("1", typed), ("2", "{}"), ("3", typed)):
        migrate(store, desired_of(spark, sets=[("x", definition, ("", (False, -1), ("",)))]), version)
        if version == "1":
            body = '{"v": 7, "w": "text", "other": {"k": [1, 2]}}'
            wanted = desired_of(spark, sets=[("x", definition, ("", (False, -1), ("",)))], documents=[("x", "d", body, False)])
            migrate(store, wanted, "1b")
        (row,) = store.scan("env-x").collect()
        rest = json.loads(row._rest)
        assert rest["other"] == {"k": [1, 2]}
        if version == "2":
            assert (rest["v"], rest["w"]) == (7, "text")
        else:
            assert (row.v, row.w) == (7, "text") and set(rest) == {"other"}
