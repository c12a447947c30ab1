import pytest

from tableset.plans.desired import BAD_DOCUMENT_NAME, resolve
from tableset.sources.resources import read_includes, read_resources

DEFAULT = ("", False, -1, "")
P1 = ("", False, -1, "p1")
CONTENT = '{"of": "%s"}'


def tree(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content if content is not None else CONTENT % path.name)


def sets_of(desired):
    return {
        r.index_set: (r.content, (r.meta["index"], r.meta.prototype.disabled, r.meta.prototype.max_docs, r.meta.reindex.pipeline))
        for r in desired.index_sets.collect()
    }


def errors_of(desired):
    return [(r.kind, r.key, r.reason) for r in desired.errors.collect()]


META_P1 = '{"reindex": {"pipeline": "p1"}}'
SET_CASES = {
    "resource": ({"x-env1.json": None}, "x-env1.json", DEFAULT),
    "meta only": (
        {"x-env1.meta.json": '{"prototype": {"disabled": true, "maxDocs": 1}, "reindex": {"pipeline": "p1"}}'},
        None, ("", True, 1, "p1"),
    ),
    "static": ({"x-env1.meta.json": '{"index": "y"}'}, None, ("y", False, -1, "")),
    "both": ({"x-env1.json": None, "x-env1.meta.json": META_P1}, "x-env1.json", P1),
    "default": ({"x-default.json": None}, "x-default.json", DEFAULT),
    "independent overlay": (
        {"x-default.json": None, "x-env1.json": None, "x-default.meta.json": META_P1}, "x-env1.json", P1,
    ),
    "exact before default whatever the order": (
        {"b/x-default.json": None, "a/x-env1.json": None}, "x-env1.json", DEFAULT,
    ),
    "settings as text": (
        {"x-env1.meta.json": '{"prototype": {"disabled": "true", "maxDocs": "7"}}'}, None, ("", True, 7, ""),
    ),
    "blank meta": ({"x-env1.json": None, "x-env1.meta.json": ""}, "x-env1.json", DEFAULT),
    "upper case extension": ({"x-env1.JSON": None}, "x-env1.JSON", DEFAULT),
}


@pytest.mark.parametrize("case", SET_CASES)
def test_index_sets(spark, tmp_path, case):
    files, content, meta = SET_CASES[case]
    tree(tmp_path / "indexSets", files)
    desired, _ = resolve(spark, str(tmp_path), "env1")
    assert errors_of(desired) == []
    assert sets_of(desired) == {"x": (CONTENT % content if content else "", meta)}


@pytest.mark.parametrize(
    "meta, reason",
    [
        ('{"index": "y", "prototype": {"disabled": true}}', "a static index takes no prototype settings"),
        ('{"index": "y", "reindex": {"pipeline": "p"}}', "a static index takes no reindex settings"),
        ('{"index": ', "unreadable settings"),
        ('{"prototype": {"maxDocs": "seven"}}', "prototype.maxDocs isn't of type int"),
        ('{"prototype": {"disabled": 7}}', "prototype.disabled isn't of type boolean"),
        ('{"prototype": 5}', "prototype isn't a group of settings"),
    ],
)
def test_bad_settings_are_errors(spark, tmp_path, meta, reason):
    tree(tmp_path / "indexSets", {"x-env1.meta.json": meta, "ok-env1.json": None})
    desired, _ = resolve(spark, str(tmp_path), "env1")
    assert errors_of(desired) == [("index_set", "x", reason)]
    assert list(sets_of(desired)) == ["ok"]


def test_other_environments_and_dashes(spark, tmp_path):
    tree(tmp_path / "indexSets", {"x-env2.json": None, "y-a-b.json": None})
    desired, _ = resolve(spark, str(tmp_path), "a-b")
    assert sets_of(desired) == {}  # the environment is what follows the last dash


def test_same_name_in_two_folders(spark, tmp_path):
    tree(tmp_path / "indexSets", {"a/x-env1.json": '{"n": 1}', "b/x-env1.json": '{"n": 2}'})
    desired, _ = resolve(spark, str(tmp_path), "env1")
    assert sets_of(desired)["x"][0] == '{"n": 2}'


def test_documents(spark, tmp_path):
    tree(
        tmp_path / "documents",
        {
            "x-y-env1.json": '{"a": 1}',
            "x-z-env1.json": '{"a": 2}',
            "x-z-env1.meta.json": '{"ignored": true}',
            "x-only-env1.meta.json": '{"ignored": true}',
        },
    )
    desired, _ = resolve(spark, str(tmp_path), "env1")
    rows = sorted((r.index_set, r.name, r.content, r.meta.ignored) for r in desired.documents.collect())
    assert rows == [("x", "y", '{"a": 1}', False), ("x", "z", '{"a": 2}', True)]


def test_document_name_without_set(spark, tmp_path):
    tree(tmp_path / "documents", {"x-env1.json": "{}"})
    desired, _ = resolve(spark, str(tmp_path), "env1")
    assert errors_of(desired) == [("document", "x", BAD_DOCUMENT_NAME)]


def test_includes_and_skipped_files(spark, tmp_path):
    tree(
        tmp_path,
        {
            "includes/common.json": '"c": /* note */ 1',
            "includes/sub/deep.json": '"d": 2',
            "indexSets/x-env1.json": '{ {{{ include "common" }}}, {{{ include "sub/deep" }}} }',
            "indexSets/nodash.json": "{}",
            "pipelines/p-default.json": '{"processors": []}',
            "pipelines/q-env1.json": '{{{ include "gone" }}}',
        },
    )
    desired, skipped = resolve(spark, str(tmp_path), "env1")
    assert sets_of(desired)["x"][0] == '{ "c":  1, "d": 2 }'
    assert [(r.name, r.definition) for r in desired.pipelines.collect()] == [("p", '{"processors": []}')]
    assert errors_of(desired) == [("pipeline", "q", "missing include: gone")]
    assert [r.file_name for r in skipped.collect()] == ["nodash.json"]


def test_missing_directories_are_empty(spark, tmp_path):
    rows, skipped = read_resources(spark, str(tmp_path / "none"))
    assert rows.count() == 0 and skipped.count() == 0
    assert read_includes(spark, str(tmp_path / "none")).count() == 0
    desired, _ = resolve(spark, str(tmp_path), "env1")
    assert sets_of(desired) == {} and errors_of(desired) == []


def test_empty_files_and_names_with_spaces(spark, tmp_path):
    (tmp_path / "sets").mkdir()
    (tmp_path / "sets" / "e 1+x%-dev.json").write_text("")
    (tmp_path / "inc").mkdir()
    (tmp_path / "inc" / "with space.json").write_text("")
    rows, skipped = read_resources(spark, str(tmp_path / "sets"))
    assert [(r.identifier, r.env, r.content) for r in rows.collect()] == [("e 1+x%", "dev", "")]
    assert skipped.count() == 0
    assert [(r.name, r.content) for r in read_includes(spark, str(tmp_path / "inc")).collect()] == [("with space", "")]
