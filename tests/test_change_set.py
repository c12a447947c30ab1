import pytest

from tableset.operators.changes import using_changed
from tableset.plans.baseline import baseline
from tableset.plans.change_set import action_text, change_set, in_order, removals
from tableset.plans.desired import Desired
from tableset.schemas import CHANGELOG, DOCUMENT, INDEX_SET, MEMBERSHIP, PIPELINE

VERSION = "20010203040506"
ZERO = ("", (False, 0), ("",))
DEFAULT = ("", (False, -1), ("",))
ZERO_JSON = '{"Index":"","Prototype":{"Disabled":false,"MaxDocs":0},"Reindex":{"Pipeline":""}}'
DEFAULT_JSON = ZERO_JSON.replace('"MaxDocs":0', '"MaxDocs":-1')


def static(index):
    return (index, (False, 0), ("",))


def desired_of(spark, env="env", sets=(), documents=(), pipelines=()):
    return Desired(
        env,
        spark.createDataFrame([(name, env, content, meta) for name, content, meta in sets], INDEX_SET),
        spark.createDataFrame(list(pipelines), PIPELINE),
        spark.createDataFrame([(s, n, c, (i,)) for s, n, c, i in documents], DOCUMENT),
        spark.createDataFrame([], "kind STRING, key STRING, reason STRING"),
    )


def log_of(spark, *rows, env="env"):
    """Rows ``(type, identifier, content, meta)``, in order of writing."""
    return spark.createDataFrame([(t, i, "", env, c, m, None, n) for n, (t, i, c, m) in enumerate(rows)], CHANGELOG)


def run(spark, desired, log=None, members=(), live=(), **options):
    membership = spark.createDataFrame(list(members), MEMBERSHIP)
    changes, errors = change_set(
        desired, log if log is not None else log_of(spark), membership,
        spark.createDataFrame(list(live), PIPELINE), VERSION, **options,
    )
    return changes, errors, membership


def brief(changes):
    """Actions in order, without the fields that are NULL."""
    fields = ("source", "target", "max_docs", "pipeline", "definition", "meta")
    return [
        (r.action, {f: r[f] for f in fields if r[f] is not None}) for r in in_order(changes).collect()
    ]


def test_fresh_index_set(spark):
    changes, errors, _ = run(spark, desired_of(spark, sets=[("x", "{}", ZERO)]))
    name = f"env-x_{VERSION}"
    assert brief(changes) == [
        ("create_index", {"target": name, "definition": "{}"}),
        ("create_alias", {"source": "env-x", "target": name}),
        ("write_changelog", {"source": "index_set", "target": name, "definition": "{}", "meta": ZERO_JSON}),
    ]
    assert errors.count() == 0


def test_update_of_an_index_set(spark):
    log = log_of(spark, ("index_set", "x", "{}", "{}"))
    changes, _, membership = run(spark, desired_of(spark, sets=[("x", "{}", ZERO)]), log, [("env-x", "old")])
    name = f"env-x_{VERSION}"
    assert [(a, v.get("source"), v["target"]) for a, v in brief(changes)] == [
        ("create_index", None, name), ("reindex", "env-x", name), ("update_alias", "env-x", name), ("write_changelog", "index_set", name),
    ]
    assert brief(changes)[1][1]["max_docs"] == -1
    assert [tuple(r) for r in removals(changes, membership).collect()] == [("env-x", "old")]


def test_new_static_index_set(spark):
    changes, _, _ = run(
        spark, desired_of(spark, sets=[("x", "", static("common-idx"))]), members=[("other-idx", "common-idx")]
    )
    assert brief(changes) == [
        ("create_alias", {"source": "env-x", "target": "common-idx"}),
        ("write_changelog", {"source": "index_set", "target": "common-idx", "definition": "", "meta": ZERO_JSON.replace('"Index":""', '"Index":"common-idx"')}),
    ]


def test_static_index_set_that_moves(spark):
    members = [("other-idx", "common-idx"), ("env-idx", "common-idx")]
    changes, _, membership = run(spark, desired_of(spark, sets=[("idx", "", static("common2-idx"))]), members=members)
    assert [(a, v["target"]) for a, v in brief(changes)] == [("update_alias", "common2-idx"), ("write_changelog", "common2-idx")]
    assert [tuple(r) for r in removals(changes, membership).collect()] == [("env-idx", "common-idx")]


@pytest.mark.parametrize(
    "members, updates", [([("env-idx", "s")], 0), ([("env-idx", "s"), ("env-idx", "t")], 1), ([("env-idx", "a"), ("env-idx", "s")], 1)]
)
def test_static_swap_only_when_members_differ(spark, members, updates):
    changes, _, _ = run(spark, desired_of(spark, sets=[("idx", "", static("s"))]), members=members)
    assert sum(a == "update_alias" for a, _ in brief(changes)) == updates
    assert brief(changes)[-1][0] == "write_changelog"


def test_unchanged_set_needs_nothing(spark):
    log = log_of(spark, ("index_set", "x", '{"b": 2, "a": 1.0}', DEFAULT_JSON))
    changes, errors, _ = run(spark, desired_of(spark, sets=[("x", '{"a":1,"b":2}', DEFAULT)]), log, [("env-x", "v")])
    assert brief(changes) == [] and errors.count() == 0


def test_latest_log_row_of_the_environment_counts(spark):
    log = log_of(spark, ("index_set", "x", "{}", DEFAULT_JSON), ("index_set", "x", '{"n":1}', DEFAULT_JSON))
    other = log_of(spark, ("index_set", "x", "{}", DEFAULT_JSON), env="dev")
    changes, _, _ = run(spark, desired_of(spark, sets=[("x", "{}", DEFAULT)]), log.union(other), [("env-x", "v")])
    assert len(brief(changes)) == 4
    changes, _, _ = run(spark, desired_of(spark, sets=[("x", '{"n":1}', DEFAULT)]), log.union(other), [("env-x", "v")])
    assert brief(changes) == []


def test_malformed_definition_is_an_error(spark):
    log = log_of(spark, ("index_set", "x", "{}", DEFAULT_JSON))
    changes, errors, _ = run(spark, desired_of(spark, sets=[("x", "{", DEFAULT)]), log)
    assert brief(changes) == []
    assert [(r.kind, r.key) for r in errors.collect()] == [("index_set", "x")]


def seeded(max_docs=7, disabled=False):
    return ("", (disabled, max_docs), ("",))


@pytest.mark.parametrize(
    "meta, members, proto, copied",
    [
        (seeded(), [], "proto", True),
        (seeded(), [], "", False),
        (seeded(), [], "env", False),
        (seeded(disabled=True), [], "proto", False),
        (static("s"), [], "proto", False),
        (seeded(), [("env-x", "old")], "proto", None),  # a copy, but of the own alias
    ],
)
def test_seeding_from_a_prototype(spark, meta, members, proto, copied):
    changes, _, _ = run(spark, desired_of(spark, sets=[("x", "{}", meta)]), members=members, prototype_env=proto)
    copies = [v for a, v in brief(changes) if a == "reindex"]
    if copied:
        assert copies == [{"source": "proto-x", "target": f"env-x_{VERSION}", "max_docs": 7, "pipeline": ""}]
    elif copied is None:
        assert copies[0]["source"] == "env-x" and copies[0]["max_docs"] == -1
    else:
        assert copies == []


def test_changed_pipeline_moves_its_sets(spark):
    meta = lambda p: ("", (False, -1), (p,))
    log = log_of(
        spark,
        *[("index_set", s, "{}", DEFAULT_JSON.replace('"Pipeline":""', f'"Pipeline":"{p}"')) for s, p in (("a", "p"), ("b", "q"), ("c", ""))],
    )
    desired = desired_of(
        spark,
        sets=[("a", "{}", meta("p")), ("b", "{}", meta("q")), ("c", "{}", meta(""))],
        pipelines=[("p", '{"processors": []}'), ("q", '{"processors":[]}'), ("r", "{}")],
    )
    live = [("env-p", '{"processors":[{}]}'), ("env-q", '{ "processors": [] }')]
    members = [("env-a", "v1"), ("env-b", "v2"), ("env-c", "v3")]
    changes, _, _ = run(spark, desired, log, members, live)
    rows = in_order(changes).collect()
    assert [(r.stage, r.key, r.action) for r in rows] == [
        (1, "p", "put_pipeline"), (1, "r", "put_pipeline"),
        (2, "a", "create_index"), (2, "a", "reindex"), (2, "a", "update_alias"), (2, "a", "write_changelog"),
    ]
    assert rows[3].pipeline == "env-p"


@pytest.mark.parametrize("broadcast", [True, False])
def test_pipeline_lookup_both_ways(spark, broadcast):
    sets = spark.createDataFrame([(i, "p" if i % 2 else ("" if i % 4 else "q")) for i in range(200)], "k INT, pipeline STRING")
    changed = spark.createDataFrame([("p",), ("",)], "name STRING")
    got = using_changed(sets, changed, sets.pipeline, "k", broadcast=broadcast).collect()
    assert len(got) == 200
    assert all(r.pipeline_changed == (r.k % 2 == 1) for r in got)


def test_documents(spark):
    desired = desired_of(
        spark,
        documents=[("is", "x", '{"k":"v"}', False), ("is", "y", "{}", True), ("is", "z", "{}", False)],
    )
    log = log_of(spark, ("document", "is/z", "{ }", '{"Ignored": false}'))
    changes, _, _ = run(spark, desired, log, [("env-is", "idx")])
    assert brief(changes) == [
        ("index_document", {"source": "x", "target": "env-is", "definition": '{"k":"v"}'}),
        ("write_changelog", {"source": "document", "target": "x", "definition": '{"k":"v"}', "meta": '{"Ignored":false}'}),
        ("write_changelog", {"source": "document", "target": "y", "definition": "{}", "meta": '{"Ignored":true}'}),
    ]


def test_text_of_actions(spark):
    desired = desired_of(
        spark, env="dev",
        sets=[
            ("index1", "{}", DEFAULT), ("index2", "{}", ("", (False, 9), ("p",))), ("index3", "{}", ("", (False, -1), ("p",))),
        ],
        documents=[("index1", "d", "{}", False)],
        pipelines=[("pipeline1", "{}")],
    )
    members = [("dev-index3", "b"), ("dev-index3", "a")]
    changes, _, membership = run(spark, desired, members=members, prototype_env="proto")
    lines = [r.text for r in in_order(action_text(changes, membership, "dev")).collect()]
    assert lines == [
        "put pipeline dev-pipeline1",
        f"create index dev-index1_{VERSION}",
        f"reindex proto-index1 -> dev-index1_{VERSION}",
        f"create alias dev-index1 -> dev-index1_{VERSION}",
        "write index_set changelog entry for dev:index1",
        f"create index dev-index2_{VERSION}",
        f"reindex proto-index2 -> dev-index2_{VERSION} via dev-p (9 max docs)",
        f"create alias dev-index2 -> dev-index2_{VERSION}",
        "write index_set changelog entry for dev:index2",
        f"create index dev-index3_{VERSION}",
        f"reindex dev-index3 -> dev-index3_{VERSION} via dev-p",
        f"update alias dev-index3 -> dev-index3_{VERSION}; removing dev-index3 -> a, dev-index3 -> b",
        "write index_set changelog entry for dev:index3",
        "index document dev-index1/d",
        "write document changelog entry for dev:index1/d",
    ]


@pytest.mark.parametrize("legacy", [False, True])
def test_baseline_then_change_run(spark, legacy):
    desired = desired_of(spark, sets=[("x", "{}", DEFAULT)], documents=[("x", "d", "{}", False)])
    keys = spark.createDataFrame(
        [("index_set", "x"), ("document", "x/d"), ("document", "x/e"), ("index_set", "y")],
        "resource_type STRING, resource_identifier STRING",
    )
    rows, missing = baseline(desired, keys, legacy=legacy)
    logged = {r.resource_identifier: (r.final_name, r.meta, r.env_name) for r in rows.collect()}
    assert logged == {"x": ("", DEFAULT_JSON, "env"), "x/d": ("d", "" if legacy else '{"Ignored":false}', "env")}
    assert sorted(tuple(r) for r in missing.collect()) == [("document", "x/e"), ("index_set", "y")]
    log = log_of(spark, *[(r.resource_type, r.resource_identifier, r.content, r.meta) for r in rows.collect()])
    changes, _, _ = run(spark, desired, log, [("env-x", "v")])
    assert len(brief(changes)) == (2 if legacy else 0)
