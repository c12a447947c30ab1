"""The stages of the pipeline against brute-force versions, each on what its predecessor kept."""

import os
import random
import re
from collections import Counter

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import __spark_entry__ as entry  # noqa: E402
from tableset.llm.common import stored  # noqa: E402
from tableset.llm.queries import ORACLES, QUERIES  # noqa: E402
from tools.check import TABLES, compare  # noqa: E402

from .test_text_operators import VOCABULARY, brute_components, brute_lines  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def shared(spark, documents):
    return spark


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
def test_stages(shared):
    from tokenizers import Tokenizer

    spark, docs = shared, shared.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stored(stage(spark, docs, SF_DIR), name)
        assert docs.columns == COLUMNS
        kept.append([(r.doc_id, r.text, r.source, r.n_chars) for r in docs.collect()])
    assert all(n == len(t) for rows in kept[1:] for _, t, _, n in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    clean = [d for d, t in labels.items() if t == 0]
    assert len({r[0] for r in kept[0]} & set(clean)) >= 0.95 * len(clean)
    want = Counter({(d, t): n for (d, _, _, t), n in brute_lines([r[:2] for r in kept[0]]).items()})
    assert Counter(r[:2] for r in kept[1]) == want
    heads = {d for (d, _), top in brute_components([r[:2] for r in kept[1]], 5).items() if d == top}
    assert {r[0] for r in kept[2]} == heads and len(kept[2]) == len(heads)
    mixed = Counter()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    full = {d: Counter(words(t)) for d, t, *_ in kept[2]}
    for d, t, *_ in kept[3]:
        mixed[d] += len(words(t))
        assert not Counter(words(t)) - full[d]
    assert all(n <= 2 * full[d].total() for d, n in mixed.items())
    library = Tokenizer.from_file(VOCABULARY)
    out = corpus_pipeline.encode(spark, docs, SF_DIR).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in out) == Counter(
        (d, tuple(e := library.encode(t, add_special_tokens=False).ids), library.decode(e, skip_special_tokens=False)) for d, t, *_ in kept[3]
    )


def test_stages_on_odd_tables(spark, odd, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, str(tmp_path)), name)
            if name != "bpe":
                assert out.columns == docs.columns
            if name in ("toxicity", "line_dedup", "bpe"):
                assert out.count() == docs.count()
            assert name == "mixing" or bool(out.count()) == bool(docs.count())


def test_a_mix_of_parts_keeps_the_words(documents, spark):
    r = random.Random(1)
    rows = [(i, "\t".join(f"d{i}w{j}" for j in range(r.randint(1, 90))), r.choice("abc")) for i in range(300)]
    times = Counter(w for x in corpus_pipeline.mix_sources(spark, documents(rows), "").collect() for w in x.text.split())
    known = {w for _, t, _ in rows for w in t.split()}
    assert set(times) <= known and max(times.values()) == 2


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(shared, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    assert not compare(shared, duck, SF_DIR, name, QUERIES[name], ORACLES.get(name)).startswith("FAIL")
    assert entry.queries()[name] is QUERIES[name]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
def test_secret_scan_runs_no_python(shared, plan_of):
    plan = plan_of(QUERIES["op9_secret_scan"](shared, SF_DIR))
    assert not re.search(r"EvalPython|InPandas|InArrow|MapIn", plan)
