"""Searches of vectors against brute force, and on odd tables."""

import math

import numpy as np
import pytest

from tableset.llm import ann, top_k, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v string, score string"


@pytest.fixture
def table(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 300)

    def make(rows):
        return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "x", "y") for i, v in rows], SCHEMA)

    return make


def random_vectors(n, width, seed):
    x = np.random.default_rng(seed).standard_normal((n, width)).astype(np.float32)
    return [(i, v.tolist()) for i, v in enumerate(x)]


ODD = [(20, None), (40, []), (60, [None] * 6), (80, [1.0, 2.0, 3.0, 4.0, 5.0, math.nan]), (100, [math.inf] * 6), (120, [0.0] * 6), (None, [1.0] * 6), (140, [1.0, 2.0])]


def brute(rows, every, k, score):
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            best = sorted((-score(v, w), i) for i, w in good if i != q)[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def whole(v, w):
    return sum(math.floor(1024 * float(np.float32(x))) * math.floor(1024 * float(np.float32(y))) for x, y in zip(v, w))


@pytest.mark.parametrize("chunk", [8192, 3])
def test_top_k(table, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    rows = random_vectors(700, 6, 1)
    # A vector that many rows share, and repeated scores.
    rows = [(1000 + i, v) if i >= 150 else (1000 + i, rows[0][1]) for i, v in rows] + [(1 + i, [1.0] * 6) for i in range(30)] + ODD
    assert found(top_k.top_k(table(rows))) == brute(rows, 100, 10, whole)


def test_top_k_of_large_numbers(table):
    rows = [(i, [1e9 * (i + 1)] * 6) for i in range(5)] + [(100 + i, [float(i)] * 6) for i in range(5)]
    limit = (1 << 63) - 1
    want = brute(rows, 100, 10, lambda v, w: min(limit, whole(v, w)))
    assert found(top_k.top_k(table(rows))) == want


def test_few_and_no_rows(table):
    assert found(top_k.top_k(table([(0, [1.0] * 6), (1, [2.0] * 6)]))) == {0: [(1, 1024 * 2048 * 6)]}
    assert top_k.top_k(table([(0, [1.0] * 6)])).count() == 0
    for search in (top_k.top_k, ann.nearest):
        assert search(table([])).count() == 0
        assert search(table([(i, v) for i, v in ODD if i != 120])).count() == 0


def test_recall_of_nearest(table):
    rows = random_vectors(3000, 6, 2)
    rows = [(i, [x * (1 + i % 3) for x in v]) for i, v in rows] + [(5000 + i, [0.5] * 6) for i in range(200)]
    dot = lambda v, w: float(np.cumsum(np.float32(v).astype(float) * np.float32(w).astype(float))[-1])
    want, got = brute(rows, 20, 20, dot), found(ann.nearest(table([*rows, *ODD])))
    assert want.keys() == got.keys()
    hits = [len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.95
    assert all(s == pytest.approx(dict(want[q]).get(i, s), abs=1e-12) for q in got for i, s in got[q])
    # Equal vectors tie exactly, to the smaller id.
    assert [i for i, _ in got[5000]] == [i for i, _ in want[5000]]


def test_the_tree_leaves_vectors_unread():
    """On vectors in clusters the stopping test holds long before all leaves are verified."""
    r = np.random.default_rng(3)
    centres = 20 * r.standard_normal((32, 16))
    points = centres[np.arange(4096) % 32] + r.standard_normal((4096, 16))
    tree = ann.KdTree(points @ r.standard_normal((16, 8)))
    assert sorted(tree.order.tolist()) == list(range(4096)) and tree.ends[-1] == 4096
    assert np.diff(np.append(0, tree.ends)).max() <= ann.LEAF


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05))
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    with pytest.raises(ValueError):
        ann.chi_square_quantile(0.5, 3)


def test_lists_bound_every_score():
    r = np.random.default_rng(4)
    rows, queries = r.integers(-1000, 1000, (200, 6)).astype(float), r.integers(-1000, 1000, (20, 6)).astype(float)
    signed = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]).T
    lists, exact = top_k.Lists(rows), rows @ queries.T
    for depth in (1, 50, 150, 200):
        worst, frontier = lists.bounds(depth)
        assert np.all(worst @ signed <= exact) and np.all(exact <= frontier @ signed)


def test_vectors_of_each_length_are_searched(table):
    rows = [*random_vectors(120, 6, 3), *((200 + i, v) for i, v in random_vectors(120, 9, 4)), (1000, [1.0] * 12)]
    for length in (6, 9):
        same = [(i, v) for i, v in rows if len(v) == length]
        want = {q: sorted((-whole(v, w), i) for i, w in same if i != q)[:10] for q, v in same if q % 100 == 0}
        got = found(top_k.top_k(table(rows)))
        assert {q: x for q, x in got.items() if q in want} == {q: [(i, -s) for s, i in x] for q, x in want.items()}
    assert {q for q in found(ann.nearest(table(rows)))} == {i for i, _ in rows if i % 20 == 0 and i != 1000}
