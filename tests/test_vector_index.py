"""Indexed and blocked vector searches against a comparison of all with all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import vector_index as vi


def clustered(seed, n=700, d=16, centres=12):
    r = np.random.default_rng(seed)
    c = r.standard_normal((centres, d))
    v = c[r.integers(0, centres, n)] + 0.35 * r.standard_normal((n, d))
    return {k: x for k, x in enumerate(v)}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    mp = pytest.MonkeyPatch()
    mp.setattr(vi, "BLOCK", 50)
    vectors = clustered(1)
    vectors |= {1000: vectors[3], 1001: vectors[3], 1002: np.zeros(16)}
    bad = [(2000, None), (2001, [float("nan")] * 16), (2002, [None] * 16), (2003, [1.0] * 5), (2004, [])]
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()] + bad, "id long, embedding array<double>")
    folder = str(tmp_path_factory.mktemp("v") / "i")
    index = vi.VectorIndex.build(df, folder)
    unit = {k: v / np.linalg.norm(v) if v.any() else v for k, v in vectors.items()}
    yield unit, index, vi.VectorIndex.open(spark, folder)
    mp.undo()


def best(unit, q, k, ids=None):
    s = sorted((-round(float(v @ q), 6), i) for i, v in unit.items() if ids is None or i in ids)
    return [(i, -x + 0.0) for x, i in s[:k]]


def test_every_vector_is_in_one_cell(made):
    unit, index, again = made
    assert sorted(r.id for r in index.vectors.select("id").collect()) == sorted(unit)
    assert (index.centroids == again.centroids).all() and (index.radius == again.radius).all() and (index.probes, index.recall) == (again.probes, again.recall)
    assert 1 < index.probes <= len(index.centroids) == 26


def test_recall_is_what_was_asked(spark, made):
    unit, _, index = made
    asked = [k for k in unit if k % 7 == 0]
    found = index.search_all(index.vectors.where("id % 7 = 0").select(F.col("id").alias("query"), "v"), 10).collect()
    want = {(q, i) for q in asked for i, _ in best(unit, unit[q], 10)}
    assert len(found) == 10 * len(asked)
    assert len(want & {(r.query, r.id) for r in found}) / len(want) >= 0.95 and index.recall >= 0.97
    exact = index.search_all(index.vectors.where("id % 7 = 0").select(F.col("id").alias("query"), "v"), 10, len(index.centroids)).collect()
    got = {q: sorted((r["rank"], r.id, r.score) for r in exact if r.query == q) for q in asked}
    assert got == {q: [(k + 1, i, pytest.approx(s, abs=2e-6)) for k, (i, s) in enumerate(best(unit, unit[q], 10))] for q in asked}


def test_filters_lose_nothing(spark, made):
    unit, _, index = made
    for ids in ([5], [1, 2, 3, 400, 600], [], [9999]):
        allowed = spark.createDataFrame([(i,) for i in ids], "id long")
        got = [(r.id, pytest.approx(r.score, abs=2e-6)) for r in index.search(list(unit[8]), 10, allowed).collect()]
        assert [(i, s) for i, s in best(unit, unit[8], 10, set(ids))] == got
    one = index.search(list(100 * unit[8]), 1).collect()
    assert (one[0].id, one[0].score) == (8, 1.0)
    assert [r.score for r in index.search([0.0] * 16, 3, probes=len(index.centroids)).collect()] == [0.0] * 3


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
def test_all_pairs_above(made, threshold):
    unit, _, index = made
    stands = {r.id: r.stands_for for r in index.members().collect()}
    assert stands[1000] == stands[1001] == stands[3] == 3 and sum(k != v for k, v in stands.items()) == 2
    ids = sorted(k for k, v in stands.items() if k == v)
    m = np.array([unit[i] for i in ids])
    score = np.round(m @ m.T, 6)
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(score >= threshold), strict=True) if i < j}
    found = [(r.src, r.dst) for r in index.pairs(threshold).collect()]
    assert len(found) == len(set(found)) and len(want ^ set(found)) <= 1 and len(want) > 5  # one may round the other way


def test_nothing_to_index(spark, tmp_path):
    empty = spark.createDataFrame([(1, None)], "id long, embedding array<float>")
    assert vi.VectorIndex.build(empty, str(tmp_path / "e")) is None
    one = vi.VectorIndex.build(spark.createDataFrame([("x", [1.0, 0.0])], "id string, embedding array<float>"), str(tmp_path / "o"))
    assert [tuple(r) for r in one.search([2.0, 0.0]).collect()] == [("x", 1.0)] and one.pairs(0.5).count() == 0


def test_pairs_move_vectors_by_groups_of_cells(monkeypatch):
    """How often a vector is moved follows the groups, which follow the vectors: many small cells share one."""
    monkeypatch.setattr(vi, "BLOCK", 50)
    c = np.random.default_rng(4).standard_normal((300, 8))
    sizes = {k: 1 + k % 7 for k in range(299)} | {299: 1000}
    n, of = vi._grouped(sizes, c)
    most = min(4 * 50, max(50, sum(sizes.values()) // 16))
    held = np.zeros(n)
    for k, (first, parts) in of.items():
        held[first : first + parts] += sizes[k] / parts
    assert set(of) == set(sizes) and held.max() <= most and n <= 2 * sum(sizes.values()) / most + 2
    assert vi._grouped({}, c) == (0, {})


def test_pairs_of_equal_vectors(spark, tmp_path, monkeypatch):
    """Each of several equal vectors has all pairs, with those equal to it too, in whatever rows and pieces they come."""
    for name, value in {"BLOCK": 50, "COPIES": 4, "OUT": 30}.items():
        monkeypatch.setattr(vi, name, value)
    vectors = clustered(5, n=150)
    vectors |= {500 + k: vectors[3] for k in range(23)} | {600 + k: 2 * vectors[7] for k in range(3)} | {700: np.zeros(16), 701: np.zeros(16)}
    rows = [*vectors.items(), (3, vectors[3]), (None, vectors[3])]
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "id long, embedding array<double>")
    index = vi.VectorIndex.build(df, str(tmp_path / "c"))
    rows = [(k, v / np.linalg.norm(v) if v.any() else v) for k, v in rows if k is not None]
    m = np.array([v for _, v in rows])
    score = np.round(m @ m.T, 6)
    want = sorted((rows[i][0], rows[j][0], float(score[i, j])) for i, j in zip(*np.nonzero(score >= 0.8), strict=True) if rows[i][0] < rows[j][0])
    found = sorted(tuple(r) for r in index.pairs(0.8, copies=True).collect())
    assert [x[:2] for x in found] == [x[:2] for x in want] and np.allclose([x[2] for x in found], [x[2] for x in want], atol=2e-6)
    assert {(3, 500), (500, 522), (7, 600), (600, 602)} <= {x[:2] for x in found} and (700, 701) not in {x[:2] for x in found}


def test_the_query_of_pairs_has_equal_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 0.0])]
    t = {"embeddings": spark.createDataFrame(rows, "vec_id long, embedding array<float>")}
    assert sorted(tuple(r) for r in vi.similar_vector_pairs(t).collect()) == [(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)]
    assert vi.similar_vector_pairs({"embeddings": t["embeddings"].where("vec_id < 0")}).collect() == []
