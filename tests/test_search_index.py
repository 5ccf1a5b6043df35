"""The stored index against a pass over the texts."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import search_index as si
from quillgraph.operators.analytics import bm25
from quillgraph.sources.driver_tables import GraphTables, store_graph


def corpus_of(spark, n, seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rare = [f"rare{k}" for k in range(20)]
    texts = []
    for k in range(n):
        t = [words[min(59, int(r.expovariate(0.12)))] for _ in range(r.choice([0, 1, 3, 8, 30, 200]))]
        if r.random() < 0.1:
            t.append(r.choice(rare))
        texts.append((f"d{k}", " ".join(t)))
    return spark.createDataFrame(texts + [("null", None), ("stop", "the and for"), ("twin1", "w3 rare1"), ("twin2", "w3 rare1")], "id string, text string")


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    mp = pytest.MonkeyPatch()
    mp.setattr(si, "RANGE", 16)
    docs = corpus_of(spark, 900, 1).cache()
    other = corpus_of(spark, 40, 2)
    folder = str(tmp_path_factory.mktemp("index") / "i")
    si.build_index({"doc": docs, "entity": other}, folder, buckets=7)
    mp.undo()
    return docs, other, si.SearchIndex(spark, folder)


@pytest.mark.parametrize("query, top", [("w0", 10), ("w1 rare1 w1", 3), ("rare3 rare4 w59 w2 w0", 10), ("nothing here", 5), ("the", 5), ("W0 w1, w2; w3 w4", 2000)])
def test_index_equals_scan(indexed, query, top, monkeypatch):
    docs, other, index = indexed
    monkeypatch.setattr(si, "FIRST", 2)
    for kind, df in (("doc", docs), ("entity", other)):
        assert [tuple(r) for r in index.search(kind, query, top).collect()] == [tuple(r) for r in bm25(df, query, top).collect()]


def test_other_parameters_and_filters(indexed, monkeypatch):
    docs, _, index = indexed
    monkeypatch.setattr(si, "FIRST", 1)
    for k1, b in ((1.2, 0.0), (0.5, 1.0)):
        assert index.search("doc", "w0 w7 rare2", 12, None, k1, b).collect() == bm25(docs, "w0 w7 rare2", 12, k1, b).collect()
    for part in (docs.where("id like '%7%'"), docs.where("id = 'd5'"), docs.where("false")):
        assert index.search("doc", "w0 w7 rare2", 12, part.select("id")).collect() == bm25(part, "w0 w7 rare2", 12).collect()


def test_only_the_words_files_are_read(indexed):
    _, _, index = indexed
    all_files = len(index.postings.inputFiles())
    some = index.blocks("doc", ["rare1"])
    assert {f.split("bucket=")[1].split("/")[0] for f in some.inputFiles()} and all_files >= 7
    scan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(corpus" in scan and "bucket" in scan.split("PartitionFilters")[1][:200] and "In(term" in scan or "EqualTo(term,rare1)" in scan
    assert some.agg(F.max("n")).first()[0] <= 64  # no row grows with the corpus


def test_ranges_below_the_threshold_are_left_out(indexed, monkeypatch):
    """A rare word's best documents bound what the common word alone can give."""
    docs, _, index = indexed
    monkeypatch.setattr(si, "FIRST", 2)
    blocks = index.blocks("doc", ["rare1", "w0"])
    found = index.search("doc", "rare1 w0", 3)
    assert found.collect() == bm25(docs, "rare1 w0", 3).collect()
    read = [r["range"] for r in blocks.select("range").distinct().collect()]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(read) > 20 and "LeftSemi" in plan


def test_index_of_a_stored_graph(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(GraphTables, "STORED", {})
    store_graph(spark, sf, str(tmp_path / "g"))
    t = GraphTables.of(spark, sf)
    si.store_index(t, f"{t.stored}/search", ("doc", "entity", "section", "function"))
    query = "graph similarity query expansion anan"
    best = si.similar(t, query, "all").collect()
    assert [r["rank"] for r in best] == list(range(1, len(best) + 1)) and {r["corpus"] for r in best} <= {"doc", "function", "entity", "section"}
    want = sorted(((-r.score, k, r.id) for k in ("doc", "function", "entity", "section") for r in si.scan(t, k, query).collect()))[:10]
    assert [(-r.score, r.corpus, r.id) for r in best] == want
    hit = next(r for r in si.similar(t, query, "doc").collect())
    assert hit.role is not None and hit.tags == ",".join(sorted({r.value for r in t["doc_tags"].where(F.col("doc_id") == hit.id).collect()}))
    assert si.similar(t, query, "doc", min_score=1e9).count() == 0
    assert si.similar(t, query, "doc", min_confidence="high").count() in (0, 10)
    repo = t["Doc"].where("bounded_context is not null").first().bounded_context
    sections = si.similar(t, "anan the heading", "section", repo=repo)
    assert sections.count() >= 0
    for kind, args in (("function", {"repo": repo}), ("page", {})):
        with pytest.raises(ValueError):
            si.similar(t, query, kind, **args)


def test_postings_are_numbers_and_equal_ids_share_a_place(spark, tmp_path):
    docs = spark.createDataFrame([("a", "w1 w2 w2"), ("a", "w2 w2 w3"), ("b", "w1"), ("a", "w1 w1"), (None, "w1 w2 w4"), ("c", "")], "id string, text string")
    si.build_index({"doc": docs}, str(tmp_path / "i"))
    index = si.SearchIndex(spark, str(tmp_path / "i"))
    assert "string" not in str(index.postings.select("places", "tfs").schema).lower()
    for query in ("w1 w2", "w2 w3 w4"):
        assert index.search("doc", query).collect() == bm25(docs, query).collect()
        some = docs.where("id <> 'b'")
        assert index.search("doc", query, 10, some.select("id")).collect() == bm25(some, query).collect()
