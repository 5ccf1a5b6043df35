"""Deletion neighbourhoods against all pairs."""

import random

import pytest

from quillgraph.operators.edit_join import family_suggestions, near_words, related_tags


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_all_pairs_within(spark, most):
    r = random.Random(most)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(0, 9)))
    a, b = [word() for _ in range(150)] + ["", "a", "same", "samé"], [word() for _ in range(150)] + ["", "same", "smae", "x" * 60]
    frame = lambda x: spark.createDataFrame([(w,) for w in [*x, None, x[0]]], "word string")
    got = {(x.a, x.b): x.distance for x in near_words(frame(a), frame(b), most).collect()}
    assert got == {(x, y): d for x in set(a) for y in set(b) if (d := distance(x, y)) <= most}
    assert near_words(frame(a).limit(0), frame(b)).count() == 0


def test_no_nested_loop(spark):
    words = spark.createDataFrame([("graph",), ("graphs",)], "word string")
    plan = near_words(words, words)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        near_words(words, words, 3)


def test_family_suggestions(spark):
    rows = [("a", "embeddings"), ("a", "research"), ("b", "graph-embedding"), ("c", "Graph-Similarity"), ("d", "research-tool"), ("e", "code-rag"), ("f", "code-rug"), ("f", None)]
    df = spark.createDataFrame(rows, "doc_id string, value string")
    got = {(r.doc_id, r.tag): r.rule for r in family_suggestions(df).collect()}
    assert got == {("a", "graph-embedding"): "form-drift", ("b", "embeddings"): "form-drift", ("b", "Graph-Similarity"): "shared-token", ("c", "graph-embedding"): "shared-token"}
    tags = spark.createDataFrame([("rules",), ("rulez-rules",)], "tag string")
    assert {(r.tag, r.other): r.rule for r in related_tags(tags, tags).collect()}[("rules", "rulez-rules")] == 1
