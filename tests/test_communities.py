"""Communities against sequential versions."""

import random
from collections import Counter, defaultdict

import pytest

from quillgraph.operators.communities import leiden, modularity, ordered_propagation
from quillgraph.operators.concepts import louvain


@pytest.fixture(autouse=True, scope="module")
def small_plans(spark):
    """Many jobs over few rows: two partitions, planned once."""
    wanted = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def planted(seed, groups=5, size=8, inside=0.6, across=0.04):
    r = random.Random(seed)
    n = groups * size
    order = list(range(n))
    r.shuffle(order)
    name = lambda i: f"n{order[i]:03d}"
    return [(name(i), name(j)) for i in range(n) for j in range(i) if r.random() < (inside if i // size == j // size else across)]


def sweep_in_order(edges, passes=50):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    label = {v: v for v in near}
    for _ in range(passes):
        changed = False
        for v in sorted(near):
            votes = Counter(label[u] for u in near[v])
            best = min(votes, key=lambda x: (-votes[x], x))
            changed |= best != label[v]
            label[v] = best
        if not changed:
            break
    return label


@pytest.mark.parametrize("seed", [1])
def test_ordered_propagation_is_the_sweep(spark, seed):
    edges = planted(seed, 4, 6, 0.5, 0.06) + [("x1", "x2"), ("x2", "x1"), ("loop", "loop"), ("x2", "x3"), ("x3", "x4"), ("x4", "x5"), ("x5", "x6")]
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {r.id: r.label for r in ordered_propagation(df).collect()} == sweep_in_order(edges)


def plain_modularity(edges, label):
    w = Counter(tuple(sorted(e)) for e in edges if e[0] != e[1])
    m2 = 2 * sum(w.values())
    k = Counter()
    for (a, b), x in w.items():
        k[a] += x
        k[b] += x
    held = Counter()
    for v, x in k.items():
        held[label[v]] += x
    return sum(2 * x for (a, b), x in w.items() if label[a] == label[b]) / m2 - sum((x / m2) ** 2 for x in held.values())


def is_connected(edges, members):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    seen, todo = set(), [min(members)]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += near[v] & members
    return seen == members


@pytest.mark.parametrize("seed", [1])
def test_leiden_is_no_worse_than_the_sequential_method(spark, seed):
    edges = planted(seed)
    df = spark.createDataFrame(edges, "src string, dst string")
    label = {r.id: r.label for r in leiden(df).collect()}
    assert set(label) == {v for e in edges for v in e}
    groups = defaultdict(set)
    for v, x in label.items():
        groups[x].add(v)
    assert all(x == min(g) and is_connected(edges, g) for x, g in groups.items())
    q = plain_modularity(edges, label)
    assert modularity(df, spark.createDataFrame(list(label.items()), "id string, label string")) == pytest.approx(q)
    assert q >= plain_modularity(edges, louvain({e: 1.0 for e in edges})) - 1e-9


def test_two_triangles_star_and_nothing(spark):
    two = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]
    df = spark.createDataFrame(two, "src string, dst string")
    assert {r.id: r.label for r in leiden(df).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d"}
    none = df.where("false")
    assert leiden(none).count() == 0 and ordered_propagation(none).count() == 0
