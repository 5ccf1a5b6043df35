"""Contexts, ego graphs and impact on small graphs."""

import pytest

from quillgraph.operators import contexts as cx


@pytest.fixture(scope="module")
def graph(spark):
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    docs = [("d1", "One", "about one", "", "docs/1.md"), ("d2", "Two", None, "note", "docs/2.md"), ("entity-x", "X", "of x", None, "docs/x.md"), ("e", "clash", None, None, "docs/e.md")] + [(f"m{k:02d}", "M", None, None, "p") for k in range(70)]
    edge = "src string, dst string, line int"
    t = {
        "Doc": table(docs, "id string, title string, summary string, kind string, path string"),
        "Entity": table([("x", "X", "the x"), ("y", "Y", ""), ("z", "Z", ""), ("e", "E", "")], "id string, display string, description string"),
        "Function": table([("f().", "a.py", "does"), ("g().", "a.py", None), ("h().", "b.py", None)], "symbol string, file string, doc_comment string"),
        "Endpoint": table([("GET:/a", "/a")], "id string, path string"),
        "WIKILINK": table([("d1", "d2", 3), ("d1", "gone", 4), ("d2", "entity-x", 9)] + [("m00", f"m{k:02d}", k) for k in range(1, 70)], edge),
        "MD_LINK": table([("d2", "d1", 5)], edge),
        "DEPENDS_ON": table([("d1", "d2", 1)], edge),
        "INFORMED_BY": table([], edge),
        "SUPERSEDES": table([], edge),
        "COVERS": table([("d1", "x", 2), ("d2", "x", 7), ("d2", "z", 8)], edge),
        "CALLS": table([("f().", "g()."), ("g().", "h()."), ("h().", "f()."), ("f().", "g().")], "src string, dst string"),
        "FUNCTION_DEFINED_IN": table([("f().", "d1")], "src string, dst string"),
        "FUNCTION_BELONGS_TO": table([("f().", "x"), ("g().", "y")], "src string, dst string"),
        "FUNCTION_MENTIONS": table([("h().", "z")], "src string, dst string"),
        "RELATES_TO": table([("x", "y")], "src string, dst string"),
        "ENTITY_CALLS": table([("y", "z")], "src string, dst string"),
        "ENDPOINT_TOUCHES_ENTITY": table([("GET:/a", "y")], "src string, dst string"),
        "ENDPOINT_HANDLED_BY": table([("GET:/a", "h().")], "src string, dst string"),
    }
    return t


def test_context_for(graph):
    rows = lambda *a: [(r.place, r.id, r.kind, r.direction, r.edge_kind, r.edge_line) for r in cx.context_for(graph, *a).collect()]
    assert rows("d1") == [(1, "d2", "note", "outbound", "DEPENDS_ON", 1), (2, "d2", "note", "outbound", "WIKILINK", 3), (3, "d2", "note", "inbound", "MD_LINK", 5)]
    assert rows("x") == [(1, "entity-x", "doc", "outbound", "DEFINED_BY", None), (2, "d1", "doc", "inbound", "COVERS", 2), (3, "d2", "note", "inbound", "COVERS", 7)]
    assert [(r[1], r[4]) for r in rows("f().")] == [("g().", "CALLS_OUT"), ("h().", "CALLS_IN"), ("d1", "DEFINED_IN"), ("x", "BELONGS_TO")]
    assert cx.node_kind(graph, "e") == "doc"  # documents come first
    assert (len(rows("m00")), len(rows("m00", 7)), len(rows("m00", 60))) == (20, 7, 50)
    assert [r[1] for r in rows("m00", 3)] == ["m01", "m02", "m03"]
    for bad in (("nothing",), ("d1", -1)):
        with pytest.raises(ValueError):
            cx.context_for(graph, *bad)


def test_ego_graph(graph):
    edges = lambda *a: {tuple(r) for r in cx.ego_edges(graph, *a).collect()}
    nodes = lambda *a: {(r.node_kind, r.id) for r in cx.ego_nodes(graph, *a).collect()}
    near = {("x", "y", "relates_to"), ("d1", "x", "covers"), ("d2", "x", "covers"), ("f().", "x", "function_belongs_to")}
    assert edges("x", 1) == near
    assert edges("x", 2) == near | {("y", "z", "entity_calls"), ("g().", "y", "function_belongs_to"), ("GET:/a", "y", "endpoint_touches_entity")}
    assert nodes("x", 1) == {("entity", "x"), ("entity", "y"), ("doc", "d1"), ("doc", "d2"), ("function", "f().")}
    assert nodes("x", 2) - nodes("x", 1) == {("entity", "z"), ("function", "g()."), ("endpoint", "GET:/a")}
    assert (edges("x", 0), nodes("x", 0), edges("nobody", 2)) == (set(), {("entity", "x")}, set())


def test_impact(graph):
    rows = lambda *a: {tuple(r)[:3] for r in cx.impact(graph, *a).collect()}
    assert rows("g().", 1) == {("caller", "f().", 1), ("entity", "y", None), ("entity", "x", None)}
    assert rows("g().", 5) == {("caller", "f().", 1), ("caller", "h().", 2), ("entity", "x", None), ("entity", "y", None), ("entity", "z", None), ("endpoint", "GET:/a", None)}
    with pytest.raises(ValueError):
        cx.impact(graph, "nothing")
