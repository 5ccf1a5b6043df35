"""The library proper: plans against an SQL engine, and sources, derivations and traversals on small hand-made inputs."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph import registry
from quillgraph.functions import text as fn
from quillgraph.operators import analytics, lint
from quillgraph.operators.catalog import CATALOG
from quillgraph.plans.relation import ansi_expr, lit, rel, spark_expr
from quillgraph.sources import repository, store
from quillgraph.sources.driver_tables import PROJECTION, RAW, GraphTables
from quillgraph.streaming import changed

RAWS = {*RAW, "benchmark", "labels", "conversations"}


@pytest.fixture(scope="module")
def tables(spark, sf):
    t = GraphTables(spark, sf)
    for n in PROJECTION:
        t.made[n] = t[n].cache()
    return t


@pytest.fixture(scope="module")
def engine(sf):
    c = duckdb.connect()
    for r in RAWS:
        c.sql(f"create view {r} as select * from '{sf}/{r}.parquet'")
    return c


def plain(v):
    return int(v) if isinstance(v, bool) else round(float(v), 9) if hasattr(v, "is_integer") or type(v).__name__ == "Decimal" else v


def key(r):
    return tuple((x is None, str(x)) for x in r)


def compare(df, engine, sql):
    got = sorted((tuple(plain(x) for x in r) for r in df.collect()), key=key)
    found = engine.sql(sql)
    at = [found.columns.index(c) for c in df.columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=key)
    return got


STARRED = ["function-blast-radius-by-file", "hub-functions-by-caller-breadth", "function-shape-distribution", "corpus-cold-start-summary", "coverage-by-entity", "orphan-entities", "stale-narrative-docs", "family-maturity-2d", "loc-pair-clone-candidates", "entity-state-grid", "node-context-function", "latest-by-loop-process", "tight-vs-loose-coupling-hubs", "pytest-prod-test-pairs", "outbound", "query-at", "classify-file-coupling"]


@pytest.mark.parametrize("name", STARRED)
def test_catalogue_matches_sql(tables, engine, name):
    compare(CATALOG[name].example(tables), engine, CATALOG[name].sql())


def test_catalogue_is_whole():
    assert len(CATALOG) >= 272 and {registry.key(n) for n in CATALOG} <= set(registry.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())
    for q in CATALOG.values():
        assert q.needs() <= set(PROJECTION), q.name


def test_all_plans_analyse(tables):
    for q in CATALOG.values():
        assert q.example(tables).columns


def test_empty_graph(spark, tables):
    none = {n: spark.createDataFrame([], tables[n].schema) for n in PROJECTION}
    for name in ("corpus-purpose-classifier", "test-coverage-baseline", "corpus-entities-per-doc-ratio", "coupling-density-stats", "function-shape-summary", "loop-process-balance-metric"):
        assert len(CATALOG[name].example(none).collect()) == 1, name
    for name in ("hub-functions", "doc-fanin", "entity-cooccurrence", "family-maturity-2d"):
        assert CATALOG[name].example(none).collect() == []


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in analytics.EXTRA.items() if sql))
def test_analytics_match_sql(tables, engine, name):
    f, sql = analytics.EXTRA[name]
    compare(f(tables), engine, sql)


def test_lint_matches_sql(tables, engine):
    got = compare(lint.issues(tables, lint.REGISTERED_DAY), engine, lint.sql(lint.plan(lint.REGISTERED_DAY)))
    every = {code for code, _ in lint.rules(lint.REGISTERED_DAY)}
    assert len(every) == 42
    print(sorted(every - {r[0] for r in got}))
    assert len({r[0] for r in got}) >= 36


def test_parameters_are_literals(tables):
    assert CATALOG["entities-by-id-pattern"].run(tables, pattern="x' OR '1'='1").collect() == []
    assert lit("a'b") == "'a''b'" and spark_expr("x = 'a''b\\'") == "x = 'a\\'b\\\\'"
    assert ansi_expr("startswith(x, 'div') AND a div b = 1") == "starts_with(x, 'div') AND a // b = 1"


def test_rel_union_and_distinct(spark, engine):
    t = {"A": spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")}
    engine.sql("create or replace table \"A\" as select * from (values (1,'x'),(1,'x'),(2,null)) t(k,v)")
    plan = rel("A a", out={"k": "a.k"}, distinct=True, union=[rel("A a", where="a.v IS NULL", out={"k": "a.k + 10"})])
    compare(plan.spark(t), engine, plan.sql())


def test_projection_has_keys(tables):
    for name, k in (("Function", "symbol"), ("File", "path"), ("Entity", "id"), ("Doc", "id"), ("Type", "symbol"), ("Endpoint", "id")):
        assert tables[name].count() == tables[name].select(k).distinct().count() > 0, name
    for name in PROJECTION:
        assert tables[name].limit(1).count() == 1, name


# ------------------------------------------------------------------ sources
DOC = """---
id: feature-one
title: "One thing"
summary: What it does
status: current
updated: 2024-05-01
tags: [alpha, 'beta']
covers:
  - brand-1
  - brand-2
depends-on: feature-two
---
# One thing

Text with [[feature-two]] and [three](three.md) and `[[not-this]]`.

```
[[nor-this]]
# not a heading
```
## Part
a
## Part
b
"""


@pytest.fixture(scope="module")
def files(spark):
    py = '@app.get("/items")\n@cached\ndef read_items():\n    # TODO: page them\n    return []\n@bp.route("/x", methods=["GET", "POST"])\nasync def both():\n    pass\n'
    return spark.createDataFrame([("docs/one.md", DOC), ("docs/three.md", "﻿# Three\nplain"), ("app/api.py", py), ("app/__init__.py", ""), ("app/sub/x.js", "router.post('/y', handler);\n")], "path string, text string")


def test_documents(files):
    rows = {r.path: r for r in repository.documents(files.where("path LIKE '%.md'")).collect()}
    one, three = rows["docs/one.md"], rows["docs/three.md"]
    assert (one.id, one.title, one.summary, one.status, one.updated) == ("feature-one", "One thing", "What it does", "current", "2024-05-01")
    assert one.tags == ["alpha", "beta"] and one.covers == ["brand-1", "brand-2"] and one.depends_on == ["feature-two"] and one.supersedes == []
    assert (three.id, three.title, three.tags) == ("three", "Three", [])


def test_sections_and_links(files):
    found = sorted((r.line, r.anchor, r.level, r.text) for r in repository.sections(files.where("path = 'docs/one.md'")).collect())
    assert [(a, lv) for _, a, lv, _ in found] == [("one-thing", 1), ("part", 2), ("part-1", 2)]
    assert [x[3] for x in found][1:] == ["a", "b"]
    assert sorted((r.kind, r.target) for r in repository.links(files).collect()) == [("md_link", "three.md"), ("wikilink", "feature-two")]


def test_endpoints_and_findings(files):
    got = sorted((r.id, r.handler) for r in repository.endpoints(files).collect())
    assert got == [("express:POST:/y", "handler"), ("fastapi:GET:/items", "read_items"), ("flask:GET:/x", "both"), ("flask:POST:/x", "both")]
    assert [(r.kind, r.file, r.line, r.message) for r in repository.findings(files).collect()] == [("todo", "app/api.py", 4, "page them")]


def test_modules(files):
    mods = repository.modules(files)
    assert [(r.id, r.name) for r in mods.collect()] == [("app", "app")]
    assert {(r.src, r.dst) for r in repository.in_module(files, mods).collect()} == {("app/api.py", "app"), ("app/__init__.py", "app"), ("app/sub/x.js", "app")}
    assert {r.path: (r.language, r.loc) for r in repository.file_table(files).collect()}["app/sub/x.js"] == ("javascript", 1)


@pytest.mark.parametrize("block", [3, 4096])
def test_git_log_and_coupling(spark, monkeypatch, block):
    monkeypatch.setattr(repository, "LOG_BLOCK", block)
    log = []
    for k in range(4):
        log += [f"abcdef{k}|{1000 + k}|", "a.py", "b.py"] + (["c.py"] if k == 0 else []) + [""]
    commits = repository.git_log(spark.createDataFrame(list(enumerate(log)), "line int, text string"))
    assert commits.count() == 9
    got = analytics.co_change(commits.select("commit", "file", "at")).collect()
    assert [(r.src, r.dst, r.commits, r.last_co_change_at, r.jaccard) for r in got] == [("a.py", "b.py", 4, 1003, 1.0)]
    assert analytics.co_change(commits.select("commit", "file", "at"), most_files=2).collect()[0].commits == 3


def test_innermost(spark):
    spans = spark.createDataFrame([("f", "outer", 1, 300), ("f", "inner", 100, 200), ("g", "other", 1, 9)], "file string, symbol string, begin int, `end` int")
    occ = spark.createDataFrame([("f", 150), ("f", 250), ("f", 400), ("g", 9)], "file string, line int")
    assert {(r.file, r.line, r.enclosing) for r in repository.innermost(occ, spans).collect()} == {("f", 150, "inner"), ("f", 250, "outer"), ("g", 9, "other")}


def test_read_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# X\n")
    assert [(r.path, r.text) for r in repository.read_files(spark, str(tmp_path)).collect()] == [("a/x.md", "# X\n")]


def test_store(spark, tmp_path):
    root = str(tmp_path / "graph")
    for k in (1, 2):
        store.write_graph({"A": spark.createDataFrame([(k,)], "id int")}, root)
    assert store.read_graph(spark, root, ["A"])["A"].collect()[0].id == 2
    e = spark.createDataFrame([("a", "b"), ("a", "zz")], "src string, dst string")
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [tuple(r) for r in store.valid_edges(e, n, n).collect()] == [("a", "b")]
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), spark.createDataFrame([("b", 3)], "id string, v int")
    assert sorted(map(tuple, store.upsert(old, new, "id").collect())) == [("a", 1), ("b", 3)]
    h = spark.range(20).select(F.col("id").alias("at"))
    assert sorted(r.at for r in store.trim_history(h, 5).collect()) == [15, 16, 17, 18, 19]
    assert [(r.name, r.rows) for r in store.schema_tables({"A": old, "B": new}).collect()] == [("A", 2), ("B", 1)]
    store.reset_graph(spark, root, {"B": new}, keep=["A"])
    assert store.read_graph(spark, root, ["A", "B"])["A"].collect()[0].id == 2


def test_stored_graph_answers_as_the_projection(spark, sf, tables, tmp_path):
    from quillgraph.sources.driver_tables import store_graph

    folder = str(tmp_path / "graph")
    try:
        store_graph(spark, sf, folder)
        stored = GraphTables.of(spark, sf)
        assert stored.stored and GraphTables.of(spark, sf) is stored
        for name in ("hub-functions", "coverage-by-entity"):
            assert sorted(map(str, CATALOG[name].example(stored).collect())) == sorted(map(str, CATALOG[name].example(tables).collect()))
        assert store.read_graph(spark, folder, ["Entity"])["Entity"].count() == tables["Entity"].count()
    finally:
        GraphTables.STORED.clear()


def test_guarded_sql(spark):
    t = {"People": spark.createDataFrame([("a;b", 1), ("c", 2)], "name string, k int")}
    assert [r.name for r in store.guarded_sql(spark, t, "SELECT name FROM People WHERE name = :n", n="a;b").collect()] == ["a;b"]
    assert store.guarded_sql(spark, t, "WITH x AS (SELECT * FROM People) SELECT * FROM x -- a ; comment").count() == 2
    assert store.guarded_sql(spark, t, "WITH x AS (SELECT k FROM people), y AS (SELECT max(k) AS k FROM x) SELECT * FROM y JOIN People p USING (k) WHERE EXISTS (SELECT 1 FROM x) AND k IN (SELECT k FROM x) ORDER BY 1 LIMIT 5").count() == 1
    assert store.guarded_sql(spark, t, "SELECT name, row_number() OVER (ORDER BY k) FROM (VALUES ('q', 3)) v(name, k) UNION ALL SELECT name, k FROM People").count() == 3
    assert store.guarded_sql(spark, t, "SELECT * FROM People", most=1).count() == 1


@pytest.mark.parametrize(
    "bad",
    [
        "DROP TABLE People", "SELECT 1; SELECT 2", "INSERT INTO People SELECT 'x', 1", "", "SET x = 1", "CACHE TABLE People", "EXPLAIN SELECT 1", "SHOW TABLES", "CREATE TABLE z AS SELECT 1", "TRUNCATE TABLE People",
        "WITH x AS (SELECT 1 AS a) INSERT INTO People SELECT 'x', a FROM x", "WITH x AS (SELECT 1 AS a) INSERT OVERWRITE DIRECTORY '{0}' USING parquet SELECT * FROM x", "INSERT OVERWRITE DIRECTORY '{0}' USING parquet SELECT 1",
        "FROM People INSERT INTO a SELECT name INSERT INTO b SELECT k", "FROM People INSERT OVERWRITE DIRECTORY '{0}' USING parquet SELECT *", "SELECT TRANSFORM(name) USING 'cat' FROM People",
        "SELECT java_method('java.lang.System', 'getenv', 'PATH')", "SELECT name FROM People WHERE k = (SELECT reflect('java.lang.Math', 'abs', 1))", "SELECT * FROM parquet.`{0}`", "SELECT * FROM Others", "WITH x AS (SELECT * FROM y), y AS (SELECT 1) SELECT * FROM x",
        "MERGE INTO People USING People AS o ON true WHEN MATCHED THEN DELETE", "DELETE FROM People", "BEGIN SELECT 1; END",
    ],
)
def test_guard_lets_nothing_else_through(spark, tmp_path, bad):
    t = {"People": spark.createDataFrame([("a", 1)], "name string, k int")}
    with pytest.raises(ValueError):
        store.guarded_sql(spark, t, bad.format(tmp_path / "out")).collect()
    assert not list(tmp_path.iterdir())


def test_missing_parameters_are_errors(tables):
    with pytest.raises(ValueError, match="missing parameter pattern"):
        CATALOG["entities-by-id-pattern"].run(tables)
    few, many = CATALOG["entity-relations"].run(tables), CATALOG["entity-relations"].run(tables, min_calls="1", other="ignored")
    assert few.count() < many.count()


def test_changed_files(spark, files):
    known = files.select("path", F.sha2("text", 256).alias("sha"))
    assert changed(files, known).count() == 0
    assert changed(files.withColumn("text", F.concat("text", F.lit("x"))), known).count() == files.count()


# ---------------------------------------------------------------- algorithms
def edge_frame(spark, pairs):
    return spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")


def test_reach_and_paths(spark):
    e = edge_frame(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (5, 4)])
    start = spark.createDataFrame([("1",)], "id string")
    assert {(r.id, r.depth) for r in analytics.reach(e, start, 5).collect()} == {("1", 0), ("2", 1), ("3", 2), ("4", 3)}
    assert [r.id for r in analytics.shortest_path(e, "1", "5").collect()] == ["1", "3", "4", "5"]
    assert analytics.shortest_path(e, "1", "99").collect() == []


def test_communities(spark):
    e = edge_frame(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")])
    labels = {r.id: r.label for r in analytics.label_propagation(e).collect()}
    assert labels["a"] == labels["b"] == labels["c"] != labels["x"] == labels["y"] == labels["z"]
    rows = {r.label: r for r in analytics.community_report(spark.createDataFrame(list(labels.items()), "id string, label string"), e).collect()}
    assert all(r.members == 3 and r.inner_edges == 3 and r.density == 1.0 for r in rows.values())
    assert analytics.label_propagation(edge_frame(spark, [])).collect() == []


def test_similar_reads_whole_documents_and_sections(spark):
    from quillgraph.operators import concepts

    long = "filler words " * 30 + "zebra\n# Okapi herd\nsavanna text"
    t = {
        "documents": spark.createDataFrame([(1, long), (2, "short note"), (3, None)], "doc_id long, text string"),
        "Doc": spark.createDataFrame([("a", "a.md", 1, long[:120]), ("b", "b.md", 2, "On chunking"), ("c", "c.md", 3, None)], "id string, path string, dkey long, summary string"),
    }
    found = lambda q: [(r.corpus, r.id) for r in concepts.similar(t, q, ("doc", "section")).collect()]
    assert found("zebra") == [("doc", "a")] and found("chunking") == [("doc", "b")]
    assert sorted(found("savanna")) == [("doc", "a"), ("section", "a.md#okapi-herd")]
    assert {r.id: r.text for r in concepts.corpus(t, "doc").collect()} == {"a": long, "b": "short note On chunking", "c": ""}


def test_bm25_counts_repeated_words(spark):
    d = spark.createDataFrame([("a", "cat dog"), ("b", "cat cat"), ("c", "fish")], "id string, text string")
    once = {r.id: r.score for r in analytics.bm25(d, "cat").collect()}
    twice = {r.id: r.score for r in analytics.bm25(d, "cat cat").collect()}
    assert once["b"] > once["a"] > 0 and "c" not in once and twice["a"] == pytest.approx(2 * once["a"], abs=2e-6)
    assert analytics.bm25(d, "the of").collect() == []
    assert analytics.confidence(analytics.bm25(d, "cat")).first().confidence == "low"


def test_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "id int, embedding array<float>")
    assert [(r.id, r.score) for r in analytics.cosine_top(v, [1.0, 0.0], 3).collect()] == [(1, 1.0), (2, 0.707107), (3, 0.0)]


def test_method_of_and_test_for(spark):
    f = spark.createDataFrame([("m/A#run().", "m.py"), ("m/A#B#go().", "m.py"), ("m/free().", "m.py"), ("t/test_free().", "tests/t.py")], "symbol string, file string")
    t = spark.createDataFrame([("m/A#",), ("m/A#B#",)], "symbol string")
    assert {(r.src, r.dst) for r in analytics.method_of(f, t).collect()} == {("m/A#run().", "m/A#"), ("m/A#B#go().", "m/A#B#")}
    assert [tuple(r) for r in analytics.test_for(f).collect()] == [("t/test_free().", "m/free().", "high")]


def test_text_functions(spark):
    df = spark.createDataFrame([("HTTPServerName_v2", "A Big-Title!", "class")], "a string, b string, c string")
    r = df.select(fn.split_identifier(F.col("a")), fn.slugify(F.col("b")), fn.heading_slug(F.col("b")), fn.naive_plural(F.col("c")), fn.depluralise(F.lit("classes")), fn.depluralise(F.lit("entities")), fn.basename(F.lit("a/b.py")), fn.simple_name(F.lit("x/y#go().")), fn.whole_match(F.lit("abc"), "a|abc"), fn.first_line(F.lit("\n one\ntwo"))).first()
    assert tuple(r) == (["http", "server", "name", "v2"], "a-big-title", "a-big-title", "classes", "class", "entity", "b.py", "go", True, "one")


def test_nothing_imports_llm():
    import pathlib

    root = pathlib.Path(registry.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(from|import)\s+\S*llm", p.read_text()), p


def test_mentions_and_unstubbed(spark):
    from quillgraph.operators import concepts

    terms = concepts.term_index(spark.createDataFrame([("user-account", "User Account"), ("order", "order")], "id string, name string"))
    f = spark.createDataFrame([("m/load_order().", "Reads user accounts"), ("m/x().", None)], "symbol string, doc_comment string")
    assert {tuple(r) for r in concepts.mentions(f, terms).collect()} == {("m/load_order().", "user-account", "high"), ("m/load_order().", "order", "low")}
    d = spark.createDataFrame([("1", "Then the Ledger and the Order go"), ("2", "we keep a Ledger here")], "id string, text string")
    assert [(r.term, r.docs) for r in concepts.unstubbed(d, terms).collect()] == [("ledger", 2)]


def test_affinity(spark):
    from quillgraph.operators import concepts

    few = [(i, "rare") for i in "abc"]
    many = [(f"m{i:02d}", "common") for i in range(12)]
    got = {tuple(r) for r in concepts.affinity(spark.createDataFrame(few + many, "id string, word string"), 400).collect()}
    assert {("a", "b"), ("a", "c"), ("b", "c")} <= got and ("m00", "m03") not in got and len(got) == 3 + 11 + 10


def test_louvain(spark):
    from quillgraph.operators import concepts

    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")]
    got = concepts.louvain({p: 1.0 for p in pairs})
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x"}
    assert concepts.louvain({}) == {}
    with pytest.raises(ValueError):
        concepts.louvain_of(edge_frame(spark, pairs), most_edges=3)


def test_ego_graph(spark):
    from quillgraph.operators import concepts

    e = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    r = spark.createDataFrame([("a", "b", "part-of")], "src string, dst string, type string")
    c = spark.createDataFrame([("b", "c"), ("c", "d")], "src string, dst string")
    assert {tuple(x) for x in concepts.ego_graph(e, r, c, "a", 2).collect()} == {("a", "b", "part-of"), ("b", "c", "calls")}


# --------------------------------------------------------------------- tools
def test_code_index(spark):
    from quillgraph.sources import code_index as ci

    d = spark.createDataFrame([("f", "m/outer().", "function", 1, 100), ("f", "m/inner().", "function", 10, 20), ("g", "m/I#run().", "function", 1, 5), ("g", "m/A#run().", "function", 6, 9), ("g", "m/I#", "trait", 1, 9), ("g", "m/A#", "struct", 1, 9), ("g", "m/J#", "trait", 1, 2)], "file string, symbol string, kind string, begin_line int, end_line int")
    o = spark.createDataFrame([("f", "m/I#run().", 12, "reference"), ("f", "m/I#run().", 50, "reference"), ("f", "m/outer().", 50, "reference"), ("f", "m/A#", 15, "reference"), ("f", "m/A#", 13, "reference"), ("f", "m/A#name.", 13, "reference"), ("f", "m/A#run().", 1, "import"), ("f", "m/I#", 200, "reference")], "file string, symbol string, line int, role string")
    r = spark.createDataFrame([("m/A#run().", "m/I#run()."), ("m/A#", "m/I#"), ("m/J#", "m/I#"), ("m/A#", "m/A#"), ("m/A#", "ext/X#")], "src string, dst string")
    assert sorted(tuple(x) for x in ci.calls(d, o, r).collect()) == [("m/inner().", "m/A#run().", "f", 12, 1), ("m/inner().", "m/I#run().", "f", 12, 0), ("m/outer().", "m/A#run().", "f", 50, 1), ("m/outer().", "m/I#run().", "f", 50, 0)]
    assert [tuple(x) for x in ci.uses_type(d, o).collect()] == [("m/inner().", "m/A#", "f", 13)]
    assert [tuple(x) for x in ci.field_references(d, o).collect()] == [("m/inner().", "m/A#name.", "f", 13)]
    assert {tuple(x) for x in ci.type_relations(d, r).collect()} == {("m/A#", "m/I#", "implements"), ("m/J#", "m/I#", "extends"), ("m/A#", "ext/X#", "implements")}
    assert [tuple(x) for x in ci.imports(d, o).collect()] == [("f", "g", 1)]


def test_tools(spark, tables, tmp_path):
    from quillgraph.operators import tools

    names = tools.available(tables)
    assert "hub-functions" in names and set(names) <= set(CATALOG)
    with pytest.raises(KeyError, match="hub-functions"):
        tools.saved("hub-function")
    (tmp_path / "a.toml").write_text('name = "big"\nparams = ["least=2", "kind"]\nsql = "SELECT id FROM People WHERE k >= CAST($least AS INT) AND kind = $kind"\n')
    (tmp_path / "b.toml").write_text("name = ")
    loaded = tools.load_queries(str(tmp_path))
    people = {"People": spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 3, "y")], "id string, k int, kind string")}
    assert list(loaded) == ["big"] and [r.id for r in tools.run_loaded(spark, people, loaded["big"], kind="x").collect()] == ["b"]
    with pytest.raises(ValueError, match="kind"):
        tools.run_loaded(spark, people, loaded["big"])
    got = tools.page(people["People"], [F.col("id")], 1, 1).collect()
    assert [(r.id, r.total) for r in got] == [("b", 3)]


def test_handlers_and_endpoint_rows(spark):
    from quillgraph.operators import tools

    f = spark.createDataFrame([("a/x/one().", "a/x.py", 1), ("a/y/two().", "a/y.py", 5), ("a/z/two().", "a/z.py", 5), ("a/w/go().", "a/w.py", 3), ("a/w/B#go().", "a/w.py", 9), ("b/q/go().", "b/q.py", 1), ("b/v/solo().", "b/v.py", 1), ("c/v/solo().", "c/v.py", 1)], "symbol string, file string, line int")
    e = spark.createDataFrame([("1", "flask", "one", "z.py", 1), ("2", "flask", "two", "a/z.py", 1), ("3", "jaxrs", "go", "a/w.py", 4), ("4", "flask", "go", "a/w.py", 4), ("5", "flask", "solo", "b/k.py", 1), ("6", "flask", "none", "b/k.py", 1), ("7", "flask", "two", "a/k.py", 1)], "id string, kind string, handler string, source_file string, source_line int")
    assert {r.id: r.symbol for r in tools.handlers(e, f).collect()} == {"1": "a/x/one().", "2": "a/z/two().", "3": "a/w/B#go().", "5": "b/v/solo()."}
    c = spark.createDataFrame([("a.rs", 3, " @endpoint get /x"), ("a.rs", 9, "nothing")], "file string, line int, text string")
    marked = tools.endpoint_markers(c)
    found = spark.createDataFrame([("fastapi:GET:/x", "fastapi", "GET", "/x", "b.py", 1), ("flask:GET:/y", "flask", "GET", "/y", "b.py", 2), ("flask:GET:/y", "flask", "GET", "/y", "c.py", 2), ("flask:GET:/z", "flask", "GET", "/z", "c.py", 3)], "id string, kind string, method string, path string, source_file string, source_line int")
    assert sorted((r.id, r.source_file) for r in tools.merge_endpoints(marked, found, exempt=("flask:GET:/z",)).collect()) == [("flask:GET:/y", "b.py"), ("marker:GET:/x", "a.rs")]


def test_files_and_texts(spark):
    from quillgraph.operators import tools

    d = spark.createDataFrame([("b", "docs/b.md", None, "x " * 300 + "needle " + "y " * 300), ("a", "docs/sub/a.md", "internal", "short"), ("c", "src/c.md", "public", None)], "id string, path string, visibility string, text string")
    assert [r.json[:9] for r in tools.sitemap(d.select("id", "visibility")).collect()] == ['{"id":"a"', '{"id":"b"', '{"id":"c"']
    assert [r.id for r in tools.export(d).orderBy("id").collect()] == ["b", "c"] and [r.id for r in tools.export(d, include=("docs/*.md",)).collect()] == ["b"]
    got = {r.id: r.s for r in d.select("id", tools.snippet(F.col("text"), ["none", "needle"], 60).alias("s")).collect()}
    assert "needle" in got["b"] and got["b"][0] == got["b"][-1] == "…" and len(got["b"]) == 62 and got["a"] == "short" and got["c"] == ""
    m = spark.createDataFrame([("core", ["docs/**"]), ("code", ["src/*.md", "lib/?.rs"])], "module string, globs array<string>")
    assert {(r.path, r.module) for r in tools.modules_by_glob(d, m).collect()} == {("docs/b.md", "core"), ("docs/sub/a.md", "core"), ("src/c.md", "code")}
    log = spark.createDataFrame([("x", 3), ("x", 9), ("y", 1)], "file string, at int")
    assert {tuple(r) for r in tools.git_dates(log).collect()} == {("x", 9), ("y", 1)}


def test_unauthored_clusters(spark):
    report = spark.createDataFrame([("l1", 9, 0.5), ("l2", 7, 0.4), ("l3", 2, 0.9), ("l4", 8, 0.01)], "label string, members long, density double")
    names = spark.createDataFrame([("l1", "Known Thing"), ("l2", "New Thing"), ("l3", "x"), ("l4", "y")], "label string, name string")
    assert [(r.code, r.subject) for r in lint.unauthored_clusters(report, names, spark.createDataFrame([("known-thing",)], "id string")).collect()] == [("unauthored-cluster", "new-thing")]


def test_orphans_and_duplicates(spark, tables):
    """The two rules that the projection cannot break."""
    none = {n: spark.createDataFrame([], tables[n].schema) for n in PROJECTION}
    doc = tables["Doc"].limit(1).collect()[0]
    twice = {**none, "Doc": spark.createDataFrame([doc, doc], tables["Doc"].schema), "doc_front": spark.createDataFrame([r for r in tables["doc_front"].where(F.col("id") == doc.id).collect()], tables["doc_front"].schema)}
    found = {r.code for r in lint.issues(twice).collect()}
    assert {"duplicate-id", "orphan-doc"} <= found
