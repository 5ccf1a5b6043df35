"""Calls by keys against the projection's SQL, on awkward rows."""

import duckdb
import pytest

from quillgraph.operators import analytics, communities, concepts, contexts
from quillgraph.operators.catalog import CATALOG
from quillgraph.sources import call_edges
from quillgraph.sources.driver_tables import PROJECTION, RAW, GraphTables

COUNTED = ("hub-functions-by-caller-breadth", "hub-spread-distribution", "function-hub-files", "function-shape-distribution", "function-shape-by-file", "functions-of-shape", "file-shape-profile", "per-file-cohesion-by-path-prefix-asc", "template-directory-survey", "leaf-with-deps-files")


class AsSql(GraphTables):
    """The projection's SQL as it stands, run by Spark: an engine's own rule for nulls in concat is no difference here."""

    def __getitem__(self, name):
        if name not in self.made:
            self.made[name] = self.from_sql(PROJECTION[name], name) if name in PROJECTION else super().__getitem__(name) if name in RAW else {}[name]
        return self.made[name]


def same(a, b):
    assert a.columns == b.columns and [f.dataType for f in a.schema] == [f.dataType for f in b.schema]
    rows = [sorted(map(str, x.collect())) for x in (a, b)]
    assert rows[0] == rows[1]
    return len(rows[0])


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """sf0.001 with repeated, null and homeless functions, lines without an order, and repeated orders."""
    d = str(tmp_path_factory.mktemp("odd"))
    c = duckdb.connect()
    change = {
        "customer": "SELECT * FROM t UNION ALL SELECT * FROM t WHERE c_custkey < 40 UNION ALL SELECT * REPLACE (c_nationkey + 1 AS c_nationkey) FROM t WHERE c_custkey % 10 = 3 UNION ALL SELECT * REPLACE (NULL AS c_nationkey) FROM t WHERE c_custkey % 9 = 1 UNION ALL SELECT * REPLACE (NULL AS c_custkey) FROM t WHERE c_custkey = 1",
        "supplier": "SELECT * FROM t UNION ALL SELECT * FROM t WHERE s_suppkey % 3 = 0 UNION ALL SELECT * REPLACE (NULL AS s_nationkey) FROM t WHERE s_suppkey = 2",
        "part": "SELECT * FROM t WHERE p_partkey % 7 <> 5 UNION ALL SELECT * FROM t WHERE p_partkey % 5 = 0 UNION ALL SELECT * REPLACE (NULL AS p_brand) FROM t WHERE p_partkey % 8 = 1",
        "orders": "SELECT * FROM t WHERE o_orderkey % 6 <> 1 UNION ALL SELECT * FROM t WHERE o_orderkey % 4 = 0",
        "lineitem": "SELECT * FROM t UNION ALL SELECT * REPLACE (NULL AS l_suppkey) FROM t WHERE l_orderkey % 50 = 0",
    }
    for r in RAW:
        body = change.get(r, "SELECT * FROM t").replace("FROM t", f"FROM '{sf}/{r}.parquet'")
        c.sql(f"COPY ({body}) TO '{d}/{r}.parquet' (FORMAT parquet)")
    return GraphTables(spark, d), AsSql(spark, d)


@pytest.mark.parametrize("name", ["CALLS", "ENTITY_CALLS", "index_occurrence"])
def test_tables_by_key_are_those_of_the_sql(odd, name):
    tables, plain = odd
    assert same(tables[name], plain[name]) > 50


@pytest.mark.parametrize("name", COUNTED)
def test_counts_by_key_are_those_of_the_sql(odd, name):
    tables, plain = odd
    same(CATALOG[name].example(tables), CATALOG[name].example(plain))


def test_entity_calls_by_key(odd):
    tables, plain = odd
    assert same(analytics.derive_entity_calls(tables), analytics.derive_entity_calls(plain)) > 10


def test_texts_of_keys(odd):
    tables, _ = odd
    known = tables["Function"].where("symbol IS NOT NULL").select("symbol").distinct()
    made = call_edges.ends(tables)
    assert made.count() == known.count() and not made.join(known, "symbol", "left_anti").count()


def test_counts_move_no_texts(odd):
    """The calls are joined and made distinct by keys: no join or distinct of theirs holds a symbol."""
    tables, _ = odd
    plan = CATALOG["hub-spread-distribution"].example(tables)._jdf.queryExecution().optimizedPlan().toString()
    held = [x for x in plan.splitlines() if "Join" in x or "Aggregate" in x]
    assert held and not any("symbol" in x for x in held)


def test_pairs_with_tags_are_few(odd):
    """Tags are compared for linked documents only; no join pairs all documents of a tag."""
    tables, plain = odd
    plan = CATALOG["research-pairs-without-shared-family-tag"].plan()
    quick = plan.spark(tables)
    plan.fast = None
    assert same(quick, plan.spark(plain)) > 10
    text = quick._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join Inner" in x and x.count("value#") == 2 and x.count("=") == 1 for x in text.splitlines())


def _sides(df):
    """Distincts and groupings that hold the homes of both ends of a call."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.splitlines() if "Aggregate" in x and "src_home" in x and "dst_home" in x], plan


def test_calls_of_entities_are_made_distinct_by_raw_keys(odd):
    tables, _ = odd
    wide, plan = _sides(tables["ENTITY_CALLS"])
    assert not wide and "RepartitionByExpression [" in plan


def test_counts_of_callers_are_of_raw_keys(odd):
    tables, _ = odd
    for name in ("function-hub-files", "hub-spread-distribution", "hub-functions-by-caller-breadth", "function-shape-by-file", "functions-of-shape"):
        wide, plan = _sides(CATALOG[name].example(tables))
        assert not wide and "RepartitionByExpression [" in plan, name


def test_calls_of_files_under_a_path_are_of_kinds_that_it_can_hold(odd):
    tables, plain = odd
    wide, plan = _sides(CATALOG["template-directory-survey"].example(tables))
    assert not wide and not any("l_partkey" in x for x in plan.splitlines() if "Relation [" not in x)
    assert [call_edges.ends_under(x) for x in ("backend/app", "frontend/", "lib/brand11", "src/supply/n4.rs", "b", "", "zz")] == ["call_ends_c", "call_ends_p", "call_ends_p", "call_ends_s", "call_ends_c", "call_ends", "call_ends"]
    for prefix in ("frontend/", "lib/", "src/", "", "backend/tests/"):
        q = CATALOG["template-directory-survey"]
        same(q.run(tables, path_prefix=prefix), q.run(plain, path_prefix=prefix))


@pytest.mark.parametrize("query", [concepts.entity_ego_graph, contexts.entity_ego_edges, communities.entity_communities_ordered])
def test_queries_of_entity_calls_are_those_of_the_sql(odd, query):
    tables, plain = odd
    assert same(query(tables), query(plain)) > 0


def test_queries_of_entity_calls_move_them_once(odd, monkeypatch):
    """The calls are written once, by raw keys, and all that follows reads them."""
    tables, _ = odd
    for module, query in ((concepts, concepts.entity_ego_graph), (communities, communities.entity_communities_ordered)):
        plans, held = [], module.held
        monkeypatch.setattr(module, "held", lambda df, plans=plans, held=held: (plans.append(_sides(df)), held(df))[1])
        _, after = _sides(query(tables))
        raw = [x for x in plans if "l_partkey" in x[1]]
        assert len(raw) == 1 and not raw[0][0] and "RepartitionByExpression [" in raw[0][1] and "l_partkey" not in after


def test_lines_of_parts_are_moved_once_when_suppliers_are_many(spark, odd):
    """Without a broadcast, as where suppliers are many, lines are not moved again for what is said of their supplier."""
    tables, _ = odd
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made = call_edges.between(tables, tables["FUNCTION_BELONGS_TO"], tables["FUNCTION_MENTIONS"], ("sp",))
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(cell#" in plan and "SortMergeJoin [a#" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
