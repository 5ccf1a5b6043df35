"""Diagnostics of the whole corpus: counts, shares, shapes and freshness."""

from __future__ import annotations

from ...plans.relation import rel
from .base import META_ROLES, AXIS_ROLES, STARTER_ROLES, all_of, any_of, clustered, cols, count_if, counted, define, density, dotted, ends, has, ladder, lacks, one_of, ratio, side_by_side, starter, starts

DIAG = "corpus-diagnostics"


def totals(*parts: tuple, out: dict[str, str], **rest):
    """Counts (source, where, what) side by side as c0.n, c1.n, ..."""
    made = [counted(p[0], where=p[1] if len(p) > 1 else None, name="n", what=p[2] if len(p) > 2 else "count(*)") for p in parts]
    return side_by_side(*made, out=out, **rest)


FN, FILE, DOC, ENTITY, COUPLED, ENDPOINT = ("Function f",), ("File f",), ("Doc d",), ("Entity e",), ("COUPLED_WITH c",), ("Endpoint e",)
NARRATIVE = ("Doc d", f"NOT {one_of('d.role', AXIS_ROLES)}")
META = ("Doc d", one_of("d.role", STARTER_ROLES))


def n(k: int) -> str:
    return f"c{k}.n"


INGEST = ladder((f"{n(0)} > 0", "full-scip"), (f"{n(1)} > 0", "file-only-no-scip"), (f"{n(2)} > 0", "doc-only-by-design"), default="empty")


def regime(x: str) -> str:
    return ladder((f"{x} = 0", "doc-empty-ontology-only"), (f"{x} < 10", "doc-sparse"), (f"{x} >= 50", "doc-rich"), default="mixed")


def purpose(meta: str, total: str) -> str:
    return ladder((f"{total} = 0", "EMPTY"), (f"({meta} * 100) div {total} >= 90", "ADOPTION-BRANCH"), (f"({meta} * 100) div {total} <= 30", "CONTENT-RICH"), default="MIXED")


define(DIAG, "corpus-ingest-state-classifier", "what was ingested", lambda p: totals(FN, FILE, DOC, COUPLED, ENDPOINT, out={"fn_count": n(0), "file_count": n(1), "doc_count": n(2), "coupled_with_count": n(3), "endpoint_count": n(4), "ingest_state": INGEST}))
define(DIAG, "cold-start-overview", "counts and labels to start from", lambda p: totals(
    FN, FILE, DOC, COUPLED, ENDPOINT, NARRATIVE,
    out={"fn_count": n(0), "file_count": n(1), "doc_count": n(2), "narrative_doc_count": n(5), "coupled_with_count": n(3), "endpoint_count": n(4), "ingest_state": INGEST, "doc_axis_regime": regime(n(5)),
         "coupling_axis": ladder((f"{n(3)} > 50", "coupling-rich"), (f"{n(3)} > 0", "coupling-sparse"), default="coupling-empty")},
))

# Routes and the queries recommended for each.
ROUTES = (
    ("c2.n >= 50 AND c0.n >= 100", "doc-rich-function-rich", "query_similar (doc + function axes) + research-by-tag + audit_doc_region"),
    ("c2.n >= 50", "doc-rich-function-sparse", "query_similar (doc axis) + research-by-tag + audits-by-tag"),
    ("c3.n > 0 AND c1.n >= 50", "doc-sparse-coupling-rich", "file-coupling-degree + coupled-files + import-fan-out + language-loc-distribution"),
    ("c0.n >= 100 AND c1.n >= 50", "doc-sparse-coupling-empty-function-rich", "language-loc-distribution + query_similar type=function + functions-of-shape + callgraph-roots"),
    ("c1.n >= 50", "doc-sparse-coupling-empty-function-sparse", "language-loc-distribution + language-distribution + import-fan-out"),
)
NO_ROUTE = ("unknown-empty-or-partial", "corpus appears empty or partial — check schema; run the corpus check before retrying")
define(DIAG, "corpus-routing-recommendation", "which queries to try first", lambda p: totals(
    FN, FILE, NARRATIVE, COUPLED,
    out={"fn_count": n(0), "file_count": n(1), "narrative_doc_count": n(2), "coupled_with_count": n(3), "route": ladder(*((c, r) for c, r, _ in ROUTES), default=NO_ROUTE[0]), "recommended_primitives": ladder(*((c, t) for c, _, t in ROUTES), default=NO_ROUTE[1])},
))
PASSES = (("file_walker", FILE), ("scip", FN), ("git_coupling", COUPLED), ("endpoint_extract", ENDPOINT))


def _pass(name: str, part: tuple, **rest):
    return rel(counted(*part, name="n"), out={"pass_name": f"'{name}'", "row_count": "n", "populated": "CASE WHEN n > 0 THEN 1 ELSE 0 END"}, **rest)


define(DIAG, "ingest-pass-status", "rows of each ingest pass", lambda p: _pass(*PASSES[0], union=[_pass(*x) for x in PASSES[1:]], order=["pass_name"]))
define(DIAG, "corpus-shape-classifier", "ontology against narrative documents", lambda p: totals(DOC, ("Doc d", one_of("d.role", AXIS_ROLES)), out={"total_docs": n(0), "ontology_docs": n(1), "narrative_docs": f"{n(0)} - {n(1)}", "regime": regime(f"({n(0)} - {n(1)})")}))
define(DIAG, "narrative-doc-count", "documents outside the ontology roles", lambda p: counted(*NARRATIVE[:1], where=NARRATIVE[1], name="narrative_doc_count"))
define(DIAG, "corpus-axis-saturation", "shares of filled columns", lambda p: totals(
    DOC, ("Doc d", "d.summary IS NOT NULL AND d.summary <> ''"), FILE, ("File f", "f.language IS NOT NULL AND f.language <> ''"), FN, ("Function f", "f.signature IS NOT NULL AND f.signature <> ''"),
    out={"doc_count": n(0), "docs_with_summary": n(1), "file_count": n(2), "files_with_language": n(3), "function_count": n(4), "functions_with_signature": n(5),
         "docs_summary_fraction": ratio(n(1), n(0)), "files_language_fraction": ratio(n(3), n(2)), "functions_signature_fraction": ratio(n(5), n(4))},
))
define(DIAG, "corpus-update-span", "oldest and newest document", lambda p: rel("Doc d", where="d.updated IS NOT NULL", agg={"oldest_doc": "min(d.updated)", "newest_doc": "max(d.updated)", "doc_count": "count(*)"}))
define(DIAG, "corpus-top-entities-by-mention", "most mentioned entities", lambda p: rel("Entity e", out=cols("e", "entity_id=id mention_count"), order=["-mention_count", "entity_id"], limit=15))
define(DIAG, "corpus-top-doc-tags", "most used tags", lambda p: rel("doc_tags t", by={"tag": "t.value"}, agg={"frequency": "count(*)"}, order=["-frequency", "tag"], limit=15))
define(DIAG, "corpus-tag-axis-shape", "how rich the tags are", lambda p: rel(
    rel("doc_tags t", by={"tag": "t.value"}, agg={"f": "count(*)"}), agg={"k": "count(tag)", "uses": "coalesce(sum(f), 0)", "most": "max(f)"},
    out={"distinct_tag_count": "k", "total_tag_mentions": "CAST(uses AS BIGINT)", "max_tag_frequency": "most", "tag_axis_shape": ladder(("k <= 5", "tag-axis-empty"), ("k <= 30", "tag-axis-thin"), default="tag-axis-rich")},
))
define(DIAG, "corpus-entity-promotion-state", "cluster-derived against promoted entities", lambda p: rel(
    "Entity e", agg={"total": "count(*)", "derived": count_if(clustered("e"))},
    out={"total_entities": "total", "cluster_derived_count": "CAST(derived AS BIGINT)", "promoted_count": "CAST(total - derived AS BIGINT)",
         "promotion_state_label": ladder(("total = 0", "no-entities"), ("derived = 0", "fully-promoted"), ("derived = total", "fully-cluster-derived"), ("derived > total - derived", "mostly-cluster-derived"), default="mostly-promoted")},
))
define(DIAG, "corpus-calls-coverage-ratio", "functions that something calls", lambda p: side_by_side(
    counted("Function f", name="n"), counted("CALLS r", ("semi", "Function a", "a.symbol = r.src"), ("semi", "Function b", "b.symbol = r.dst"), name="n", what="count(DISTINCT r.dst)"),
    out={"total_functions": n(0), "functions_with_inbound_calls": n(1), "coverage_percent": ratio(n(1), n(0), "100")},
))
define(DIAG, "corpus-purpose-classifier", "share of ontology documents", lambda p: totals(DOC, META, out={"total_docs": n(0), "ontology_meta_docs": n(1), "ontology_ratio_percent": ratio(n(1), n(0), "100"), "corpus_purpose": purpose(n(1), n(0))}))
define(DIAG, "corpus-cold-start-summary", "four counts and the purpose", lambda p: totals(DOC, META, ENTITY, FN, FILE, out={"total_docs": n(0), "total_entities": n(2), "total_functions": n(3), "total_files": n(4), "corpus_purpose": purpose(n(1), n(0))}))
define(DIAG, "corpus-entity-shape-summary", "entities by kind of description", lambda p: rel(
    "Entity e", agg={"total": "count(*)", "derived": count_if(clustered("e")), "promoted": count_if(f"NOT {clustered('e')} AND e.description IS NOT NULL AND e.description <> ''"), "fact": count_if(all_of(clustered("e"), density("e", 0))), "mid": count_if(all_of(clustered("e"), density("e", 1)))},
    out={"total_entities": "total", "cluster_derived": "CAST(derived AS BIGINT)", "promoted": "CAST(promoted AS BIGINT)", "fact_entities": "CAST(fact AS BIGINT)", "mid_entities": "CAST(mid AS BIGINT)", "pattern_entities_likely": "CAST(derived - fact - mid AS BIGINT)"},
))
define(DIAG, "corpus-entities-per-doc-ratio", "entities for each document", lambda p: totals(DOC, ENTITY, out={"total_docs": n(0), "total_entities": n(1), "entities_per_doc_ratio": ratio(n(1), n(0))}))
define(DIAG, "corpus-functions-per-file-ratio", "functions for each file", lambda p: totals(FN, FILE, out={"total_functions": n(0), "total_files": n(1), "functions_per_file_ratio": ratio(n(0), n(1))}))
define(DIAG, "corpus-doc-coverage-ratio", "documents for each file", lambda p: totals(DOC, FILE, out={"total_docs": n(0), "total_files": n(1), "docs_per_file_ratio": ratio(n(0), n(1))}))
define(DIAG, "corpus-entity-axis-shape", "how rich the entities are", lambda p: rel(
    "Entity e", agg={"k": "count(e.id)", "most": "max(e.mention_count)", "uses": "sum(e.mention_count)"},
    out={"total_entity_count": "k", "max_mention_count": "most", "total_mentions": "CAST(uses AS BIGINT)", "entity_axis_shape": ladder(("k <= 10", "entity-axis-empty"), ("k <= 50", "entity-axis-sparse"), default="entity-axis-rich")},
))
define(DIAG, "function-count-by-language", "functions by language", lambda p: rel("Function f", by={"language": "f.language"}, agg={"count": "count(f.symbol)"}, order=["-count", "language"]))
define(DIAG, "function-signature-population-by-language", "functions with a signature by language", lambda p: rel(
    "Function f", by={"language": "f.language"}, agg={"k": "count(f.symbol)", "filled": count_if("f.signature IS NOT NULL AND f.signature <> ''")},
    out={"language": "language", "function_count": "k", "populated_signatures": "CAST(filled AS BIGINT)", "percent_populated": "CAST((100 * filled) div k AS BIGINT)"}, order=["-function_count", "language"],
))
define(DIAG, "function-mentions-by-language", "mentions by language of the function", lambda p: rel("Function f", ("FUNCTION_MENTIONS r", "r.src = f.symbol"), ("semi", "Entity e", "e.id = r.dst"), by={"language": "f.language"}, agg={"mention_count": "count(*)"}, order=["-mention_count", "language"]))
CYTHON = all_of(ends("f.path", ".pyx", ".pxd"), lacks("f.path", "tests/"))
define(DIAG, "corpus-workflow-viability-classifier", "whether the documents carry an architecture workflow", lambda p: totals(("Doc d", "d.role = 'doc'"), ("File f", CYTHON), out={"narrative_doc_count": n(0), "cython_file_count": n(1), "viability_label": ladder((f"{n(0)} >= 10", "architecture-viable"), (f"{n(1)} > 0", "cython-blocked"), default="pure-python-narrative-sparse")}))
define(DIAG, "file-language-distribution", "files outside tests by language", lambda p: rel("File f", where=lacks("f.path", "tests/"), by={"language": "f.language"}, agg={"file_count": "count(f.path)"}, order=["-file_count", "language"], limit=25))
define(DIAG, "language-distribution", "files by language", lambda p: rel("File f", by={"f.language": "f.language"}, agg={"count": "count(f.path)"}, order=["-count", "f.language"]))
define(DIAG, "type-distribution", "types by kind", lambda p: rel("Type t", by={"t.kind": "t.kind"}, agg={"count": "count(t.symbol)"}, order=["-count", "t.kind"]))
define(DIAG, "language-loc-distribution", "lines of code by language", lambda p: rel("File f", where="f.loc IS NOT NULL AND f.loc > 0", by={"language": "f.language"}, agg={"file_count": "count(f.path)", "total_loc": "CAST(sum(f.loc) AS BIGINT)", "avg_loc": "CAST(sum(f.loc) AS DOUBLE) / count(f.loc)", "max_loc": "max(f.loc)"}, order=["-total_loc", "language"]))
define(DIAG, "imports-edge-count-by-language", "imports by language of the importer", lambda p: rel("IMPORTS r", ("File a", "a.path = r.src"), ("semi", "File b", "b.path = r.dst"), by={"language": "a.language"}, agg={"imports_count": "count(*)"}, order=["-imports_count", "language"]))
define(DIAG, "doc-role-distribution", "documents by role", lambda p: rel("Doc d", by={"role": "d.role"}, agg={"doc_count": "count(d.id)"}, order=["-doc_count", "role"], limit=25))
define(DIAG, "corpus-doc-starter-ratio", "starter against authored documents", lambda p: rel(
    "Doc d", agg={"s": count_if(starter("d")), "k": "count(*)"},
    out={"starter_count": "CAST(s AS BIGINT)", "authored_count": "CAST(k - s AS BIGINT)", "total_count": "k", "starter_ratio": ratio("s", "k"),
         "shape_label": ladder(("k = 0", "doc-empty"), ("s = k", "doc-null"), ("CAST(s AS DOUBLE) / k >= 0.8", "mostly-starter"), ("CAST(s AS DOUBLE) / k >= 0.3", "authored-mixed"), default="mostly-authored")},
))
AUTHORED = f"NOT {starter('d')}"
define(DIAG, "authored-docs-sample", "newest authored documents", lambda p: rel("Doc d", where=AUTHORED, out=cols("d", "id role title summary updated"), order=["-updated", "id"], limit=10))
define(DIAG, "authored-docs-by-kind", "newest authored documents of a kind", lambda p: rel("Doc d", where=all_of(f"d.kind = {p.kind}", AUTHORED), out=cols("d", "id role title summary updated"), order=["-updated", "id"], limit=10), kind="how-to")
for _plural, _col in (("roles", "role"), ("kinds", "kind"), ("lifecycles", "lifecycle")):
    _shown = "d.role" if _col == "role" else f"CASE WHEN d.{_col} = '' THEN '{_col}-unset' ELSE d.{_col} END"
    define(DIAG, f"corpus-narrative-doc-{_plural}-distribution", f"authored documents by {_col}", lambda p, c=_col, e=_shown: rel("Doc d", where=AUTHORED, by={c: e}, agg={"narrative_doc_count": "count(d.id)"}, order=["-narrative_doc_count", c], limit=20))


def shortlist(name: str, about: str, where: str, shown: str, order: list[str], limit: int | None) -> None:
    define(DIAG, name, about, lambda p: rel("Doc d", where=where, out=cols("d", shown), order=order, limit=limit))


shortlist("non-ontology-docs", "documents outside the starter roles", f"NOT {one_of('d.role', STARTER_ROLES)}", "doc_id=id role kind title summary", ["kind", "role", "doc_id"], 30)
shortlist("onboarding-doc-shortlist", "documents to begin with", "d.role = 'doc' AND d.kind IN ('explanation', 'how-to', 'tutorial')", "doc_id=id kind title summary", ["kind", "doc_id"], 20)
shortlist("session-context-docs", "notes between sessions", has("d.id", "session", "handoff", "next-", "resume"), "doc_id=id kind title summary", ["doc_id"], 20)
shortlist("ontology-doc-shortlist", "documents of the ontology", one_of("d.role", AXIS_ROLES), "doc_id=id role title summary", ["role", "doc_id"], 50)
shortlist("narrative-doc-list", "narrative documents", "d.role = 'doc'", "doc_id=id kind title summary", ["kind", "doc_id"], 50)
HELPERS = (("Function f", all_of(has("f.symbol", "test_"), has("f.symbol", "/_"), lacks("f.symbol", "#__")), "count(DISTINCT f.symbol)"), ("Function f", all_of(has("f.symbol", "test_"), has("f.symbol", "#__"), lacks("f.symbol", "tests.test_")), "count(DISTINCT f.symbol)"))
TEST_FILES, TEST_FNS = ("File f", has("f.path", "test_"), "count(DISTINCT f.path)"), ("Function f", has("f.symbol", "test_"), "count(DISTINCT f.symbol)")


def idiom(module: str, inner: str) -> str:
    return ladder((f"{module} = 0 AND {inner} = 0", "EMPTY"), (f"{inner} = 0", "APP-MODULE-ONLY"), (f"{module} = 0", "INNER-CLASS-ONLY"), default="FRAMEWORK-MIXED")


define("entity-axis", "unified-corpus-diagnostic", "all counts with purpose and idiom", lambda p: totals(
    DOC, META, ENTITY, FN, FILE, TEST_FILES, TEST_FNS, *HELPERS,
    out={"total_docs": n(0), "total_entities": n(2), "total_functions": n(3), "total_files": n(4), "total_test_files": n(5), "total_test_functions": n(6), "module_helper_count": n(7), "inner_class_helper_count": n(8), "corpus_purpose": purpose(n(1), n(0)), "test_fixture_idiom": idiom(n(7), n(8))},
))
define("test-surface", "test-fixture-idiom-classifier", "how test helpers are written", lambda p: totals(*HELPERS, out={"module_helper_count": n(0), "inner_class_helper_count": n(1), "test_fixture_idiom": idiom(n(0), n(1))}))
define("test-surface", "corpus-test-shape-summary", "counts of the tests", lambda p: totals(
    TEST_FILES, TEST_FNS, *HELPERS, ("Entity e", starts("e.id", "test-")),
    out={"total_test_files": n(0), "total_test_functions": n(1), "module_helper_count": n(2), "inner_class_helper_count": n(3), "test_entity_count": n(4), "test_fixture_idiom": idiom(n(2), n(3))},
))
define("test-surface", "corpus-test-coverage-ratio", "share of test functions", lambda p: totals(FN, TEST_FNS, out={"total_functions": n(0), "test_function_count": n(1), "test_function_pct": ratio(n(1), n(0), "100")}))
FRESH = f"d.updated IS NOT NULL AND NOT {one_of('d.role', STARTER_ROLES)}"
define(DIAG, "stale-narrative-docs", "narrative documents untouched for longest", lambda p: rel("Doc d", where=FRESH, out=cols("d", "id role kind updated title"), order=["updated", "id"], limit=20))
define(DIAG, "freshness-by-kind", "update span by kind", lambda p: rel("Doc d", where=f"{FRESH} AND d.kind IS NOT NULL AND d.kind <> ''", by={"kind": "d.kind"}, agg={"doc_count": "count(d.id)", "oldest_updated": "min(d.updated)", "newest_updated": "max(d.updated)"}, order=["oldest_updated", "kind"]))
define(DIAG, "stale-docs-with-impact", "stale documents with the links into them", lambda p: rel(
    "Doc d", ("left", rel("WIKILINK w", ("semi", "Doc s", "s.id = w.src"), by={"dst": "w.dst"}, agg={"k": "count(*)"}), "i.dst = d.id", "i"), where=f"{FRESH} AND d.kind <> ''",
    out={**cols("d", "id kind updated"), "inbound_count": "coalesce(i.k, 0)", "title": "d.title"}, order=["updated", "inbound_count", "id"], limit=20,
))
assert META_ROLES and any_of and dotted
