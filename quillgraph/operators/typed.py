"""Typed reads: the fixed questions an application asks of the graph.

They are catalogue plans too, under categories of their own, so each has its
SQL.  Frontier searches are in :mod:`.traverse`.
"""

from __future__ import annotations

from ..plans.relation import lit, rel
from .catalog.base import TAG_LIST, all_of, any_of, cols, counted, define, has, ladder, one_of, ratio, side_by_side

READ, TOOL = "typed-read", "query-tool"
DOC_EDGES = ("WIKILINK", "MD_LINK", "DEPENDS_ON", "INFORMED_BY", "SUPERSEDES")
DOC = "id path role kind lifecycle bounded_context title summary status updated phase"
FN = "symbol file line doc_comment language signature"


def edges(kinds=DOC_EDGES, extra=()):
    """(src, dst, line, edge_type) of several edge tables."""
    made = [rel(f"{k} r", out={"src": "r.src", "dst": "r.dst", "line": "r.line", "edge_type": lit(k.lower())}) for k in kinds] + list(extra)
    made[0].union = made[1:]
    return made[0]


COVER_LIST = rel("COVERS c", by={"cid": "c.src"}, agg={"covers": "SET(c.dst)"})


def doc_rows(where: str | None = None):
    return rel("Doc d", ("left", TAG_LIST, "l.doc_id = d.id", "l"), ("left", COVER_LIST, "k.cid = d.id", "k"), where=where, out={**cols("d", DOC), "tags": "coalesce(l.tags, '')", "covers": "coalesce(k.covers, '')"}, order=["id"])


define(READ, "list-all-docs", "all documents with their tags and covered entities", lambda p: doc_rows())
define(READ, "get-doc", "one document", lambda p: doc_rows(f"d.id = {p.id}"), id="research-33")
define(READ, "outbound", "what a document links to or covers", lambda p: rel(
    edges(), ("Doc o", "o.id = r.dst"), alias="r", where=f"r.src = {p.id}", out={"id": "o.id", "title": "o.title", "line": "r.line", "edge_type": "r.edge_type"},
    union=[rel("COVERS c", ("Entity e", "e.id = c.dst"), where=f"c.src = {p.id}", out={"id": "concat('entity-', e.id)", "title": "e.display", "line": "c.line", "edge_type": "'covers'"})], order=["id", "edge_type", "line"],
), id="audit-run-48")
define(READ, "inbound", "what links to a document", lambda p: rel(edges(), ("Doc o", "o.id = r.src"), alias="r", where=f"r.dst = {p.id}", out={"id": "o.id", "title": "o.title", "line": "r.line", "edge_type": "r.edge_type"}, order=["id", "edge_type", "line"]), id="audit-run-48")
define(READ, "covers-inbound-for-entity-doc", "documents that cover the entity behind an entity document", lambda p: rel("COVERS c", ("Doc d", "d.id = c.src"), where=f"concat('entity-', c.dst) = {p.id}", out={"id": "d.id", "title": "d.title", "line": "c.line"}, order=["id", "line"]), id="entity-brand-8")
define(READ, "get-entity", "one entity", lambda p: rel("Entity e", where=f"e.id = {p.id}", out=cols("e", "id display description mention_count is_god_node entity_class")), id="brand-8")
define(READ, "top-entities-in-path", "entities by the functions under a path that mention them", lambda p: rel("FUNCTION_MENTIONS m", ("Function f", "f.symbol = m.src"), ("Entity e", "e.id = m.dst"), where=f"startswith(f.file, {p.prefix})", by=cols("e", "id display"), agg={"functions": "count(DISTINCT f.symbol)"}, order=["-functions", "id"], limit=20), prefix="frontend/")
TOUCHED = rel("ENDPOINT_TOUCHES_ENTITY t", by={"eid": "t.src"}, agg={"entities": "SET(t.dst)"})
ENDPOINT = "id kind method path handler_symbol source_file source_line"
define(READ, "list-endpoints", "endpoints of a kind with the entities they touch", lambda p: rel("Endpoint e", ("left", TOUCHED, "t.eid = e.id", "t"), where=f"e.kind = {p.kind}", out={**cols("e", ENDPOINT), "entities": "coalesce(t.entities, '')"}, order=["id"]), kind="flask")
# Kinds of endpoints, all of which are reported.
KINDS = ("axum", "clap", "mcp", "fastapi", "flask", "express", "jaxrs")
REACHING = rel("ENDPOINT_TOUCHES_ENTITY t", ("semi", "Entity n", "n.id = t.dst"), out={"eid": "t.src"}, distinct=True)


def _kind_rows():
    made = [rel("Endpoint e", ("left", REACHING, "t.eid = e.id", "t"), where=f"e.kind = {lit(k)}", agg={"total": "count(e.id)", "reaching": "count(t.eid)"}, out={"kind": lit(k), "total": "total", "reaching": "reaching"}) for k in KINDS]
    made[0].union = made[1:]
    return made[0]


define(READ, "endpoint-reach-by-kind", "endpoints by kind and how many touch an entity; kinds without endpoints count 0", lambda p: _kind_rows())
define(READ, "functions-mentioning", "functions that mention an entity", lambda p: rel("FUNCTION_MENTIONS m", ("Function f", "f.symbol = m.src"), where=f"m.dst = {p.entity}", out=cols("f", FN), distinct=True, order=["symbol"]), entity="brand-8")
define(READ, "function-context", "neighbours of a function by relation", lambda p: rel(
    "FUNCTION_DEFINED_IN r", ("Doc o", "o.id = r.dst"), where=f"r.src = {p.symbol}", out={"relation": "'defined_in'", "id": "o.id", "title": "o.title"},
    union=[rel("FUNCTION_MENTIONS r", ("Entity o", "o.id = r.dst"), where=f"r.src = {p.symbol}", out={"relation": "'mentions'", "id": "o.id", "title": "o.display"}),
           rel("METHOD_OF r", ("Type o", "o.symbol = r.dst"), where=f"r.src = {p.symbol}", out={"relation": "'method_of'", "id": "o.symbol", "title": "o.kind"}),
           rel("USES_TYPE r", ("Type o", "o.symbol = r.dst"), where=f"r.src = {p.symbol}", out={"relation": "'uses_type'", "id": "o.symbol", "title": "o.kind"})], order=["relation", "id"],
), symbol="supply/n4/s77().")
define(READ, "search-functions-by-symbol-substring", "functions whose symbol contains a text", lambda p: rel("Function f", where=has("f.symbol", p.text), out=cols("f", FN), order=["symbol"], limit=50), text="cli")
define(READ, "function-mentions", "entities that a function mentions", lambda p: rel("FUNCTION_MENTIONS m", ("Entity e", "e.id = m.dst"), where=f"m.src = {p.symbol}", out={"id": "e.id", "display": "e.display", "confidence": "m.confidence"}, order=["id"]), symbol="app/cli/n0/c786().")
define(READ, "docs-covering-entities", "documents that cover one of two entities", lambda p: rel("Doc d", ("semi", "COVERS c", f"c.src = d.id AND c.dst IN ({p.a}, {p.b})"), out=cols("d", "id title kind"), order=["id"]), a="brand-8", b="build-economy")
define(READ, "function-siblings", "functions of a file's folder by the entities they share with one", lambda p: rel(
    "FUNCTION_MENTIONS m", ("FUNCTION_MENTIONS o", "o.dst = m.dst AND o.src <> m.src"), ("Function f", "f.symbol = o.src"), where=f"m.src = {p.symbol}", by=cols("f", "symbol file"), agg={"shared": "SET(o.dst)", "shared_count": "count(DISTINCT o.dst)"}, order=["-shared_count", "symbol"], limit=20,
), symbol="app/cli/n0/c786().")
# The last function at or before a line: an as-of lookup by the greatest line.
LAST = lambda p: rel("Function f", where=f"f.file = {p.file} AND f.line <= CAST({p.line} AS INT)", agg={"at": "max(f.line)"})
define(READ, "query-at", "the function at a line, and what it mentions", lambda p: rel(
    "Function f", ("inner", LAST(p), "l.at = f.line", "l"), ("left", rel("FUNCTION_MENTIONS m", by={"fid": "m.src"}, agg={"entities": "SET(m.dst)"}), "m.fid = f.symbol", "m"), ("left", rel("ENDPOINT_HANDLED_BY h", by={"fid": "h.dst"}, agg={"endpoints": "SET(h.src)"}), "h.fid = f.symbol", "h"),
    where=f"f.file = {p.file}", out={"symbol": "f.symbol", "line": "f.line", "entities": "coalesce(m.entities, '')", "endpoints": "coalesce(h.endpoints, '')"}, order=["symbol"],
), file="backend/app/core/n10.py", line="250")
DEAD = ("anti", "CALLS c", "c.dst = f.symbol"), ("anti", "ENDPOINT_HANDLED_BY h", "h.dst = f.symbol")
define(READ, "list-dead-code", "functions that nothing reaches, by owning entity", lambda p: rel("Function f", *DEAD, ("left", "FUNCTION_BELONGS_TO b", "b.src = f.symbol"), where="f.generated = 0", out={**cols("f", "symbol file line"), "entity": "b.dst"}, order=["symbol", "entity"]))
# A function is dark when it has no comment and mentions nothing.
DARK = ("anti", "FUNCTION_MENTIONS m", "m.src = f.symbol")
PUBLIC = all_of("coalesce(f.doc_comment, '') = ''", "f.generated = 0", "NOT contains(f.symbol, '/_')", "NOT contains(f.symbol, '#_')")
define(READ, "list-all-dark-public-functions", "public functions without a word about them", lambda p: rel("Function f", DARK, where=PUBLIC, out=cols("f", "symbol file line"), order=["symbol"]))
define(READ, "list-dark-public-functions", "such functions under a path", lambda p: rel("Function f", DARK, where=all_of(PUBLIC, f"startswith(f.file, {p.scope})"), out=cols("f", "symbol file line"), order=["symbol"]), scope="src/")
define(READ, "list-dark-endpoints", "endpoints that touch no entity", lambda p: rel("Endpoint e", ("anti", "ENDPOINT_TOUCHES_ENTITY t", "t.src = e.id"), out=cols("e", ENDPOINT), order=["id"]))
FUNCS = rel("FUNCTION_MENTIONS m", by={"eid": "m.dst"}, agg={"func_count": "count(DISTINCT m.src)"})
DOCS = rel("COVERS c", by={"eid": "c.dst"}, agg={"doc_count": "count(DISTINCT c.src)"})
define(READ, "list-entity-coverage-gaps", "entities with few documents for their functions", lambda p: rel(
    "Entity e", (FUNCS, "f.eid = e.id", "f"), ("left", DOCS, "d.eid = e.id", "d"), where=f"CAST(coalesce(d.doc_count, 0) AS DOUBLE) / f.func_count < CAST({p.threshold} AS DOUBLE)", out={"id": "e.id", "func_count": "f.func_count", "doc_count": "coalesce(d.doc_count, 0)", "score": ratio("coalesce(d.doc_count, 0)", "f.func_count")}, order=["score", "id"],
), threshold="0.2")
define(READ, "global-function-reach", "functions that mention an entity", lambda p: side_by_side(counted("Function f", where="f.generated = 0", name="n"), counted("Function f", ("semi", "FUNCTION_MENTIONS m", "m.src = f.symbol"), where="f.generated = 0", name="n"), out={"total": "c0.n", "reaching": "c1.n", "share": ratio("c1.n", "c0.n")}))

define(TOOL, "neighbors", "links out of a document, of chosen kinds", lambda p: rel(edges(), ("Doc o", "o.id = r.dst"), alias="r", where=f"r.src = {p.id} AND r.edge_type IN ({p.kind_a}, {p.kind_b})", out={"id": "o.id", "edge_type": "r.edge_type", "line": "r.line"}, order=["id", "edge_type", "line"]), id="audit-run-48", kind_a="wikilink", kind_b="md_link")
define(TOOL, "backlinks", "links into a document, of chosen kinds", lambda p: rel(edges(), ("Doc o", "o.id = r.src"), alias="r", where=f"r.dst = {p.id} AND r.edge_type IN ({p.kind_a}, {p.kind_b})", out={"id": "o.id", "edge_type": "r.edge_type", "line": "r.line"}, order=["id", "edge_type", "line"]), id="audit-run-48", kind_a="wikilink", kind_b="md_link")
define(TOOL, "list-docs", "documents by role and tag", lambda p: rel(doc_rows(f"d.role = {p.role}"), ("semi", "doc_tags t", f"t.doc_id = d.id AND t.value = {p.tag}"), alias="d", out=cols("d", DOC + " tags covers"), order=["id"]), role="doc", tag="research")
define(TOOL, "list-types", "types of a kind whose symbol contains a text", lambda p: rel("Type t", where=all_of(f"t.kind = {p.kind}", has("t.symbol", p.text)), out=cols("t", "symbol kind file line"), order=["symbol"]), kind="struct", text="Brand")
define(TOOL, "list-findings", "findings of a severity and kind", lambda p: rel("Finding f", where=f"f.severity = {p.severity} AND f.kind = {p.kind}", out=cols("f", "id kind file line message severity"), order=["-severity", "file", "line", "id"]), severity="info", kind="todo")
define(TOOL, "list-files", "files of a language whose path contains a text", lambda p: rel("File f", where=all_of(f"f.language = {p.language}", has("f.path", p.text)), out=cols("f", "path language loc last_touched"), order=["path"]), language="rust", text="n1")
define(TOOL, "query-endpoints-of-entity", "endpoints that touch an entity", lambda p: rel("Endpoint e", ("semi", "ENDPOINT_TOUCHES_ENTITY t", f"t.src = e.id AND t.dst = {p.entity}"), out=cols("e", ENDPOINT), order=["id"]), entity="test-nation_10")
SHARED_COVERS = lambda p: rel("COVERS a", ("COVERS b", "b.dst = a.dst AND b.src <> a.src"), where=f"a.src = {p.id}", by={"id": "b.src"}, agg={"covers": "count(DISTINCT b.dst)"})
LINKS = lambda p: rel("WIKILINK w", where=f"w.src = {p.id}", by={"id": "w.dst"}, agg={"links": "count(*)"})
define(TOOL, "doc-neighbors-fused", "documents near one by shared entities and links", lambda p: rel(
    rel(SHARED_COVERS(p), out={"id": "id", "covers": "covers", "links": "0"}, union=[rel(LINKS(p), out={"id": "id", "covers": "0", "links": "links"})]), by={"id": "id"}, agg={"covers": "CAST(sum(covers) AS BIGINT)", "links": "CAST(sum(links) AS BIGINT)", "fused": "CAST(sum(covers + links) AS BIGINT)"}, order=["-fused", "id"], limit=50,
), id="audit-run-48")
define(TOOL, "entity-neighbors-co-cover", "entities that documents cover together with one", lambda p: rel("COVERS a", ("COVERS b", "b.src = a.src AND b.dst <> a.dst"), where=f"a.dst = {p.id}", by={"id": "b.dst"}, agg={"shared_docs": "count(DISTINCT a.src)"}, order=["-shared_docs", "id"], limit=50), id="build-economy")
define(TOOL, "entity-neighbors-related", "entities that one relates to", lambda p: rel("RELATES_TO r", ("Entity e", "e.id = r.dst"), where=f"r.src = {p.id}", out={"id": "e.id", "type": "r.type", "frequency": "r.frequency"}, order=["-frequency", "id"]), id="test-nation_10")
EITHER = rel("COUPLED_WITH c", out={"f": "c.src", "commits": "c.commits", "jaccard": "c.jaccard"}, union=[rel("COUPLED_WITH c", out={"f": "c.dst", "commits": "c.commits", "jaccard": "c.jaccard"})])
define(TOOL, "classify-file-coupling", "coupling tier of each file", lambda p: rel(
    rel("File f", ("left", EITHER, "r.f = f.path", "r"), by={"path": "f.path"}, agg={"n": "count(r.f)", "top": "max(r.jaccard)", "mean": "round(sum(round(r.jaccard, 9)) / count(r.f), 6)"}),
    out={"path": "path", "neighbors": "n", "max_jaccard": "round(coalesce(top, 0), 9)", "mean_jaccard": "coalesce(mean, 0)", "tier": ladder(("n = 0", "absence"), ("n >= 5 AND top >= 0.75", "heavy"), ("n <= 2 AND top >= 0.3 AND top < 0.7", "minimal"), default="moderate")}, order=["path"],
))
define(TOOL, "suggest-tags-by-summary", "tags that a summary names and the document lacks", lambda p: rel(
    "Doc d", ("cross", rel("doc_tags t", where="length(t.value) >= 3", out={"tag": "t.value"}, distinct=True), any_of("contains(lower(d.summary), a.tag)", "contains(lower(d.summary), replace(a.tag, '-', ' '))"), "a"), ("anti", "doc_tags t", "t.doc_id = d.id AND t.value = a.tag"),
    where=f"d.id = {p.id}", out={"id": "d.id", "tag": "a.tag"}, order=["tag"],
), id="interrogation-68")
