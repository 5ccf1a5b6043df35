"""Documents and the links between them."""

from __future__ import annotations

from ...plans.relation import rel
from .base import META_ROLES, all_of, any_of, cols, count_if, define, has, ladder, one_of, ratio, starts

GRAPH = "doc-graph"
BOTH_WAYS = rel("WIKILINK w", out={"src": "w.src", "dst": "w.dst"}, union=[rel("WIKILINK w", out={"src": "w.dst", "dst": "w.src"})])
DEGREE = rel(BOTH_WAYS, ("semi", "Doc o", "o.id = l.dst"), alias="l", by={"id": "l.src"}, agg={"total_connections": "count(*)"})
AUDIT = starts("a.id", "interrogation-", "user-probe-")
TIERS = ladder(("g.total_connections >= 40", "tier-1-architectural-narrative"), ("g.total_connections >= 25", "tier-2-substantial"), ("g.total_connections >= 15", "tier-3-active-participation"), default="tier-4-leaf-or-feature")


def connected(name: str, about: str, least: int, category: str = GRAPH, **more: str) -> None:
    define(category, name, about, lambda p: rel("Doc d", (DEGREE, "g.id = d.id", "g"), where=f"g.total_connections >= {least}", out={**cols("d", "id title role"), "total_connections": "g.total_connections", **more}, order=["-total_connections", "id"], limit=25))


connected("doc-connectivity-ranking", "documents by links either way", 3)
connected("tier1-architectural-hubs", "documents with forty links or more", 40)
connected("doc-hub-tier-classifier", "documents by links either way, in tiers", 3, "corpus-diagnostics", tier_label=TIERS)
define(GRAPH, "feature-doc-connectivity", "feature documents by links either way", lambda p: rel("Doc d", ("left", DEGREE, "g.id = d.id", "g"), where="d.role = 'feature'", out={**cols("d", "id title"), "total_connections": "coalesce(g.total_connections, 0)"}, order=["-total_connections", "id"], limit=25))
define(GRAPH, "audits-mentioning-family-tag", "audits whose title or summary names a tag", lambda p: rel("Doc a", where=all_of(AUDIT, any_of(has("a.title", p.tag), has("a.summary", p.tag))), out=cols("a", "audit_id=id audit_title=title audit_updated=updated"), order=["-audit_updated", "audit_id"], limit=25), tag="chunking")
define(GRAPH, "ontology-vs-narrative-doc-ratio", "ontology against narrative documents", lambda p: rel(
    "Doc d", agg={"k": "count(*)", "o": count_if(one_of("d.role", (*META_ROLES, "index")))},
    out={"ontology_doc_count": "CAST(o AS BIGINT)", "narrative_doc_count": "CAST(k - o AS BIGINT)", "ontology_pct": ratio("o", "k", "100"),
         "ontology_routing_label": ladder(("k = 0", "empty"), ("(o * 100) div k >= 70", "rich-ontology-doc-axis-finds-defs"), ("(o * 100) div k >= 30", "mixed"), default="narrative-doc-axis-finds-howtos")},
))
define(GRAPH, "docs-by-kind", "documents of a kind", lambda p: rel("Doc d", where=f"d.kind = {p.kind}", out=cols("d", "id title role summary"), order=["id"]), kind="tutorial")
define(GRAPH, "docs-by-update-recency", "newest documents", lambda p: rel("Doc d", where="d.updated IS NOT NULL", out=cols("d", "id role kind updated title"), order=["-updated", "id"], limit=20))
define(GRAPH, "doc-fanin", "documents by distinct links into them", lambda p: rel("Doc d", ("WIKILINK w", "w.dst = d.id"), ("semi", "Doc s", "s.id = w.src"), by=cols("d", "id title kind role status"), agg={"in_degree": "count(DISTINCT w.src)"}, order=["-in_degree", "id"], limit=20))
define(GRAPH, "leaf-docs", "documents that nothing links to", lambda p: rel("Doc d", *(("anti", f"{e} x", "x.dst = d.id") for e in ("WIKILINK", "MD_LINK", "INFORMED_BY")), out=cols("d", "id title kind role status"), order=["id"]))
define(GRAPH, "recent-leaf-docs", "newest plain documents without a link in", lambda p: rel("Doc d", ("anti", "WIKILINK x", "x.dst = d.id"), where="d.role = 'doc'", out=cols("d", "id title kind updated"), order=["-updated", "id"], limit=15))
define(GRAPH, "docs-by-summary-substring", "documents whose summary contains a text", lambda p: rel("Doc d", where=all_of("d.summary IS NOT NULL", has("d.summary", p.substring)), out=cols("d", "doc_id=id title summary"), order=["doc_id"], limit=30), substring="graph-similarity")
define(GRAPH, "roadmap-unmet-deps", "features that wait for others", lambda p: rel("DEPENDS_ON r", ("Doc a", "a.id = r.src"), ("Doc b", "b.id = r.dst"), where="a.role = 'feature' AND b.role = 'feature' AND b.lifecycle IN ('planning', 'implementing')", out={"feature": "a.id", "unmet_dep": "b.id", "dep_lifecycle": "b.lifecycle"}, order=["feature", "unmet_dep"]))
define(GRAPH, "phasing", "documents by phase", lambda p: rel("Doc d", by={"phase": "d.phase"}, agg={"docs": "RECORDS(id: d.id, title: d.title)", "count": "count(d.id)"}, order=["phase"]))

# Processes by the beginning of the id.
PROCESSES = ("research", "interrogation", "user-probe", "audit-run")
PROCESS = ladder(*((starts("d.id", f"{x}-"), x) for x in PROCESSES), default="other")
CATEGORY = ladder(
    *((starts("d.id", f"{x}-"), x) for x in PROCESSES),
    (starts("d.id", "entity-"), "ontology"), (starts("d.id", "feature-"), "feature"), (starts("d.id", "gap-"), "gap"), ("d.role = 'doc'", "other-narrative"), (one_of("d.role", META_ROLES), "ontology"),
    default="other",
)
CATEGORIES = ("research", "interrogation", "user-probe", "audit-run", "ontology", "feature", "gap", "other-narrative")


def _n(category: str) -> str:
    return category.replace("-", "_") + "_count"


define(GRAPH, "loop-process-doc-distribution", "documents by process, in one row", lambda p: rel(
    rel("Doc d", out={"category": CATEGORY}), agg={_n(c): f"CAST({count_if(f'category = {chr(39)}{c}{chr(39)}')} AS BIGINT)" for c in CATEGORIES},
    out={**{_n(c): _n(c) for c in CATEGORIES}, "meta_to_research_ratio": ratio("(interrogation_count + user_probe_count + audit_run_count)", "research_count"), "interrogation_to_user_probe_ratio": ratio("interrogation_count", "user_probe_count")},
))
PROCESSED = rel("Doc d", out={"id": "d.id", "title": "d.title", "updated": "d.updated", "process_class": PROCESS})
define(GRAPH, "latest-by-loop-process", "newest document of each process", lambda p: rel(
    rel(PROCESSED, ("semi", rel(PROCESSED, where="process_class <> 'other' AND updated IS NOT NULL AND updated <> ''", by={"pc": "process_class"}, agg={"newest": "max(updated)"}), "m.pc = q.process_class AND m.newest = q.updated", "m"), alias="q", by={"process_class": "q.process_class"}, agg={"latest": "max(q.id)"}),
    ("Doc f", "f.id = l.latest"), alias="l", out={"process_class": "l.process_class", "latest_doc_id": "f.id", "latest_title": "f.title", "latest_updated": "f.updated"}, order=["process_class"],
))
define(GRAPH, "loop-process-balance-metric", "user probes against interrogations", lambda p: rel(
    "Doc d", agg={"u": count_if(starts("d.id", "user-probe-")), "i": count_if(starts("d.id", "interrogation-"))},
    out={"user_probe_count": "CAST(u AS BIGINT)", "interrogation_count": "CAST(i AS BIGINT)", "user_probe_to_interrogation_ratio": ratio("u", "i"),
         "balance_label": ladder(("i = 0 AND u = 0", "balanced"), ("i = 0", "V-heavy"), ("u = 0", "I-heavy"), ("CAST(u AS DOUBLE) / i > 1.2", "V-heavy"), ("CAST(u AS DOUBLE) / i < 0.83", "I-heavy"), default="balanced")},
))
