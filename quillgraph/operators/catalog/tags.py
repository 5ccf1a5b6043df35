"""Families of documents by their tags.

Each query has its own list of tags too general to mean a family.
"""

from __future__ import annotations

from ...plans.relation import lit, rel
from .base import TAG_LIST, all_of, any_of, cols, define, has, ladder, lacks, one_of, starts, tagged

TAGS = "doc-tag-families"

# General tags, in the five variants the queries use.
GENERAL = ("research", "paper", "tool", "production", "framework", "survey", "design", "system")
FAMILY = (*GENERAL, "ingest-pass-storyline")
PLAIN = (*GENERAL, "substantial-bundle", "user-probe", "interrogation")
LOOSE = (*PLAIN, "audit")
BRIDGE = ("research", "paper", "production", "tool", "doc")
AUDIT = starts("a.id", "interrogation-", "user-probe-")


def meaningful(column: str, general: tuple[str, ...]) -> str:
    return f"NOT {one_of(column, general)}"


def bridging(column: str) -> str:
    return all_of(meaningful(column, BRIDGE), f"length({column}) >= 6", lacks(column, "storyline"))


RESEARCH = rel("Doc d", tagged("d", "research", "r"), tagged("d", "index", "x", "anti"), out={"id": "d.id", "title": "d.title"})


def families(least: int = 3, long: bool = False):
    return rel("doc_tags t", ("semi", RESEARCH, "rd.id = t.doc_id", "rd"), where=all_of(meaningful("t.value", FAMILY), *(["length(t.value) >= 6"] if long else [])), by={"family_tag": "t.value"}, agg={"member_count": "count(DISTINCT t.doc_id)"}, having=f"member_count >= {least}")


def siblings(long: bool = False):
    """(family_tag, member_count, sibling_tag_count, sibling_tags)."""
    return rel(
        families(long=long), ("doc_tags m", "m.value = f.family_tag"), ("semi", RESEARCH, "rd.id = m.doc_id", "rd"), ("doc_tags s", "s.doc_id = m.doc_id AND s.value <> f.family_tag"),
        alias="f", where=all_of(meaningful("s.value", FAMILY), f"NOT {starts('s.value', 'iter-')}"), by=cols("f", "family_tag member_count"), agg={"sibling_tag_count": "count(DISTINCT s.value)", "sibling_tags": "SET(s.value)"},
    )


DEPTH = rel(siblings(), out={**{k: k for k in ("family_tag", "member_count", "sibling_tag_count")}, "depth_score": "member_count * sibling_tag_count"})
LONG_DEPTH = rel(siblings(long=True), out={**{k: k for k in ("family_tag", "member_count", "sibling_tag_count")}, "depth_score": "member_count * sibling_tag_count"})
# Audits are few beside the documents; whether a text contains a tag has no key to join on.
MENTIONED = ("cross", rel("Doc a", where=AUDIT, out=cols("a", "id title summary")), any_of("contains(a.title, f.family_tag)", "contains(a.summary, f.family_tag)"), "a")

define(TAGS, "established-research-families", "tags of three research documents or more", lambda p: rel("doc_tags t", ("semi", RESEARCH, "rd.id = t.doc_id", "rd"), where=meaningful("t.value", FAMILY), by={"family_tag": "t.value"}, agg={"member_count": "count(DISTINCT t.doc_id)", "members": "SET(t.doc_id)"}, having="member_count >= 3", order=["-member_count", "family_tag"]))
define(TAGS, "cross-family-concept-tags", "tags beside each family's", lambda p: rel(siblings(), order=["-sibling_tag_count", "family_tag"], limit=25))
define(TAGS, "family-tag-absorption-depth", "members times sibling tags", lambda p: rel(DEPTH, order=["-depth_score", "family_tag"], limit=25))
define(TAGS, "family-tag-audit-counts-summary", "audits that mention each family", lambda p: rel(families(long=True), MENTIONED, alias="f", by=cols("f", "family_tag member_count"), agg={"audit_count": "count(DISTINCT a.id)"}, order=["-audit_count", "family_tag"], limit=25))
define(TAGS, "family-maturity-2d", "families by depth and audits", lambda p: rel(
    rel(LONG_DEPTH, MENTIONED, alias="f", by=cols("f", "family_tag member_count sibling_tag_count depth_score"), agg={"audit_count": "count(DISTINCT a.id)"}),
    out={**{k: k for k in ("family_tag", "member_count", "sibling_tag_count", "depth_score", "audit_count")}, "maturity_label": ladder(("depth_score >= 100 AND audit_count >= 7", "deeply-explored-mature"), ("depth_score >= 100", "recently-absorbed-umbrella"), ("audit_count >= 7", "narrow-but-explored"), default="narrow-recent")},
    order=["-depth_score", "-audit_count", "family_tag"], limit=25,
))
# Tags of the code domain.
CODE_TAGS = ("code-rag", "code-embedding-lineage", "code-context-engine", "code-comprehension", "static-analysis", "code-indexer-architecture", "code-similarity", "code-embedding", "ast-paths", "ast-structural-features")
define(TAGS, "family-tags-by-code-domain", "families by the share of members about code", lambda p: rel(
    rel(families(), ("doc_tags m", "m.value = f.family_tag"), ("semi", RESEARCH, "rd.id = m.doc_id", "rd"), ("left", rel("doc_tags c", where=one_of("c.value", CODE_TAGS), out={"cid": "c.doc_id"}, distinct=True), "c.cid = m.doc_id", "c"), alias="f", by=cols("f", "family_tag member_count"), agg={"code_count": "count(c.cid)"}),
    out={"family_tag": "family_tag", "member_count": "member_count", "code_count": "code_count", "domain_label": ladder(("CAST(code_count AS DOUBLE) / member_count > 0.5", "code-domain"), ("CAST(code_count AS DOUBLE) / member_count < 0.2", "generic"), default="mixed")}, order=["domain_label", "family_tag"], limit=25,
))
define(TAGS, "lessons-for-research-family", "audits that cite a family's research", lambda p: rel(
    "WIKILINK w", ("Doc a", "a.id = w.src"), ("semi", "doc_tags", "t.doc_id = w.dst AND t.value = 'research'", "t"), ("semi", "doc_tags", f"u.doc_id = w.dst AND u.value = {p.tag}", "u"),
    where=AUDIT, by=cols("a", "audit_id=id audit_title=title audit_updated=updated"), agg={"cites_count": "count(DISTINCT w.dst)", "cites_in_family": "SET(w.dst)"}, order=["-cites_count", "-audit_updated", "audit_id"], limit=25,
), tag="graph-similarity")


def listed(doc: str = "d") -> tuple:
    return (TAG_LIST, f"l.doc_id = {doc}.id", "l")


define(TAGS, "docs-by-tag", "documents with a tag", lambda p: rel("Doc d", tagged("d", p.tag, "t"), listed(), out={**cols("d", "id role kind title"), "tags": "l.tags"}, order=["role", "id"]), tag="chunking")
define(TAGS, "audits-by-iter-tag", "audits of an iteration", lambda p: rel("Doc a", tagged("a", p.iter_tag, "t"), listed("a"), where=AUDIT, out={**cols("a", "audit_id=id audit_title=title"), "audit_tags": "l.tags", "audit_updated": "a.updated"}, order=["audit_id"], limit=25), iter_tag="iter-1")
define(TAGS, "cross-corpus-validated-patterns", "patterns that hold across corpora", lambda p: rel("Doc d", tagged("d", "cross-corpus-validation", "t"), listed(), out={**cols("d", "doc_id=id title kind"), "tags": "l.tags"}, order=["doc_id"]))
define(TAGS, "recent-research-by-update", "newest research documents", lambda p: rel("Doc d", ("left", *listed()), where=all_of(starts("d.id", "research-"), "d.updated IS NOT NULL"), out={**cols("d", "id title updated"), "tags": "coalesce(l.tags, '')"}, order=["-updated", "id"], limit=10))
define(TAGS, "docs-without-family-tag", "plain documents without a telling tag", lambda p: rel(
    "Doc d", ("left", *listed()), ("anti", "doc_tags t", all_of("t.doc_id = d.id", meaningful("t.value", LOOSE), f"NOT {starts('t.value', 'iter-')}")), where=all_of("d.role = 'doc'", f"NOT {starts('d.id', 'audit-run-', 'feature-')}"),
    out={**cols("d", "doc_id=id title"), "tags": "coalesce(l.tags, '')"}, order=["doc_id"],
))

# Tags of patterns, failures, mitigations and workflows.
PICKED = {
    "architectural-patterns": ("pattern_tags", ("absence-as-signal", "test-co-location", "query-reformulation", "cross-corpus-validation", "cross-workflow-comparison")),
    "retrieval-failure-modes": ("failure_tags", ("vocabulary-mismatch", "tag-axis-loose-end", "negation-failure", "adjacent-family-displacement", "embedding-backend-not-compiled", "vocabulary-asymmetry")),
    "retrieval-mitigation-modes": ("mitigation_tags", ("vocabulary-mismatch-mitigation", "audit-as-surface", "query-reformulation")),
    "workflow-validations": ("workflow_tags", ("install-setup-workflow", "churn-analysis-workflow", "pre-commit-workflow", "security-review-workflow", "review-workflow", "refactor-workflow")),
}
for _name, (_column, _values) in PICKED.items():
    define(TAGS, _name, "documents with one of some tags", lambda p, c=_column, v=_values: rel("Doc d", ("doc_tags t", "t.doc_id = d.id"), where=one_of("t.value", v), by=cols("d", "doc_id=id title kind"), agg={c: "SET(t.value)"}, order=["doc_id"]))


def staged(stages: tuple[tuple[str, str], ...], label: str, default: str, *needed: str):
    """Research documents with the label of the first of some tags they carry."""
    rank = "CASE t.value " + " ".join(f"WHEN {lit(tag)} THEN {k}" for k, (tag, _) in enumerate(stages)) + " END"
    best = rel("doc_tags t", where=one_of("t.value", tuple(tag for tag, _ in stages)), by={"bid": "t.doc_id"}, agg={"k": f"min({rank})"})
    return rel("Doc d", *(tagged("d", x, f"n{i}") for i, x in enumerate(("research", *needed))), ("left", best, "b.bid = d.id", "b"), out={**cols("d", "id title"), label: ladder(*((f"b.k = {k}", name) for k, (_, name) in enumerate(stages)), default=default)})


# Stages and subfamilies by tag.
PIPELINE = (("llm-era-query-rewriting", "1-query-rewriting"), ("chunking", "2-chunking"), ("deployment-model", "3-embedding"), ("reranking", "4-reranking"), ("rag-evaluation", "5-evaluation"))
SIMILARITY = tuple((x, x) for x in ("graph-kernel", "graph-embedding", "neural-graph-matching", "cross-attention", "bipartite-matching"))
EXPANSION = (("aqe-local", "aqe-local"), ("aqe-global", "aqe-global"), ("aqe-external", "aqe-external"), ("llm-era-query-rewriting", "llm-era"), ("vocabulary-mismatch", "vocabulary-mismatch-survey"))
define(TAGS, "retrieval-pipeline-cookbook", "research by pipeline stage", lambda p: rel(staged(PIPELINE, "stage_label", "NA"), where="stage_label <> 'NA'", order=["stage_label", "id"], limit=25))
define(TAGS, "pipeline-stage-coverage", "research counted by pipeline stage", lambda p: rel(rel(staged(PIPELINE, "stage_label", "NA"), where="stage_label <> 'NA'", by={"stage_label": "stage_label"}, agg={"member_count": "count(id)"}), out={"stage_label": "stage_label", "member_count": "member_count", "coverage_label": ladder(("member_count >= 3", "trio-coverage"), ("member_count >= 1", "partial-coverage"), default="gap")}, order=["stage_label"]))
for _family, _stages in (("graph-similarity", SIMILARITY), ("query-expansion", EXPANSION)):
    define(TAGS, f"{_family}-cookbook", f"research on {_family} by subfamily", lambda p, f=_family, s=_stages: rel(staged(s, "subfamily_label", "other", f), order=["subfamily_label", "id"], limit=25))
    define(TAGS, f"{_family}-subfamily-coverage", f"research on {_family} counted by subfamily", lambda p, f=_family, s=_stages: rel(
        rel(staged(s, "subfamily_label", "other", f), by={"subfamily_label": "subfamily_label"}, agg={"member_count": "count(id)"}), out={"subfamily_label": "subfamily_label", "member_count": "member_count", "coverage_label": ladder(("member_count >= 2", "rich"), ("member_count >= 1", "singleton"), default="gap")}, order=["subfamily_label"]))


def co_tags(family: str):
    return rel("doc_tags t", ("semi", "Doc d", "d.id = t.doc_id"), ("semi", "doc_tags", f"f.doc_id = t.doc_id AND f.value = {family}", "f"), ("semi", "doc_tags", "r.doc_id = t.doc_id AND r.value = 'research'", "r"), where=all_of(f"t.value <> {family}", bridging("t.value")), by={"co_tag": "t.value"}, agg={"member_count": "count(DISTINCT t.doc_id)"})


SHARE = ladder(("member_count >= 3", "rich"), ("member_count = 2", "couple"), default="singleton")
define(TAGS, "mature-topic-shape-distribution", "tags beside a family's, by how many share them", lambda p: rel(co_tags(p.family_tag), out={"co_tag": "co_tag", "member_count": "member_count", "coverage_label": SHARE}, order=["-member_count", "co_tag"], limit=30), family_tag="graph-similarity")
define(TAGS, "family-rich-cotags", "tags that three of a family share", lambda p: rel(co_tags(p.family_tag), where="member_count >= 3", out={"co_tag": "co_tag", "member_count": "member_count", "coverage_label": "'rich'"}, order=["-member_count", "co_tag"]), family_tag="graph-similarity")
define(TAGS, "family-top-bridges", "tags that two of a family share", lambda p: rel(co_tags(p.family_tag), where="member_count >= 2", out={"other_family": "co_tag", "bridge_count": "member_count"}, order=["-bridge_count", "other_family"], limit=20), family_tag="graph-similarity")
define(TAGS, "cross-family-bridge-papers", "research with both of two tags", lambda p: rel("Doc d", tagged("d", p.family_a, "a"), tagged("d", p.family_b, "b"), tagged("d", "research", "r"), out=cols("d", "id title"), order=["id"]), family_a="graph-similarity", family_b="chunking")
PAIRS = rel("doc_tags x", ("doc_tags y", "y.doc_id = x.doc_id AND x.value < y.value"), ("semi", "doc_tags", "r.doc_id = x.doc_id AND r.value = 'research'", "r"), ("semi", "Doc d", "d.id = x.doc_id"), where=all_of(bridging("x.value"), bridging("y.value")), by={"family_a": "x.value", "family_b": "y.value"}, agg={"bridge_count": "count(DISTINCT x.doc_id)"}, having="bridge_count >= 3")
define(TAGS, "cross-family-bridge-density", "pairs of tags on three research documents or more", lambda p: rel(PAIRS, order=["-bridge_count", "family_a", "family_b"], limit=25))
FAM5 = rel("doc_tags t", ("semi", "doc_tags", "r.doc_id = t.doc_id AND r.value = 'research'", "r"), ("semi", "Doc d", "d.id = t.doc_id"), where=bridging("t.value"), by={"family_tag": "t.value"}, agg={"total_members": "count(DISTINCT t.doc_id)"}, having="total_members >= 5")
CO5 = rel(FAM5, ("doc_tags m", "m.value = f.family_tag"), ("semi", "doc_tags", "r.doc_id = m.doc_id AND r.value = 'research'", "r"), ("semi", "Doc d", "d.id = m.doc_id"), ("doc_tags c", "c.doc_id = m.doc_id AND c.value <> f.family_tag"), alias="f", where=bridging("c.value"), by={**cols("f", "family_tag total_members"), "co_tag": "c.value"}, agg={"k": "count(DISTINCT m.doc_id)"})
define(TAGS, "mature-topic-shape-census", "shape of each mature family", lambda p: rel(
    rel(CO5, by={"family_tag": "family_tag", "total_members": "total_members"}, agg={"rich": "count(CASE WHEN k >= 3 THEN co_tag END)", "couple": "count(CASE WHEN k = 2 THEN co_tag END)", "single": "count(CASE WHEN k = 1 THEN co_tag END)"}),
    out={"family_tag": "family_tag", "total_members": "total_members", "rich_subfamilies": "rich", "couple_subfamilies": "couple", "singleton_cotags": "single",
         "shape_label": ladder(("rich >= 2 AND single <= 2", "DEEP-mature"), ("rich = 0 AND couple <= 1 AND single >= 4", "BROAD-mature"), ("rich >= 1 AND single >= 2", "MIXED-mature"), default="emergent")}, order=["-total_members", "family_tag"], limit=25,
))
define(TAGS, "family-to-feature-bridges", "features that a family's research links to", lambda p: rel("WIKILINK w", ("Doc r", "r.id = w.src"), ("Doc f", "f.id = w.dst AND f.role = 'feature'"), tagged("r", "research", "t"), tagged("r", p.tag, "u"), out={"research_id": "r.id", "research_title": "r.title", "feature_id": "f.id", "feature_title": "f.title"}, order=["research_id", "feature_id"], limit=25), tag="graph-similarity")
define(TAGS, "feature-incoming-from-research", "features by research that links to them", lambda p: rel(
    "Doc f", ("left", rel("WIKILINK w", ("semi", "Doc r", "r.id = w.src"), ("semi", "doc_tags", "t.doc_id = w.src AND t.value = 'research'", "t"), by={"dst": "w.dst"}, agg={"k": "count(*)"}), "i.dst = f.id", "i"),
    where="f.role = 'feature'", out={"feature_id": "f.id", "feature_title": "f.title", "research_incoming_count": "coalesce(i.k, 0)"}, order=["-research_incoming_count", "feature_id"], limit=25,
))
define(TAGS, "tag-axis-loose-ends", "summaries that name a tag the document lacks", lambda p: rel(
    "Doc d", ("cross", rel("doc_tags t", where="length(t.value) >= 3", out={"candidate": "t.value"}, distinct=True), "contains(d.summary, a.candidate)", "a"), ("anti", "doc_tags", "t.doc_id = d.id AND t.value = a.candidate", "t"),
    where="d.summary IS NOT NULL", out={"doc_id": "d.id", "title": "d.title", "missing_tag": "a.candidate"}, order=["doc_id", "missing_tag"],
))
define(TAGS, "singleton-tags", "tags of one document", lambda p: rel("doc_tags t", by={"tag": "t.value"}, agg={"k": "count(DISTINCT t.doc_id)", "only_doc": "min(t.doc_id)"}, having="k = 1", out={"tag": "tag", "only_doc": "only_doc"}, order=["tag"]))
define(TAGS, "entities-coupled-to-tag", "entities that a tag's documents cover", lambda p: rel("COVERS c", ("Entity e", "e.id = c.dst"), ("semi", "Doc d", "d.id = c.src"), ("semi", "doc_tags", f"t.doc_id = c.src AND t.value = {p.tag}", "t"), by=cols("e", "entity_id=id display"), agg={"tag_doc_count": "count(DISTINCT c.src)"}, order=["-tag_doc_count", "entity_id"], limit=25), tag="research")
_LINKED = ("WIKILINK w", ("Doc a", "a.id = w.src"), ("Doc b", "b.id = w.dst"), *(tagged(x, "research", f"r{x}") for x in "ab"), *(tagged(x, "index", f"i{x}", "anti") for x in "ab"))
_PAIR = {"doc_a": "a.id", "doc_b": "b.id", "title_a": "a.title", "title_b": "b.title"}
# the tags that linked documents share, of these pairs alone: not all pairs of documents with a tag
_SHARED = rel(rel("WIKILINK w", where="w.src < w.dst", out={"a": "w.src", "b": "w.dst"}, distinct=True), ("doc_tags x", "x.doc_id = p.a"), ("semi", "doc_tags y", "y.doc_id = p.b AND y.value = x.value"), alias="p", where=meaningful("x.value", GENERAL), out={"da": "p.a", "db": "p.b"})
define(TAGS, "research-pairs-without-shared-family-tag", "linked research without a telling tag in common", lambda p: rel(
    *_LINKED,
    ("anti", rel("doc_tags x", ("doc_tags y", "y.value = x.value"), where=all_of(meaningful("x.value", GENERAL), "x.doc_id < y.doc_id"), out={"da": "x.doc_id", "db": "y.doc_id"}), "s.da = a.id AND s.db = b.id", "s"),
    where="a.id < b.id", out=_PAIR, order=["doc_a", "doc_b"],
    fast=rel(*_LINKED, ("anti", _SHARED, "s.da = a.id AND s.db = b.id", "s"), where="a.id < b.id", out=_PAIR, order=["doc_a", "doc_b"]),
))
USE = rel("doc_tags t", ("semi", "doc_tags", "r.doc_id = t.doc_id AND r.value = 'research'", "r"), by={"value": "t.value"}, agg={"docs": "count(DISTINCT t.doc_id)"})
define(TAGS, "research-docs-with-all-singleton-meaningful-tags", "research whose telling tags no other research has", lambda p: rel(
    rel("doc_tags t", ("semi", RESEARCH, "rd.id = t.doc_id", "rd"), (USE, "u.value = t.value", "u"), where=meaningful("t.value", GENERAL), by={"did": "t.doc_id"}, agg={"k": "count(t.value)", "alone": "sum(CASE WHEN u.docs = 1 THEN 1 ELSE 0 END)"}, having="k > 0 AND k = alone"),
    ("Doc d", "d.id = g.did"), alias="g", out={"doc_id": "d.id", "title": "d.title", "tag_count": "g.k"}, order=["doc_id"],
))
define(TAGS, "storyline-leaf-detector", "storyline documents without a link in", lambda p: rel("Doc d", tagged("d", "ingest-pass-storyline", "t"), ("anti", "WIKILINK x", "x.dst = d.id"), out=cols("d", "id title role updated"), order=["-updated", "id"]))
define(TAGS, "storyline-siblings", "documents that share telling tags with one", lambda p: rel(
    "doc_tags s", ("doc_tags o", "o.value = s.value"), ("Doc d", "d.id = o.doc_id"), ("semi", "Doc me", f"me.id = s.doc_id AND me.id = {p.doc_id}"), where=all_of(f"s.doc_id = {p.doc_id}", f"d.id <> {p.doc_id}", "d.role = 'doc'", meaningful("s.value", PLAIN)),
    by=cols("d", "doc_id=id title"), agg={"shared_tag_count": "count(*)"}, order=["-shared_tag_count", "doc_id"], limit=25,
), doc_id="research-33")
define(TAGS, "roles-using-tag", "documents with a tag by role", lambda p: rel("Doc d", tagged("d", p.tag, "t"), by={"role": "d.role"}, agg={"doc_count": "count(d.id)"}, order=["-doc_count", "role"]), tag="research")
define(TAGS, "tag-axis-coverage-summary", "tags by use", lambda p: rel(
    rel("doc_tags t", ("semi", "Doc d", "d.id = t.doc_id AND d.role = 'doc'"), where=meaningful("t.value", PLAIN), by={"tag": "t.value"}, agg={"uses": "count(DISTINCT t.doc_id)"}),
    out={"tag": "tag", "uses": "uses", "health": ladder(("uses >= 7", "load-bearing"), ("uses >= 4", "mid-family"), ("uses >= 2", "small-family"), default="singleton")}, order=["-uses", "tag"],
))
COOCCUR = (*PLAIN, "ingest-pass-storyline")
define(TAGS, "tag-cooccurrence", "pairs of tags on two plain documents or more", lambda p: rel(
    "doc_tags x", ("doc_tags y", "y.doc_id = x.doc_id AND x.value < y.value"), ("semi", "Doc d", "d.id = x.doc_id AND d.role = 'doc'"), where=all_of(*(all_of(meaningful(f"{a}.value", COOCCUR), f"NOT {starts(f'{a}.value', 'iter-')}") for a in "xy")),
    by={"tag_a": "x.value", "tag_b": "y.value"}, agg={"cooccur_count": "count(*)"}, having="cooccur_count >= 2", order=["-cooccur_count", "tag_a", "tag_b"], limit=25,
))
define(TAGS, "decisions-to-prior-art", "design documents and the prior art they link to", lambda p: rel(
    rel("INFORMED_BY i", out={"src": "i.src", "dst": "i.dst", "line": "i.line", "edge_type": "'INFORMED_BY'"}, union=[rel("WIKILINK i", out={"src": "i.src", "dst": "i.dst", "line": "i.line", "edge_type": "'WIKILINK'"})]),
    ("Doc s", "s.id = r.src"), ("Doc q", "q.id = r.dst"), ("left", rel("doc_tags t", where="t.value = 'design'", out={"did": "t.doc_id"}, distinct=True), "g.did = s.id", "g"),
    alias="r", where=all_of(any_of(starts("s.path", "docs/design/"), "g.did IS NOT NULL"), any_of(has("q.id", "prior-art"), "coalesce(q.kind, '') = 'reference'")), out={"decision": "s.id", "prior_art": "q.id", "edge_type": "r.edge_type", "line": "r.line"}, order=["decision", "prior_art", "line"],
))
