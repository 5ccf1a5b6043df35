"""Entities: cards, searches, labels and what relates them."""

from __future__ import annotations

from ...plans.relation import rel
from .base import *  # noqa: F403
from .base import all_of, any_of, clustered, cols, count_if, counted, define, density, dotted, has, ladder, lacks, outside_tests, promotion, ratio, side_by_side, starts

AXIS = "entity-axis"
FULL, BRIEF = "entity_id=id display mention_count description", "entity_id=id mention_count description"


def listing(name: str, about: str, where, shown: str = FULL, limit: int | None = 30, order=("-mention_count", "entity_id"), **params: str) -> None:
    define(AXIS, name, about, lambda p: rel("Entity e", where=where(p), out=cols("e", shown), order=list(order), limit=limit), **params)


listing("entities-by-id-pattern", "ids that contain a text", lambda p: has("e.id", p.pattern), BRIEF, 20, pattern="brand")
listing("entities-by-description-substring", "descriptions that contain a text", lambda p: has("e.description", p.pattern), BRIEF, 20, pattern="anchored")
listing("entities-by-id-or-description-substring", "id or description contains a text", lambda p: any_of(has("e.id", p.pattern), has("e.description", p.pattern)), BRIEF, 20, pattern="brand-1")
listing("entities-by-display-substring", "display names that contain a text", lambda p: has("e.display", p.pattern), FULL, 20, pattern="A")
listing("entity-pair-comparison", "two entities side by side", lambda p: f"e.id = {p.entity_a} OR e.id = {p.entity_b}", limit=None, entity_a="brand-9", entity_b="africa")
listing("cluster-derived-entities", "entities that a cluster suggested", lambda p: clustered("e"), BRIEF)
listing("promoted-entities", "entities that are not cluster-derived", lambda p: f"NOT {clustered('e')}", BRIEF)
listing("promoted-with-pointer-entities", "promoted entities that point somewhere", lambda p: all_of(f"NOT {clustered('e')}", has("e.description", "`")), BRIEF)
listing("low-density-entities-as-likely-fact", "cluster-derived entities of density below 0.10", lambda p: all_of(clustered("e"), density("e", 0)))
listing("utility-cluster-pattern-entities", "clusters of one or two files", lambda p: all_of(clustered("e"), has("e.description", *(f"across {k} file(s)" for k in (1, 2)))))
listing("multi-file-extension-target-candidates", "clusters of three to nine files", lambda p: all_of(clustered("e"), has("e.description", *(f"across {k} file(s)" for k in range(3, 10)))))
listing("god-node-entities", "entities flagged as god nodes", lambda p: "e.is_god_node = 1", limit=20)
define("test-surface", "test-entity-anchors", "entities about tests", lambda p: rel("Entity e", where=starts("e.id", "test-"), out=cols("e", FULL), order=["-mention_count", "entity_id"], limit=30))

# Verbs that commands of a tool begin with.
VERBS = ("debug-", "init-", "train-", "validate-", "convert-", "apply-", "package-", "assemble-", "evaluate-", "run-", "build-", "deploy-")
MORE_VERBS = (*VERBS, "benchmark-", "profile-", "serve-", "show-", "list-", "check-", "info-", "find-", "clean-", "install-", "update-")
listing("cli-subcommand-pattern-entities", "clusters named like commands", lambda p: all_of(clustered("e"), starts("e.id", *VERBS)), limit=40, order=("entity_id",))
listing("cli-subcommand-pattern-entities-v2", "clusters named like commands, more verbs", lambda p: all_of(clustered("e"), starts("e.id", *MORE_VERBS)), limit=50, order=("entity_id",))

define(AXIS, "entity-card-summary", "one entity with its promotion label", lambda p: rel("Entity e", where=f"e.id = {p.entity_id}", out={**cols("e", FULL), "promotion_label": promotion("e")}), entity_id="brand-8")
define(
    AXIS,
    "entity-card-with-file-axis",
    "one entity with the number of files whose path names it",
    lambda p: side_by_side(
        rel("Entity e", where=f"e.id = {p.entity_id}", out={**cols("e", FULL), "promotion_label": promotion("e")}),
        counted("File f", where=all_of(has("f.path", p.entity_id), lacks("f.path", "test")), name="n", what="count(DISTINCT f.path)"),
        out={**cols("c0", "entity_id display mention_count description"), "file_axis_count": "c1.n", "promotion_label": "c0.promotion_label"},
    ),
    entity_id="africa",
)
define(
    AXIS,
    "entity-fact-vs-pattern-classifier",
    "label by the number of functions that mention the entity",
    lambda p: side_by_side(
        rel("Entity e", where=f"e.id = {p.entity_id}", out=cols("e", "entity_id=id display mention_count")),
        counted("FUNCTION_MENTIONS m", where=f"m.dst = {p.entity_id}", name="fn_count", what="count(DISTINCT m.src)"),
        out={
            **cols("c0", "entity_id display mention_count"),
            "fn_count": "c1.fn_count",
            "role_label": ladder(("c1.fn_count > 50", "FACT"), ("c1.fn_count BETWEEN 1 AND 30", "PATTERN"), ("c1.fn_count BETWEEN 31 AND 50", "MID"), default="unclassified"),
        },
    ),
    entity_id="brand-8",
)
define(
    AXIS,
    "entity-fact-vs-pattern-classifier-v2",
    "label by the density in the description",
    lambda p: rel("Entity e", where=f"e.id = {p.entity_id}", out={**cols("e", FULL), "role_label": ladder((f"NOT {clustered('e')}", "unclassified-promoted"), (density("e", 0), "FACT"), (density("e", 1), "MID"), default="PATTERN")}),
    entity_id="brand-8",
)

# Pairs of a word and its plural: the plural without its s is the other id, or begins with it.
SAME_STEM = rel("Entity a", ("cross", "Entity b", "startswith(b.id, a.id) AND endswith(b.id, 's') AND a.id <> b.id"), out={"singular_id": "a.id", "singular_mention_count": "a.mention_count", "plural_id": "b.id", "plural_mention_count": "b.mention_count", "combined_mention_count": "a.mention_count + b.mention_count"})
define(AXIS, "entity-singular-plural-pairs", "ids of which one begins the other, which ends in s", lambda p: rel(SAME_STEM, order=["-combined_mention_count", "singular_id", "plural_id"], limit=20))
define(
    "corpus-diagnostics",
    "corpus-singular-plural-pair-summary",
    "number of such pairs",
    lambda p: rel(SAME_STEM, agg={"pair_count": "count(*)"}, out={"pair_count": "pair_count", "total_entities_in_pairs": "pair_count * 2", "singular_plural_ambiguity_label": ladder(("pair_count = 0", "no-pairs"), ("pair_count <= 3", "sparse-ambiguity"), default="rich-ambiguity")}),
)

define(AXIS, "orphan-entities", "entities that nothing covers or belongs to", lambda p: rel("Entity e", ("anti", "COVERS c", "c.dst = e.id"), ("anti", "FUNCTION_BELONGS_TO b", "b.dst = e.id"), out=dotted("e", "id display"), order=["e.id"]))
define(AXIS, "discriminative-entities", "entities that at most seven documents cover", lambda p: rel("COVERS c", ("Entity e", "e.id = c.dst"), by={"entity_id": "e.id", "display": "e.display"}, agg={"coverer_count": "count(DISTINCT c.src)"}, having="coverer_count <= 7", order=["coverer_count", "entity_id"], limit=25))
define(AXIS, "coverage-by-entity", "functions that mention each entity", lambda p: rel("Entity e", ("left", "FUNCTION_MENTIONS m", "m.dst = e.id"), by=dotted("e", "id display is_god_node"), agg={"coverage": "count(DISTINCT m.src)"}, order=["-coverage", "e.id"]))
define(AXIS, "entity-relations", "authored and derived relations between entities", lambda p: rel(
    "RELATES_TO r", ("Entity a", "a.id = r.src"), ("Entity b", "b.id = r.dst"), out={"from": "a.id", "to": "b.id", "type": "r.type", "origin": "'authored'", "frequency": "r.frequency"},
    union=[rel("ENTITY_CALLS r", ("Entity a", "a.id = r.src"), ("Entity b", "b.id = r.dst"), where=f"r.frequency >= CAST({p.min_calls} AS INT)", out={"from": "a.id", "to": "b.id", "type": "'calls'", "origin": "'derived'", "frequency": "r.frequency"})],
), optional={"min_calls": "5"}, min_calls="3")
define(AXIS, "entity-callers", "callers of the functions of an entity", lambda p: rel(
    rel("FUNCTION_BELONGS_TO b", out=cols("b", "src dst"), union=[rel("FUNCTION_MENTIONS m", out=cols("m", "src dst"))]), ("CALLS c", "c.dst = r.src"), ("Function caller", "caller.symbol = c.src"), ("semi", "Function target", "target.symbol = r.src"),
    alias="r", where=f"r.dst = {p.entity}", out=dotted("caller", "symbol file line"), distinct=True, order=["caller.file", "caller.line", "caller.symbol"],
), entity="brand-8")
define(AXIS, "concept-work-list", "mentioned entities by how few authored documents cover them", lambda p: rel(
    rel("FUNCTION_MENTIONS m", ("semi", "Entity e", "e.id = m.dst"), by={"entity": "m.dst"}, agg={"functions": "count(DISTINCT m.src)"}),
    ("left", rel("COVERS c", ("Doc d", "d.id = c.src AND d.role NOT IN ('ontology-entity', 'ontology-value', 'ontology-axis', 'ontology-migration', 'index')"), by={"eid": "c.dst"}, agg={"chapters": "count(DISTINCT d.id)"}), "k.eid = f.entity", "k"),
    alias="f", out={"entity": "f.entity", "functions": "f.functions", "chapters": "coalesce(k.chapters, 0)"}, order=["chapters", "-functions", "entity"], limit=25,
))
define(AXIS, "docs-via-shared-entity-coverage", "documents that share telling entities with one", lambda p: rel(
    rel("COVERS c", by={"eid": "c.dst"}, agg={"n": "count(DISTINCT c.src)"}, having="n <= 7"), ("semi", "COVERS s", f"s.dst = k.eid AND s.src = {p.doc_id}"), ("COVERS c", "c.dst = k.eid"), ("Doc d", "d.id = c.src"),
    alias="k", where=f"c.src <> {p.doc_id}", by={"doc_id": "d.id", "title": "d.title"}, agg={"shared_entities": "SET(c.dst)", "shared_count": "count(DISTINCT c.dst)"}, order=["-shared_count", "doc_id"], limit=25,
), doc_id="audit-run-15")
define(AXIS, "entities-via-shared-doc-coverage", "entities covered by the documents that cover one", lambda p: rel(
    "COVERS c", ("semi", "COVERS s", f"s.src = c.src AND s.dst = {p.entity_id}"), ("Entity o", "o.id = c.dst"), where=f"o.id <> {p.entity_id}",
    by={"entity_id": "o.id", "display": "o.display"}, agg={"shared_doc_count": "count(DISTINCT c.src)"}, order=["-shared_doc_count", "entity_id"], limit=25,
), entity_id="build-economy")
define(AXIS, "entity-cooccurrence", "pairs of entities that documents cover together", lambda p: rel(
    "COVERS x", ("COVERS y", "y.src = x.src AND x.dst < y.dst"), ("semi", "Entity a", "a.id = x.dst"), ("semi", "Entity b", "b.id = y.dst"),
    by={"entity_a": "x.dst", "entity_b": "y.dst"}, agg={"cooccur_count": "count(*)"}, having="cooccur_count >= 2", order=["-cooccur_count", "entity_a", "entity_b"], limit=25,
))
define(AXIS, "competitive-tools", "entities with attributes", lambda p: rel("Entity e", ("entity_attributes a", "a.entity_id = e.id"), by=cols("e", "id display description"), agg={"attributes": "LIST(a.value)"}, order=["id"]))
define(AXIS, "function-entity-touch-card", "entities that a function mentions", lambda p: rel("FUNCTION_MENTIONS m", ("Entity e", "e.id = m.dst"), ("semi", "Function f", "f.symbol = m.src"), where=f"m.src = {p.function_symbol}", out=cols("e", "entity_id=id display is_god_node mention_count"), order=["-is_god_node", "-mention_count", "entity_id"], limit=20), function_symbol="app/cli/n0/c786().")


def mentions_of(edge: str, table: str, name: str, keep) -> object:
    return rel(f"{edge} m", (f"{table} x", "x.symbol = m.src"), where=keep("x"), by={"eid": "m.dst"}, agg={name: "count(DISTINCT x.symbol)", f"{name}_files": "count(DISTINCT x.file)"})


def per_entity(keep, where: str | None = None) -> object:
    """Entities with their mention and membership counts."""
    return rel(
        "Entity e",
        ("left", mentions_of("FUNCTION_MENTIONS", "Function", "fm", keep), "a.eid = e.id", "a"),
        ("left", mentions_of("TYPE_MENTIONS", "Type", "tm", keep), "b.eid = e.id", "b"),
        ("left", mentions_of("FUNCTION_BELONGS_TO", "Function", "bt", keep), "c.eid = e.id", "c"),
        where=where,
        out={"id": "e.id", **{k: f"coalesce({k}, 0)" for k in ("fm", "tm", "bt", "fm_files", "tm_files")}},
    )


GRID = per_entity(outside_tests)
FLAVOR = ladder(("tm = 0", "function-heavy"), ("CAST(fm AS DOUBLE) / tm >= 2.0", "function-heavy"), ("CAST(fm AS DOUBLE) / tm <= 1.5", "type-heavy"), default="balanced")
LIFECYCLE = ladder(("bt = 0", "pure-discussion"), ("fm = 0", "pure-structural"), ("CAST(bt AS DOUBLE) / fm >= 2.0", "implementation-heavy"), ("CAST(bt AS DOUBLE) / fm <= 0.7", "discussion-heavy"), default="balanced")
CLUSTER = ladder(
    ("lifecycle_label = 'pure-discussion'", "future-work"),
    ("flavor_label = 'type-heavy' AND lifecycle_label = 'implementation-heavy'", "implemented-infrastructure"),
    ("flavor_label = 'function-heavy' AND lifecycle_label = 'discussion-heavy'", "discussed-handlers"),
    ("flavor_label = 'function-heavy' AND lifecycle_label = 'balanced'", "architectural-center"),
    ("flavor_label = 'balanced' AND lifecycle_label = 'implementation-heavy'", "implementation-anomaly"),
    default="unclassified",
)
FLAVORED = rel(GRID, where="fm >= 1 OR tm >= 1", out={"entity_id": "id", "function_mentions": "fm", "type_mentions": "tm", "ratio": ratio("fm", "tm", empty="999"), "flavor_label": FLAVOR})
LIVED = rel(GRID, where="bt >= 1 OR fm >= 1", out={"entity_id": "id", "belongs_count": "bt", "mentions_count": "fm", "ratio": f"CASE WHEN fm = 0 AND bt >= 1 THEN CAST(999 AS DOUBLE) ELSE {ratio('bt', 'fm')} END", "lifecycle_label": LIFECYCLE})
STATED = rel(rel(GRID, where="fm >= 1 OR tm >= 1 OR bt >= 1", out={"entity_id": "id", "flavor_label": FLAVOR, "lifecycle_label": LIFECYCLE}), out={"entity_id": "entity_id", "flavor_label": "flavor_label", "lifecycle_label": "lifecycle_label", "cluster_label": CLUSTER})
define(AXIS, "entity-mention-ratio", "functions against types that mention each entity", lambda p: rel(FLAVORED, order=["-ratio", "entity_id"], limit=25))
define(AXIS, "entity-belongs-vs-mentions-ratio", "functions that belong against those that mention", lambda p: rel(LIVED, order=["-ratio", "entity_id"], limit=25))
define(AXIS, "entity-state-grid", "flavor, lifecycle and cluster label of each entity", lambda p: rel(STATED, order=["entity_id"], limit=25))
for _name, _source, _label in (("entity-flavor-distribution", FLAVORED, "flavor_label"), ("entity-lifecycle-distribution", LIVED, "lifecycle_label"), ("entity-cluster-distribution", STATED, "cluster_label")):
    define(AXIS, _name, f"entities by {_label}", lambda p, s=_source, c=_label: rel(s, by={c: c}, agg={"entity_count": "count(*)"}, order=["-entity_count", c]))

IMPLEMENTED = per_entity(lambda a: lacks(f"{a}.file", "test"))
define(AXIS, "entity-implementation-summary", "what implements an entity", lambda p: rel(IMPLEMENTED, where=f"id = {p.entity_id}", out={"entity_id": "id", "function_mentions_count": "fm", "type_mentions_count": "tm", "function_belongs_count": "bt", "distinct_implementation_files": "fm_files + tm_files"}), entity_id="brand-8")
define(AXIS, "entity-to-implementation-files", "files of the functions and types that mention an entity", lambda p: rel(
    rel("FUNCTION_MENTIONS m", ("Function x", "x.symbol = m.src"), ("semi", "Entity e", "e.id = m.dst"), where=all_of(f"m.dst = {p.entity_id}", lacks("x.file", "test")), out={"file_path": "x.file"}, distinct=True,
        union=[rel("TYPE_MENTIONS m", ("Type x", "x.symbol = m.src"), ("semi", "Entity e", "e.id = m.dst"), where=all_of(f"m.dst = {p.entity_id}", lacks("x.file", "test")), out={"file_path": "x.file"}, distinct=True)]),
    where="file_path IS NOT NULL", by={"file_path": "file_path"}, agg={"mention_count": "count(*)"}, order=["-mention_count", "file_path"], limit=20,
), entity_id="brand-8")

define(AXIS, "axis-routing-card-for-vocabulary", "where a term occurs", lambda p: rel(
    "Entity e", where=has("e.id", p.term), agg={"axis_count": "count(e.id)"}, having="axis_count > 0", out={"axis": "'entity'", "axis_count": "axis_count"},
    union=[rel("File f", where=has("f.path", p.term), agg={"axis_count": "count(f.path)"}, having="axis_count > 0", out={"axis": "'file'", "axis_count": "axis_count"})],
), term="brand")
define(AXIS, "axis-routing-card-for-vocabulary-v2", "where a term occurs, in one row", lambda p: side_by_side(
    counted("Entity e", where=has("e.id", p.term), name="n", what="count(DISTINCT e.id)"), counted("File f", where=has("f.path", p.term), name="n", what="count(DISTINCT f.path)"),
    counted("Function f", where=all_of(has("f.symbol", p.term), lacks("f.symbol", "tests", "test_")), name="n", what="count(DISTINCT f.symbol)"),
    out={"entity_count": "c0.n", "file_count": "c1.n", "function_count": "c2.n"},
), term="n1")
define(AXIS, "promoted-entity-pointer-breakdown", "promoted entities with and without a pointer", lambda p: rel(
    "Entity e", where=f"NOT {clustered('e')}", agg={"total": "count(*)", "pointing": count_if(has("e.description", "`"))},
    out={"total_promoted": "total", "promoted_with_pointer_count": "pointing", "promoted_pure_semantic_count": "total - pointing",
         "promoted_sub_label": ladder(("total = 0", "no-promoted"), ("pointing = 0", "promoted-mostly-pure-semantic"), ("total = pointing", "promoted-mostly-with-pointers"), ("pointing > total - pointing", "promoted-mostly-with-pointers"), ("pointing < total - pointing", "promoted-mostly-pure-semantic"), default="promoted-mixed")},
))
define(AXIS, "public-api-hub-functions", "public functions that mention three entities or more", lambda p: rel(
    "Function f", ("FUNCTION_MENTIONS r", "r.src = f.symbol"), ("semi", "Entity e", "e.id = r.dst"), where=all_of(lacks("f.file", "/tests/", "/test_"), lacks("f.symbol", "/_")),
    by={"file": "f.file", "symbol": "f.symbol"}, agg={"mention_count": "count(*)"}, having="mention_count >= 3", order=["-mention_count", "file", "symbol"], limit=25,
))
define(AXIS, "hub-functions", "functions that mention three distinct entities or more", lambda p: rel(
    rel("FUNCTION_MENTIONS m", by={"src": "m.src"}, agg={"mentions": "count(DISTINCT m.dst)"}, having="mentions >= 3"), ("Function f", "f.symbol = m.src"), alias="m", out={**dotted("f", "symbol file line"), "mentions": "m.mentions"}, order=["-mentions", "f.symbol"], limit=50,
))
