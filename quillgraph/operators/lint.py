"""Rules over the graph, each giving rows (code, severity, subject, message).

A rule is a plan; :func:`issues` puts their rows together.  A code may have
several rules.  Documents whose status is ``auto``, or without front matter of
their own, are not checked one by one.  Rules that need other tools (spelling,
language servers, indexers) are not here; :func:`unauthored_clusters` needs
communities and is no plan.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..plans.relation import Rel, lit, rel
from ..sources.driver_tables import ctes
from .catalog.base import all_of, any_of, has, lacks, one_of, starts
from .typed import edges

# The default configuration, what documents may say of themselves.
ROLES = ("doc", "feature", "index", "ontology-entity", "ontology-value", "ontology-axis", "ontology-migration")
KINDS = ("explanation", "how-to", "tutorial", "reference", "note", "")
STATUSES = ("draft", "current", "superseded", "auto")
LIFECYCLES = ("planning", "implementing", "stable", "superseded", "archived", "")
VISIBILITIES = ("public", "internal")
RELATIONS = ("part-of", "uses", "specialises")
REQUIRED_AXES = {"doc": ("kind",), "feature": ("lifecycle",)}
ALLOWED_LIFECYCLES = {"doc": ("stable", "superseded", "archived", ""), "index": ("stable", "")}
FILENAMES = {"feature": "^[0-9]*[02468]\\.md$"}
#: (role, kind, lifecycle, allowed folders): the first that fits a document counts.
LAYOUT = (("feature", None, None, ("docs/design/", "docs/features/")), ("doc", "reference", None, ("docs/",)), ("doc", None, "planning", ("docs/design/",)))
ACCEPTED = ("Json",)
PATH_EXEMPT = ("target/",)
FEW_DOCS, LEAST_REACH = "0.2", "99"

CHECKED = all_of("d.has_frontmatter = 1", "d.parse_error IS NULL", "d.status <> 'auto'")
NARRATIVE = all_of("d.role = 'doc'", "coalesce(d.lifecycle, '') <> 'archived'")


class Rules:
    def __init__(self):
        self.made: list[tuple[str, Rel]] = []

    def add(self, code: str, severity: str, source, *joins, subject: str, message: str, where: str | None = None) -> None:
        self.made.append((code, rel(source, *joins, where=where, out={"code": lit(code), "severity": lit(severity), "subject": subject, "message": message})))

    def doc(self, code: str, severity: str, where: str, message: str, *joins) -> None:
        """A rule of checked documents, as d."""
        self.add(code, severity, "doc_front d", *joins, subject="d.id", message=message, where=all_of(CHECKED, where))


def _layout() -> str:
    cases = ""
    for role, kind, lifecycle, folders in LAYOUT:
        fits = all_of(*(f"d.{c} = {lit(v)}" for c, v in (("role", role), ("kind", kind), ("lifecycle", lifecycle)) if v))
        cases += f" WHEN {fits} THEN NOT {starts('d.path', *folders)}"
    return f"CASE{cases} ELSE false END"


def rules(today: str) -> list[tuple[str, Rel]]:
    r = Rules()
    r.add("missing-frontmatter", "error", "doc_front d", subject="d.path", message="'no front matter'", where="d.has_frontmatter = 0")
    r.add("parse-error", "error", "doc_front d", subject="d.path", message="d.parse_error", where="d.parse_error IS NOT NULL AND d.has_frontmatter = 1")
    r.add("yaml-scalar-truncated-by-comment", "warning", "doc_front_line l", ("doc_front d", "d.id = l.doc_id"), subject="d.id", message="concat('line ', CAST(l.line AS STRING))", where=all_of(CHECKED, "regexp_like(l.text, '^\\s*[A-Za-z0-9_-]+:\\s*([^\"''>|\\[{\\s].*( #|: )|: )')"))
    for field in ("id", "title", "summary", "status"):
        r.doc("missing-field", "error", f"coalesce(d.{field}, '') = ''", lit(f"{field} is missing"))
    r.doc("missing-field", "error", "d.role IS NULL AND d.legacy_type IS NULL", "'role is missing'")
    r.doc("legacy-type-field", "error", "d.role IS NULL AND d.legacy_type IS NOT NULL", "concat('type ', d.legacy_type)")
    r.doc("unknown-role", "error", f"NOT {one_of('d.role', ROLES)}", "concat('role ', d.role)")
    for axis, known in (("kind", KINDS), ("lifecycle", LIFECYCLES)):
        r.doc("unknown-axis-value", "error", f"NOT {one_of(f'd.{axis}', known)}", f"concat('{axis} ', d.{axis})")
    r.add("unknown-axis-value", "error", "RELATES_TO l", subject="l.src", message="concat('relates_to_type ', l.type)", where=f"NOT {one_of('l.type', RELATIONS)}")
    for role, axes in REQUIRED_AXES.items():
        for axis in axes:
            r.doc("missing-axis-field", "warning", f"d.role = {lit(role)} AND d.{axis} IS NULL", lit(f"{axis} is missing"))
    for role, allowed in ALLOWED_LIFECYCLES.items():
        r.doc("lifecycle-not-allowed-for-role", "warning", f"d.role = {lit(role)} AND NOT {one_of('d.lifecycle', allowed)}", "concat('lifecycle ', d.lifecycle, ' on ', d.role)")
    for role, pattern in FILENAMES.items():
        r.doc("filename-pattern-mismatch", "warning", f"d.role = {lit(role)} AND NOT regexp_like(BASENAME(d.path), {lit(pattern)})", "concat('path ', d.path)")
    r.doc("wrong-folder", "warning", all_of("coalesce(d.lifecycle, '') <> 'archived'", _layout()), "concat('path ', d.path)")
    r.doc("unknown-entity", "error", "true", "concat('covers ', c.dst)", ("doc_covers c", "c.src = d.id"), ("anti", "Entity e", "e.id = c.dst"))
    r.doc("unknown-bounded-context", "error", "d.bounded_context IS NOT NULL", "concat('context ', d.bounded_context)", ("anti", "bounded_context b", "b.id = d.bounded_context"))
    r.add("unknown-bounded-context", "error", "entity_context c", ("anti", "bounded_context b", "b.id = c.context"), subject="c.entity", message="concat('context ', c.context)")
    r.doc("wrong-bounded-context-field", "warning", any_of("d.role = 'ontology-entity' AND d.bounded_context IS NOT NULL", "d.role <> 'ontology-entity' AND d.has_context_list = 1"), "CASE WHEN d.role = 'ontology-entity' THEN 'bounded_context for bounded_contexts' ELSE 'bounded_contexts for bounded_context' END")
    r.doc("invalid-status", "error", f"NOT {one_of('d.status', STATUSES)}", "concat('status ', d.status)")
    r.doc("invalid-visibility", "error", f"NOT {one_of('d.visibility', VISIBILITIES)}", "concat('visibility ', d.visibility)")
    r.doc("updated-in-future", "warning", f"d.updated > {lit(today)}", "concat('updated ', d.updated)")
    r.add("duplicate-id", "error", rel("Doc d", by={"id": "d.id"}, agg={"k": "count(*)"}, having="k > 1"), subject="id", message="concat(CAST(k AS STRING), ' documents')")
    r.doc("id-mismatch", "warning", "NOT endswith(concat(d.id, '.md'), concat('-', BASENAME(d.path)))", "concat('path ', d.path)")
    stems = rel("Doc x", out={"stem": "replace(BASENAME(x.path), '.md', '')"}, distinct=True)
    known = ("anti", "known_path x", "x.path = l.target")
    for kind, code, severity, where, joins in (
        ("wikilink", "broken-wikilink", "error", "true", (("anti", "Doc x", "x.id = l.target"), ("anti", stems, "z.stem = l.target", "z"), ("anti", "Entity y", "concat('entity-', y.id) = l.target"))),
        ("md", "broken-md-link", "error", "endswith(lower(l.target), '.md')", (known,)),
        ("md", "broken-file-link", "error", "NOT endswith(lower(l.target), '.md')", (known,)),
        ("path", "unlinked-path", "info", f"NOT {starts('l.target', *PATH_EXEMPT)}", ()),
    ):
        r.add(code, severity, "doc_target l", ("doc_front d", "d.id = l.src"), *joins, subject="l.src", message="concat('line ', CAST(l.line AS STRING), ': ', l.target)", where=all_of(CHECKED, f"l.kind = {lit(kind)}", where))
    r.add("broken-typed-edge", "error", "doc_target l", ("doc_front d", "d.id = l.src"), ("anti", "Doc x", "x.id = l.target"), subject="l.src", message="concat(l.kind, ' ', l.target)", where=all_of(CHECKED, one_of("l.kind", ("depends-on", "informed-by", "supersedes"))))
    r.doc("orphan-doc", "info", "true", "'no links either way'", ("anti", edges(), "i.dst = d.id", "i"), ("anti", edges(), "o.src = d.id", "o"))
    r.add("cross-context-reference", "warning", rel(
        "doc_term t", ("doc_front d", "d.id = t.doc_id"), ("Entity e", "e.display = t.term"), ("entity_context c", "c.entity = e.id"),
        ("anti", rel("Entity x", ("anti", "entity_context y", "y.entity = x.id"), out={"term": "x.display"}, distinct=True), "free.term = t.term", "free"),
        ("anti", rel("Entity x", ("entity_context y", "y.entity = x.id"), out={"term": "x.display", "context": "y.context"}, distinct=True), "same.term = t.term AND same.context = d.bounded_context", "same"),
        where=all_of(CHECKED, "d.bounded_context IS NOT NULL"), by={"doc": "t.doc_id", "term": "t.term"}, agg={"entity": "min(e.id)"}), subject="doc", message="concat(term, ' is ', entity)")
    r.add("comment-vocab-violation", "warning", "code_comment c", ("anti", "Entity e", "lower(e.display) = lower(c.term)"), subject="c.symbol", message="concat('term ', c.term)", where=all_of("contains(c.text, c.term)", f"NOT {one_of('c.term', ACCEPTED)}"))
    r.add("missing-anchor", "info", "code_comment c", ("anti", "FUNCTION_MENTIONS m", "m.src = c.symbol AND m.confidence = 'high'"), subject="c.symbol", message="'names no entity'", where=all_of(lacks("c.symbol", "/_", "#_"), lacks("c.text", "roadmap")))
    r.add("self-loop", "error", edges(), subject="src", message="concat(edge_type, ' to itself')", where="src = dst")
    r.doc("superseded-without-successor", "warning", "d.lifecycle = 'superseded'", "'no document supersedes it'", ("anti", "SUPERSEDES s", "s.dst = d.id"))
    r.add("dark-public-function", "info", "Function f", ("anti", "FUNCTION_MENTIONS m", "m.src = f.symbol"), subject="f.symbol", message="'no comment and no entity'", where=all_of("coalesce(f.doc_comment, '') = ''", "f.generated = 0", lacks("f.symbol", "/_", "#_"), lacks("f.file", "test")))
    r.add("dark-endpoint", "info", "Endpoint e", ("anti", "ENDPOINT_TOUCHES_ENTITY t", "t.src = e.id"), subject="e.id", message="'touches no entity'")
    funcs = rel("FUNCTION_MENTIONS m", by={"eid": "m.dst"}, agg={"n": "count(DISTINCT m.src)"})
    docs = rel("COVERS c", by={"eid": "c.dst"}, agg={"n": "count(DISTINCT c.src)"})
    r.add("entity-coverage-gap", "info", "Entity e", (funcs, "f.eid = e.id", "f"), ("left", docs, "d.eid = e.id", "d"), subject="e.id", message="concat(CAST(coalesce(d.n, 0) AS STRING), ' documents for ', CAST(f.n AS STRING), ' functions')", where=f"CAST(coalesce(d.n, 0) AS DOUBLE) / f.n < {FEW_DOCS}")
    reach = rel("Function f", ("left", rel("FUNCTION_MENTIONS m", out={"src": "m.src"}, distinct=True), "m.src = f.symbol", "m"), where="f.generated = 0", agg={"total": "count(f.symbol)", "reaching": "count(m.src)"})
    r.add("coverage-below-min", "error", reach, subject="'corpus'", message="concat(CAST(reaching AS STRING), ' of ', CAST(total AS STRING), ' functions reach an entity')", where=f"CASE WHEN total = 0 THEN 0.0 ELSE CAST(reaching AS DOUBLE) * 100 / total END < {LEAST_REACH}")
    r.add("orphan-entity", "warning", "Entity e", ("anti", "COVERS c", "c.dst = e.id"), ("anti", "doc_target l", "l.kind = 'wikilink' AND l.target = concat('entity-', e.id)"), subject="e.id", message="'no document covers or links it'")
    r.doc("missing-covers", "info", NARRATIVE, "'covers no entity'", ("anti", "COVERS c", "c.src = d.id"))
    r.doc("missing-bounded-context", "info", all_of(NARRATIVE, "d.bounded_context IS NULL"), "'no bounded context'")
    r.doc("placeholder-entity", "warning", all_of("d.role = 'ontology-entity'", "d.value_id = 'example'", has("d.description", "Placeholder domain entity")), "'still the template'")
    r.doc("missing-body-wikilink", "info", NARRATIVE, "concat('no link to ', c.dst)", ("COVERS c", "c.src = d.id AND c.inferred = 0"), ("anti", "doc_target l", "l.src = d.id AND l.kind = 'wikilink' AND l.target = concat('entity-', c.dst)"))
    r.add("unused-bounded-context", "info", "bounded_context b", ("anti", "doc_front d", "d.bounded_context = b.id"), subject="b.id", message="'no document uses it'")
    r.add("homepage-missing", "warning", "homepage h", subject="h.path", message="'no file'", where="h.text IS NULL")
    r.add("homepage-stale", "warning", "homepage h", subject="h.path", message="'differs from what it should be'", where="h.text <> h.expected")
    return r.made


def unauthored_clusters(report: DataFrame, names: DataFrame, entities: DataFrame, least_members: int = 5, least_density: float = 0.05, most: int = 10) -> DataFrame:
    """Dense communities (label, members, density) whose name (label, name) is no entity's id: the largest ``most``, as issues."""
    known = entities.select(F.col("id").alias("subject")).distinct()
    found = report.where((F.col("members") >= least_members) & (F.col("density") >= least_density)).join(names.select("label", slugify(F.col("name")).alias("subject")), "label")
    found = found.join(known, "subject", "left_anti").orderBy(F.desc("members"), "label").limit(most)
    return found.select(F.lit("unauthored-cluster").alias("code"), F.lit("info").alias("severity"), "subject", F.concat(F.col("members").cast("string"), F.lit(" members")).alias("message"))


#: What the registered queries take for today, so that all engines agree on old documents.
REGISTERED_DAY = "2024-12-15"


def plan(today: str | None = None) -> Rel:
    """All rules as one relation."""
    made = [r for _, r in rules(today or datetime.date.today().isoformat())]
    return Rel(made[0], "t", out={c: c for c in ("code", "severity", "subject", "message")}, union=made[1:])


def issues(tables: Mapping[str, DataFrame], today: str | None = None) -> DataFrame:
    return plan(today).spark(tables)


def summary(today: str | None = None) -> Rel:
    return rel(plan(today), by={"code": "code", "severity": "severity"}, agg={"issues": "count(*)"}, order=["code"])


def sql(of: Rel) -> str:
    return ctes(of.tables()) + of.sql()
