"""What tools do around the queries: paging, the list of queries, contexts, snippets, exports, and facts from a code index."""

from __future__ import annotations

import difflib
import os
import re
import tomllib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import simple_name
from ..plans.relation import rel
from ..sources import code_index
from .analytics import Tables, extra, reach, undirected
from .catalog.base import CATALOG, all_of, cols, define
from .typed import DARK, FN, PUBLIC, TOOL, edges


def page(df: DataFrame, order: list[Column], offset: int = 0, top: int = 50) -> DataFrame:
    """One page in an order that is total, with the number of all rows as ``total``."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(top).crossJoin(F.broadcast(total))  # one row


# ------------------------------------------------------- the list of queries
def available(tables: Mapping[str, DataFrame]) -> list[str]:
    """Names of the queries all of whose tables hold rows."""
    empty = {n for n in {n for q in CATALOG.values() for n in q.needs()} if not tables[n].limit(1).count()}
    return sorted(n for n, q in CATALOG.items() if not q.needs() & empty)


def saved(name: str):
    """The query of a name; an unknown one is an error that names the nearest."""
    if name not in CATALOG:
        near = difflib.get_close_matches(name, CATALOG, n=1, cutoff=0)
        raise KeyError(f"no query {name}; the nearest is {near[0]}")
    return CATALOG[name]


def load_queries(folder: str) -> dict[str, dict]:
    """Queries of ``*.toml`` files (name, description, params, sql) in a folder, in the order of their names; broken files are skipped."""
    found = {}
    for x in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if x.endswith(".toml"):
            try:
                with open(f"{folder}/{x}", "rb") as f:
                    q = tomllib.load(f)
                found[q["name"]] = {"name": q["name"], "description": q.get("description", ""), "params": list(q.get("params", [])), "sql": q["sql"], "origin": "corpus-local"}
            except (tomllib.TOMLDecodeError, KeyError):
                continue
    return found


def run_loaded(spark: SparkSession, tables: Mapping[str, DataFrame], query: dict, **given: str) -> DataFrame:
    """Run a loaded query: ``$name`` are its parameters, ``name=default`` among its params gives a default."""
    from ..sources.store import guarded_sql

    values = dict(p.split("=", 1) for p in query["params"] if "=" in p) | given
    names = [p.split("=", 1)[0] for p in query["params"]]
    if missing := [n for n in names if n not in values]:
        raise ValueError(f"{query['name']}: missing parameter {', '.join(missing)}")
    text = re.sub(r"\$([A-Za-z_]\w*)", r":\1", query["sql"])
    return guarded_sql(spark, tables, text, **{n: values[n] for n in names})


# ----------------------------------------------------------------- contexts
define(TOOL, "query-doc", "a document's links both ways, and what covers the entity behind it", lambda p: rel(
    edges(), ("Doc o", "o.id = r.dst"), alias="r", where=f"r.src = {p.id}", out={"direction": "'out'", "relation": "r.edge_type", "id": "o.id", "title": "o.title", "line": "r.line"},
    union=[
        rel(edges(), ("Doc o", "o.id = r.src"), alias="r", where=f"r.dst = {p.id}", out={"direction": "'in'", "relation": "r.edge_type", "id": "o.id", "title": "o.title", "line": "r.line"}),
        rel("COVERS c", ("Doc o", "o.id = c.src"), where=f"concat('entity-', c.dst) = {p.id}", out={"direction": "'in'", "relation": "'covers'", "id": "o.id", "title": "o.title", "line": "c.line"}),
    ], order=["direction", "id", "relation", "line"],
), id="audit-run-48")
define(TOOL, "context-for-entity", "what is around an entity, at most 50", lambda p: rel(
    "COVERS c", ("Doc o", "o.id = c.src"), where=f"c.dst = {p.id}", out={"kind": "'doc'", "relation": "'covered_by'", "id": "o.id", "title": "o.title"},
    union=[
        rel("FUNCTION_MENTIONS m", ("Function o", "o.symbol = m.src"), where=f"m.dst = {p.id}", out={"kind": "'function'", "relation": "'mentioned_by'", "id": "o.symbol", "title": "o.file"}),
        rel("RELATES_TO r", ("Entity o", "o.id = r.dst"), where=f"r.src = {p.id}", out={"kind": "'entity'", "relation": "r.type", "id": "o.id", "title": "o.display"}),
        rel("ENTITY_CALLS r", ("Entity o", "o.id = r.dst"), where=f"r.src = {p.id}", out={"kind": "'entity'", "relation": "'calls'", "id": "o.id", "title": "o.display"}),
        rel("ENDPOINT_TOUCHES_ENTITY t", ("Endpoint o", "o.id = t.src"), where=f"t.dst = {p.id}", out={"kind": "'endpoint'", "relation": "'touched_by'", "id": "o.id", "title": "o.path"}),
    ], order=["kind", "relation", "id"], limit=50,
), id="brand-8")
define(TOOL, "context-for-function", "what is around a function, at most 50", lambda p: rel(
    "CALLS c", ("Function o", "o.symbol = c.dst"), where=f"c.src = {p.symbol}", out={"kind": "'function'", "relation": "'calls'", "id": "o.symbol", "title": "o.file"}, distinct=True,
    union=[
        rel("CALLS c", ("Function o", "o.symbol = c.src"), where=f"c.dst = {p.symbol}", out={"kind": "'function'", "relation": "'called_by'", "id": "o.symbol", "title": "o.file"}, distinct=True),
        rel("FUNCTION_MENTIONS m", ("Entity o", "o.id = m.dst"), where=f"m.src = {p.symbol}", out={"kind": "'entity'", "relation": "'mentions'", "id": "o.id", "title": "o.display"}),
        rel("USES_TYPE u", ("Type o", "o.symbol = u.dst"), where=f"u.src = {p.symbol}", out={"kind": "'type'", "relation": "'uses_type'", "id": "o.symbol", "title": "o.kind"}, distinct=True),
        rel("FUNCTION_DEFINED_IN d", ("Doc o", "o.id = d.dst"), where=f"d.src = {p.symbol}", out={"kind": "'doc'", "relation": "'defined_in'", "id": "o.id", "title": "o.title"}),
    ], order=["kind", "relation", "id"], limit=50,
), symbol="supply/n4/s77().")
define(TOOL, "list-dark-functions-in-crate", "functions of a crate, by the first part of the symbol, without a word about them", lambda p: rel("Function f", DARK, where=all_of(PUBLIC, f"startswith(f.symbol, concat({p.crate}, '/'))"), out=cols("f", FN), order=["symbol"]), crate="supply")
define(TOOL, "list-migrations", "migrations from a version on", lambda p: rel("Migration m", where=f"m.to_version >= CAST({p.since} AS INT)", out=cols("m", "id from_version to_version about"), order=["from_version", "id"]), since="2")
define(TOOL, "list-repos", "repositories of the corpus", lambda p: rel("Repo r", out=cols("r", "id root docs"), order=["id"]))
define(TOOL, "god-entities-in-report", "the three entities that most functions mention", lambda p: rel("FUNCTION_MENTIONS m", by={"id": "m.dst"}, agg={"func_count": "count(DISTINCT m.src)"}, having="func_count > 0", order=["-func_count", "id"], limit=3))
define(TOOL, "endpoints-without-entity", "endpoints of a kind that touch nothing", lambda p: rel("Endpoint e", ("anti", "ENDPOINT_TOUCHES_ENTITY t", "t.src = e.id"), where=f"e.kind = {p.kind}", out=cols("e", "id kind method path"), order=["id"]), kind="flask")


@extra(
    "entity_subgraph",
    """, l AS (SELECT src, dst FROM "RELATES_TO" UNION SELECT dst, src FROM "RELATES_TO"), n0 AS (SELECT 'europe' AS id), n1 AS (SELECT id FROM n0 UNION SELECT l.dst FROM n0 JOIN l ON l.src = n0.id), n2 AS (SELECT id FROM n1 UNION SELECT l.dst FROM n1 JOIN l ON l.src = n1.id)
    SELECT e.id, e.display, e.is_god_node, CASE WHEN e.id IN (SELECT id FROM n0) THEN 0 WHEN e.id IN (SELECT id FROM n1) THEN 1 ELSE 2 END AS depth FROM "Entity" e JOIN n2 ON n2.id = e.id""",
    "RELATES_TO Entity",
)
def entity_subgraph(t: Tables, centre: str = "europe", depth: int = 2) -> DataFrame:
    """Entities within some relations of one, god nodes first."""
    near = reach(undirected(t["RELATES_TO"]), t["Entity"].where(F.col("id") == centre).select("id"), depth)
    return near.join(t["Entity"], "id").select("id", "display", "is_god_node", "depth").orderBy(F.desc("is_god_node"), "id")


# ------------------------------------------------------ facts of a code index
_INNER = """, f AS (SELECT * FROM "index_definition" WHERE kind = 'function'), o AS (SELECT DISTINCT file, symbol, line FROM "index_occurrence" WHERE role = 'reference'),
    r AS (SELECT o.*, d.symbol AS enc, row_number() OVER (PARTITION BY o.file, o.symbol, o.line ORDER BY d.end_line - d.begin_line, d.symbol) AS k FROM o JOIN f d ON d.file = o.file AND o.line BETWEEN d.begin_line AND d.end_line),
    u AS (SELECT enc AS src, symbol AS dst, file, line FROM r WHERE k = 1 AND enc <> symbol)"""
_INDEX = "index_definition index_occurrence index_relation"


@extra(
    "derive_index_calls",
    _INNER + """, b AS (SELECT DISTINCT src, dst, file AS source_file, line AS source_line FROM u WHERE ends_with(dst, ').')),
    i AS (SELECT DISTINCT src, dst FROM "index_relation" WHERE src <> dst AND ends_with(src, ').') AND ends_with(dst, ').') AND dst IN (SELECT symbol FROM "index_definition"))
    SELECT b.*, 0 AS dispatch FROM b UNION ALL SELECT DISTINCT b.src, i.src, b.source_file, b.source_line, 1 FROM b JOIN i ON i.dst = b.dst WHERE i.src <> b.src""",
    _INDEX,
)
def derive_index_calls(t: Tables) -> DataFrame:
    return code_index.calls(t["index_definition"], t["index_occurrence"], t["index_relation"])


_FIRST = " SELECT src, dst, arg_min(file, (file, line)) AS source_file, arg_min(line, (file, line)) AS source_line FROM u WHERE {} GROUP BY src, dst"


@extra("derive_index_uses_type", _INNER + _FIRST.format("ends_with(dst, '#')"), _INDEX)
def derive_index_uses_type(t: Tables) -> DataFrame:
    return code_index.uses_type(t["index_definition"], t["index_occurrence"])


@extra("derive_index_field_references", _INNER + _FIRST.format("ends_with(dst, '.') AND contains(dst, '#') AND NOT ends_with(dst, ').')"), _INDEX)
def derive_index_field_references(t: Tables) -> DataFrame:
    return code_index.field_references(t["index_definition"], t["index_occurrence"])


@extra(
    "derive_index_type_relations",
    """, k AS (SELECT symbol, min(kind) AS kind FROM "index_definition" WHERE kind <> 'function' GROUP BY symbol)
    SELECT DISTINCT r.src, r.dst, CASE WHEN a.kind = 'trait' AND b.kind = 'trait' THEN 'extends' ELSE 'implements' END AS relation FROM "index_relation" r JOIN k a ON a.symbol = r.src LEFT JOIN k b ON b.symbol = r.dst WHERE r.src <> r.dst AND r.dst <> ''""",
    _INDEX,
)
def derive_index_type_relations(t: Tables) -> DataFrame:
    return code_index.type_relations(t["index_definition"], t["index_relation"])


@extra(
    "derive_index_imports",
    """, h AS (SELECT DISTINCT symbol, file FROM "index_definition"), o AS (SELECT DISTINCT file, symbol, line FROM "index_occurrence" WHERE role = 'import')
    SELECT o.file AS src, h.file AS dst, count(*) AS import_count FROM o JOIN h ON h.symbol = o.symbol WHERE o.file <> h.file GROUP BY 1, 2""",
    _INDEX,
)
def derive_index_imports(t: Tables) -> DataFrame:
    return code_index.imports(t["index_definition"], t["index_occurrence"])


def handlers(endpoints: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, symbol) of endpoints (id, kind, handler, source_file, source_line): the function of that name, if it is
    the only one; else the only one of the file; for jaxrs the first of the file at or below the line; else the only
    one of the crate (the first folder); else none."""
    named = functions.select(simple_name(F.col("symbol")).alias("handler"), "symbol", "file", "line")
    crate = lambda path: F.split(path, "/")[0]
    e = endpoints.join(named, "handler")
    same_file, same_crate = F.col("file") == F.col("source_file"), crate(F.col("file")) == crate(F.col("source_file"))
    below = same_file & (F.col("line") >= F.col("source_line"))
    pick = lambda c: (F.count_if(c), F.min(F.when(c, F.col("symbol"))))
    (n, one), (nf, onef), (nc, onec) = pick(F.lit(True)), pick(same_file), pick(same_crate)
    jax = F.min(F.when(below & (F.col("kind") == "jaxrs"), F.struct("line", "symbol")))["symbol"]
    found = e.groupBy("id").agg(F.when(n == 1, one).when(nf == 1, onef).when((nf > 1) & jax.isNotNull(), jax).when(nc == 1, onec).alias("symbol"))
    return found.where("symbol IS NOT NULL")


# ------------------------------------------------------------- files and text
def snippet(text: Column, words: list[str], most: int = 200) -> Column:
    """A window of ``most`` characters around the first of the words, or the head; marked where it was cut."""
    body = F.trim(F.coalesce(text, F.lit("")))
    size, lower = F.length(body), F.lower(body)
    at = F.array_min(F.filter(F.array(*[F.instr(lower, w) for w in words if w]), lambda x: x > 0)) if any(words) else F.lit(None).cast("int")
    start = F.least(F.greatest(F.coalesce(at, F.lit(1)) - 1 - most // 2, F.lit(0)), F.greatest(size - most, F.lit(0)))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(body, start + 1, F.lit(most)), F.when(start + most < size, "…").otherwise(""))
    return F.when(size <= most, body).otherwise(cut)


def sitemap(docs: DataFrame) -> DataFrame:
    """One JSON object for each document, by id."""
    return docs.orderBy("id").select(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).alias("json"))


def export(docs: DataFrame, strip: tuple[str, ...] = ("internal", "secret"), include: tuple[str, ...] = ("*",)) -> DataFrame:
    """Documents (path, visibility, ...) that may be published: not of a stripped visibility, and under an included glob."""
    fits = F.lit(False)
    for g in include:
        fits = fits | F.col("path").rlike(glob_pattern(g))
    return docs.where(fits & ~F.coalesce(F.col("visibility").isin(*strip), F.lit(False)))


def glob_pattern(glob: str) -> str:
    """A pattern for whole paths; ``*`` stays within a folder, ``**`` does not."""
    if glob == "*":
        return ".*"
    return "^" + re.sub(r"\\\*\\\*/?", ".*", re.escape(glob)).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$"


def modules_by_glob(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, module) of files (path) and modules (module, globs): the few globs are turned to patterns, one pass over the files."""
    rows = [(r.module, g) for r in modules.collect() for g in r.globs]  # a configuration
    found = [F.when(F.col("path").rlike(glob_pattern(g)), F.lit(m)) for m, g in rows]
    return files.select("path", F.explode(F.array_distinct(F.array_compact(F.array(*found)))).alias("module")) if found else files.select("path", F.lit("").alias("module")).limit(0)


def git_dates(commits: DataFrame) -> DataFrame:
    """(file, at): the newest commit of each file."""
    return commits.groupBy("file").agg(F.max("at").alias("at"))


def merge_endpoints(markers: DataFrame, extracted: DataFrame, exempt: tuple[str, ...] = ()) -> DataFrame:
    """Endpoints by marker win over extracted ones of the same method and path; one row an id."""
    rest = extracted.join(markers.select("method", "path").distinct(), ["method", "path"], "left_anti").select(*extracted.columns)
    both = markers.withColumn("_k", F.lit(0)).unionByName(rest.withColumn("_k", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("id").orderBy("_k", "source_file", "source_line"))
    return both.withColumn("_n", first).where("_n = 1").drop("_k", "_n").where(~F.col("id").isin(*exempt) if exempt else F.lit(True))


def endpoint_markers(comments: DataFrame) -> DataFrame:
    """(id, kind, method, path, source_file, source_line) of comment lines ``@endpoint METHOD path`` in (file, line, text)."""
    method, path = F.upper(F.regexp_extract("text", r"^\s*@endpoint\s+([A-Za-z]+)\s+\S", 1)), F.regexp_extract("text", r"^\s*@endpoint\s+[A-Za-z]+\s+(\S+)", 1)
    return comments.withColumn("method", method).where("method <> ''").select(F.concat_ws(":", F.lit("marker"), "method", path).alias("id"), F.lit("marker").alias("kind"), "method", path.alias("path"), F.col("file").alias("source_file"), F.col("line").alias("source_line"))
