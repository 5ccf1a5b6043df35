"""What surrounds a node: contexts with capped neighbours, ego graphs with all kinds of nodes, the impact of a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import Tables, extra, held, reach, undirected

#: Links between documents.
DOC_EDGES = ("WIKILINK", "MD_LINK", "DEPENDS_ON", "INFORMED_BY", "SUPERSEDES")
NEIGHBOURS, MOST_NEIGHBOURS = 20, 50


def _doc_edges(t: Tables, names: tuple[str, ...] = DOC_EDGES) -> DataFrame:
    out = None
    for n in names:
        one = t[n].select("src", "dst", F.col("line").cast("long").alias("edge_line"), F.lit(n).alias("edge_kind"))
        out = one if out is None else out.unionByName(one)
    return out


def _as_doc(found: DataFrame, t: Tables, part: int, direction: str) -> DataFrame:
    """Neighbours (n, edge_kind, edge_line) that are documents."""
    d = t["Doc"].select(F.col("id").alias("n"), "title", "summary", "kind", "path")
    return found.join(d, "n").select(F.lit(part).alias("part"), F.col("n").alias("id"), "title", "summary", F.coalesce(F.expr("nullif(kind, '')"), F.lit("doc")).alias("kind"), "path", F.lit(direction).alias("direction"), "edge_kind", "edge_line")


def _doc_neighbours(t: Tables, node: str) -> DataFrame:
    e = _doc_edges(t)
    out = e.where(F.col("src") == node).select(F.col("dst").alias("n"), "edge_kind", "edge_line")
    back = e.where(F.col("dst") == node).select(F.col("src").alias("n"), "edge_kind", "edge_line")
    return _as_doc(out, t, 0, "outbound").unionByName(_as_doc(back, t, 1, "inbound"))


def _entity_neighbours(t: Tables, node: str) -> DataFrame:
    """Its own document, those that cover it, those that link to its own; each once, in that order."""
    own = f"entity-{node}"
    defined = t["Doc"].where(F.col("id") == own).select(F.col("id").alias("n"), F.lit("DEFINED_BY").alias("edge_kind"), F.lit(None).cast("long").alias("edge_line"))
    covers = t["COVERS"].where(F.col("dst") == node).select(F.col("src").alias("n"), F.lit("COVERS").alias("edge_kind"), F.col("line").cast("long").alias("edge_line"))
    linked = _doc_edges(t, ("WIKILINK", "MD_LINK")).where(F.col("dst") == own).select(F.col("src").alias("n"), "edge_kind", "edge_line")
    found = _as_doc(defined, t, 0, "outbound").unionByName(_as_doc(covers, t, 1, "inbound")).unionByName(_as_doc(linked, t, 2, "inbound"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("part", "edge_kind", F.col("edge_line").asc_nulls_first()))
    return found.withColumn("k", first).where("k = 1").drop("k")


def _function_neighbours(t: Tables, node: str) -> DataFrame:
    none = F.lit(None).cast("long").alias("edge_line")
    f = t["Function"].select(F.col("symbol").alias("id"), F.col("symbol").alias("title"), F.col("doc_comment").alias("summary"), F.lit("function").alias("kind"), F.col("file").alias("path"))
    e = t["Entity"].select("id", F.col("display").alias("title"), F.col("description").alias("summary"), F.lit("entity").alias("kind"), F.lit("").alias("path"))
    d = t["Doc"].select("id", "title", "summary", F.lit("doc").alias("kind"), "path")

    def part(k: int, edges: DataFrame, own: str, other: str, nodes: DataFrame, name: str, direction: Column) -> DataFrame:
        ids = edges.where(F.col(own) == node).select(F.col(other).alias("id")).distinct()
        return nodes.join(ids, "id", "left_semi").select(F.lit(k).alias("part"), "id", "title", "summary", "kind", "path", direction.alias("direction"), F.lit(name).alias("edge_kind"), none)

    no = F.lit(None).cast("string")
    out = part(0, t["CALLS"], "src", "dst", f, "CALLS_OUT", no)
    for k, edges, own, other, nodes, name in ((1, "CALLS", "dst", "src", f, "CALLS_IN"), (2, "FUNCTION_DEFINED_IN", "src", "dst", d, "DEFINED_IN"), (3, "FUNCTION_BELONGS_TO", "src", "dst", e, "BELONGS_TO")):
        out = out.unionByName(part(k, t[edges], own, other, nodes, name, no))
    return out


def node_kind(t: Tables, node: str) -> str:
    """doc, entity or function, the first that has the id."""
    found = None
    for k, (kind, table, key) in enumerate((("doc", "Doc", "id"), ("entity", "Entity", "id"), ("function", "Function", "symbol"))):
        one = t[table].where(F.col(key) == node).limit(1).select(F.lit(k).alias("k"), F.lit(kind).alias("kind"))
        found = one if found is None else found.unionByName(one)
    row = found.orderBy("k").first()
    if row is None:
        raise ValueError(f"unknown id {node}: no document, entity or function has it")
    return row.kind


def context_for(t: Tables, node: str, top: int = 0) -> DataFrame:
    """Neighbours (place, id, title, summary, kind, path, direction, edge_kind, edge_line) of a document, entity or function; 20 unless ``top`` says how many, 50 at most.  An unknown id is an error."""
    if top < 0:
        raise ValueError("top: 0 or more")
    most = min(top, MOST_NEIGHBOURS) if top else NEIGHBOURS
    kind = node_kind(t, node)
    found = {"doc": _doc_neighbours, "entity": _entity_neighbours, "function": _function_neighbours}[kind](t, node)
    order = ["part", "edge_kind", "id", F.col("edge_line").asc_nulls_first()] if kind == "doc" else ["part", "id", "edge_kind", F.col("edge_line").asc_nulls_first()]
    best = found.orderBy(*order).limit(most)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("part")  # a few rows


_NEAR = """SELECT CAST(row_number() OVER (ORDER BY part, {order}, edge_line NULLS FIRST) AS INTEGER) AS place, id, title, summary, kind, path, direction, edge_kind, edge_line FROM n ORDER BY place LIMIT {top}"""
_EDGES = " UNION ALL ".join(f"""SELECT src, dst, CAST(line AS BIGINT) AS edge_line, '{n}' AS edge_kind FROM "{n}\"""" for n in DOC_EDGES)
_DOC = """{part} AS part, d.id, d.title, d.summary, coalesce(nullif(d.kind, ''), 'doc') AS kind, d.path, '{way}' AS direction"""


@extra(
    "context_for_document",
    f""", e AS ({_EDGES}), n AS (SELECT {_DOC.format(part=0, way="outbound")}, e.edge_kind, e.edge_line FROM e JOIN "Doc" d ON d.id = e.dst WHERE e.src = 'audit-run-48'
    UNION ALL SELECT {_DOC.format(part=1, way="inbound")}, e.edge_kind, e.edge_line FROM e JOIN "Doc" d ON d.id = e.src WHERE e.dst = 'audit-run-48') """ + _NEAR.format(order="edge_kind, id", top=20),
    "Doc " + " ".join(DOC_EDGES),
)
def context_for_document(t: Tables) -> DataFrame:
    return context_for(t, "audit-run-48")


@extra(
    "context_for_an_entity",
    f""", x AS (SELECT {_DOC.format(part=0, way="outbound")}, 'DEFINED_BY' AS edge_kind, CAST(NULL AS BIGINT) AS edge_line FROM "Doc" d WHERE d.id = 'entity-brand-8'
    UNION ALL SELECT {_DOC.format(part=1, way="inbound")}, 'COVERS', CAST(c.line AS BIGINT) FROM "COVERS" c JOIN "Doc" d ON d.id = c.src WHERE c.dst = 'brand-8'
    UNION ALL SELECT {_DOC.format(part=2, way="inbound")}, e.edge_kind, e.edge_line FROM ({_EDGES}) e JOIN "Doc" d ON d.id = e.src WHERE e.dst = 'entity-brand-8' AND e.edge_kind IN ('WIKILINK', 'MD_LINK')),
    n AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY part, edge_kind, edge_line NULLS FIRST) = 1) """ + _NEAR.format(order="id, edge_kind", top=50),
    "Doc COVERS " + " ".join(DOC_EDGES),
)
def context_for_an_entity(t: Tables) -> DataFrame:
    return context_for(t, "brand-8", 500)


_FN = "{k} AS part, {key} AS id, {title} AS title, {summary} AS summary, '{kind}' AS kind, {path} AS path, CAST(NULL AS VARCHAR) AS direction, '{edge}' AS edge_kind, CAST(NULL AS BIGINT) AS edge_line"
_FUNCTION = {"key": "o.symbol", "title": "o.symbol", "summary": "o.doc_comment", "kind": "function", "path": "o.file"}


def _first_supplier(t: Tables) -> str:
    return t["Function"].where("startswith(symbol, 'supply/')").agg(F.min("symbol")).first()[0]


@extra(
    "context_for_a_function",
    f""", n AS (SELECT DISTINCT {_FN.format(k=0, edge="CALLS_OUT", **_FUNCTION)} FROM "CALLS" c JOIN "Function" o ON o.symbol = c.dst WHERE c.src = (SELECT min(symbol) FROM "Function" WHERE starts_with(symbol, 'supply/'))
    UNION ALL SELECT DISTINCT {_FN.format(k=1, edge="CALLS_IN", **_FUNCTION)} FROM "CALLS" c JOIN "Function" o ON o.symbol = c.src WHERE c.dst = (SELECT min(symbol) FROM "Function" WHERE starts_with(symbol, 'supply/'))
    UNION ALL SELECT DISTINCT {_FN.format(k=2, edge="DEFINED_IN", key="o.id", title="o.title", summary="o.summary", kind="doc", path="o.path")} FROM "FUNCTION_DEFINED_IN" c JOIN "Doc" o ON o.id = c.dst WHERE c.src = (SELECT min(symbol) FROM "Function" WHERE starts_with(symbol, 'supply/'))
    UNION ALL SELECT DISTINCT {_FN.format(k=3, edge="BELONGS_TO", key="o.id", title="o.display", summary="o.description", kind="entity", path="''")} FROM "FUNCTION_BELONGS_TO" c JOIN "Entity" o ON o.id = c.dst WHERE c.src = (SELECT min(symbol) FROM "Function" WHERE starts_with(symbol, 'supply/'))) """ + _NEAR.format(order="id, edge_kind", top=50),
    "Function CALLS FUNCTION_DEFINED_IN FUNCTION_BELONGS_TO Doc Entity",
)
def context_for_a_function(t: Tables) -> DataFrame:
    return context_for(t, _first_supplier(t), 50)


# ------------------------------------------------------------------ ego graph
def ego_edges(t: Tables, centre: str, depth: int = 2) -> DataFrame:
    """(source, target, type): relations and calls that meet an entity within depth - 1 steps of the centre, and the documents, functions and endpoints of those entities."""
    between = t["RELATES_TO"].select("src", "dst", F.lit("relates_to").alias("type")).unionByName(t["ENTITY_CALLS"].select("src", "dst", F.lit("entity_calls").alias("type"))).distinct()
    between = held(between)  # few, and read by each step
    start = t["Entity"].where(F.col("id") == centre).select("id")
    if depth < 1:
        return between.where("false").select(F.col("src").alias("source"), F.col("dst").alias("target"), "type")
    inner = reach(undirected(between), start, depth - 1).select("id")
    met = between.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(between.join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type"))
    out = met.select("src", "dst", "type")
    for table, name in (("COVERS", "covers"), ("FUNCTION_BELONGS_TO", "function_belongs_to"), ("ENDPOINT_TOUCHES_ENTITY", "endpoint_touches_entity")):
        out = out.unionByName(t[table].join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", F.lit(name).alias("type")))
    return out.distinct().select(F.col("src").alias("source"), F.col("dst").alias("target"), "type")


def ego_nodes(t: Tables, centre: str, depth: int = 2) -> DataFrame:
    """(node_kind, id, label) of the centre and both ends of :func:`ego_edges`."""
    edges = ego_edges(t, centre, depth)
    between = F.col("type").isin("relates_to", "entity_calls")
    ids = edges.select(F.col("target").alias("id")).unionByName(edges.where(between).select(F.col("source").alias("id"))).unionByName(t["Entity"].where(F.col("id") == centre).select("id")).distinct()
    out = t["Entity"].join(ids, "id", "left_semi").select(F.lit("entity").alias("node_kind"), "id", F.col("display").alias("label"))
    for name, table, key, label in (("covers", "Doc", "id", "title"), ("function_belongs_to", "Function", "symbol", "file"), ("endpoint_touches_entity", "Endpoint", "id", "path")):
        there = edges.where(F.col("type") == name).select(F.col("source").alias("id")).distinct()
        out = out.unionByName(t[table].select(F.col(key).alias("id"), F.col(label).alias("label")).join(there, "id", "left_semi").select(F.lit(table.lower()).alias("node_kind"), "id", "label"))
    return out


_EGO = """, b AS (SELECT DISTINCT src, dst, 'relates_to' AS type FROM "RELATES_TO" UNION SELECT DISTINCT src, dst, 'entity_calls' FROM "ENTITY_CALLS"),
    i AS (SELECT 'asia' AS id UNION SELECT dst FROM b WHERE src = 'asia' UNION SELECT src FROM b WHERE dst = 'asia'),
    e AS (SELECT * FROM b WHERE src IN (SELECT id FROM i) OR dst IN (SELECT id FROM i) UNION SELECT src, dst, 'covers' FROM "COVERS" WHERE dst IN (SELECT id FROM i)
      UNION SELECT src, dst, 'function_belongs_to' FROM "FUNCTION_BELONGS_TO" WHERE dst IN (SELECT id FROM i) UNION SELECT src, dst, 'endpoint_touches_entity' FROM "ENDPOINT_TOUCHES_ENTITY" WHERE dst IN (SELECT id FROM i))"""
_EGO_TABLES = "RELATES_TO ENTITY_CALLS COVERS FUNCTION_BELONGS_TO ENDPOINT_TOUCHES_ENTITY"


@extra("entity_ego_edges", _EGO + " SELECT src AS source, dst AS target, type FROM e", _EGO_TABLES)
def entity_ego_edges(t: Tables) -> DataFrame:
    return ego_edges(t, "asia", 2)


@extra(
    "entity_ego_nodes",
    _EGO + """ SELECT 'entity' AS node_kind, id, display AS label FROM "Entity" WHERE id = 'asia' OR id IN (SELECT dst FROM e) OR id IN (SELECT src FROM e WHERE type IN ('relates_to', 'entity_calls'))
    UNION ALL SELECT 'doc', id, title FROM "Doc" WHERE id IN (SELECT src FROM e WHERE type = 'covers') UNION ALL SELECT 'function', symbol, file FROM "Function" WHERE symbol IN (SELECT src FROM e WHERE type = 'function_belongs_to')
    UNION ALL SELECT 'endpoint', id, path FROM "Endpoint" WHERE id IN (SELECT src FROM e WHERE type = 'endpoint_touches_entity')""",
    _EGO_TABLES + " Entity Doc Function Endpoint",
)
def entity_ego_nodes(t: Tables) -> DataFrame:
    return ego_nodes(t, "asia", 2)


# --------------------------------------------------------------------- impact
def impact(t: Tables, symbol: str, depth: int = 3) -> DataFrame:
    """(part, id, depth, label): callers with their fewest steps, and the entities and endpoints of the function and its callers.  An unknown symbol is an error."""
    start = t["Function"].where(F.col("symbol") == symbol).select(F.col("symbol").alias("id"))
    if not start.limit(1).count():
        raise ValueError(f"unknown symbol {symbol}")
    chain = reach(t["CALLS"].select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, depth)
    callers = chain.where("depth > 0").join(t["Function"].select(F.col("symbol").alias("id"), "file"), "id").select(F.lit("caller").alias("part"), "id", F.col("depth").cast("int").alias("depth"), F.col("file").alias("label"))
    named = t["FUNCTION_MENTIONS"].select("src", "dst").unionByName(t["FUNCTION_BELONGS_TO"].select("src", "dst")).join(chain.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    none = F.lit(None).cast("int").alias("depth")
    entities = t["Entity"].join(named, "id", "left_semi").select(F.lit("entity").alias("part"), "id", none, F.col("display").alias("label"))
    handled = t["ENDPOINT_HANDLED_BY"].join(chain.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    endpoints = t["Endpoint"].join(handled, "id", "left_semi").select(F.lit("endpoint").alias("part"), "id", none, F.col("path").alias("label"))
    return callers.unionByName(entities).unionByName(endpoints)


@extra(
    "impact_whole",
    """, RECURSIVE r(id, depth) AS (SELECT symbol, 0 FROM "Function" WHERE symbol = (SELECT min(symbol) FROM "Function" WHERE starts_with(symbol, 'supply/')) UNION SELECT c.src, r.depth + 1 FROM r JOIN "CALLS" c ON c.dst = r.id WHERE r.depth < 2), m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)
    SELECT 'caller' AS part, m.id, m.depth, f.file AS label FROM m JOIN "Function" f ON f.symbol = m.id WHERE m.depth > 0
    UNION ALL SELECT 'entity', id, NULL, display FROM "Entity" WHERE id IN (SELECT dst FROM "FUNCTION_MENTIONS" WHERE src IN (SELECT id FROM m) UNION SELECT dst FROM "FUNCTION_BELONGS_TO" WHERE src IN (SELECT id FROM m))
    UNION ALL SELECT 'endpoint', id, NULL, path FROM "Endpoint" WHERE id IN (SELECT src FROM "ENDPOINT_HANDLED_BY" WHERE dst IN (SELECT id FROM m))""",
    "Function CALLS Entity FUNCTION_MENTIONS FUNCTION_BELONGS_TO Endpoint ENDPOINT_HANDLED_BY",
)
def impact_whole(t: Tables) -> DataFrame:
    return impact(t, _first_supplier(t), 2)
