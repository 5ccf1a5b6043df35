"""Derivations, scores, searches and traversals that are more than one plan.

Each function takes the graph tables (a mapping of names to DataFrames) and
returns a DataFrame.  ``EXTRA`` holds those registered as queries: name to
(function of tables, SQL or None).
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.driver_tables import ctes

Tables = Mapping[str, DataFrame]
EXTRA: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def extra(name: str, sql: str | None = None, needs: str = ""):
    def add(f):
        text = ctes(set(needs.split())) + sql if sql else None
        if text and "RECURSIVE" in text:
            text = text.replace("RECURSIVE ", "").replace("WITH ", "WITH RECURSIVE ", 1)
        EXTRA[name] = (f, text)
        return f

    return add


# ------------------------------------------------------------------- ranks
@extra("ranked_entities", 'SELECT row_number() OVER (ORDER BY mention_count DESC, id) AS rank, id, display, mention_count FROM "Entity"', "Entity")
def ranked_entities(t: Tables) -> DataFrame:
    """Entities by mentions; the entities of a corpus are few, so one ordered window ranks them."""
    return t["Entity"].select(F.row_number().over(Window.orderBy(F.desc("mention_count"), "id")).cast("long").alias("rank"), "id", "display", "mention_count")


# ------------------------------------------------------------- derivations
def co_change(commits: DataFrame, most_files: int = 50, least_commits: int = 3, least_jaccard: float = 0.2) -> DataFrame:
    """Coupling of files from (commit, file, at): unordered pairs within a commit, without commits of over ``most_files``."""
    once = commits.groupBy("commit", "file").agg(F.max("at").alias("at"))
    small = once.join(once.groupBy("commit").count().where(F.col("count") <= most_files).select("commit"), "commit", "left_semi")
    per_file = small.groupBy("file").agg(F.count("*").alias("n"))
    pairs = small.alias("a").join(small.alias("b"), F.expr("a.commit = b.commit AND a.file < b.file"))
    pairs = pairs.groupBy(F.col("a.file").alias("src"), F.col("b.file").alias("dst")).agg(F.count("*").alias("commits"), F.max("a.at").alias("last_co_change_at"))
    pairs = pairs.where(F.col("commits") >= least_commits)
    both = pairs.join(per_file.select(F.col("file").alias("src"), F.col("n").alias("ns")), "src").join(per_file.select(F.col("file").alias("dst"), F.col("n").alias("nd")), "dst")
    return both.withColumn("jaccard", F.col("commits") / (F.col("ns") + F.col("nd") - F.col("commits"))).where(F.col("jaccard") >= least_jaccard).select("src", "dst", "commits", "jaccard", "last_co_change_at")


def _driver_commits(t: Tables) -> DataFrame:
    orders = t["orders"].select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("commit"))
    files = t["lineitem"].join(t["supplier"], F.expr("s_suppkey = l_suppkey")).select("l_orderkey", F.format_string("n%d.py", "s_nationkey").alias("file"))
    return orders.join(files, F.expr("o_orderkey = l_orderkey")).select("commit", "file", F.col("commit").alias("at"))


@extra(
    "derive_co_change",
    """
    WITH c AS (SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS k, 'n' || s_nationkey || '.py' AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey),
    s AS (SELECT * FROM c WHERE k IN (SELECT k FROM c GROUP BY k HAVING count(*) <= 50)), n AS (SELECT f, count(*) AS n FROM s GROUP BY f),
    p AS (SELECT a.f AS src, b.f AS dst, count(*) AS commits, max(a.k) AS last_co_change_at FROM s a JOIN s b ON a.k = b.k AND a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT src, dst, commits, commits / CAST(x.n + y.n - commits AS DOUBLE) AS jaccard, last_co_change_at FROM p JOIN n x ON x.f = src JOIN n y ON y.f = dst WHERE commits / CAST(x.n + y.n - commits AS DOUBLE) >= 0.05
    """,
)
def derive_co_change(t: Tables) -> DataFrame:
    return co_change(_driver_commits(t), least_jaccard=0.05)


def entity_calls(calls: DataFrame, belongs: DataFrame) -> DataFrame:
    """Calls between the entities that functions belong to: (src, dst, frequency, weight)."""
    a, b = belongs.select(F.col("src").alias("s"), F.col("dst").alias("ea")), belongs.select(F.col("src").alias("d"), F.col("dst").alias("eb"))
    return _weighed(calls.join(a, F.expr("src = s")).join(b, F.expr("dst = d")).where("ea <> eb").groupBy(F.col("ea").alias("src"), F.col("eb").alias("dst")).agg(F.count("*").alias("frequency")))


def _weighed(found: DataFrame) -> DataFrame:
    top = found.agg(F.max("frequency").alias("top"))
    return found.crossJoin(top).select("src", "dst", "frequency", (F.col("frequency") / F.col("top")).alias("weight"))


@extra(
    "derive_entity_calls",
    """, f AS (SELECT a.dst AS src, b.dst AS dst, count(*) AS frequency FROM "CALLS" c JOIN "FUNCTION_BELONGS_TO" a ON a.src = c.src JOIN "FUNCTION_BELONGS_TO" b ON b.src = c.dst WHERE a.dst <> b.dst GROUP BY 1, 2)
    SELECT src, dst, frequency, CAST(frequency AS DOUBLE) / (SELECT max(frequency) FROM f) AS weight FROM f""",
    "CALLS FUNCTION_BELONGS_TO",
)
def derive_entity_calls(t: Tables) -> DataFrame:
    if "belongs_calls" in t:
        return _weighed(held(t["belongs_calls"]))  # few pairs of entities, read twice
    return entity_calls(t["CALLS"], t["FUNCTION_BELONGS_TO"])


def god_nodes(entities: DataFrame, mentions: DataFrame, unranked: tuple[str, ...] = ("language", "infrastructure")) -> DataFrame:
    """Entities with their distinct mentioning functions; a god node is over the mean by two standard deviations."""
    n = mentions.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("mentions"))
    all_ = entities.select("id", "entity_class").join(n, "id", "left").fillna(0, ["mentions"])
    rank = ~F.coalesce(F.col("entity_class").isin(*unranked), F.lit(False))
    cut = all_.where(rank).agg((F.avg("mentions") + 2 * F.stddev_pop("mentions")).alias("cut"))
    return all_.crossJoin(cut).select("id", "mentions", F.when(rank & (F.col("mentions") > F.col("cut")) & (F.col("mentions") > 0), 1).otherwise(0).alias("is_god_node"))


@extra(
    "derive_god_nodes",
    """, n AS (SELECT e.id, count(DISTINCT m.src) AS mentions FROM "Entity" e LEFT JOIN "FUNCTION_MENTIONS" m ON m.dst = e.id GROUP BY e.id)
    SELECT id, mentions, CASE WHEN mentions > (SELECT avg(mentions) + 2 * stddev_pop(mentions) FROM n) AND mentions > 0 THEN 1 ELSE 0 END AS is_god_node FROM n""",
    "Entity FUNCTION_MENTIONS",
)
def derive_god_nodes(t: Tables) -> DataFrame:
    return god_nodes(t["Entity"], t["FUNCTION_MENTIONS"])


@extra("derive_endpoint_touches", """SELECT DISTINCT h.src, m.dst FROM "ENDPOINT_HANDLED_BY" h JOIN (SELECT src, dst FROM "FUNCTION_MENTIONS" UNION SELECT src, dst FROM "FUNCTION_BELONGS_TO") m ON m.src = h.dst""", "ENDPOINT_HANDLED_BY FUNCTION_MENTIONS FUNCTION_BELONGS_TO")
def derive_endpoint_touches(t: Tables) -> DataFrame:
    """Entities that the handler of an endpoint mentions or belongs to."""
    named = t["FUNCTION_MENTIONS"].select(F.col("src").alias("f"), "dst").unionByName(t["FUNCTION_BELONGS_TO"].select(F.col("src").alias("f"), "dst"))
    return t["ENDPOINT_HANDLED_BY"].select("src", F.col("dst").alias("f")).join(named, "f").select("src", "dst").distinct()


def method_of(functions: DataFrame, types: DataFrame) -> DataFrame:
    """The type whose symbol is the longest prefix of a function's; prefixes end at a # or /, so an equality joins them."""
    parts = functions.select("symbol", F.posexplode(F.split("symbol", "(?<=[#/])")).alias("k", "part"))
    w = Window.partitionBy("symbol").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    prefixes = parts.select("symbol", "k", F.concat_ws("", F.collect_list("part").over(w)).alias("prefix"))
    found = prefixes.join(types.select(F.col("symbol").alias("prefix")), "prefix")
    return found.groupBy("symbol").agg(F.max_by("prefix", "k").alias("dst")).select(F.col("symbol").alias("src"), "dst")


def test_for(functions: DataFrame) -> DataFrame:
    """Test functions named test_X with the functions named X: high confidence if there is one, else low."""
    name = F.regexp_extract("symbol", r"([A-Za-z0-9_]+)\(\)\.?$", 1)
    named = functions.select("symbol", "file", name.alias("name"))
    in_test = F.col("file").contains("test")
    tests = named.where(in_test & F.col("name").startswith("test_")).select(F.col("symbol").alias("src"), F.expr("substring(name, 6)").alias("name"))
    real = named.where(~in_test).select(F.col("symbol").alias("dst"), "name")
    return tests.join(real, "name").withColumn("n", F.count("*").over(Window.partitionBy("src"))).select("src", "dst", F.when(F.col("n") == 1, "high").otherwise("low").alias("confidence"))


# ---------------------------------------------------------------- coverage
@extra(
    "coverage_by_entity_report",
    """, f AS (SELECT m.dst AS id, count(DISTINCT m.src) AS n FROM "FUNCTION_MENTIONS" m GROUP BY m.dst), d AS (SELECT dst AS id, count(DISTINCT src) AS n FROM "COVERS" GROUP BY dst),
    r AS (SELECT e.id, coalesce(f.n, 0) AS func_count, coalesce(d.n, 0) AS doc_count FROM "Entity" e LEFT JOIN f ON f.id = e.id LEFT JOIN d ON d.id = e.id)
    SELECT id, func_count, doc_count, CASE WHEN func_count = 0 THEN NULL ELSE round(CAST(doc_count AS DOUBLE) / func_count, 4) END AS score,
      CASE WHEN func_count = 0 THEN 'no-functions' WHEN CAST(doc_count AS DOUBLE) / func_count < 0.05 THEN 'under-documented' WHEN CAST(doc_count AS DOUBLE) / func_count < 0.2 THEN 'thin' WHEN CAST(doc_count AS DOUBLE) / func_count > 5 THEN 'over-documented' ELSE 'balanced' END AS verdict FROM r""",
    "Entity FUNCTION_MENTIONS COVERS",
)
def coverage_report(t: Tables) -> DataFrame:
    """Documents for the functions of each entity, with a verdict."""
    f = t["FUNCTION_MENTIONS"].groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("func_count"))
    d = t["COVERS"].groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("doc_count"))
    r = t["Entity"].select("id").join(f, "id", "left").join(d, "id", "left").fillna(0)
    score = F.col("doc_count") / F.expr("nullif(func_count, 0)")
    verdict = F.when(F.col("func_count") == 0, "no-functions").when(score < 0.05, "under-documented").when(score < 0.2, "thin").when(score > 5, "over-documented").otherwise("balanced")
    return r.select("id", "func_count", "doc_count", F.round(score, 4).alias("score"), verdict.alias("verdict"))


# -------------------------------------------------------------- similarity
# Words too common to search for.
STOPWORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "her", "was", "one", "our", "out", "day", "get", "has", "him", "his", "how", "man", "new", "now", "old",
    "see", "two", "way", "who", "boy", "did", "its", "let", "put", "say", "she", "too", "use", "from", "with", "this", "that", "they", "have", "what", "when", "your", "which",
    "their", "would", "there", "these", "those", "into", "than", "then", "them", "such", "only", "some", "more", "much", "very", "most", "also", "other", "where", "while", "after", "before",
)


def tokens(text):
    """Lower-case runs of ASCII letters and digits of two or more, without stop words."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.filter(found, lambda x: (F.length(x) >= 2) & ~x.isin(*STOPWORDS))


def query_tokens(query: str) -> list[str]:
    return [x for x in re.split(r"[^a-z0-9]+", query.lower()) if len(x) >= 2 and x not in STOPWORDS]


def bm25(docs: DataFrame, query: str, top: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The best of (id, text) for a query; a word that the query repeats scores as often.

    Only the query's words are exploded: term counts come from the filtered
    arrays, so the shuffle holds a row per document and word that matches.
    """
    words = query_tokens(query)
    if not words:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    base = docs.select("id", tokens(F.col("text")).alias("w")).withColumn("dl", F.size("w"))
    stats = base.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = base.select("id", "dl", F.explode(F.filter("w", lambda x: x.isin(*sorted(set(words))))).alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.create_map(*[x for w in sorted(set(words)) for x in (F.lit(w), F.lit(float(words.count(w))))])
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # a row per query word, and one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight[F.col("term")] * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest("avgdl", F.lit(1.0))))
    return scored.groupBy("id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(top)


_BM25 = """, d AS (SELECT id, list_filter(string_split_regex(lower(concat_ws(' ', title, summary, text)), '[^a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ({stop})) AS w FROM "Doc" JOIN documents ON doc_id = dkey),
    s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d), h AS (SELECT id, len(w) AS dl, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM d) WHERE term IN ({words}) GROUP BY id, dl, term), f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
    SELECT id, round(sum(q.k * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(a, 1)))), 6) AS score
    FROM h JOIN f USING (term) JOIN (SELECT term, count(*) AS k FROM (VALUES {rows}) AS v(term) GROUP BY term) q USING (term), s GROUP BY id HAVING score > 0 ORDER BY score DESC, id LIMIT 10"""
QUERY = "graph similarity query expansion anan graph"


def _bm25_sql(query: str) -> str:
    words = query_tokens(query)
    quote = lambda xs: ", ".join(f"'{x}'" for x in xs)
    return _BM25.format(stop=quote(STOPWORDS), words=quote(sorted(set(words))), rows=", ".join(f"('{w}')" for w in words))


@extra("similar_docs_bm25", _bm25_sql(QUERY), "Doc")
def similar_docs(t: Tables) -> DataFrame:
    """Over titles, summaries and whole texts."""
    whole = t["Doc"].join(t["documents"].select(F.col("doc_id").alias("dkey"), "text"), "dkey")
    return bm25(whole.select("id", F.concat_ws(" ", "title", "summary", "text").alias("text")), QUERY)


def cosine_top(vectors: DataFrame, query: list[float], top: int = 10) -> DataFrame:
    """The nearest of (id, embedding) by cosine, exactly: one pass, no shuffle but the top of each partition."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    e = F.col("embedding").cast("array<double>")
    norm = F.sqrt(dot(e, e)) * F.sqrt(dot(q, q))
    return vectors.select("id", F.round(F.when(norm > 0, dot(e, q) / norm).otherwise(0.0), 6).alias("score")).orderBy(F.desc("score"), "id").limit(top)


_PROBE = [((7 * k) % 13 - 6) / 6 for k in range(64)]


@extra("similar_vectors_cosine", f"SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_PROBE}::DOUBLE[]), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 10")
def similar_vectors(t: Tables) -> DataFrame:
    return cosine_top(t["embeddings"].select(F.col("vec_id").alias("id"), "embedding"), _PROBE)


def confidence(top: DataFrame, bands: tuple[float, float, float, float] = (20, 8, 5, 1.5)) -> DataFrame:
    """Label of a ranked result: the best score and its lead over the next."""
    s = top.agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))  # at most the top few
    best, lead = F.get("s", F.lit(0)), F.coalesce(F.get("s", F.lit(0)) - F.get("s", F.lit(1)), F.lit(0.0))
    return s.select(best.alias("best"), lead.alias("lead"), F.when((best >= bands[0]) | (lead >= bands[2]), "high").when((best >= bands[1]) | (lead >= bands[3]), "medium").otherwise("low").alias("confidence"))


def nearest_names(names: DataFrame, word: str, top: int = 5) -> DataFrame:
    """(id, name) by edit distance of the best name of each id."""
    return names.groupBy("id").agg(F.min(F.levenshtein("name", F.lit(word))).alias("distance")).orderBy("distance", "id").limit(top)


@extra("nearest_entities", "SELECT id, least(min(levenshtein(id, 'brand-81')), min(levenshtein(display, 'brand-81'))) AS distance FROM \"Entity\" GROUP BY id ORDER BY distance, id LIMIT 5", "Entity")
def nearest_entities(t: Tables) -> DataFrame:
    e = t["Entity"]
    return nearest_names(e.select("id", F.col("id").alias("name")).unionByName(e.select("id", F.col("display").alias("name"))), "brand-81")


# -------------------------------------------------------------- traversals
def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for what executors share; a new one in local mode without a setting, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="quillgraph-")


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop's frame, in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def held(df: DataFrame) -> DataFrame:
    """A loop's frame, written to the shared folder and read again: its lineage is cut, and it is computed once."""
    path = f"{shared_folder(df.sparkSession)}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, depth): nodes reachable along (src, dst) from (id), each at its least depth, the start at 0.

    One join for each step over the frontier alone; nodes seen before drop out.
    """
    seen = _cut(start.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    step = edges.select("src", "dst").distinct()
    for d in range(1, depth + 1):
        new = frontier.select(F.col("id").alias("src")).join(step, "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        frontier = _cut(new)
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


@extra(
    "impact_callers",
    """, RECURSIVE r(id, depth) AS (SELECT symbol, 0 FROM "Function" WHERE symbol = 'supply/n4/s77().' UNION SELECT c.src, r.depth + 1 FROM r JOIN "CALLS" c ON c.dst = r.id WHERE r.depth < 3)
    SELECT id, min(depth) AS depth FROM r GROUP BY id""",
    "Function CALLS",
)
def impact_callers(t: Tables) -> DataFrame:
    """Functions that reach one by calls, with the fewest steps."""
    calls = t["CALLS"].select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(calls, t["Function"].where("symbol = 'supply/n4/s77().'").select(F.col("symbol").alias("id")), 3)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def shortest_path(edges: DataFrame, source: str, target: str, most: int = 10) -> DataFrame:
    """(step, id) of the shortest undirected path; among equals, each node has its least parent.

    Empty without a path of ``most`` steps.  One search, then one job that goes
    back from the target by a join for each step.
    """
    spark, both = edges.sparkSession, undirected(edges)
    near = reach(both, spark.createDataFrame([(source,)], "id string"), most)
    found = near.where(F.col("id") == target).select("depth").first()
    if found is None:
        return spark.createDataFrame([], "step int, id string")
    at = spark.createDataFrame([(int(found.depth), target)], "step int, id string")
    path = at
    for depth in range(int(found.depth) - 1, -1, -1):
        level = near.where(F.col("depth") == depth).select(F.col("id").alias("src"))
        at = both.join(at.select(F.col("id").alias("dst")), "dst").join(level, "src").agg(F.min("src").alias("id")).select(F.lit(depth).alias("step"), "id")
        path = path.unionByName(at)
    return path.orderBy("step")


@extra(
    "doc_subgraph",
    """, e AS (SELECT src, dst FROM "WIKILINK" UNION SELECT dst, src FROM "WIKILINK"), r0 AS (SELECT id FROM "Doc" WHERE id = 'audit-run-48'),
    r1 AS (SELECT id FROM r0 UNION SELECT e.dst FROM r0 JOIN e ON e.src = r0.id), r2 AS (SELECT id FROM r1 UNION SELECT e.dst FROM r1 JOIN e ON e.src = r1.id)
    SELECT r2.id, CASE WHEN r2.id IN (SELECT id FROM r0) THEN 0 WHEN r2.id IN (SELECT id FROM r1) THEN 1 ELSE 2 END AS depth FROM r2""",
    "Doc WIKILINK",
)
def doc_subgraph(t: Tables) -> DataFrame:
    """Documents within two links of one."""
    return reach(undirected(t["WIKILINK"]), t["Doc"].where("id = 'audit-run-48'").select("id"), 2)


# ------------------------------------------------------------- communities
def label_propagation(edges: DataFrame, passes: int = 50) -> DataFrame:
    """(id, label): synchronous label propagation over undirected edges; the commonest label wins, the least on ties.

    A node that would swap labels for ever with a neighbour keeps the lesser of
    its last two, which settles bipartite oscillation.
    """
    both = _cut(undirected(edges.where("src <> dst")))
    labels = _cut(both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    for _ in range(passes):
        votes = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("new"), F.max("n").alias("n"))
        new = _cut(best.join(labels, "id").select("id", F.when(F.col("n") > 1, F.col("new")).otherwise(F.least("new", "label")).alias("label"), (F.col("label")).alias("old")))
        labels = new.select("id", "label")
        if not new.where("label <> old").limit(1).count():
            break
    return labels


def community_report(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Size, inner edges and density of each community, and its most linked member."""
    inner = edges.where("src < dst OR src > dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("x")), labels.select(F.col("id").alias("b"), F.col("label").alias("y"))
    within = inner.join(la, "a").join(lb, "b").where("x = y")
    sizes = labels.groupBy("label").agg(F.count("*").alias("members"))
    count = within.groupBy(F.col("x").alias("label")).agg(F.count("*").alias("inner_edges"))
    degree = within.select(F.col("x").alias("label"), "b").groupBy("label", "b").agg(F.count("*").alias("k")).groupBy("label").agg(F.min_by("b", F.struct(-F.col("k"), F.col("b"))).alias("centre"))
    pairs = F.col("members") * (F.col("members") - 1) / 2
    return sizes.join(count, "label", "left").join(degree, "label", "left").fillna(0, ["inner_edges"]).select("label", "members", "inner_edges", F.round(F.when(pairs > 0, F.col("inner_edges") / pairs).otherwise(0.0), 6).alias("density"), "centre")


@extra("entity_communities")
def entity_communities(t: Tables) -> DataFrame:
    """Communities of entities by the calls between their functions."""
    edges = held(t["ENTITY_CALLS"])
    return community_report(label_propagation(edges), edges)


def tf_idf_names(members: DataFrame, top: int = 3) -> DataFrame:
    """(label, term, score): the terms that name groups of (label, text) best."""
    terms = members.select("label", F.explode(F.array_distinct(tokens(F.regexp_replace("text", "([a-z])([A-Z])", "$1 $2")))).alias("term"))
    tf = terms.groupBy("label", "term").agg(F.count("*").alias("tf"))
    groups = members.agg(F.countDistinct("label").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(df, "term").crossJoin(groups).withColumn("score", F.round(F.col("tf") * F.log((1 + F.col("n")) / F.col("df")), 6))
    w = Window.partitionBy("label").orderBy(F.desc("score"), "term")
    return scored.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).select("label", "term", "score")


@extra(
    "entity_class_names",
    """, w AS (SELECT DISTINCT entity_class AS label, id, unnest(list_filter(string_split_regex(lower(regexp_replace(concat_ws(' ', id, display, description), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ({stop}))) AS term FROM "Entity"),
    f AS (SELECT label, term, count(*) AS tf FROM w GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1), s AS (SELECT label, term, round(tf * ln((1 + (SELECT count(DISTINCT entity_class) FROM "Entity")) / CAST(df AS DOUBLE)), 6) AS score FROM f JOIN d USING (term))
    SELECT label, term, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, term) AS k FROM s) WHERE k <= 3""".format(stop=", ".join(f"'{x}'" for x in STOPWORDS)),
    "Entity",
)
def entity_class_names(t: Tables) -> DataFrame:
    return tf_idf_names(t["Entity"].select(F.col("entity_class").alias("label"), F.concat_ws(" ", "id", "display", "description").alias("text")))
