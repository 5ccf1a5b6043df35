"""Terms and concepts: which entities texts mention, which words lack one, and how functions group."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import depluralise, naive_plural, split_identifier
from ..sources.repository import sections
from .analytics import Tables, bm25, extra, held, reach, undirected

# Sentence words that name no concept.
PLAIN = ("about", "after", "also", "because", "before", "between", "does", "each", "from", "have", "into", "more", "only", "other", "over", "same", "some", "than", "that", "their", "them", "then", "there", "these", "they", "this", "when", "where", "which", "while", "with", "your")


def term_index(names: DataFrame) -> DataFrame:
    """(term, id) from (id, name): the name in lower case with dashes as spaces, and the plural of its last word."""
    base = names.select("id", F.lower(F.regexp_replace("name", "[-_]+", " ")).alias("term")).where("term <> ''")
    return base.unionByName(base.select("id", naive_plural(F.col("term")).alias("term"))).distinct()


def phrases(words: Column, longest: int = 3) -> Column:
    """Runs of one to ``longest`` words, joined by a space."""

    def of(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))

    return F.array_distinct(F.concat(*[of(k) for k in range(1, longest + 1)]))


def mentions(functions: DataFrame, terms: DataFrame) -> DataFrame:
    """(src, dst, confidence): terms in a function's comment are high, in its symbol low; high wins.

    The words of each text are exploded once and joined on the term, so the
    cost follows the text, not texts times terms.
    """
    words = F.filter(F.split(F.lower(F.coalesce("doc_comment", F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")
    said = functions.select(F.col("symbol").alias("src"), F.explode(phrases(words)).alias("term"), F.lit(1).alias("high"))
    named = functions.select(F.col("symbol").alias("src"), F.explode(phrases(split_identifier(F.col("symbol")))).alias("term"), F.lit(0).alias("high"))
    found = said.unionByName(named).join(terms, "term")
    return found.groupBy("src", F.col("id").alias("dst")).agg(F.when(F.max("high") == 1, "high").otherwise("low").alias("confidence"))


def unstubbed(docs: DataFrame, known: DataFrame, least_docs: int = 2) -> DataFrame:
    """(term, docs): capitalised words within sentences of (id, text), in several documents, that no known term names."""
    words = docs.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"[a-z0-9,;:]\s+([A-Z][A-Za-z]{3,})"), 1)).alias("word"))
    words = words.select("id", F.lower("word").alias("term")).where(~F.col("term").isin(*PLAIN))
    counted = words.groupBy("term").agg(F.countDistinct("id").alias("docs")).where(F.col("docs") >= least_docs)
    single = counted.withColumn("one", depluralise(F.col("term")))
    names = known.select("term").distinct()
    return single.join(names, "term", "left_anti").join(names.withColumnRenamed("term", "one"), "one", "left_anti").select("term", "docs")


def affinity(holders: DataFrame, corpus: int, clique: int = 10) -> DataFrame:
    """(src, dst): holders of a rare word of (id, word); few holders pair with each other, more with their next two."""
    cap = max(corpus // 25, 8)
    rare = holders.distinct().join(holders.distinct().groupBy("word").agg(F.count("*").alias("n")).where(F.col("n").between(2, cap)), "word")
    w = Window.partitionBy("word").orderBy("id")
    ranked = rare.withColumn("k", F.row_number().over(w))
    ahead = F.when(F.col("n") <= clique, F.col("n") - F.col("k")).otherwise(F.least(F.lit(2), F.col("n") - F.col("k")))
    nexts = ranked.where(ahead > 0).select("word", F.col("id").alias("src"), F.explode(F.transform(F.sequence(F.lit(1), ahead.cast("int")), lambda j: F.col("k") + j)).alias("k"))
    return nexts.join(ranked.select("word", "k", F.col("id").alias("dst")), ["word", "k"]).select("src", "dst").distinct()


def ego_graph(entities: DataFrame, relates: DataFrame, calls: DataFrame, centre: str, depth: int = 2) -> DataFrame:
    """(src, dst, type): relations and calls among the entities within some steps of one."""
    edges = relates.select("src", "dst", "type").unionByName(calls.select("src", "dst", F.lit("calls").alias("type")))
    seen = reach(undirected(edges), entities.where(F.col("id") == centre).select("id"), depth).select("id")
    inside = edges.join(seen.withColumnRenamed("id", "src"), "src", "left_semi").join(seen.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inside.select("src", "dst", "type").distinct()


def louvain(edges: Mapping[tuple[str, str], float], resolution: float = 1.0, levels: int = 10) -> dict[str, str]:
    """Communities of a small weighted graph by greedy modularity, in key order, least label on ties.

    Moves depend on each other one by one, so this runs on one machine; callers
    bound the graph (:func:`louvain_of`).
    """
    weight: dict[str, dict[str, float]] = defaultdict(dict)
    for (a, b), w in edges.items():
        if a != b:
            weight[a][b] = weight[a].get(b, 0) + w
            weight[b][a] = weight[b].get(a, 0) + w
    label = {v: v for v in weight}
    of = dict(label)  # nodes of the first level to communities
    loops = dict.fromkeys(weight, 0.0)
    for _ in range(levels):
        total = sum(sum(n.values()) for n in weight.values()) + sum(loops.values())
        if not total:
            break
        degree = {v: sum(n.values()) + loops[v] for v, n in weight.items()}
        label = {v: v for v in weight}
        held = dict(degree)
        moved_any, moved = False, True
        while moved:
            moved = False
            for v in sorted(weight):
                near: dict[str, float] = defaultdict(float)
                for u, w in weight[v].items():
                    near[label[u]] += w
                old = label[v]
                held[old] -= degree[v]
                gain = lambda c: near.get(c, 0.0) - resolution * held[c] * degree[v] / total  # noqa: B023, E731
                best = min({*near, old}, key=lambda c: (-round(gain(c), 12), c))
                if gain(best) <= gain(old) + 1e-12:
                    best = old
                held[best] += degree[v]
                if best != old:
                    label[v], moved, moved_any = best, True, True
        of = {v: label[c] for v, c in of.items()}
        if not moved_any:
            break
        merged: dict[str, dict[str, float]] = {c: {} for c in set(label.values())}
        inner = dict.fromkeys(merged, 0.0)
        for v, n in weight.items():
            inner[label[v]] += loops[v]
            for u, w in n.items():
                if label[u] == label[v]:
                    inner[label[v]] += w
                else:
                    merged[label[v]][label[u]] = merged[label[v]].get(label[u], 0) + w
        weight, loops = merged, inner
    least: dict[str, str] = {}
    for v in sorted(of):
        least.setdefault(of[v], v)
    return {v: least[c] for v, c in of.items()}


def louvain_of(edges: DataFrame, most_edges: int = 200_000, resolution: float = 1.0) -> DataFrame:
    """(id, label) of (src, dst); a graph over ``most_edges`` is refused: use label propagation there."""
    once = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("w"))
    rows = once.limit(most_edges + 1).collect()
    if len(rows) > most_edges:
        raise ValueError(f"over {most_edges} edges: use label_propagation")
    found = louvain({(r.a, r.b): float(r.w) for r in rows}, resolution)
    return edges.sparkSession.createDataFrame(sorted(found.items()), "id string, label string")


@extra("entity_communities_louvain")
def entity_communities_louvain(t: Tables) -> DataFrame:
    return louvain_of(t["ENTITY_CALLS"])


@extra(
    "entity_ego_graph",
    """, e AS (SELECT src, dst, type FROM "RELATES_TO" UNION ALL SELECT src, dst, 'calls' FROM "ENTITY_CALLS"), n AS (SELECT 'brand-8' AS id UNION SELECT dst FROM e WHERE src = 'brand-8' UNION SELECT src FROM e WHERE dst = 'brand-8')
    SELECT DISTINCT src, dst, type FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""",
    "RELATES_TO ENTITY_CALLS",
)
def entity_ego_graph(t: Tables) -> DataFrame:
    return ego_graph(t["Entity"], t["RELATES_TO"], held(t["ENTITY_CALLS"]), "brand-8", 1)


_SYMBOL_WORDS = "lower(regexp_replace(regexp_replace(symbol, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'))"
_WORDS = "list_filter(string_split_regex({}, '[^a-z0-9]+'), lambda x: x <> '')"


@extra(
    "derive_mentions",
    f""", t AS (SELECT DISTINCT id, lower(regexp_replace(name, '[-_]+', ' ', 'g')) AS term FROM (SELECT id, id AS name FROM "Entity" UNION ALL SELECT id, display FROM "Entity") AS n),
    k AS (SELECT id, term FROM t UNION SELECT id, CASE WHEN regexp_matches(term, '[^aeiou]y$') THEN regexp_replace(term, 'y$', 'ies') WHEN regexp_matches(term, '(s|x|z|ch|sh)$') THEN term || 'es' ELSE term || 's' END FROM t),
    w AS (SELECT symbol AS src, 1 AS high, {_WORDS.format("lower(coalesce(doc_comment, ''))")} AS w FROM "Function" UNION ALL SELECT symbol, 0, {_WORDS.format(_SYMBOL_WORDS)} FROM "Function"),
    p AS (SELECT DISTINCT src, high, array_to_string(w[i : i + n - 1], ' ') AS term FROM (SELECT src, high, w, unnest(range(1, len(w) + 1)) AS i FROM w) AS a, (VALUES (1), (2), (3)) AS l(n) WHERE i + n - 1 <= len(w))
    SELECT src, id AS dst, CASE WHEN max(high) = 1 THEN 'high' ELSE 'low' END AS confidence FROM p JOIN k USING (term) WHERE term <> '' GROUP BY src, id""",
    "Entity Function",
)
def derive_mentions(t: Tables) -> DataFrame:
    e = t["Entity"]
    return mentions(t["Function"].select("symbol", "doc_comment"), term_index(e.select("id", F.col("id").alias("name")).unionByName(e.select("id", F.col("display").alias("name")))))


CORPORA = {
    "function": ("Function", "symbol", ("signature", "doc_comment")),
    "type": ("Type", "symbol", ("signature", "doc_comment", "body_excerpt")),
    "entity": ("Entity", "id", ("display", "id", "display", "description")),
}


def whole_docs(t: Tables) -> DataFrame:
    """(id, path, text, summary) of documents with all of their text; the summary only where it says something else."""
    body = t["documents"].select(F.col("doc_id").alias("dkey"), "text")
    other = F.when(~F.coalesce(F.col("text").startswith(F.col("summary")), F.lit(False)), F.col("summary"))
    return t["Doc"].join(body, "dkey").select("id", "path", "text", other.alias("summary"))


def corpus(t: Tables, kind: str) -> DataFrame:
    """(id, text): documents are title and body, sections their heading and body."""
    if kind == "doc":
        return whole_docs(t).select("id", F.concat_ws(" ", "text", "summary").alias("text"))
    if kind == "section":
        # a text without a line that starts like a heading has no sections
        headed = whole_docs(t).where(F.col("text").rlike(r"(?m)^#{1,6}\s+\S"))
        found = sections(headed.select("path", "text"))
        return found.select(F.concat_ws("#", "path", "anchor").alias("id"), F.concat_ws(" ", "heading", "text").alias("text"))
    table, key, columns = CORPORA[kind]
    return t[table].select(F.col(key).alias("id"), F.concat_ws(" ", *columns).alias("text"))


def similar(t: Tables, query: str, kinds: tuple[str, ...] = ("doc", "function", "entity", "section"), top: int = 10) -> DataFrame:
    """The best of several corpora, each scored with its own statistics."""
    out = None
    for k in kinds:
        found = bm25(corpus(t, k), query, top).select(F.lit(k).alias("corpus"), "id", "score")
        out = found if out is None else out.unionByName(found)
    return out.orderBy(F.desc("score"), "corpus", "id").limit(top)


@extra("similar_all_bm25")
def similar_all(t: Tables) -> DataFrame:
    return similar(t, "brand details step of the graph")



