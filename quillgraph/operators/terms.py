"""Mentions of entities by all their names: synonyms, plurals, phrases that bind or veto, types and the project itself.

Entities are (id, display, synonyms, code_terms, code_veto, status).  A term is an id, a
display or a synonym in lower case, or its plural; a word that is no term is looked up
without its plural ending.  Candidates have no terms.

* Words of a comment give mentions of high confidence (``entity-x`` also says x), words of
  a symbol such of low confidence, but for stop words and for entities with code terms.
* A code term binds where its words stand side by side in a part of the symbol, the last
  one also with an s; a veto takes the entity off the symbol in the same way.  Both are
  equalities on windows of words, of those lengths alone that phrases have.
* What a type's symbol mentions, all symbols below it mention with low confidence; the
  ancestors of a symbol are exploded and joined.
* The project's own entity gives way to any other, and alone it has low confidence.

Texts are exploded once, and every step is an equality join; no side is compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import depluralise, naive_plural, split_identifier
from .analytics import Tables, extra

NONE = "array<string>"
#: Shortest word of a symbol that is looked up.
LEAST = 3


def known_terms(entities: DataFrame) -> DataFrame:
    """(term, id, coded) of entities that are no candidates; ``coded``: has code terms."""
    live = entities.where("status is null or status <> 'candidate'")
    names = F.concat(F.array("id", "display"), F.coalesce("synonyms", F.array().cast(NONE)))
    coded = F.size(F.coalesce("code_terms", F.array().cast(NONE))) > 0
    base = live.select("id", coded.alias("coded"), F.explode(names).alias("name")).select("id", "coded", F.lower(F.trim("name")).alias("term")).where("term <> ''")
    return base.unionByName(base.withColumn("term", naive_plural(F.col("term")))).distinct()


def look_up(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(src, id, coded) for (src, word): the word itself if it is a term, else without its plural ending."""
    words = words.distinct()
    direct = words.join(terms, F.col("word") == F.col("term")).select("src", "word", "id", "coded")
    rest = words.join(terms.select(F.col("term").alias("word")).distinct(), "word", "left_anti").withColumn("one", depluralise(F.col("word")))
    single = rest.where("one <> word").join(terms, F.col("one") == F.col("term")).select("src", "word", "id", "coded")
    return direct.unionByName(single).select("src", "id", "coded").distinct()


def runs(symbol: Column) -> Column:
    """Words of each part of a symbol between slashes."""
    return F.filter(F.transform(F.split(symbol, "/"), split_identifier), lambda r: F.size(r) > 0)


def _phrases(entities: DataFrame, column: str) -> DataFrame:
    live = entities.where("status is null or status <> 'candidate'")
    found = live.select("id", F.explode(F.coalesce(column, F.array().cast(NONE))).alias("phrase")).withColumn("words", split_identifier(F.col("phrase")))
    return found.where(F.size("words") > 0).select("id", F.array_join("words", " ").alias("phrase"), F.size("words").alias("n")).distinct()


def with_phrase(symbols: DataFrame, phrases: DataFrame) -> DataFrame:
    """(src, id) of symbols (src) in which a phrase of (id, phrase, n) stands."""
    lengths = [r.n for r in phrases.select("n").distinct().orderBy("n").collect()]  # as few as phrases are short
    if not lengths:
        return symbols.select("src", F.lit("").alias("id")).limit(0)

    def of_length(run: Column, n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(run) - n + 1, F.lit(1))), lambda k: F.slice(run, k, F.lit(n)))
        return F.transform(F.filter(every, lambda w: F.size(w) == n), lambda w: F.array_join(w, " "))

    def windows(run: Column) -> Column:
        return F.concat(*[of_length(run, n) for n in lengths])

    said = symbols.select("src", F.explode(F.array_distinct(F.flatten(F.transform(runs(F.col("src")), windows)))).alias("said"))
    said = said.unionByName(said.where("endswith(said, 's')").select("src", F.expr("substring(said, 1, length(said) - 1)").alias("said")))
    return said.join(phrases.select("id", F.col("phrase").alias("said")), "said").select("src", "id").distinct()


def symbol_mentions(symbols: DataFrame, entities: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """(src, id) of symbols (src): by words, bound by phrases, without those that a phrase vetoes."""
    words = symbols.select("src", F.explode(F.array_distinct(F.flatten(runs(F.col("src"))))).alias("word")).where(F.length("word") >= LEAST)
    words = words.where(~F.col("word").isin(*stop)) if stop else words
    by_word = look_up(words, known_terms(entities)).where("not coded").select("src", "id")
    bound = with_phrase(symbols, _phrases(entities, "code_terms"))
    return by_word.unionByName(bound).distinct().join(with_phrase(symbols, _phrases(entities, "code_veto")), ["src", "id"], "left_anti")


def entity_mentions(functions: DataFrame, entities: DataFrame, types: DataFrame | None = None, own: str | None = None, stop: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, confidence) of functions (symbol, doc_comment); ``types`` (symbol) hand theirs down to symbols below them, ``own`` is the project's entity."""
    symbols = functions.select(F.col("symbol").alias("src")).distinct()
    comment = F.split(F.lower(F.coalesce("doc_comment", F.lit(""))), "[^a-z0-9_-]+")
    words = functions.select(F.col("symbol").alias("src"), F.explode(F.array_distinct(comment)).alias("word")).where("word <> ''")
    words = words.unionByName(words.where("startswith(word, 'entity-')").select("src", F.expr("substring(word, 8)").alias("word")))
    high = look_up(words, known_terms(entities)).select("src", "id", F.lit(1).alias("high"))
    low = symbol_mentions(symbols, entities, stop)
    if types is not None:
        parent = symbol_mentions(types.select(F.col("symbol").alias("src")).distinct(), entities, stop).select(_stem(F.col("src")).alias("above"), "id")
        parts = F.split(_stem(F.col("src")), "/")
        above = symbols.select("src", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("above")).where(F.col("above") != _stem(F.col("src")))
        low = low.unionByName(above.join(parent, "above").select("src", "id"))
    found = high.unionByName(low.select("src", "id", F.lit(0).alias("high"))).groupBy("src", F.col("id").alias("dst")).agg(F.max("high").alias("high"))
    if own is not None:
        mine = F.col("dst") == own
        other = F.max((~mine).cast("int")).over(Window.partitionBy("src"))
        found = found.withColumn("other", other).where(~mine | (F.col("other") == 0)).withColumn("high", F.when(mine, 0).otherwise(F.col("high")))
    return found.select("src", "dst", F.when(F.col("high") == 1, "high").otherwise("low").alias("confidence"))


def _stem(symbol: Column) -> Column:
    """A symbol with the marks of types and members as slashes, without those at its end."""
    return F.regexp_replace(F.regexp_replace(symbol, r"[#.()]+", "/"), "/+$", "")


# What authors of entities add: synonyms, phrases and a status, by the number of the entity.
_AUTHORED = """SELECT id, display, {syn} AS synonyms, CASE WHEN n % 7 = 3 THEN {bind} ELSE {none} END AS code_terms, CASE WHEN n % 7 = 5 THEN {veto} ELSE {none} END AS code_veto, CASE WHEN n % 9 = 4 THEN 'candidate' ELSE 'current' END AS status FROM {table}"""
_OWN = "africa"


def authored_entities(t: Tables) -> DataFrame:
    parts = {"syn": "array(replace(id, '-', ''))", "bind": "array(concat('view-p', n), id)", "veto": "array(concat('p', n, '0'))", "none": "CAST(array() AS ARRAY<STRING>)"}
    return t["entity_seed"].sparkSession.sql(_AUTHORED.format(**parts, table="{seed}"), seed=t["entity_seed"])


def _mentions_sql() -> str:
    parts = {"syn": "[replace(id, '-', '')]", "bind": "[concat('view-p', n), id]", "veto": "[concat('p', n, '0')]", "none": "CAST([] AS VARCHAR[])"}
    words = lambda x: f"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"
    single = "CASE WHEN regexp_matches(word, 'ies$') THEN regexp_replace(word, 'ies$', 'y') WHEN regexp_matches(word, '(s|x|z|ch|sh)es$') THEN regexp_replace(word, 'es$', '') WHEN regexp_matches(word, '[^s]s$') THEN regexp_replace(word, 's$', '') ELSE word END"
    plural = "CASE WHEN regexp_matches(term, '[^aeiou]y$') THEN regexp_replace(term, 'y$', 'ies') WHEN regexp_matches(term, '(s|x|z|ch|sh)$') THEN term || 'es' ELSE term || 's' END"
    stem = lambda x: f"regexp_replace(regexp_replace({x}, '[#.()]+', '/', 'g'), '/+$', '')"
    return f""", ent AS ({_AUTHORED.format(**parts, table='"entity_seed"')}), live AS (SELECT * FROM ent WHERE status <> 'candidate'),
    t0 AS (SELECT DISTINCT id, len(code_terms) > 0 AS coded, lower(trim(name)) AS term FROM (SELECT id, code_terms, unnest([id, display] || synonyms) AS name FROM live) AS n), t1 AS (SELECT * FROM t0 UNION SELECT id, coded, {plural} FROM t0),
    sym AS (SELECT DISTINCT symbol AS src, 'f' AS kind FROM "Function" UNION SELECT DISTINCT symbol, 't' FROM "Type"),
    said AS (SELECT symbol AS src, 'c' AS kind, unnest(list_filter(string_split_regex(lower(coalesce(doc_comment, '')), '[^a-z0-9_-]+'), lambda w: w <> '')) AS word FROM "Function"),
    run AS (SELECT src, kind, {words("part")} AS r FROM (SELECT src, kind, unnest(string_split(src, '/')) AS part FROM sym) AS p),
    w AS (SELECT * FROM said UNION SELECT src, kind, substr(word, 8) FROM said WHERE starts_with(word, 'entity-') UNION SELECT src, kind, word FROM (SELECT src, kind, unnest(r) AS word FROM run) AS u WHERE length(word) >= 3),
    hit AS (SELECT w.src, w.kind, t1.id, t1.coded FROM w JOIN t1 ON t1.term = w.word OR (t1.term = {single} AND w.word NOT IN (SELECT term FROM t1))),
    ph AS (SELECT id, b, {words("phrase")} AS p FROM (SELECT id, true AS b, unnest(code_terms) AS phrase FROM live UNION ALL SELECT id, false, unnest(code_veto) FROM live) AS x),
    full_ AS (SELECT src, kind, ' ' || array_to_string(r, ' ') || ' ' AS r FROM run),
    at_ AS (SELECT DISTINCT src, kind, id, b FROM full_ JOIN ph ON contains(r, ' ' || array_to_string(p, ' ') || ' ') OR contains(r, ' ' || array_to_string(p, ' ') || 's ')),
    low AS (SELECT src, kind, id FROM (SELECT src, kind, id FROM hit WHERE kind <> 'c' AND NOT coded UNION SELECT src, kind, id FROM at_ WHERE b) AS y WHERE NOT EXISTS (SELECT 1 FROM at_ v WHERE NOT v.b AND v.src = y.src AND v.kind = y.kind AND v.id = y.id)),
    down AS (SELECT f.src, l.id FROM (SELECT src, {stem("src")} AS s FROM sym WHERE kind = 'f') f JOIN (SELECT {stem("src")} AS s, id FROM low WHERE kind = 't') l ON starts_with(f.s, l.s || '/')),
    m AS (SELECT src, id, max(h) AS h FROM (SELECT src, id, 1 AS h FROM hit WHERE kind = 'c' UNION ALL SELECT src, id, 0 FROM low WHERE kind = 'f' UNION ALL SELECT src, id, 0 FROM down) AS z GROUP BY 1, 2)
    SELECT src, id AS dst, CASE WHEN h = 1 AND id <> '{_OWN}' THEN 'high' ELSE 'low' END AS confidence FROM m WHERE id <> '{_OWN}' OR NOT EXISTS (SELECT 1 FROM m o WHERE o.src = m.src AND o.id <> '{_OWN}')"""


@extra("derive_entity_mentions", _mentions_sql(), "entity_seed Function Type")
def derive_entity_mentions(t: Tables) -> DataFrame:
    """Mentions by authored names, phrases, types and the project's own entity."""
    return entity_mentions(t["Function"].select("symbol", "doc_comment"), authored_entities(t), t["Type"].select("symbol"), _OWN)
