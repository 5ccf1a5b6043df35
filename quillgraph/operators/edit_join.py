"""Words within one or two edits of each other, by deletion neighbourhoods.

Two words within d edits have a string in common that is left of each after at most d of
its letters are deleted.  So each distinct word is exploded to what is left of it, once
for each way up to d letters go, and equal leftovers join; the edit distance of the pairs
that meet is then computed.  A word of n letters has n (n + 1) / 2 + 1 leftovers at most
for d = 2, and no word is compared with one that shares none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analytics import Tables, extra

#: Words of tags that too many have.
COMMON = ("research", "paper", "tool", "production", "framework", "survey", "design", "system")


def _one_deleted(word: Column) -> Column:
    """What is left of a word when one letter goes."""
    n = F.length(word)
    left = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, n)))
    return F.when(n > 0, left).otherwise(F.array().cast("array<string>"))


def leftovers(word: Column, most: int) -> Column:
    """Distinct strings left of a word after at most ``most`` (1 or 2) deletions."""
    one = _one_deleted(word)
    all_ = [F.array(word), one]
    if most == 2:
        all_.append(F.flatten(F.transform(one, _one_deleted)))
    return F.array_distinct(F.concat(*all_))


def near_words(left: DataFrame, right: DataFrame, most: int = 2) -> DataFrame:
    """(a, b, distance) of the words of two frames (word) within ``most`` edits, equal ones too."""
    if most not in (1, 2):
        raise ValueError("most: 1 or 2")
    side = lambda df, name: df.where("word is not null").select(F.col("word").alias(name)).distinct().select(name, F.explode(leftovers(F.col(name), most)).alias("rest"))
    met = side(left, "a").join(side(right, "b"), "rest").where(F.abs(F.length("a") - F.length("b")) <= most).select("a", "b").distinct()
    return met.withColumn("distance", F.levenshtein("a", "b", most)).where("distance >= 0")


def _tokens(tags: DataFrame) -> DataFrame:
    return tags.select("tag", F.explode(F.split(F.lower("tag"), "-")).alias("word")).distinct()


def related_tags(carried: DataFrame, known: DataFrame) -> DataFrame:
    """(tag, other, rule): carried and known tags (tag) with words one or two edits apart (form-drift), else with a word in common that says something (shared-token)."""
    a, b = _tokens(carried), _tokens(known)
    long = F.length("word") >= 4
    drift = near_words(a.where(long).select("word"), b.where(long).select("word")).where("distance > 0")
    drift = a.withColumnRenamed("word", "a").join(drift, "a").join(b.select(F.col("tag").alias("other"), F.col("word").alias("b")), "b").select("tag", "other", F.lit(1).alias("rule"))
    telling = (F.length("word") >= 5) & ~F.col("word").isin(*COMMON)
    same = a.where(telling).join(b.select(F.col("tag").alias("other"), "word"), "word").select("tag", "other", F.lit(2).alias("rule"))
    return drift.unionByName(same).groupBy("tag", "other").agg(F.min("rule").alias("rule"))


def family_suggestions(doc_tags: DataFrame) -> DataFrame:
    """(doc_id, tag, rule): known tags that a document of (doc_id, value) lacks and that are related to one it carries, each once by its first rule."""
    tags = doc_tags.where("value is not null").select(F.col("value").alias("tag")).distinct()
    carried = doc_tags.where("value is not null").select("doc_id", F.col("value").alias("tag")).distinct()
    found = carried.join(related_tags(tags, tags), "tag").select("doc_id", F.col("other").alias("tag"), "rule")
    lacking = found.join(carried, ["doc_id", "tag"], "left_anti").groupBy("doc_id", "tag").agg(F.min("rule").alias("rule"))
    return lacking.select("doc_id", "tag", F.when(F.col("rule") == 1, "form-drift").otherwise("shared-token").alias("rule"))


_COMMON = ", ".join(f"'{w}'" for w in COMMON)


@extra(
    "suggest_family_tags",
    f""", c AS (SELECT DISTINCT doc_id, value AS tag FROM "doc_tags"), k AS (SELECT DISTINCT value AS tag FROM "doc_tags"), w AS (SELECT tag, unnest(string_split(lower(tag), '-')) AS word FROM k),
    r AS (SELECT a.tag, b.tag AS other, min(CASE WHEN a.word <> b.word THEN 1 ELSE 2 END) AS rule FROM w a JOIN w b
      ON (a.word <> b.word AND length(a.word) >= 4 AND length(b.word) >= 4 AND levenshtein(a.word, b.word) <= 2) OR (a.word = b.word AND length(a.word) >= 5 AND a.word NOT IN ({_COMMON})) GROUP BY 1, 2)
    SELECT c.doc_id, r.other AS tag, CASE WHEN min(rule) = 1 THEN 'form-drift' ELSE 'shared-token' END AS rule FROM c JOIN r ON r.tag = c.tag WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.doc_id = c.doc_id AND x.tag = r.other) GROUP BY 1, 2""",
    "doc_tags",
)
def suggest_family_tags(t: Tables) -> DataFrame:
    return family_suggestions(t["doc_tags"])


@extra("near_entity_names", 'SELECT a.id AS a, b.id AS b, CAST(levenshtein(a.id, b.id) AS INTEGER) AS distance FROM "Entity" a JOIN "Entity" b ON a.id < b.id AND levenshtein(a.id, b.id) <= 2', "Entity")
def near_entity_names(t: Tables) -> DataFrame:
    """Entities whose ids are one or two edits apart."""
    words = t["Entity"].select(F.col("id").alias("word"))
    return near_words(words, words).where("a < b")


@extra("near_tag_words", """SELECT a.w AS a, b.w AS b, CAST(levenshtein(a.w, b.w) AS INTEGER) AS distance FROM (SELECT DISTINCT unnest(string_split_regex(lower(display), '[^a-z0-9]+')) AS w FROM "Entity") a
    JOIN (SELECT DISTINCT unnest(string_split_regex(lower(value), '[^a-z0-9]+')) AS w FROM "doc_tags") b ON levenshtein(a.w, b.w) <= 2 WHERE length(a.w) >= 3 AND length(b.w) >= 3""", "Entity doc_tags")
def near_tag_words(t: Tables) -> DataFrame:
    """Words of entity names beside words of tags."""
    words = lambda df, c: df.select(F.explode(F.split(F.lower(c), "[^a-z0-9]+")).alias("word")).where("length(word) >= 3")
    return near_words(words(t["Entity"], "display"), words(t["doc_tags"], "value"))
