"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op4_exact_dedup",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
    FROM d JOIN g ON d.t = g.t
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(spark, table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op5_suffix_dedup",
    r"""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    win AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 200)) AS k, substr(h, 2 * p + 1, 200) AS t FROM (SELECT doc_id, h, unnest(range(0, strlen(h) // 2 - 99)) AS p FROM d WHERE strlen(h) >= 200) AS q),
    ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k, t ORDER BY doc_id, p) AS r FROM win),
    hit AS (SELECT doc_id, p, p - lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM ranked WHERE r > 1),
    runs AS (SELECT doc_id, p, sum(CASE WHEN gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM hit),
    spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY doc_id, g),
    edges AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
    cut AS (SELECT doc_id, count(*) AS n, sum(b - a) AS k, max(b) AS last FROM spans GROUP BY doc_id),
    parts AS (SELECT e.doc_id, string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS t FROM edges e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
    SELECT d.doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
      sha256(unhex(CASE WHEN cut.doc_id IS NULL THEN h ELSE parts.t || substr(h, 2 * last + 1) END)) AS kept_sha256
    FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id LEFT JOIN parts ON parts.doc_id = d.doc_id
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(spark, table(spark, sf_dir, "documents"), length=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query(
    "op7_substring_dedup",
    r"""
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    win AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 20], ' ') AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS p FROM d WHERE len(w) >= 20) AS s),
    ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM win),
    cut AS (SELECT DISTINCT doc_id, p + i AS pos FROM ranked, range(0, 20) AS t(i) WHERE r > 1),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
    kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.pos) AS t FROM words LEFT JOIN cut ON cut.doc_id = words.doc_id AND cut.pos = words.pos WHERE cut.pos IS NULL GROUP BY words.doc_id),
    n AS (SELECT doc_id, count(*) AS k FROM cut GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.k, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(spark, table(spark, sf_dir, "documents"), length=20, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query(
    "op6_ngram_jaccard_join",
    r"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + 5], ' ') AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS p FROM d WHERE len(w) >= 5) AS q
      UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
    e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
    r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
    SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(spark, table(spark, sf_dir, "documents"), k=5, num=75, den=100).select("doc_id", "n_shingles", "component_id")


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "items", "n_items", "contaminated")


@query("op1_kneser_ney")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .kneser_ney import score_documents

    return score_documents(spark, table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, order=3)


@query("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(spark, table(spark, sf_dir, "documents"))


@query("op11_sharding")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .sharding import shuffle_into_shards

    text = F.coalesce(F.col("row.text"), F.lit(""))
    return shuffle_into_shards(spark, table(spark, sf_dir, "documents"), shards=8).select(
        "row.doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(spark, table(spark, sf_dir, "embeddings"), k=16)


@query(
    "op13_conversation_prefix_trie",
    """
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT conv_id, list(sha256(length(r) || ':' || r || x) ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS k, list(CAST(strlen(x) AS BIGINT) ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS n FROM t GROUP BY conv_id),
    h AS (SELECT conv_id, k, n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
      lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: xor(x // 2, (x % 2) * 3988292384))), 4294967295) % 9 AS h FROM o),
    b AS (SELECT h.conv_id, coalesce(p.k[1:h.h], []) || h.k[h.h + 1 : len(h.k)] AS k, coalesce(p.n[1:h.h], []) || h.n[h.h + 1 : len(h.n)] AS n FROM h LEFT JOIN o p ON p.conv_id = h.conv_id - h.conv_id % 5),
    m AS (SELECT conv_id, d, array_to_string(k[1:d], ',') AS key, array_to_string(k[1:d - 1], ',') AS up, CASE WHEN d = 0 THEN 0 ELSE n[d] END AS bytes, len(k) = d AS ends FROM (SELECT *, unnest(range(0, len(k) + 1)) AS d FROM b)),
    nodes AS (SELECT key, CAST(d AS BIGINT) AS depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY key, d),
    kids AS (SELECT up AS key, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
    below AS (SELECT a.key, a.depth, sum((s.n_convs - 1) * s.bytes) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
      FROM (SELECT DISTINCT m.d AS depth, m.key, e.d AS low, e.key AS low_key FROM m JOIN m e ON e.conv_id = m.conv_id AND e.d >= m.d) AS a JOIN nodes s ON s.key = a.low_key AND s.depth = a.low LEFT JOIN kids c ON c.key = s.key AND c.depth = s.depth GROUP BY 1, 2)
    SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, CAST(l.leaves AS BIGINT) AS n_leaves, CAST(l.saved AS BIGINT) AS saved_tokens, x.ends_sha256
    FROM nodes x LEFT JOIN nodes p ON p.key = x.up AND p.depth = x.depth - 1 AND x.depth > 0 LEFT JOIN kids c ON c.key = x.key AND c.depth = x.depth JOIN below l ON l.key = x.key AND l.depth = x.depth
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the contract rebuilds them: their first turns come from another one."""
    from pyspark.sql import functions as F

    from .prefix_trie import prefix_trie, turn_arrays

    own = turn_arrays(table(spark, sf_dir, "conversations"))
    first = own.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    none = F.array().cast(own.schema["turns"].dataType)
    taken = F.when(F.col("first").isNull(), none).otherwise(F.slice("first", F.lit(1), h))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    rebuilt = own.join(first, F.col("conv_id") - F.col("conv_id") % 5 == F.col("base"), "left").select("conv_id", F.concat(taken, rest).alias("turns"))
    return prefix_trie(spark, rebuilt)
