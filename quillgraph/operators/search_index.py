"""A stored inverted index, and searches over it with filters, thresholds and what hits say.

A posting list is cut into blocks: a word's documents of one range.  Ranges hold
documents of about one length (quarter powers of two) and about :data:`RANGE` of them,
so a block's least length and most occurrences bound what any document in it can
score, for any k1, b and mean length, and blocks of all words align.  A frequent word
is as many rows as it has ranges; no row grows with the corpus.  A posting is two
numbers, a document's place in its range and its occurrences; ids and lengths stand once
for each document.

A search reads the blocks of its words alone: files are laid out by a hash of the word
and sorted by it.  It bounds each range by the sum over words, scores the documents of
the few ranges of highest bound, and then only those ranges whose bound reaches the
score of the last of the best so far.  Under a filter all blocks of its words are read
once, and what passes is kept and scored.  Scores, ties and statistics are those of
:func:`~.analytics.bm25` over the same texts.

With a filter the corpus is what passes it: number, lengths and document frequencies
are counted among those documents.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .analytics import QUERY, STOPWORDS, Tables, bm25, confidence, extra, held, query_tokens, shared_folder, tokens
from .concepts import corpus

#: Documents of a range, about.
RANGE = 4096
#: Postings of a bucket of words, about.
BUCKET = 2_000_000
#: What postings look like; an index of another form is refused.
FORM = 2
#: Ranges that are scored first.
FIRST = 8
KINDS = ("doc", "function", "type", "entity", "section")


def build_index(corpora: Mapping[str, DataFrame], folder: str, buckets: int | None = None) -> None:
    """Write the index of some corpora of (id, text) to a new folder.

    Texts are moved once, to their range: a task counts and gathers the words of whole
    ranges, and what it sends on are blocks, of numbers alone.
    """
    spark = next(iter(corpora.values())).sparkSession
    rows = None
    for kind, df in corpora.items():
        here = df.select(F.lit(kind).alias("corpus"), F.col("id").cast("string").alias("id"), tokens(F.col("text")).alias("words"))
        rows = here if rows is None else rows.unionByName(here)
    rows = rows.select("corpus", "id", F.size("words").alias("dl"), F.array_join("words", " ").alias("words"))
    rows = held(rows.withColumn("length_class", F.floor(F.log2(F.col("dl") + 1) * 4).cast("int")))  # read three times
    classes = rows.groupBy("corpus", "length_class").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl"))
    classes.write.parquet(f"{folder}/classes")
    classes = spark.read.parquet(f"{folder}/classes")
    # a range is counted by one task, so long texts have narrower ones
    width = classes.select("corpus", "length_class", F.ceil(F.greatest(F.col("n") / RANGE, F.col("dl") / BUCKET)).cast("long").alias("width"))
    # a corpus has at most some 130 classes
    placed = rows.join(F.broadcast(width), ["corpus", "length_class"]).withColumn("range", F.col("length_class") * F.lit(1 << 40) + F.pmod(F.xxhash64("id"), "width"))
    # a document's place is its rank in its range, by what names it in searches
    rank = Window.partitionBy("corpus", "range").orderBy("id", "dl")
    lengths = placed.select("corpus", "range", "id", "dl").repartition("corpus", "range").groupBy("corpus", "range", "id", "dl").agg(F.count(F.lit(1)).alias("rows")).withColumn("place", F.dense_rank().over(rank) - 1)
    lengths.sortWithinPartitions("corpus", "range").write.partitionBy("corpus").parquet(f"{folder}/lengths")
    total = classes.agg(F.sum("dl")).first()[0] or 0
    buckets = buckets or max(1, min(4096, -(-total // BUCKET)))
    parts = max(1, min(16384, -(-4 * total // BUCKET)))
    words = placed.select("corpus", "range", "id", "dl", "words").repartition(parts, "corpus", "range").withColumn("place", F.dense_rank().over(rank) - 1).where("dl > 0")
    tf = words.select("corpus", "range", "place", "dl", F.explode(F.split("words", " ")).alias("term")).groupBy("corpus", "range", "term", "place", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    blocks = tf.groupBy("corpus", "range", "term").agg(F.collect_list("place").alias("places"), F.collect_list("tf").alias("tfs"), F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("dl").alias("least"))
    blocks = blocks.withColumn("bucket", bucket_of(F.col("term"), buckets).cast("int"))
    blocks.repartition("corpus", "bucket").sortWithinPartitions("corpus", "bucket", "term", "range").write.partitionBy("corpus", "bucket").parquet(f"{folder}/postings")
    spark.createDataFrame([(buckets, FORM)], "buckets int, form int").coalesce(1).write.parquet(f"{folder}/layout")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets))


@dataclass
class SearchIndex:
    spark: SparkSession
    folder: str

    def __post_init__(self) -> None:
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        self.buckets, form = read("layout", "buckets int, form int").first()
        if form != FORM:
            raise ValueError(f"the index in {self.folder} has another form: store it anew")
        self.classes = read("classes", "corpus string, length_class int, n long, dl long")
        self.postings = read("postings", "term string, range long, places array<int>, tfs array<int>, n long, most int, least int, corpus string, bucket int")
        self.lengths = read("lengths", "range long, place int, id string, dl int, rows long, corpus string")
        #: Number and lengths of a corpus, once known: an index does not change.
        self.sizes: dict[str, tuple] = {}

    def blocks(self, kind: str, words: list[str]) -> DataFrame:
        """The words' blocks; nothing else is read."""
        of = self.spark.range(1).select(F.array(*[bucket_of(F.lit(w), self.buckets).cast("int") for w in words])).first()[0]
        return self.postings.where((F.col("corpus") == kind) & F.col("bucket").isin(sorted(set(of))) & F.col("term").isin(words))

    def search(self, kind: str, query: str, top: int = 10, allowed: DataFrame | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """The best (id, score) of a corpus; ``allowed`` (id) is the filter."""
        counts = Counter(query_tokens(query))
        none = self.lengths.select("id", F.lit(0.0).alias("score")).where("false")
        if not counts or top < 1:
            return none
        blocks = self.blocks(kind, sorted(counts))
        here = self.lengths.where(F.col("corpus") == kind)
        chosen = None
        if allowed is None:
            if kind not in self.sizes:
                self.sizes[kind] = self.classes.where(F.col("corpus") == kind).agg(F.sum("n"), F.sum("dl")).first()
            size = self.sizes[kind]
            df = blocks.groupBy("term").agg(F.sum("n").alias("n"))
        else:
            # what passes is found once, and so are its postings, which counts and scores both read
            allowed = allowed.select(F.col("id").cast("string").alias("id")).distinct()
            here = held(here.join(allowed, "id", "left_semi").select("range", "place", "id", "dl", "rows"))
            size = here.agg(F.sum("rows"), F.sum(F.col("dl") * F.col("rows"))).first()
            chosen = held(_each(blocks, here))
            df = chosen.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        n = size[0] or 0
        if not n:
            return none
        mean = max((size[1] or 0) / n, 1.0)
        # a number for each word of the query
        weight = {r.term: counts[r.term] * math.log1p((n - r.n + 0.5) / (r.n + 0.5)) for r in df.collect()}
        if not weight:
            return none
        of_word = F.create_map(*[F.lit(x) for w, v in sorted(weight.items()) for x in (w, v)])

        def part(tf: Column, dl: Column) -> Column:
            return of_word[F.col("term")] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))

        def scored(each: DataFrame) -> DataFrame:
            best = each.groupBy("id").agg(F.round(F.sum(part(F.col("tf"), F.col("dl"))), 6).alias("score"))
            return best.where("score > 0").orderBy(F.desc("score"), "id").limit(top)

        if chosen is not None:
            return scored(chosen)
        bounds = blocks.groupBy("range").agg(F.sum(part(F.col("most"), F.col("least"))).alias("bound"))
        first = [r.range for r in bounds.orderBy(F.desc("bound"), "range").limit(FIRST + 1).collect()]
        if len(first) <= FIRST:
            return scored(_each(blocks, here))
        some = F.col("range").isin(first[:FIRST])
        so_far = [r.score for r in scored(_each(blocks.where(some), here.where(some))).collect()]
        least = so_far[-1] if len(so_far) == top else 0.0
        return scored(_each(blocks.join(bounds.where(F.col("bound") >= least - 1e-6).select("range"), "range", "left_semi"), here))


def _each(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, term, tf, dl) of the blocks' documents that are among these."""
    each = blocks.select("term", "range", F.inline(F.arrays_zip("places", "tfs"))).withColumnsRenamed({"places": "place", "tfs": "tf"})
    return each.join(docs.select("range", "place", "id", "dl"), ["range", "place"]).select("id", "term", "tf", "dl")


def store_index(t: Tables, folder: str, kinds: tuple[str, ...] = KINDS) -> SearchIndex:
    """Write the index of the graph's corpora beside a stored graph, or anywhere."""
    build_index({k: corpus(t, k) for k in kinds}, folder)
    return SearchIndex(t["Doc"].sparkSession, folder)


def index_of(t: Tables, kinds: tuple[str, ...] = KINDS) -> SearchIndex:
    """The index stored with the graph's version; one is built, once for these tables, where there is none."""
    stored = getattr(t, "stored", None)
    spark = t["Doc"].sparkSession
    if stored and (known := getattr(t, "search_index", None)) and known.folder == f"{stored}/search":
        return known
    if stored and _exists(spark, f"{stored}/search/layout"):
        t.search_index = SearchIndex(spark, f"{stored}/search")
        return t.search_index
    if stored:
        return store_index(t, f"{stored}/search")
    return store_index(t, f"{shared_folder(spark)}/search-{uuid.uuid4().hex}", kinds)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def allowed_docs(t: Tables, repo: str | None = None, with_tag: str | None = None, without_tag: str | None = None) -> DataFrame | None:
    """Documents that pass the filters; None without any."""
    if repo is None and with_tag is None and without_tag is None:
        return None
    docs = t["Doc"]
    if repo is not None:
        docs = docs.where(F.col("bounded_context") == repo)
    tag = lambda value: t["doc_tags"].where(F.col("value") == value).select(F.col("doc_id").alias("id"))
    if with_tag is not None:
        docs = docs.join(tag(with_tag), "id", "left_semi")
    if without_tag is not None:
        docs = docs.join(tag(without_tag), "id", "left_anti")
    return docs.select("id", "path")


def similar(
    t: Tables,
    query: str,
    kind: str = "doc",
    top: int = 10,
    index: SearchIndex | None = None,
    repo: str | None = None,
    with_tag: str | None = None,
    without_tag: str | None = None,
    min_score: float = 0.0,
    min_confidence: str = "low",
) -> DataFrame:
    """Hits (rank, corpus, id, score, role, kind, lifecycle, tags, covers) of one corpus, or of ``all``.

    ``repo`` and the tags restrict documents, and sections by their document; other
    corpora take no such filter.  ``min_score`` drops hits after the best are chosen;
    a result whose confidence is below ``min_confidence`` is empty.
    """
    if kind not in (*KINDS, "all"):
        raise ValueError(f"unknown type {kind}; it is one of {', '.join(KINDS)}, all")
    allowed = allowed_docs(t, repo, with_tag, without_tag)
    if allowed is not None and kind not in ("doc", "section"):
        raise ValueError(f"{kind}: filters hold for documents and sections")
    kinds = ("doc", "function", "entity", "section") if kind == "all" else (kind,)
    index = index or index_of(t, kinds)
    found = None
    for k in kinds:
        some = allowed
        if k == "section" and allowed is not None:
            headed = index.lengths.where(F.col("corpus") == "section").select("id", F.substring_index("id", "#", 1).alias("path"))
            some = headed.join(allowed.select("path"), "path", "left_semi").select("id")
        hits = index.search(k, query, top, some).select(F.lit(k).alias("corpus"), "id", "score")
        found = hits if found is None else found.unionByName(hits)
    best = found.orderBy(F.desc("score"), "corpus", "id").limit(top)
    # at most the top few from here on
    rows = [(k + 1, *r) for k, r in enumerate(best.collect()) if r.score >= min_score]
    each = [F.struct(F.lit(k).alias("rank"), F.lit(c).alias("corpus"), F.lit(i).alias("id"), F.lit(s).alias("score")) for k, c, i, s in rows]
    hits = best.sparkSession.range(1).select(F.inline(F.array(*each))) if rows else best.select(F.lit(0).alias("rank"), "corpus", "id", "score").where("false")
    levels = ("low", "medium", "high")
    if min_confidence != "low" and levels.index(confidence(hits).first().confidence if rows else "low") < levels.index(min_confidence):
        hits = hits.where("false")
    ids = [r[2] for r in rows]
    docs = t["Doc"].where(F.col("id").isin(ids)).select("id", "role", "kind", "lifecycle")
    tags = t["doc_tags"].where(F.col("doc_id").isin(ids)).groupBy(F.col("doc_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("tags"))
    covers = t["COVERS"].where(F.col("src").isin(ids)).groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("covers"))
    return hits.join(docs, "id", "left").join(tags, "id", "left").join(covers, "id", "left").select("rank", "corpus", "id", "score", "role", "kind", "lifecycle", "tags", "covers")


def _sql(query: str, kind: str, where: str = "TRUE") -> str:
    """(corpus, id, score) of the best ten, from the texts."""
    words, quote = query_tokens(query), lambda xs: ", ".join(f"'{x}'" for x in xs)
    text = {
        "doc": """SELECT id, concat_ws(' ', text, CASE WHEN starts_with(text, summary) THEN NULL ELSE summary END) AS t FROM "Doc" d JOIN documents ON doc_id = dkey""",
        "function": """SELECT symbol AS id, concat_ws(' ', signature, doc_comment) AS t FROM "Function" d""",
        "type": """SELECT symbol AS id, concat_ws(' ', signature, doc_comment, body_excerpt) AS t FROM "Type" d""",
        "entity": """SELECT id, concat_ws(' ', display, id, display, description) AS t FROM "Entity" d""",
    }[kind]
    tf = "SELECT id, w, len(w) AS dl FROM (SELECT id, list_filter(string_split_regex(lower(t), '[^a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ({stop})) AS w FROM ({text} WHERE {where}) AS x) AS y".format(stop=quote(STOPWORDS), text=text, where=where)
    return f"""SELECT * FROM (WITH d AS ({tf}), s AS (SELECT count(*) AS n, avg(dl) AS a FROM d), h AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, dl, unnest(w) AS term FROM d) AS u WHERE term IN ({quote(sorted(set(words)))}) GROUP BY id, dl, term),
      f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
      SELECT '{kind}' AS corpus, id, round(sum(q.k * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(a, 1)))), 6) AS score
      FROM h JOIN f USING (term) JOIN (SELECT term, count(*) AS k FROM (VALUES {", ".join(f"('{w}')" for w in words)}) AS v(term) GROUP BY term) q USING (term), s GROUP BY id HAVING score > 0 ORDER BY score DESC, id LIMIT 10) AS top_{kind}"""


_HITS = """, hit AS ({found}), best AS (SELECT row_number() OVER (ORDER BY score DESC, corpus, id) AS rank, * FROM hit)
    SELECT CAST(rank AS INTEGER) AS rank, corpus, best.id, score, role, kind, lifecycle, tags, covers FROM best LEFT JOIN "Doc" d ON d.id = best.id
    LEFT JOIN (SELECT doc_id, string_agg(DISTINCT value, ',' ORDER BY value) AS tags FROM "doc_tags" GROUP BY doc_id) g ON g.doc_id = best.id
    LEFT JOIN (SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS covers FROM "COVERS" GROUP BY src) c ON c.src = best.id WHERE rank <= 10 AND score >= {least}"""
_FILTER = """d.bounded_context IS NOT NULL AND EXISTS (SELECT 1 FROM "doc_tags" g WHERE g.doc_id = d.id AND g.value = 'research') AND NOT EXISTS (SELECT 1 FROM "doc_tags" g WHERE g.doc_id = d.id AND g.value = 'graph-kernel')"""
_TYPES = "holds the type t25, type t30"
_NAMES = "Brand details of the graph step, lists and builds; customer africa"


@extra("similar_docs_indexed", _HITS.format(found=_sql(QUERY, "doc"), least=0), "Doc doc_tags COVERS")
def similar_docs_indexed(t: Tables) -> DataFrame:
    return similar(t, QUERY, "doc")


@extra("similar_docs_filtered", _HITS.format(found=_sql(QUERY, "doc", _FILTER.replace("d.bounded_context IS NOT NULL AND ", "")), least=1.0), "Doc doc_tags COVERS")
def similar_docs_filtered(t: Tables) -> DataFrame:
    """Documents with one tag and without another, from a score of 1 on."""
    return similar(t, QUERY, "doc", with_tag="research", without_tag="graph-kernel", min_score=1.0)


@extra("similar_functions_indexed", _HITS.format(found=_sql(_NAMES, "function"), least=0), "Function Doc doc_tags COVERS")
def similar_functions(t: Tables) -> DataFrame:
    return similar(t, _NAMES, "function")


@extra("similar_types_indexed", _HITS.format(found=_sql(_TYPES, "type"), least=0), "Type Doc doc_tags COVERS")
def similar_types(t: Tables) -> DataFrame:
    return similar(t, _TYPES, "type")


@extra("similar_entities_indexed", _HITS.format(found=_sql(_NAMES, "entity"), least=0), "Entity Doc doc_tags COVERS")
def similar_entities(t: Tables) -> DataFrame:
    return similar(t, _NAMES, "entity")


@extra(
    "audit_doc_region",
    _HITS.format(found="SELECT corpus, id, score FROM (" + _sql(QUERY, "doc", "d.bounded_context = (SELECT max(bounded_context) FROM \"Doc\")") + ")", least=0),
    "Doc doc_tags COVERS",
)
def audit_doc_region(t: Tables) -> DataFrame:
    """Documents of one repository by their likeness to a text of another."""
    last = t["Doc"].agg(F.max("bounded_context")).first()[0]
    return similar(t, QUERY, "doc", repo=last or "")


def scan(t: Tables, kind: str, query: str, top: int = 10) -> DataFrame:
    """The same by a pass over the texts, without an index."""
    return bm25(corpus(t, kind), query, top)
