"""A corpus pipeline of five stages, each a decision of one operator.

``STAGES`` holds (name, function); each function takes (spark, docs, sf_dir)
and returns a frame, which :func:`run` writes as Parquet and reads again as the
next one's documents.  All but the last return the columns of ``documents``.

Each row is decided by its own text, whatever other rows have its id: a null id
or one that several rows share is no reason to keep or drop a row.  Of rows that
are equal in id and text one stays.  A null text counts as empty; an empty text
is clean, is a copy of other empty ones, and has no shingles, so it is near to
nothing.  Where several rows of a group could stay, the one with the largest id
(exact copies) or the smallest (near ones, a null id first) does, then the one
with the least digest.  Columns beyond those of ``documents``, whatever their
names, pass through.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.decontaminate import decontaminate
from quillgraph.llm.exact_dedup import exact_dedup
from quillgraph.llm.jaccard_join import jaccard_components
from quillgraph.llm.mixing import mix
from quillgraph.llm.shared import NO_ID, Workspace
from quillgraph.llm.toxicity import toxicity


def _named(docs: DataFrame) -> DataFrame:
    """Rows as a struct, under what names a document: its id and the digest of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.sha2(text, 256).alias("digest"))


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row for each of the kept (doc_id, text_sha256)."""
    kept = kept.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("text_sha256").alias("digest")).distinct()
    one = F.row_number().over(Window.partitionBy("id", "digest").orderBy("id"))
    return _named(docs).join(kept, ["id", "digest"], "left_semi").withColumn("one", one).where("one = 1").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(spark, docs, labels, carry=True).where("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest id of equal texts stays."""
    return _only(docs, exact_dedup(spark, docs).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each component stays, and all rows without words."""
    found = jaccard_components(spark, docs, k=5, num=75, den=100, digests=True)
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text_sha256")).alias("least")
    one = found.where("component is not null").groupBy("component").agg(least).select("least.*")
    return _only(docs, one.unionByName(found.where("component is null").select("doc_id", "text_sha256")))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(spark, docs, benchmark, carry=True).where("not contaminated").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents, all columns as they are, with topic, n_tokens, weight and probability; one of these that a document has already is named ``mixing_...``."""
    taken = {c.lower() for c in docs.columns}
    added = [F.col(c).alias(f"mixing_{c}" if c in taken else c) for c in ("topic", "n_tokens", "weight", "probability")]
    return mix(spark, docs, carry=True).where("sampled").select("row.*", *added)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
]

#: The learnt scores of the first stage and the edits of the fourth have no SQL; the tests hold all stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them is in the shared folder."""
    work = Workspace(spark, "pipeline")

    def step(docs: DataFrame, stage: tuple[int, tuple[str, Callable]]) -> DataFrame:
        k, (_, f) = stage
        out = work.table(f(spark, docs, sf_dir), f"stage-{k}")
        work.keep(f"stage-{k}")
        return out

    return functools.reduce(step, enumerate(STAGES), spark.read.parquet(f"{sf_dir}/documents.parquet"))
