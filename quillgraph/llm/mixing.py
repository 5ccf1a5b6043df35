"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are summed by cell (source, language, topic).  Raking multiplies the
cells of each source by the factor that gives the source its target, then each
language's, then each topic's, and repeats until all three marginals hold.  A
document's calibrated probability is its cell's factor over the largest factor,
so the kept tokens have the target marginals in expectation.  Each row has a draw of
its own, a hash of its id, its text and its place in the table: rows without an id,
and rows that repeat one, stand or fall by themselves, and the same table read in the
same way keeps the same rows.

The cells are few (the product of the distinct values), whatever the number of
documents, and stay in Spark; only the largest deviation comes to the driver.

A null source or language is a value of its own, ``(none)``.  Where targets of a
marginal are given, values that have none, or none over 0, are left out (factor
0); targets of values that no document has are spread over the others.  Where no
mixture has all three marginals, raking stops after ``rounds`` and the last
marginal (topic) holds.  Documents without tokens take part with their cell's
factor; a cell without any tokens has factor 1 unless a value of it is left out.

Without ``carry`` texts are read once: the features of all rows are written and the
later steps read those.  Rows to carry are not written; their texts are read a second
time when the factors are known.  Of the tables written on the way only features and
factors stay, which the result reads.  The cells lie in one partition as long as
they are few, so that raking exchanges nothing.  Where the factors are too many to
be broadcast, rows of a hot cell are split by the engine's skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace

MARGINS = ("source", "lang", "topic")
NONE = "(none)"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Up to so many cells are raked in one partition.
FEW_CELLS = 200_000


def n_tokens(text: Column) -> Column:
    """Runs of other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from what the text is made of."""
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda marks: (F.length(text) - F.length(F.translate(text, marks, ""))) / size
    table, symbols = "|{}<>;=", "%$#*&@^~"
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty")
        # one pass settles both for most texts
        .when(share(table + symbols) <= 0.02, F.when(share(CAPITALS) > 0.4, "capitals").otherwise("prose"))
        .when(share(table) > 0.02, "table")
        .when(share(symbols) > 0.02, "symbols")
        .when(share(CAPITALS) > 0.4, "capitals")
        .otherwise("prose")
    )


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Targets in proportion to a power of the observed tokens: the usual flattening of a mixture."""
    return cells.groupBy(margin).agg(F.sum("tokens").alias("tokens")).select(margin, F.pow(F.col("tokens").cast("double"), F.lit(power)).alias("target"))


def _with_targets(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Each cell's targets, as shares of the targets of the values that occur."""
    for m in MARGINS:
        wanted = cells.select(m).distinct().join(targets[m].select(m, F.col("target").cast("double").alias("target")), m, "left")
        wanted = wanted.withColumn("target", F.greatest(F.coalesce("target", F.lit(0.0)), F.lit(0.0)))
        total = wanted.agg(F.sum("target").alias("all"))
        share = wanted.join(total, F.lit(True)).select(m, F.when(F.col("all") > 0, F.col("target") / F.col("all")).otherwise(F.lit(0.0)).alias(f"to_{m}"))
        cells = cells.join(share, m)
    return cells


def rake(cells: DataFrame, targets: dict[str, DataFrame], work: Workspace, rounds: int = 40, at_once: int = 4, tolerance: float = 1e-6) -> DataFrame:
    """Cells (source, lang, topic, tokens) with ``share``, the raked share of all tokens."""
    now = _with_targets(cells, targets).withColumn("share", F.col("tokens").cast("double"))
    now = work.table(now, "rake-0")
    few = now.count() <= FEW_CELLS
    for step in range(1, -(-rounds // at_once) + 1):
        now = now.coalesce(1) if few else now
        for _ in range(at_once):
            for m in MARGINS:
                sum_m = F.sum("share").over(Window.partitionBy(m))
                now = now.withColumn("share", F.when(sum_m > 0, F.col("share") * F.col(f"to_{m}") / sum_m).otherwise(F.lit(0.0)))
        now = work.table(now, f"rake-{step}")
        work.drop(f"rake-{step - 1}")
        off = [now.groupBy(m).agg(F.abs(F.sum("share") - F.first(f"to_{m}")).alias("off")).agg(F.max("off")).first()[0] or 0.0 for m in MARGINS[:2]]
        if max(off) <= tolerance:
            break
    return now


def mix(
    spark: SparkSession,
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    power: float = 0.8,
    seed: int = 20,
    carry: bool = False,
) -> DataFrame:
    """Returns doc_id, source, lang, topic, n_tokens, weight, probability, sampled; one row per row.

    ``targets`` has a frame (value, target) for ``source``, ``lang`` and
    ``topic``; a missing one is tempered by ``power``.  ``weight`` scales a
    document's tokens to the target mixture (1: as often as now).  With ``carry``
    also ``row``, the columns of docs as a struct, whatever their names.
    """
    work = Workspace(spark, "mixing")
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"),
        topic_of(text).alias("topic"),
        n_tokens(text).alias("n_tokens"),
        # uniform in [0, 1) from 52 bits of a hash
        (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text, F.monotonically_increasing_id()), 12) / F.lit(float(1 << 52))).alias("chance"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    if not carry:
        rows = work.table(rows, "rows")
    cells = work.table(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    given = targets or {}
    wanted = {m: given[m] if m in given else tempered(cells, m, power) for m in MARGINS}
    raked = rake(cells.where("tokens > 0"), wanted, work)
    total, top = cells.agg(F.sum("tokens").alias("all")), F.max("weight").alias("top")
    weights = raked.join(total, F.lit(True)).select(*MARGINS, (F.col("share") / (F.col("tokens") / F.col("all"))).alias("weight"))
    # cells without tokens
    bare = cells.where("tokens = 0").select(*MARGINS)
    left_out = F.lit(False)
    for m in given:
        bare = bare.join(given[m].where("target > 0").select(m).distinct().withColumn(f"has_{m}", F.lit(True)), m, "left")
        left_out = left_out | F.col(f"has_{m}").isNull()
    bare = bare.select(*MARGINS, F.when(left_out, 0.0).otherwise(1.0).alias("weight"), F.when(left_out, 0.0).otherwise(1.0).alias("probability"))
    weights = weights.join(weights.agg(top), F.lit(True)).select(*MARGINS, "weight", F.when(F.col("top") > 0, F.col("weight") / F.col("top")).otherwise(0.0).alias("probability"))
    factors = work.table(weights.unionByName(bare), "factors")
    work.keep("rows", "factors")
    sampled = F.col("chance") < F.col("probability")
    return rows.join(factors, list(MARGINS)).select("doc_id", *MARGINS, "n_tokens", "weight", "probability", sampled.alias("sampled"), *(["row"] if carry else []))
