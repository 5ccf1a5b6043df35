"""Nearest vectors by an inverted-file index, exactly or by probing, and all pairs above a cosine.

Centroids are fitted by spherical k-means on a sample of at most :data:`SAMPLE` vectors
(those of least hash); every vector is dealt to the cell of its nearest centroid.  A
search probes the cells nearest to its query.  How many is measured: of a stated recall,
the least number of cells that gives it for queries drawn from the sample, against a
comparison with all vectors.  A filter widens the probes until enough vectors pass, to
all cells if need be, so a narrow filter loses nothing.

Many queries are answered in blocks: a cell's vectors and its queries are dealt to parts of
:data:`BLOCK` rows or so, whatever their number, and a task multiplies two parts and keeps
the best of each query.  Pairs above a cosine come from groups of cells, of one to four
blocks: a vector is sent once to each group with a cell that can hold a partner, by the
triangle inequality between angles (the angle to the centroid is at most the cell's widest
angle plus that of the threshold), so all are found, and two groups meet in one task; equal
vectors are one, with a table of their members, or rows of many ids that a task pairs where
all pairs are asked for, which it gives out piece by piece.  Where a threshold reaches every cell, n
vectors are moved n / (4 * :data:`BLOCK`) times, whatever the number of cells.

Vectors are compared by direction: a zero vector has cosine 0 to all.  Null vectors and
those with null or non-finite entries are left out, as are those of another length than
most.  Of equal scores the least id comes first.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .analytics import Tables, _PROBE, extra, held, shared_folder

#: Vectors that centroids are fitted on, at most; and queries that the number of probes is measured with.
SAMPLE, MEASURED = 20_000, 100
#: Cells, at most.
CELLS = 4096
#: Rows of one side of a block, about.
BLOCK = 4096
#: Rows that a task compares at a time with all of the other side.
SLICE = 512
#: Ids of equal vectors that are one row, about; and pairs that a task gives out at a time, about.
COPIES, OUT = 256, 500_000


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(id, v): vectors of (id, embedding) that count, of length 1 or 0."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = vectors.select("id", e.alias("e")).where(e.isNotNull() & ~bad & (F.size(e) > 0))
    length = good.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, c: s + c * c))
    v = F.when(norm > 0, F.transform("e", lambda c: c / norm)).otherwise(F.col("e"))
    return good.where(F.size("e") == (length.d if length else 0)).select("id", v.alias("v"))


def _matrix(values) -> np.ndarray:
    return np.array([np.asarray(x, float) for x in values])


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Spherical k-means; an empty cell takes the vector that is worst placed."""
    r = np.random.default_rng(seed)
    c = sample[r.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        near = sample @ c.T
        cell, best = near.argmax(axis=1), near.max(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, cell, sample)
        for k in np.flatnonzero(np.bincount(cell, minlength=cells) == 0):
            worst = int(best.argmin())
            new[k], best[worst] = sample[worst], 1.0
        c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-30)
    return c


def _listed(lists: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, and of each list where it begins in them and how many there are."""
    n = lists.map(len).to_numpy(np.int64)
    return np.concatenate([np.asarray(x) for x in lists]), np.cumsum(n) - n, n


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _nearest_cells(centroids: np.ndarray, n: int):
    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        near = -(_matrix(v) @ centroids.T)
        return pd.Series(list(np.argsort(near, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return cells


def _grouped(sizes: dict[int, int], centroids: np.ndarray) -> tuple[int, dict[int, tuple[int, int]]]:
    """How many groups, and of each cell with vectors its first group and in how many it is: cells that lie along the widest axis share a group, a large cell is several."""
    most = min(4 * BLOCK, max(BLOCK, sum(sizes.values()) // 16))
    axis = np.linalg.svd(centroids, full_matrices=False)[2][0]
    of, last, held_by_last = {}, -1, most
    for c in sorted(sizes, key=lambda c: (float(centroids[c] @ axis), c)):
        n = -(-sizes[c] // most)
        if n > 1:
            of[c] = (last + 1, n)
            last, held_by_last = last + n, most
        else:
            if held_by_last + sizes[c] > most:
                last, held_by_last = last + 1, 0
            of[c] = (last, 1)
            held_by_last += sizes[c]
    return last + 1, of


def _reached_groups(centroids: np.ndarray, radius: np.ndarray, of: dict[int, tuple[int, int]], threshold: float):
    """The groups with a cell that can hold a vector within the threshold of this one, its own among them."""
    most = radius + math.acos(threshold - 1e-6) + 1e-9  # what rounds to the threshold counts
    groups = {c: np.arange(first, first + n) for c, (first, n) in of.items()}

    @F.pandas_udf("array<int>")
    def reached(v: pd.Series, own: pd.Series) -> pd.Series:
        near = _angle(_matrix(v) @ centroids.T) <= most
        return pd.Series([np.unique(np.concatenate([[o], *(groups[c] for c in np.flatnonzero(a) if c in groups)])).astype(np.int32) for a, o in zip(near, own, strict=True)])

    return reached


def _dealt(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of (cell, ...) with a part of their cell, and (cell, parts): parts of a block's size by a hash of the key."""
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    # a row for each cell
    return rows.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64(key, F.lit(5)), "parts").cast("int")).drop("parts"), parts


def _blocks(rows: DataFrame, queries: DataFrame) -> tuple:
    """Both sides grouped by (cell, part of the rows, part of the queries)."""
    rows, row_parts = _dealt(rows, "id")
    queries, query_parts = _dealt(queries, "query")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(F.broadcast(query_parts), "cell").select("cell", "part", numbers("parts").alias("other"), "id", "v")
    right = queries.join(F.broadcast(row_parts), "cell").select("cell", F.col("part").alias("other"), numbers("parts").alias("part"), "query", F.col("v").alias("q"))
    key = ["cell", "part", "other"]
    return left.groupBy(*key), right.groupBy(*key)


@dataclass
class VectorIndex:
    spark: SparkSession
    folder: str
    centroids: np.ndarray
    radius: np.ndarray
    probes: int
    recall: float

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/cells")

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, cells: int | None = None, recall: float = 0.97, k: int = 10) -> VectorIndex | None:
        """Write the index of (id, embedding) to a new folder; None if no vector counts."""
        spark = vectors.sparkSession
        unit_vectors(vectors).write.parquet(f"{folder}/unit")
        unit = spark.read.parquet(f"{folder}/unit")
        n = unit.count()
        if not n:
            return None
        sample = _matrix(r.v for r in unit.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE).collect())
        cells = min(cells or CELLS, CELLS, max(1, math.isqrt(n)), len(sample))
        c = fit_centroids(sample, cells)
        cell = _nearest_cells(c, 1)(F.col("v"))[0]
        unit.select("id", "v", cell.alias("cell")).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{folder}/cells")
        placed = spark.read.parquet(f"{folder}/cells")

        def widest(batches):
            for b in batches:
                a = _angle(np.einsum("ij,ij->i", _matrix(b["v"]), c[b["cell"]]))
                yield pd.DataFrame({"cell": b["cell"], "angle": a}).groupby("cell", as_index=False).max()

        wide = {r.cell: r.angle for r in placed.mapInPandas(widest, "cell int, angle double").groupBy("cell").agg(F.max("angle").alias("angle")).collect()}
        index = cls(spark, folder, c, np.array([wide.get(x, -10.0) for x in range(len(c))]), cells, 1.0)
        index._measure(recall, k)
        spark.createDataFrame([(x, [float(y) for y in c[x]], float(index.radius[x]), index.probes, index.recall) for x in range(len(c))], "cell int, centroid array<double>, radius double, probes int, recall double").coalesce(1).write.parquet(f"{folder}/centroids")
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex:
        rows = sorted(spark.read.parquet(f"{folder}/centroids").collect(), key=lambda r: r.cell)
        return cls(spark, folder, _matrix(r.centroid for r in rows), np.array([r.radius for r in rows]), rows[0].probes, rows[0].recall)

    def _measure(self, recall: float, k: int) -> None:
        """The least number of probes that finds the wanted share of the k best of a few hundred queries."""
        queries = self.vectors.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(MEASURED).select(F.col("id").alias("query"), "v")
        exact = {(r.query, r.id) for r in self.search_all(queries, k, len(self.centroids)).collect()}
        where = {(r.query, r.id): r.at for r in self._places(queries, exact)}
        for p in range(1, len(self.centroids) + 1):
            found = sum(where[x] < p for x in exact) / max(1, len(exact))
            if found >= recall:
                break
        self.probes, self.recall = p, found

    def _places(self, queries: DataFrame, exact: set) -> list:
        """At which probe each of the (query, id) would be met."""
        pairs = self.spark.createDataFrame(sorted(exact), f"query {queries.schema['query'].dataType.simpleString()}, id {self.vectors.schema['id'].dataType.simpleString()}")
        order = queries.select("query", _nearest_cells(self.centroids, len(self.centroids))(F.col("v")).alias("order"))
        held = pairs.join(self.vectors.select("id", "cell"), "id").join(order, "query")
        return held.select("query", "id", (F.array_position("order", F.col("cell")) - 1).alias("at")).collect()

    def search(self, query: list[float], k: int = 10, allowed: DataFrame | None = None, probes: int | None = None) -> DataFrame:
        """The nearest (id, score); of those ``allowed`` (id), if given."""
        q = np.asarray(query, float)
        norm = float(np.linalg.norm(q))
        q = q / norm if norm else q
        order = np.argsort(-(self.centroids @ q), kind="stable")
        dot = F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in q]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        n = min(len(order), probes or self.probes)
        while True:
            some = self.vectors.where(F.col("cell").isin([int(x) for x in order[:n]]))
            if allowed is None:
                break
            some = some.join(allowed.select("id").distinct(), "id", "left_semi")
            # a filter leaves fewer: four times k vectors are wanted to choose from
            if n == len(order) or some.limit(4 * k).count() >= 4 * k:
                break
            n = min(len(order), 2 * n)
        return some.select("id", F.round(dot, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)

    def search_all(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query, rank, id, score) for many queries (query, v) of length 1 or 0."""
        rows = self.vectors.select("cell", "id", "v")
        asked = queries.select("query", "v", F.explode(_nearest_cells(self.centroids, min(len(self.centroids), probes or self.probes))(F.col("v"))).alias("cell"))
        left, right = _blocks(rows, asked)
        id_type, query_type = rows.schema["id"].dataType.simpleString(), queries.schema["query"].dataType.simpleString()

        def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query": b["query"][:0], "id": a["id"][:0], "score": np.zeros(0)})
            a = a.sort_values("id")
            score = np.round(_matrix(b["q"]) @ _matrix(a["v"]).T, 6)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            return pd.DataFrame({"query": np.repeat(b["query"].to_numpy(), top.shape[1]), "id": a["id"].to_numpy()[top.ravel()], "score": np.take_along_axis(score, top, 1).ravel()})

        found = left.cogroup(right).applyInPandas(best, f"query {query_type}, id {id_type}, score double")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")

    def pairs(self, threshold: float = 0.8, copies: bool = False) -> DataFrame:
        """(src, dst, score): all pairs of different vectors with at least this cosine, src before dst.

        Of equal vectors the one with the least id stands for all (:meth:`members`); with ``copies``
        each of them has its pairs, with those equal to it too.
        """
        if not 0 < threshold <= 1:
            raise ValueError("threshold: over 0, at most 1")
        one = held(self._copies() if copies else self._copies().groupBy("v").agg(F.min(F.struct("first", "cell")).alias("x")).select("v", "x.cell", "x.first", F.array("x.first").alias("ids"), F.lit(1).alias("n")))
        _, of = _grouped({r.cell: r.n for r in one.groupBy("cell").agg(F.sum("n").alias("n")).collect()}, self.centroids)
        # a row for each cell
        parts = self.spark.createDataFrame([(c, first, n) for c, (first, n) in of.items()], "cell int, first_group int, groups int")
        placed = one.join(F.broadcast(parts), "cell").select("ids", "v", (F.col("first_group") + F.pmod(F.xxhash64("first", F.lit(5)), "groups")).cast("int").alias("own"))
        met = placed.select("ids", "v", "own", F.explode(_reached_groups(self.centroids, self.radius, of, threshold)("v", "own")).alias("other"))
        dealt = met.select("ids", "v", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
        kind = self.vectors.schema["id"].dataType.simpleString()

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = pd.concat(list(batches), ignore_index=True)
            x, y = int(rows["x"].iloc[0]), int(rows["y"].iloc[0])
            a, b = rows[rows["own"] == x], rows[rows["own"] == y]
            if not len(a) or not len(b):
                return
            left, right = _matrix(a["v"]), _matrix(b["v"]).T
            (ids, start, n), (others, other_start, other_n) = _listed(a["ids"]), _listed(b["ids"])
            for k in range(0, len(left), SLICE):
                score = left[k : k + SLICE] @ right
                i, j = np.nonzero(score >= threshold - 1e-6)
                score = np.round(score[i, j], 6)
                keep = (score >= threshold) & ((k + i <= j) if x == y else True)  # a row meets itself: its ids are of equal vectors
                i, j, score = k + i[keep], j[keep], score[keep]
                size = n[i] * other_n[j]
                cut = np.cumsum(size) // OUT
                for at in np.split(np.arange(len(i)), np.flatnonzero(np.diff(cut)) + 1):
                    pair = np.repeat(at, size[at])
                    within = np.arange(len(pair)) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
                    p, q = within // other_n[j[pair]], within % other_n[j[pair]]
                    own = (i[pair] != j[pair]) | (p < q) if x == y else np.ones(len(pair), bool)
                    src, dst, of_pair = ids[start[i[pair]] + p][own], others[other_start[j[pair]] + q][own], score[pair][own]
                    swap, differ = src > dst, src != dst
                    yield pd.DataFrame({"src": np.where(swap, dst, src)[differ], "dst": np.where(swap, src, dst)[differ], "score": of_pair[differ]})

        return dealt.groupBy("x", "y").applyInPandas(near, f"src {kind}, dst {kind}, score double")

    def _copies(self) -> DataFrame:
        """(v, cell, ids, first, n): equal vectors as one row, or as several of about :data:`COPIES` ids each, ``first`` the least; rows without an id are left out."""
        each = self.vectors.where("id IS NOT NULL").withColumn("of", F.xxhash64("id", F.lit(7)))
        parts = each.groupBy("v").agg(F.min("cell").alias("cell"), F.ceil(F.count("*") / COPIES).alias("parts")).where("parts > 1")
        # at most one row for each COPIES vectors
        many = each.select("id", "v", "cell", "of").join(F.broadcast(parts.select("v", "parts")), "v", "left").withColumn("part", F.pmod("of", F.coalesce("parts", F.lit(1))))
        rows = many.groupBy("v", "part").agg(F.min("cell").alias("cell"), F.sort_array(F.collect_list("id")).alias("ids"))
        return rows.select("v", "cell", "ids", F.col("ids")[0].alias("first"), F.size("ids").alias("n"))

    def members(self) -> DataFrame:
        """(id, stands_for): each vector with the least id of those equal to it."""
        least = self.vectors.groupBy("v").agg(F.min("id").alias("stands_for"))
        return self.vectors.join(least, "v").select("id", "stands_for")


def _index(t: Tables, where: Column | None = None) -> VectorIndex | None:
    spark = t["embeddings"].sparkSession
    rows = t["embeddings"].select(F.col("vec_id").alias("id"), "embedding")
    return VectorIndex.build(rows if where is None else rows.where(where), f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")


@extra("similar_vectors_indexed")
def similar_vectors_indexed(t: Tables) -> DataFrame:
    """The ten nearest of all vectors for each whose id is divisible by 100, by the measured number of probes."""
    index = _index(t)
    return index.search_all(index.vectors.where(F.col("id") % 100 == 0).select(F.col("id").alias("query"), "v"), 10)


@extra(
    "similar_vectors_filtered",
    f"SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_PROBE}::DOUBLE[]), 6) AS score FROM embeddings WHERE label = 3 AND vec_id < 60 ORDER BY score DESC, id LIMIT 10",
)
def similar_vectors_filtered(t: Tables) -> DataFrame:
    """Under a filter that few vectors pass: probes widen until all are seen."""
    allowed = t["embeddings"].where("label = 3 AND vec_id < 60").select(F.col("vec_id").alias("id"))
    return _index(t).search(_PROBE, 10, allowed)


@extra(
    "similar_vector_pairs",
    "SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) >= 0.4",
)
def similar_vector_pairs(t: Tables) -> DataFrame:
    """All pairs from a cosine of 0.4 on, those of equal vectors too."""
    index = _index(t)
    return index.pairs(0.4, copies=True) if index else t["embeddings"].where("false").select(F.col("vec_id").alias("src"), F.col("vec_id").alias("dst"), F.lit(0.0).alias("score"))
