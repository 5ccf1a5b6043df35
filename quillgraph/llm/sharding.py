"""Sharding by a hypergeometric communication matrix, in DataFrame operations only.

A uniform shuffle of all rows into shards whose sizes are exact:

1. *Permute locally*: each input partition is sorted by a random number and
   written with the partition's number and each row's place in it.
2. *Draw the matrix*: how many rows each partition sends to each shard.  In a
   uniform shuffle these counts are multivariate hypergeometric: the partitions
   take without replacement from the shards' places.  They are drawn down a tree
   of :data:`FANOUT` partitions a node, so that the nodes of a level are drawn
   independently of each other, each from what its parent got.
3. *Exchange*: the first rows of a permuted partition go to shard 0, the next to
   shard 1, as the matrix says.
4. *Permute again*: a shard's rows are ordered by a second random number.  A shard
   is dealt in blocks of that number's range, about :data:`BLOCK` rows each, so no
   task holds a shard; a block's first slot is the sum of the blocks before it.

What the first step writes settles every later one, whatever tasks are repeated:
partition and place are stored, and all later draws are hashes of the seed and
them.  The matrix has at most :data:`CELLS` cells (more input partitions than that
allows are coalesced, without a shuffle), so it can be broadcast.

A draw walks the distribution from its mode and back, nine standard deviations
and 30 to either side; what lies beyond has a chance under the 2^-53 that a random
number resolves.  Its work grows with the square root of the rows of a node.

Rows are whole and equal rows are rows of their own; null ids, null or empty texts
and any column names are nothing special, since no column is read.  Sizes differ by
one row at most, the larger ones first.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace

#: The matrix has so many cells at most: 32 MB as numbers.
CELLS = 1 << 22
#: Partitions of a tree node that are drawn one after another.
FANOUT = 32
#: Rows of a shard that are ordered together, about.
BLOCK = 8192

NO_COUNTS = "array<bigint>"


def uniform(*key: Column) -> Column:
    """In (0, 1), from 52 bits of a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 12).cast("double") + 0.5) / float(1 << 52)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _steps(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast(NO_COUNTS))


def hypergeometric(u: Column, pool: Column, good: Column, draws: Column) -> Column:
    """How many of ``draws`` rows, taken from ``pool`` of which ``good`` are good, are good: the value for the uniform ``u``."""
    share = good / F.greatest(pool, F.lit(1))
    spread = F.sqrt(draws * share * (1 - share) * (pool - draws) / F.greatest(pool - 1, F.lit(1)))
    least, most = F.greatest(F.lit(0).cast("long"), draws + good - pool), F.least(draws, good)
    mode = F.greatest(least, F.least(most, F.floor((draws + 1).cast("double") * (good + 1) / (pool + 2)).cast("long")))
    given = F.struct(pool.alias("pool"), good.alias("good"), draws.alias("draws"), mode.alias("mode"), least.alias("least"), most.alias("most"), (F.ceil(spread * 9) + 30).cast("long").alias("width"))

    def drawn(g: Column) -> Column:
        bad = (g["pool"] - g["good"] - g["draws"]).cast("double")

        def next_up(k: Column) -> Column:
            return (g["good"] - k).cast("double") * (g["draws"] - k) / ((k + 1) * (bad + k + 1))

        def next_down(k: Column) -> Column:
            return k.cast("double") * (bad + k) / ((g["good"] - k + 1).cast("double") * (g["draws"] - k + 1))

        up, down = F.least(g["width"], g["most"] - g["mode"]), F.least(g["width"], g["mode"] - g["least"])

        def weight(steps: Column, ratio: Callable, sign: int) -> Column:
            """Of all values on one side, that of the mode being 1."""
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
            add = lambda s, i: _let(s["w"] * ratio(g["mode"] + sign * (i - 1)), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum")))
            return F.aggregate(_steps(steps), start, add, lambda s: s["sum"])

        def walk(steps: Column, ratio: Callable, sign: int, target: Column) -> Column:
            """The value at which the sum reaches the target."""
            start = F.struct(g["mode"].alias("k"), F.lit(1.0).alias("w"), target.alias("left"))

            def on(s: Column, _: Column) -> Column:
                ahead = _let(s["w"] * ratio(s["k"]), lambda w: F.struct((s["k"] + sign).alias("k"), w.alias("w"), (s["left"] - w).alias("left")))
                return F.when(s["left"] < 0, s).otherwise(ahead)

            return F.aggregate(_steps(steps), start, on, lambda s: s["k"])

        def chosen(side: Column) -> Column:
            target = u * (1 + side["up"] + side["down"]) - 1
            return F.when(target < 0, g["mode"]).when(target < side["up"], walk(up, next_up, 1, target)).otherwise(walk(down, next_down, -1, target - side["up"]))

        return _let(F.struct(weight(up, next_up, 1).alias("up"), weight(down, next_down, -1).alias("down")), chosen)

    return _let(given, drawn)


def _take(places: Column, n: Column, shards: int, *key: Column) -> Column:
    """Of each shard's free places, how many ``n`` rows take."""
    start = F.struct(F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + x).alias("pool"), n.alias("need"), F.array().cast(NO_COUNTS).alias("took"))

    def shard(s: Column, i: Column) -> Column:
        k = hypergeometric(uniform(*key, i), s["pool"], places[i], s["need"])
        return _let(k, lambda k: F.struct((s["pool"] - places[i]).alias("pool"), (s["need"] - k).alias("need"), F.concat(s["took"], F.array(k)).alias("took")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, shard, lambda s: s["took"])


def _share_out(places: Column, children: Column, shards: int, *key: Column) -> Column:
    """The children (node, n) of a tree node with their counts: each takes of what those before it left."""
    start = F.struct(places.alias("left"), F.array().cast("array<struct<node:bigint,counts:array<bigint>>>").alias("given"))

    def child(s: Column, c: Column) -> Column:
        def took(t: Column) -> Column:
            one = F.struct(c["node"].alias("node"), t.alias("counts"))
            return F.struct(F.zip_with(s["left"], t, lambda a, b: a - b).alias("left"), F.concat(s["given"], F.array(one)).alias("given"))

        return _let(_take(s["left"], c["n"], shards, *key, c["node"]), took)

    return F.aggregate(children, start, child, lambda s: s["given"])


def communication_matrix(counts: DataFrame, shards: int, work: Workspace, seed: int = 11) -> DataFrame:
    """For partitions (part, n): part and ``counts``, the rows each shard gets of it."""
    size = counts.agg(F.sum("n"), F.max("part")).first()
    total, last = int(size[0] or 0), int(size[1] or 0)
    levels = 1
    while FANOUT**levels <= last:
        levels += 1
    places = [total // shards + (s < total % shards) for s in range(shards)]
    now = work.spark.range(1).select(F.col("id").alias("node"), F.array(*[F.lit(p).cast("long") for p in places]).alias("counts"))
    for level in reversed(range(levels)):
        nodes = counts.groupBy(F.floor(F.col("part") / FANOUT**level).cast("long").alias("node")).agg(F.sum("n").alias("n"))
        children = nodes.groupBy(F.floor(F.col("node") / FANOUT).cast("long").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("children"))
        given = now.join(children, F.col("node") == F.col("parent")).select(F.explode(_share_out(F.col("counts"), F.col("children"), shards, F.lit(seed), F.lit(level))).alias("c"))
        now = work.table(given.select("c.node", "c.counts"), f"matrix-{level}")
    return now.withColumnRenamed("node", "part")


def shuffle_into_shards(spark: SparkSession, docs: DataFrame, shards: int = 8, seed: int = 11) -> DataFrame:
    """Each row as ``row`` with its ``shard`` and its ``slot`` in the shard, from 0 without gaps."""
    if shards < 1:
        raise ValueError("shards: 1 or more")
    work = Workspace(spark, "sharding")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    mixed = docs.select(row).coalesce(max(1, min(65_536, CELLS // shards))).withColumn("luck", F.rand(seed)).sortWithinPartitions("luck")
    place = mixed.select("row", F.monotonically_increasing_id().alias("id"))
    rows = work.table(place.select("row", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("place")), "rows")
    counts = work.table(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "counts")
    matrix = communication_matrix(counts, shards, work, seed)
    until = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.aggregate(F.slice("counts", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    bounds = F.broadcast(matrix.select("part", until.alias("until")))
    blocks = max(1, -(-(counts.agg(F.sum("n")).first()[0] or 0) // (shards * BLOCK)))

    def dealt(frame: DataFrame) -> DataFrame:
        again = F.xxhash64(F.lit(seed + 1), "part", "place")
        block = F.floor(uniform(F.lit(seed + 1), F.col("part"), F.col("place")) * blocks).cast("long")
        shard = F.size(F.filter("until", lambda x: x <= F.col("place"))).cast("int")
        return frame.join(bounds, "part").select("*", shard.alias("shard"), block.alias("block"), again.alias("again"))

    sizes = dealt(rows.select("part", "place")).groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = work.table(sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "first")
    within = Window.partitionBy("shard", "block").orderBy("again", "part", "place")
    ordered = dealt(rows).select("row", "shard", "block", (F.row_number().over(within) - 1).cast("long").alias("rank"))
    return ordered.join(first, ["shard", "block"]).select("row", "shard", (F.col("first") + F.col("rank")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet files a shard; a file is a run of slots in their order."""
    blocks = sharded.select("row", "slot", "shard").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    blocks.write.partitionBy("shard").parquet(path)
