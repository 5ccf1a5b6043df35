"""Communities in Spark: label propagation in key order, and Leiden with refinement.

Both keep labels, degrees and edges as tables; a step is a join and a grouping, and only
counts and sums come to the driver.

*In order.*  A sweep visits nodes by key, and a node sees the new labels of smaller keys
and the old ones of larger keys.  The outcome of a sweep is the one labelling that agrees
with itself under that rule, for a node depends on smaller keys only.  So a sweep starts
from the old labels and applies the rule to all nodes at once until nothing changes: after
k rounds all nodes whose chain of smaller neighbours is k long are settled, and changes die
out far sooner than the longest chain.

*Leiden.*  Nodes move by modularity in classes drawn anew for each sweep, so that few
neighbours move at once; a sweep that loses modularity is undone.  Then each community is
refined: its nodes start alone, and one that is still alone joins a neighbouring part of
its community.  Parts are what the next level's nodes stand for, with the communities as
their first labels.  Nodes join parts that they touch and that nobody of their class can be
leaving, so parts are connected; a community that a move has cut falls into its connected
parts at the end, which modularity gains from.  Equal gains go to the least label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analytics import Tables, community_report, extra, held, undirected

#: Classes of a sweep.
CLASSES = 3
EPSILON = 1e-10


def ordered_propagation(edges: DataFrame, passes: int = 50) -> DataFrame:
    """(id, label): each node takes the commonest label of its neighbours, the least on ties, node after node in key order, until a sweep changes nothing."""
    both = held(undirected(edges.where("src <> dst").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))))
    labels = held(both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    for _ in range(passes):
        state = labels.select("id", F.col("label").alias("old"), F.col("label").alias("new"))
        while True:
            seen = both.join(state.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), F.when(F.col("dst") < F.col("src"), F.col("new")).otherwise(F.col("old")).alias("label"))
            votes = seen.groupBy("id", "label").agg(F.count("*").alias("n"))
            best = votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("next"))
            ahead = held(state.join(best, "id").select("id", "old", F.col("next").alias("new"), (F.col("next") != F.col("new")).alias("moved")))
            state = ahead.select("id", "old", "new")
            if not ahead.where("moved").limit(1).count():
                break
        labels = state.select("id", F.col("new").alias("label"))
        if not state.where("old <> new").limit(1).count():
            break
    return labels


def _weighted(edges: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions, without loops; a pair named several times weighs as often, in whichever direction."""
    weight = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    once = edges.where("src <> dst").groupBy(F.least("src", "dst").cast("string").alias("a"), F.greatest("src", "dst").cast("string").alias("b")).agg(F.sum(weight).alias("w"))
    return once.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(once.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of a labelling (id, label) of a weighted graph (src, dst[, w])."""
    both = _weighted(edges)
    nodes = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    return _modularity(nodes.withColumn("loop", F.lit(0.0)), both, labels, both.agg(F.sum("w")).first()[0] or 0.0, resolution)


def _modularity(nodes: DataFrame, both: DataFrame, labels: DataFrame, total: float, resolution: float) -> float:
    """``k`` of a node holds its loops, twice as ``loop`` does not: a loop counts as its two ends."""
    if not total:
        return 0.0
    of = nodes.join(labels, "id")
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("x")), labels.select(F.col("id").alias("dst"), F.col("label").alias("y"))
    inside = both.join(a, "src").join(b, "dst").where("x = y").agg(F.sum("w")).first()[0] or 0.0
    sums = of.groupBy("label").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
    loops = of.agg(F.sum("loop")).first()[0] or 0.0
    return (inside + loops) / total - resolution * sums / total**2


def _gains(nodes: DataFrame, both: DataFrame, labels: DataFrame, total: float, resolution: float) -> DataFrame:
    """(id, label, gain) of each node and each label beside it, its own too, by what the node itself adds."""
    near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("to"))
    own = labels.select("id", "label", F.lit(0.0).alias("to"))
    near = near.unionByName(own).groupBy("id", "label").agg(F.sum("to").alias("to"))
    sums = nodes.join(labels, "id").groupBy("label").agg(F.sum("k").alias("held"))
    mine = nodes.join(labels.withColumnRenamed("label", "own"), "id").select("id", "k", "own")
    all_ = near.join(mine, "id").join(sums, "label")
    others = F.col("held") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)
    return all_.select("id", "own", "label", (F.col("to") - resolution * F.col("k") * others / total).alias("gain"))


def _class(seed: int):
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(CLASSES))


def _best(gains: DataFrame) -> DataFrame:
    """(id, label): where a node goes, its own label unless another is better."""
    top = F.min_by(F.struct("label", "gain"), F.struct(-F.round("gain", 12), F.col("label")))
    found = gains.groupBy("id", "own").agg(top.alias("top"), F.max(F.when(F.col("label") == F.col("own"), F.col("gain"))).alias("stay"))
    return found.select("id", F.when(F.col("top.gain") > F.coalesce("stay", F.lit(0.0)) + EPSILON, F.col("top.label")).otherwise(F.col("own")).alias("label"), "own")


def _move(nodes: DataFrame, both: DataFrame, labels: DataFrame, total: float, resolution: float, sweeps: int, seed: int) -> DataFrame:
    score = _modularity(nodes, both, labels, total, resolution)
    for sweep in range(sweeps):
        before, moved = labels, False
        for c in range(CLASSES):
            best = _best(_gains(nodes, both, labels, total, resolution))
            mine = _class(seed + sweep) == c
            now = held(best.select("id", F.when(mine, F.col("label")).otherwise(F.col("own")).alias("label"), (mine & (F.col("label") != F.col("own"))).alias("moved")))
            moved = moved or bool(now.where("moved").limit(1).count())
            labels = now.select("id", "label")
        if not moved:
            return labels
        after = _modularity(nodes, both, labels, total, resolution)
        if after <= score + EPSILON:
            return before
        score = after
    return labels


def _refine(nodes: DataFrame, both: DataFrame, labels: DataFrame, total: float, resolution: float, seed: int) -> DataFrame:
    """(id, label): connected parts of the communities."""
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("x")), labels.select(F.col("id").alias("dst"), F.col("label").alias("y"))
    inner = held(both.join(a, "src").join(b, "dst").where("x = y").select("src", "dst", "w"))
    parts = nodes.select("id", F.col("id").alias("label"))
    for c in range(2 * CLASSES):
        size = parts.groupBy("label").agg(F.count("*").alias("size"), F.min("id").alias("id"))
        alone = size.where("size = 1").select("label", "id")
        leaving = alone.where(_class(seed) == c % CLASSES).select("label")
        gains = _gains(nodes, inner, parts, total, resolution)
        # a node that may leave is no place to go to
        reachable = gains.where("label = own").unionByName(gains.where("label <> own").join(leaving, "label", "left_anti").select(*gains.columns))
        best = _best(reachable).join(leaving.withColumnRenamed("label", "own"), "own", "left_semi").select("id", F.col("label").alias("to"))
        parts = held(parts.join(best, "id", "left").select("id", F.coalesce("to", "label").alias("label")))
    return parts


def _connected(both: DataFrame, labels: DataFrame) -> DataFrame:
    """Communities cut to their connected parts, named by their least member."""
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("x")), labels.select(F.col("id").alias("dst"), F.col("label").alias("y"))
    inner = held(both.join(a, "src").join(b, "dst").where("x = y").select("src", "dst"))
    least = labels.select("id", F.col("id").alias("label"))
    while True:
        near = inner.join(least.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        step = least.join(near, "id", "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"))
        # and to where that one has come
        jump = step.withColumnRenamed("label", "via").join(step.select(F.col("id").alias("via"), F.col("label").alias("far")), "via").select("id", F.least("via", "far").alias("label"))
        now = held(jump.join(least.withColumnRenamed("label", "was"), "id").select("id", "label", (F.col("label") != F.col("was")).alias("moved")))
        least = now.select("id", "label")
        if not now.where("moved").limit(1).count():
            return least


def leiden(edges: DataFrame, resolution: float = 1.0, levels: int = 10, sweeps: int = 20, seed: int = 7) -> DataFrame:
    """(id, label) of a weighted graph (src, dst[, w]); labels are the least members, communities are connected."""
    first = held(_weighted(edges))
    total = first.agg(F.sum("w")).first()[0] or 0.0
    both, nodes = first, held(first.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).withColumn("loop", F.lit(0.0)))
    of = nodes.select(F.col("id").alias("node"), "id")  # nodes of the first level in those of this one
    labels = nodes.select("id", F.col("id").alias("label"))
    count = nodes.count()
    for level in range(levels if total else 0):
        labels = _move(nodes, both, labels, total, resolution, sweeps, seed + 100 * level)
        parts = _refine(nodes, both, labels, total, resolution, seed + 100 * level)
        left = parts.select("label").distinct().count()
        if left == count:
            break
        count = left
        up = held(parts.join(labels.withColumnRenamed("label", "community"), "id").select("id", F.col("label").alias("part"), "community"))
        a, b = up.select(F.col("id").alias("src"), F.col("part").alias("x")), up.select(F.col("id").alias("dst"), F.col("part").alias("y"))
        merged = both.join(a, "src").join(b, "dst").groupBy("x", "y").agg(F.sum("w").alias("w"))
        sums = nodes.join(up, "id").groupBy(F.col("part").alias("id")).agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"))
        inner = merged.where("x = y").select(F.col("x").alias("id"), F.col("w").alias("inner"))
        nodes = held(sums.join(inner, "id", "left").select("id", "k", (F.col("loop") + F.coalesce("inner", F.lit(0.0))).alias("loop")))
        both = held(merged.where("x <> y").select(F.col("x").alias("src"), F.col("y").alias("dst"), "w"))
        of = held(of.join(up.select("id", "part"), "id").select("node", F.col("part").alias("id")))
        labels = held(up.groupBy(F.col("part").alias("id")).agg(F.first("community").alias("label")))
    found = of.join(labels, "id").select(F.col("node").alias("id"), "label")
    return _connected(first, held(found))


@extra("entity_communities_leiden")
def entity_communities_leiden(t: Tables) -> DataFrame:
    """Communities of entities by the calls between their functions, weighted by how often."""
    calls = held(t["ENTITY_CALLS"])
    return community_report(leiden(calls.select("src", "dst", F.col("frequency").alias("w"))), calls)


@extra("entity_communities_ordered")
def entity_communities_ordered(t: Tables) -> DataFrame:
    calls = held(t["ENTITY_CALLS"])
    return community_report(ordered_propagation(calls), calls)
