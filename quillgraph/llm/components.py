"""Connected components of an edge table, in Spark.

Every node takes the least label among itself and its neighbours, then the
label's own label; rounds repeat until nothing changes.  Each round is written
to the shared folder, so the lineage stays short and no link, label or
component passes through the driver.  Before the rounds, tasks of bounded size
drop edges between nodes they have already joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


#: Edges that one task contracts.
CONTRACTED = 500_000


def contracted(edges: DataFrame, count: int) -> DataFrame:
    """Edges with the same components, at most one fewer than nodes from each task.

    A task keeps an edge only if it joins two of the sets it has seen so far.
    """

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for batch in batches:
            kept = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    kept.append((a, b))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], ["a", "b"])

    return edges.select("a", "b").coalesce(max(1, -(-count // CONTRACTED))).mapInArrow(forest, "a long, b long")


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, label) for every end of an edge (columns a, b; longs); the label is the least node of the component."""
    edges = work.table(contracted(edges, edges.count()), f"{name}-forest")
    both = work.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    labels = work.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = work.table(lower.join(jump, "label", "left").select("node", F.coalesce(F.least("label", "next"), "label").alias("label"), "old"), f"{name}-{step}")
        changed = after.where("label <> old").limit(1).count()
        work.drop(f"{name}-{step - 1}")
        labels = after.select("node", "label")
        if not changed:
            work.drop(f"{name}-both", f"{name}-forest")
            return labels
