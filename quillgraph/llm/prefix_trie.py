"""Prefix trie of conversations.

Each conversation is a row with the array of its turns, a turn being a 128-bit digest
of role and text and the bytes of the text.  A node of the trie is a distinct sequence
of first turns; its members are the conversations that start with it.

1. Turn arrays are range-sorted over all partitions by their packed digests, then by
   id.  A sequence sorts right before its extensions, and copies are told apart by
   their ids, so a hot group of copies spreads over partitions.
2. Each partition is swept once.  The common prefix of a row with the one before says
   which nodes of the stack are complete: those deeper than it.  A node that closes
   adds what it has to its parent.
3. At a partition's edges nodes stay open: the prefixes of its first row may have begun
   earlier, those of its last row may go on.  Both spines come out with what they have
   so far, and are stitched in the order of the partitions by the same stack.  Spines
   are a path or two for each partition; over :data:`UNITS` partitions they are
   stitched in runs first, each run giving two spines in turn.
4. Nodes below a spine learn their parent's name from the stitch, by a join in which a
   key has a partition's rows at most.

The ids that end at a node are hashed in ascending order.  Within a partition that is
done in the sweep; those of spines are sent on in pieces and hashed in their order, one
piece at a time, for SHA-256 has no other way.

Equal digests stand for equal turns.  A conversation is one row, 40 bytes or so for each
turn and none of its text, and must fit in a task; so must the nodes of a partition.

Turns without an order come first; turns that share one are ordered by their digests, so
repeated rows are turns of their own.  Null roles and texts count as empty.  Rows without
a conversation's id belong to none and are left out.  An empty table has no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, partitions, small_batches

#: So many units are stitched in one task.
UNITS = 4096
#: Ids in a piece.
PIECE = 4096
DIGEST = 16
NODE, SPINE, ENDS, NAME = range(4)
EMPTY = hashlib.sha256(b"").hexdigest()

#: What a sweep gives, by ``kind``.  ``unit`` and ``side`` of a NODE: the spine its parent is on, where it is on one.
#: SPINE: an open node, ``spans`` on both spines.  ENDS: a piece of an open node's ids.  NAME: where an open node of a unit has gone, a node (``conv_id``) or a spine (``up``).
SWEPT = (
    "kind int, unit long, side int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends string, digest binary, n_bytes long, spans boolean, piece long, up int"
)
FIELDS = [x.split()[0] for x in SWEPT.split(", ")]
TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
KINDS = [TYPES[x.split()[1]] for x in SWEPT.split(", ")]


class Node:
    """An open node with what its closed descendants gave it."""

    __slots__ = ("digest", "n_bytes", "conv", "n_convs", "n_children", "n_leaves", "saved", "ends", "first", "waiting", "parts")

    def __init__(self, digest: bytes, n_bytes: int, first: bool):
        self.digest, self.n_bytes, self.first = digest, n_bytes, first
        self.conv: int | None = None
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.ends: list[int] = []
        self.waiting: list[dict] = []  # closed children, which lack this node's name
        self.parts: list[tuple] = []  # (unit, side, depth) of the spine nodes that are this one

    def add(self, conv: int | None, n_convs: int, n_children: int, n_leaves: int, saved: int) -> None:
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv
        self.n_convs += n_convs
        self.n_children += n_children
        self.n_leaves += n_leaves
        self.saved += saved


class Sweep:
    """The stack over rows or units in their order.  ``last``: nothing comes before or after, so no spine is left."""

    def __init__(self, unit: int, last: bool = False):
        self.unit, self.last = unit, last
        self.stack: list[Node] = []
        self.left: list[Node] = []  # closed nodes of the first row's path, deepest first
        self.out: list[dict] = []

    def common(self, digests: list[bytes]) -> int:
        """Depth of the deepest open node on this path; -1 without any."""
        k, most = 0, min(len(self.stack), len(digests))
        while k < most and self.stack[k].digest == digests[k]:
            k += 1
        return k - 1

    def push(self, digest: bytes, n_bytes: int, first: bool) -> Node:
        node = Node(digest, n_bytes, first and not self.last)
        self.stack.append(node)
        return node

    def close_below(self, depth: int) -> None:
        while len(self.stack) - 1 > depth:
            at, node = len(self.stack) - 1, self.stack.pop()
            if node.first:
                self.left.append(node)
            else:
                self._finish(node, at)

    def _finish(self, node: Node, depth: int) -> None:
        leaves = node.n_leaves if node.n_children else 1
        saved = node.saved + (node.n_convs - 1) * node.n_bytes
        row = {"kind": NODE, "depth": depth, "conv_id": node.conv, "n_convs": node.n_convs, "n_children": node.n_children, "n_leaves": leaves, "saved_tokens": saved, "ends": hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()}
        for child in node.waiting:
            self.out.append(child | {"parent_conv_id": node.conv})
        self.out += [{"kind": NAME, "unit": u, "side": s, "depth": d, "conv_id": node.conv} for u, s, d in node.parts]
        if not self.stack:
            self.out.append(row)
            return
        parent = self.stack[-1]
        parent.add(node.conv, node.n_convs, 1, leaves, saved)
        if parent.first:
            self.out.append(row | {"unit": self.unit, "side": 0})
        else:
            parent.waiting.append(row)

    def row(self, conv: int, digests: list[bytes], sizes: list[int]) -> None:
        """A conversation; ``digests`` begins with the root's, an empty one."""
        begin = not self.stack
        shared = self.common(digests)
        self.close_below(shared)
        for d in range(shared + 1, len(digests)):
            self.push(digests[d], sizes[d], begin)
        node = self.stack[-1]
        node.add(conv, 1, 0, 0, 0)
        node.ends.append(conv)

    def spines(self, left: list[dict], right: list[dict]) -> None:
        """A unit: its first path, and of its last one what is not on the first."""
        begin = not self.stack
        shared = self.common([x["digest"] for x in left])
        self.close_below(shared)
        for d, x in enumerate(left):
            self._part(self.stack[d] if d <= shared else self.push(x["digest"], x["n_bytes"], begin), x)
        self.close_below(sum(x["spans"] for x in left) - 1)
        for x in right:
            self._part(self.push(x["digest"], x["n_bytes"], False), x)

    @staticmethod
    def _part(node: Node, x: dict) -> None:
        node.add(x["conv_id"], x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"])
        node.parts.append((x["unit"], x["side"], x["depth"]))

    def end(self) -> None:
        """Close all, or give the spines."""
        if self.last:
            self.close_below(-1)
            return
        spans = sum(n.first for n in self.stack)
        left = [*self.stack[:spans], *reversed(self.left)]
        for side, nodes, base in ((0, left, 0), (1, self.stack[spans:], spans)):
            for depth, node in enumerate(nodes, base):
                here = {"unit": self.unit, "side": side, "depth": depth}
                self.out.append(here | {"kind": SPINE, "conv_id": node.conv, "n_convs": node.n_convs, "n_children": node.n_children, "n_leaves": node.n_leaves, "saved_tokens": node.saved, "digest": node.digest, "n_bytes": node.n_bytes, "spans": side == 0 and depth < spans})
                self.out += [child | {"unit": self.unit, "side": side} for child in node.waiting]
                self.out += [here | {"kind": ENDS, "piece": k, "ends": ",".join(map(str, node.ends[k : k + PIECE]))} for k in range(0, len(node.ends), PIECE)]
                self.out += [{"kind": NAME, "unit": u, "side": s, "depth": d, "up": side} for u, s, d in node.parts]

    def given(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        """What has come out so far, if it is as much as that."""
        while len(self.out) > least:
            some, self.out = self.out[:20_000], self.out[20_000:]
            yield pa.RecordBatch.from_arrays([pa.array([x.get(f) for x in some], k) for f, k in zip(FIELDS, KINDS, strict=True)], FIELDS)


def _sweep_rows(batches):
    from pyspark import TaskContext

    sweep, any_row = Sweep(TaskContext.get().partitionId()), False
    for b in batches:
        for conv, packed, sizes in zip(*(c.to_pylist() for c in b.columns), strict=True):
            any_row = True
            sweep.row(conv, [b"", *(packed[k : k + DIGEST] for k in range(0, len(packed), DIGEST))], [0, *sizes])
        yield from sweep.given(20_000)
    if any_row:
        sweep.end()
    yield from sweep.given()


def _stitch(last: bool, width: int):
    """Units in order, each with its open nodes in order; a run of ``width`` units is swept by itself unless this is the last level."""

    def run(batches):
        sweep, unit, left, right = None, None, [], []

        def feed():
            if left:
                sweep.spines(left, right)

        for b in batches:
            for x in b.to_pylist():
                if x["unit"] != unit:
                    feed()
                    left, right = [], []
                    block = 0 if last else x["unit"] // width
                    if sweep is None or block != sweep.unit:
                        if sweep is not None:
                            sweep.end()
                            yield from sweep.given()
                        sweep = Sweep(block, last)
                    unit = x["unit"]
                (right if x["side"] else left).append(x)
            if sweep is not None:
                yield from sweep.given(20_000)
        if sweep is not None:
            feed()
            sweep.end()
            yield from sweep.given()

    return run


def _hash_pieces(batches):
    """Pieces sorted by node and place: the digest of each node's ids."""
    now, state = None, None
    for b in batches:
        out = []
        for conv, depth, piece in zip(*(b.column(c).to_pylist() for c in ("conv_id", "depth", "ends")), strict=True):
            if (conv, depth) != now:
                if now:
                    out.append((*now, state.hexdigest()))
                now, state = (conv, depth), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield _hashed(out)
    if now:
        yield _hashed([(*now, state.hexdigest())])


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    conv, depth, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest, pa.string())], ["conv_id", "depth", "spine_ends"])


def turn_arrays(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and ``turns``: of each turn in order the digest (hex) and the bytes of its text.  Texts are hashed where they are read."""
    who, what = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, what).cast("binary"), 256), 1, 2 * DIGEST)
    one = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.octet_length(what).cast("long").alias("n_bytes")).alias("t")
    )
    # a struct's nulls sort first
    return one.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["n_bytes"].alias("n_bytes"))).alias("turns"))


def prefix_trie(spark: SparkSession, arrays: DataFrame, units: int = UNITS) -> DataFrame:
    """The nodes of the trie over conversations (conv_id, ``turns`` of digest and n_bytes).

    Returns conv_id (the least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (of the subtree) and ends_sha256; (conv_id, depth) is a key.
    """
    work = Workspace(spark, "trie")
    packed = arrays.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("packed"), F.transform("turns", lambda t: t["n_bytes"]).alias("sizes"))
    ordered = packed.repartitionByRange(partitions(spark), "packed", "conv_id").sortWithinPartitions("packed", "conv_id")
    with small_batches(spark, 5000):
        swept = work.table(ordered.mapInArrow(_sweep_rows, SWEPT), "swept")
        found, names, level = [swept], [], 0
        count = (swept.where(F.col("kind") == SPINE).agg(F.max("unit")).first()[0] or 0) + 1
        while True:
            last = count <= units
            open_nodes = found[-1].where(F.col("kind") == SPINE)
            order = ["unit", "side", "depth"]
            dealt = open_nodes.coalesce(1) if last else open_nodes.repartition(-(-count // units), F.floor(F.col("unit") / units))
            level += 1
            found.append(work.table(dealt.sortWithinPartitions(*order).mapInArrow(_stitch(last, units), SWEPT), f"stitched-{level}"))
            names.append(found[-1].where(F.col("kind") == NAME).select("unit", "side", "depth", F.col("conv_id").alias("named"), "up"))
            if last:
                break
            count = -(-count // units)
        # the names of each level's open nodes, from the top down
        for k in reversed(range(len(names) - 1)):
            above = names[k + 1].select(F.col("unit").alias("above"), F.col("side").alias("up"), "depth", F.col("named").alias("further"))
            with_above = names[k].withColumn("above", F.floor(F.col("unit") / units)).join(above, ["above", "up", "depth"], "left")
            names[k] = work.table(with_above.select("unit", "side", "depth", F.coalesce("named", "further").alias("named"), "up"), f"names-{k}")
        pieces = swept.where(F.col("kind") == ENDS).select("unit", "side", "depth", "piece", "ends").join(names[0].drop("up"), ["unit", "side", "depth"])
        pieces = pieces.select(F.col("named").alias("conv_id"), "depth", "unit", "side", "piece", "ends").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "unit", "side", "piece")
        ends = work.table(pieces.mapInArrow(_hash_pieces, "conv_id long, depth long, spine_ends string"), "ends")
        columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
        nodes = None
        for k, frame in enumerate(found):
            here = frame.where(F.col("kind") == NODE)
            if k < len(names):
                parent = names[k].select("unit", "side", (F.col("depth") + 1).alias("depth"), "named")
                here = here.join(parent, ["unit", "side", "depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "named"))
            here = here.select(*columns)
            if k:
                here = here.join(ends, ["conv_id", "depth"], "left").withColumn("ends", F.coalesce("spine_ends", "ends")).select(*columns)
            nodes = here if nodes is None else nodes.unionByName(here)
        out = work.table(nodes.withColumnRenamed("ends", "ends_sha256"), "result")
    work.keep("result")
    return out
