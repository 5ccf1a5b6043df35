"""Exact duplicates by a minimal perfect hash over historical digests.

The rows fall into *history* (already indexed) and *arrivals*.  The distinct
SHA-256 digests of the history are dealt to shards by their leading bits; each
shard becomes a minimal perfect hash whose slots hold the whole digest, the
locator of the winner (its largest id) and the number of copies.  Arrivals are
first grouped by digest (partial sums before the shuffle, so a text that makes
up a third of all rows is a few records), then looked up: a slot counts only if
all 32 bytes agree.  Digests that are no members form groups of their own.

Nulls count as the empty text; empty texts are equal to each other.  Ties
cannot occur between distinct ids; rows that repeat an id count as copies, and
all rows with the winner's id are marked as kept.  A null id is smaller than any
other, and wins only where all rows of a group have none.

Rows meet their groups by a join on the digest.  Its hot keys have one small row
on the side of the groups; the side of the rows (no texts, 41 bytes a row) is
split by the engine's skew handling, which is on by default.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import mix, splitmix
from .shared import NO_ID, Workspace, ids_back, partitions

GAMMA = 2.0


class PerfectHash:
    """Maps n distinct keys (pairs of 64-bit words) to 0..n-1.

    Level by level, keys that are alone in their slot of a bit array are
    settled and the others go on to the next, smaller level.  A key's number is
    the rank of its bit.  Any other key maps to some number, or to -1.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.bitwise_count(w).astype(np.int64) for w in levels]
        self.rank, base = [], 0
        for c in counts:
            self.rank.append(base + np.cumsum(c) - c)
            base += int(c.sum())

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, words: int) -> np.ndarray:
        h = mix(a + np.uint64(splitmix(2 * level))) ^ mix(b + np.uint64(splitmix(2 * level + 1)))
        return ((h >> np.uint64(32)) * np.uint64(words * 64) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(a):
            words = max(1, int(np.ceil(GAMMA * len(a) / 64)))
            at = cls._place(a, b, len(levels), words)
            alone = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = ~alone[at]
            a, b = a[rest], b[rest]
            if len(levels) > 200:
                raise ValueError("keys must be distinct")
        return cls(levels)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, np.int64)
        todo = np.arange(len(a))
        for level, (words, rank) in enumerate(zip(self.levels, self.rank)):
            at = self._place(a[todo], b[todo], level, len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = rank[at[hit] >> 6] + below[hit]
            todo = todo[~hit]
        return out

    def dump(self) -> bytes:
        return np.array([len(self.levels), *map(len, self.levels)], np.uint64).tobytes() + b"".join(w.tobytes() for w in self.levels)

    @classmethod
    def load(cls, blob: memoryview) -> tuple[PerfectHash, int]:
        n = int(np.frombuffer(blob, np.uint64, 1)[0])
        sizes = np.frombuffer(blob, np.uint64, n, 8).astype(int)
        at, levels = 8 * (n + 1), []
        for s in sizes:
            levels.append(np.frombuffer(blob, np.uint64, s, at))
            at += 8 * int(s)
        return cls(levels), at


def _shard(parts: int) -> Column:
    return F.expr(f"cast(shiftright(cast(conv(substr(hex(digest), 1, 8), 16, 10) as bigint) * {parts}, 32) as int)")


def digests(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The frame's rows with ``digest`` (32 bytes) in place of the text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.withColumn("digest", F.unhex(F.sha2(text.cast("binary"), 256)))


def grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("copies"))


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
    key = np.ascontiguousarray(raw).view(np.uint64)
    return raw, key, batch.column("winner").to_numpy(), batch.column("copies").to_numpy()


def _put(found: list) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*found))


def build_index(spark: SparkSession, history: DataFrame, work: Workspace, parts: int) -> DataFrame:
    """One row (pid, blob) for each shard of the grouped history that has digests."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, pid = [], 0
        for b in batches:
            if b.num_rows:
                pid = b.column("pid")[0].as_py()
                found.append(_words(b))
        if not found:
            return
        raw, key, winner, copies = _put(found)
        table = PerfectHash.build(key[:, 0], key[:, 1])
        slot = table.find(key[:, 0], key[:, 1])
        order = np.argsort(slot)
        blob = table.dump() + raw[order].tobytes() + winner[order].tobytes() + copies[order].tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([len(raw)], pa.int64()), pa.array([blob], pa.binary())], ["pid", "n", "blob"])

    dealt = history.withColumn("pid", _shard(parts)).repartitionById(parts, "pid")
    return work.table(dealt.mapInArrow(make, "pid int, n long, blob binary"), "index")


def lookup(index: DataFrame, arrivals: DataFrame, parts: int) -> DataFrame:
    """All groups: (digest, winner, copies, member) after adding grouped arrivals to the index's groups.

    ``member`` tells whether the digest is in the index.
    """
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, found = [], []
        for b in batches:
            stored = b.column("blob").is_valid().to_numpy(zero_copy_only=False)
            blobs += [(n.as_py(), x.as_buffer()) for n, x in zip(b.column("n"), b.column("blob")) if x.is_valid]
            new = b.filter(pa.array(~stored))
            if new.num_rows:
                found.append(_words(new))
        raw, key, winner, copies = _put(found) if found else (np.zeros((0, 32), np.uint8), np.zeros((0, 4), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        rest = np.ones(len(raw), bool)
        out = []
        for n, blob in blobs:
            table, at = PerfectHash.load(blob)
            slots = np.frombuffer(blob, np.uint8, 32 * n, at).reshape(n, 32)
            best = np.frombuffer(blob, np.int64, n, at + 32 * n).copy()
            size = np.frombuffer(blob, np.int64, n, at + 40 * n).copy()
            slot = table.find(key[:, 0], key[:, 1])
            hit = slot >= 0
            hit[hit] = (slots[slot[hit]] == raw[hit]).all(axis=1)
            best[slot[hit]] = np.maximum(best[slot[hit]], winner[hit])
            size[slot[hit]] += copies[hit]
            rest &= ~hit
            out.append((slots, best, size, np.ones(n, bool)))
        out.append((raw[rest], winner[rest], copies[rest], np.zeros(int(rest.sum()), bool)))
        for d, w, c, m in out:
            for s in range(0, len(d), 50_000):
                e = slice(s, s + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in d[e]], pa.binary()), pa.array(w[e]), pa.array(c[e]), pa.array(m[e])], ["digest", "winner", "copies", "member"])

    nulls = {"n": "long", "blob": "binary", "digest": "binary", "winner": "long", "copies": "long"}
    left = index.select("pid", "n", "blob", *[F.lit(None).cast(nulls[c]).alias(c) for c in ("digest", "winner", "copies")])
    right = arrivals.select(_shard(parts).alias("pid"), *[F.lit(None).cast(nulls[c]).alias(c) for c in ("n", "blob")], "digest", "winner", "copies")
    return left.unionByName(right).repartitionById(parts, "pid").mapInArrow(probe, "digest binary, winner long, copies long, member boolean")


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", is_history: Column | None = None) -> DataFrame:
    """Group equal texts; the row with the largest id stays.

    ``is_history`` marks the rows whose digests are indexed; by default a fixed
    half of the ids.  The result does not depend on it.  Returns doc_id,
    keep_id, group_size, kept, text_sha256, in_history (whether the text is in
    the index).  An empty table gives an empty result.
    """
    parts = partitions(spark)
    work = Workspace(spark, "exact")
    ids = F.col(f"`{id_col}`").cast("long")
    old = F.crc32(ids.cast("string").cast("binary")) % 2 == 0 if is_history is None else is_history
    rows = docs.select(F.coalesce(ids, F.lit(NO_ID)).alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(old, F.lit(False)).alias("old"))
    rows = work.table(digests(rows).select("doc_id", "old", "digest"), "digests")
    index = build_index(spark, grouped(rows.where("old")), work, parts)
    groups = lookup(index, grouped(rows.where("not old")), parts)
    out = rows.join(groups, "digest").select(
        "doc_id",
        F.col("winner").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("doc_id") == F.col("winner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("member").alias("in_history"),
    )
    out = work.table(ids_back(out, "doc_id", "keep_id"), "result")
    work.keep("result")
    return out
