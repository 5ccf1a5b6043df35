"""Stretches of text that occur more than once: what the word and byte variants share.

A *unit* is a word or a byte.  Every window of ``length`` units picks an anchor,
the gram of ``gram`` units inside it with the least hash, leftmost on ties.  The
choice depends on the window's content alone, so equal windows sit equally
around equal anchors, and a window can only repeat if its anchor does.

1. :func:`repeated_anchors` counts anchors (distinct hashes of each chunk first)
   and writes those that occur twice or more as sorted array files.
   Anchors with very many different surroundings (a line that a third of all
   documents hold) are listed as *hot*: their windows are dealt by content, not
   by anchor, so that they spread over all partitions.
2. The callers bring the surroundings of repeated anchors together and report
   windows with an earlier equal as runs ``(doc, start, windows)``.
3. :func:`apply_runs` brings the runs to their documents.

The workers map the anchor files.  Where these exceed ``MAPPED_BYTES``, steps 2
and 3 see them in slices of the hash range, one pass over the texts for each
slice: slower, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import CHUNK_BYTES, PACKED, Chunk, Tokens, _slide, bucket, byte_grams, chunks, encode, grams, mix, packed, powers, runs, splitmix, spread, unpacked
from .shared import Lazy, Workspace, array_names, id_partition, read_array, write_array

MAPPED_BYTES = 16 << 30
#: An anchor is hot from so many different surroundings on, if they are also this many for each chunk that has it.
HOT, HOT_PER_CHUNK = 500, 3
#: Text bytes at once, by unit: a byte costs more arrays than a word does.
LIMITS = {"word": CHUNK_BYTES, "byte": 1 << 20}


class Windows:
    """Windows of a chunk and the anchor of each: ``start`` (units in the chunk), ``anchor``, ``hash`` of all grams."""

    def __init__(self, chunk: Chunk, unit: str, gram: int, length: int):
        self.unit = unit
        if unit == "word":
            self.tokens = Tokens(chunk, lower=False)
            self.first = self.tokens.first
            self.hash = grams(self.tokens.hash, gram)
        else:
            self.tokens = None
            self.first = chunk.offsets
            self.hash = byte_grams(chunk.data, gram)
        total = int(self.first[-1])
        if total < length:
            self.start = self.anchor = np.zeros(0, np.int64)
            return
        order = self.hash & np.uint64(0xFFFFFFFF00000000)
        order |= np.arange(len(order), dtype=np.uint64)
        least = _slide(order, length - gram + 1, np.minimum)
        ok = np.ones(len(least), bool)
        ends = self.first[1:]
        for s, e in zip(np.maximum(ends - length + 1, self.first[:-1]), np.minimum(ends, len(ok))):
            ok[s:e] = False
        self.start = np.flatnonzero(ok)
        self.anchor = (least[self.start] & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def keys(self, anchors: np.ndarray) -> np.ndarray:
        """Hashes of anchors, spread evenly again: as least hashes they are all small."""
        return mix(self.hash[anchors] + np.uint64(0x5851F42D4C957F2D))

    def surroundings(self, gram: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor in turn: its hash, and a hash that tells different stretches of its windows apart."""
        first = runs(self.anchor)
        if not len(first):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        begin, last = self.start[first], self.start[np.append(first[1:], len(self.start)) - 1]
        h = self.keys(self.anchor[first])
        return h, mix(h + mix(self.hash[begin] + np.uint64(1)) + mix(self.hash[last + length - gram] + np.uint64(2)))

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1


def repeated_anchors(docs: DataFrame, unit: str, gram: int, length: int, work: Workspace, parts: int) -> tuple[str, str, int]:
    """Folders of the sorted files of anchors that occur at least twice and of the hot ones, and how many repeat."""
    folder, hot = work.folder("anchors"), work.folder("hot")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=LIMITS[unit]):
            h, around = Windows(chunk, unit, gram, length).surroundings(gram, length)
            order = np.lexsort((around, h))
            h, around = h[order], around[order]
            first = runs(h)
            if not len(first):
                continue
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (around[1:] != around[:-1])
            many = np.diff(np.append(first, len(h))) > 1
            yield from packed(bucket(h[first], parts), [h[first], np.add.reduceat(fresh.astype(np.uint32), first).astype(np.uint32), many])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, kinds, many = unpacked(batches, [np.uint64, np.uint32, bool])
        order = np.argsort(h)
        h, kinds, many = h[order], kinds[order], many[order]
        first = runs(h)
        if not len(first):
            return
        seen = np.diff(np.append(first, len(h)))
        again = (seen > 1) | np.logical_or.reduceat(many, first)
        kinds = np.add.reduceat(kinds.astype(np.int64), first)
        very = again & (kinds >= HOT) & (kinds >= HOT_PER_CHUNK * seen)
        h = h[first]
        name = f"{int(bucket(h[:1], parts)[0]):08d}"
        if again.any():
            write_array(folder, name, h[again])
        if very.any():
            write_array(hot, name, h[very])
        yield pa.RecordBatch.from_arrays([pa.array([int(again.sum())], pa.int64())], ["n"])

    found = docs.mapInArrow(find, PACKED).repartitionById(parts, "pid").mapInArrow(keep, "n long")
    return folder, hot, found.agg(F.sum("n")).first()[0] or 0


class AnchorFiles:
    """Membership in the files of partitions ``low`` to ``high``, mapped."""

    def __init__(self, folder: str, parts: int, low: int, high: int):
        self.parts = parts
        self.files = Lazy(folder, [int(x) for x in array_names(folder) if low <= int(x) < high], lambda p: read_array(folder, f"{p:08d}", np.uint64))

    def has(self, h: np.ndarray) -> np.ndarray:
        order = np.argsort(h)
        sorted_h = h[order]
        pid = bucket(sorted_h, self.parts)
        hit = np.zeros(len(h), bool)
        first = runs(pid)
        for s, e in zip(first, np.append(first[1:], len(pid))):
            file = self.files.get(int(pid[s]))
            if file is not None and len(file):
                at = np.minimum(np.searchsorted(file, sorted_h[s:e]), len(file) - 1)
                hit[s:e] = file[at] == sorted_h[s:e]
        out = np.zeros(len(h), bool)
        out[order] = hit
        return out


def slices(folder: str, count: int, parts: int, limit: int = MAPPED_BYTES) -> list[tuple[int, int]]:
    """Ranges of partitions whose files together keep within ``limit``."""
    n = max(1, min(parts, -(-8 * count // limit)))
    cuts = [parts * i // n for i in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


_P = splitmix(77) | 1
_PI = pow(_P, -1, 1 << 64)
_SYMBOL = np.array([splitmix(1000 + i) | 1 for i in range(256)], np.uint64)


def hash_slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of some stretches of bytes."""
    s = np.concatenate([[np.uint64(0)], np.cumsum(_SYMBOL[data] * powers(_P, len(data)))])
    return mix((s[start + size] - s[start]) * powers(_PI, len(data) + 1)[start])


def same_slices(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, step: int = 1 << 22) -> np.ndarray:
    """Whether the stretches of ``size`` bytes at a and b are equal, for each pair; sizes are over 0."""
    out = np.ones(len(a), bool)
    total = np.cumsum(size)
    low = 0
    while low < len(a):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + step, side="right")))
        n = size[low:high]
        k = spread(n)
        same = data[np.repeat(a[low:high], n) + k] == data[np.repeat(b[low:high], n) + k]
        out[low:high] = np.logical_and.reduceat(same, np.cumsum(n) - n)
        low = high
    return out


def settled(data: np.ndarray, at: np.ndarray, size: np.ndarray, left: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk's contexts: those to send on, and those that repeat an earlier one, byte for byte and around the same place."""
    content = hash_slices(data, at, size)
    order = np.lexsort((place, doc, left, content))
    c, l = content[order], left[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (c[1:] != c[:-1]) | (l[1:] != l[:-1])
    head = order[np.flatnonzero(fresh)]
    of = head[np.cumsum(fresh) - 1] if len(head) else head
    same = size[order] == size[of]
    same[same] = same_slices(data, at[order[same]], at[of[same]], size[order[same]])
    moved = (doc[order] != doc[of]) | (place[order] != place[of])
    return np.concatenate([head, order[~same]]), order[same & moved]


def context_rows(pid: np.ndarray, heads: list[np.ndarray], data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[pa.RecordBatch]:
    """Packed contexts, a row for each target partition: the heads' arrays, then the bytes."""
    if not len(pid):
        return []
    order = np.argsort(pid, kind="stable")
    pid, start, size = pid[order], start[order], size[order]
    raw = data[np.repeat(start, size) + spread(size)]
    cuts = np.concatenate([runs(pid), [len(pid)]])
    ends = np.concatenate([[0], np.cumsum(size)])
    heads = [h[order] for h in heads]
    rows = [encode([h[s:e] for h in heads]) + raw[ends[s] : ends[e]].tobytes() for s, e in zip(cuts[:-1], cuts[1:])]
    return [pa.RecordBatch.from_arrays([pa.array(pid[cuts[:-1]], pa.int32()), pa.array(rows, pa.binary())], ["pid", "blob"])]


RUN_KINDS = [np.int64, np.uint32, np.uint32]


def as_runs(doc: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Marked windows as runs (doc, first start, windows)."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order].astype(np.int64)
    if not len(doc):
        return [np.zeros(0, k) for k in RUN_KINDS]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(fresh)
    last = start[np.append(at[1:], len(doc)) - 1]
    return [doc[at], start[at].astype(np.uint32), (last - start[at] + 1).astype(np.uint32)]


def run_rows(found: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Packed rows that bring each run to the partition of its document."""
    yield from packed(id_partition(found[0], parts), found)


def covered(found: list[np.ndarray], doc: int, units: int, length: int) -> np.ndarray:
    """Starts and ends (rows of a 2-column array) of the marked stretches of one document; found is sorted by doc."""
    s, e = np.searchsorted(found[0], doc), np.searchsorted(found[0], doc, side="right")
    if s == e:
        return np.zeros((0, 2), np.int64)
    start, end = found[1][s:e].astype(np.int64), found[1][s:e].astype(np.int64) + found[2][s:e] + length - 1
    order = np.argsort(start)
    start, end = start[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(fresh)
    return np.column_stack([start[at], np.minimum(end[np.append(at[1:], len(start)) - 1], units)])


def apply_runs(docs: DataFrame, found: DataFrame, parts: int, each: Callable[[Iterator[tuple[Chunk, list[np.ndarray]]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Deal documents and runs to the same partitions; ``each`` sees chunks of documents with the partition's sorted runs."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        early: list[pa.RecordBatch] = []

        def documents() -> Iterator[pa.RecordBatch]:
            nonlocal held
            for b in batches:
                is_doc = b.column("kind").to_numpy().astype(bool)
                n = int((~is_doc).sum())
                if n:
                    early.append(b.slice(0, n))
                if n < b.num_rows:
                    if held is None:
                        held = unpacked(early, RUN_KINDS)
                        order = np.argsort(held[0], kind="stable")
                        held = [x[order] for x in held]
                        early.clear()
                    yield b.slice(n)

        yield from each((c, held) for c in chunks(documents()))

    left = found.select("pid", F.lit(0).alias("kind"), "blob", F.lit(0).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    right = docs.select(F.pmod(F.hash("doc_id"), F.lit(parts)).alias("pid"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("blob"), "doc_id", "text")
    return left.unionByName(right).repartitionById(parts, "pid").sortWithinPartitions("kind").mapInArrow(step, schema)
