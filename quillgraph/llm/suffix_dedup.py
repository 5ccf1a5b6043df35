"""Repeated byte strings by column-wise construction of a collection's Burrows-Wheeler transform.

A byte window of ``length`` can repeat only if its anchor repeats
(:mod:`.repeats`), so the collection is not all text but the *contexts* of
repeated anchors: for each occurrence, the bytes of all windows that chose it.
Contexts are dealt by anchor, aligned at it, and built column by column from the
right (:class:`Columns`): each round inserts one symbol of every context.  The
symbols to insert are the former round's transform, in the order of its
suffixes; their stable count (the last-to-first mapping) gives the new order,
and the common prefixes follow by range minima over the former ones.  A round
reads order, common prefixes and transform of the former round from a sequential
file in the shared folder and writes its own, so nothing but one round is in
memory.

Windows that start in one column are equal just where the common prefix of
neighbours stays at ``length`` or more; all but the earliest (smaller id, then
earlier start) are marked.  Suffixes of different columns never meet: equal
windows have their anchor at the same offset.  That keeps a round linear in the
number of contexts, where one list of all suffixes would grow with each round.

Texts are UTF-8 bytes, null as empty.  Matches never cross documents.  Equal
contexts inside one chunk of text are settled there, so copies travel once for
each chunk.  Around hot anchors each window is a context of its own, dealt by
its content.  Rows that repeat an id are the same document read twice: they do
not mark each other.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .kernels import PACKED, bucket, chunks, runs, spread
from .repeats import LIMITS, AnchorFiles, Windows, apply_runs, as_runs, context_rows, covered, hash_slices, repeated_anchors, run_rows, settled, slices
from .shared import Workspace, ids_back, partitions, read_array, remove_array, small_batches, texts, write_array

GRAM = 32
_HEAD = [np.uint64, np.int64, np.uint32, np.uint8, np.uint8]

class RoundFile:
    """The order, common prefixes and transform of the last finished round, one file after the other."""

    def __init__(self, folder: str):
        self.folder, self.name, self.round = folder, uuid.uuid4().hex, 0

    def write(self, order: np.ndarray, common: np.ndarray, transform: np.ndarray) -> None:
        parts = [np.array([len(order)], np.uint32), order.astype(np.uint32), common.astype(np.uint16), transform.astype(np.uint8)]
        write_array(self.folder, f"{self.name}.{self.round + 1}", np.concatenate([a.view(np.uint8) for a in parts]))
        self.close()
        self.round += 1

    def read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.asarray(read_array(self.folder, f"{self.name}.{self.round}", np.uint8))
        n = int(raw[:4].view(np.uint32)[0])
        return raw[4 : 4 + 4 * n].view(np.uint32).astype(np.int64), raw[4 + 4 * n : 4 + 6 * n].copy().view(np.uint16).astype(np.int64), raw[4 + 6 * n :].copy()

    def close(self) -> None:
        if self.round:
            remove_array(self.folder, f"{self.name}.{self.round}")


def _least_between(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least of values[left + 1 .. right] for each pair, by doubling."""
    span = right - left
    out = values[right].copy()
    level, size = values, 1
    todo = np.flatnonzero(span > 1)
    while len(todo):
        # level[i] is the least of values[i .. i + size - 1]; spans up to 2 * size are two such ranges
        now = todo[span[todo] <= 2 * size]
        out[now] = np.minimum(level[left[now] + 1], level[right[now] - size + 1])
        todo = todo[span[todo] > 2 * size]
        if len(todo):
            level = np.minimum(level[:-size], level[size:])
            size *= 2
    return out


class Columns:
    """Insert one symbol of every context per round, from the rightmost column on.

    ``data`` holds the contexts one after the other from ``at`` on; context i
    covers the columns ``begin[i]`` to ``end[i] - 1``; contexts of different
    ``group`` never compare.  Groups must be numbered in ascending order of i.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, group: np.ndarray, file: RoundFile):
        self.data, self.at, self.begin, self.end, self.group, self.file = data, at, begin, end, group, file

    def rounds(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yield (column, contexts in the order of their suffixes from there, common prefix with the one before)."""
        if not len(self.at):
            return
        none = np.zeros(0, np.int64)
        self.file.write(none, none, none)
        by_end = np.argsort(self.end, kind="stable")
        ends = self.end[by_end]
        for column in range(int(self.end.max()) - 1, int(self.begin.min()) - 1, -1):
            order, common, symbol = self.file.read()
            going = self.begin[order] <= column
            if not going.all():  # contexts that ended on the left leave; ranges join
                place = np.flatnonzero(going)
                common = _least_between(common, np.concatenate([[-1], place[:-1]]), place) if len(place) else common[:0]
                order, symbol = order[going], symbol[going]
            fresh = by_end[np.searchsorted(ends, column + 1) : np.searchsorted(ends, column + 1, side="right")]
            if len(fresh):  # empty suffixes come first in their group
                fresh = np.sort(fresh)
                spot = np.searchsorted(self.group[order], self.group[fresh], side="left")
                order, common = np.insert(order, spot, fresh), np.insert(common, spot, 0)
                symbol = np.insert(symbol, spot, self.data[self.at[fresh] + column - self.begin[fresh]])
                # what follows an empty suffix shares nothing with it
                added = spot + np.arange(len(fresh))
                after = added + 1
                after = after[after < len(order)]
                common[after] = 0
            # the transform of the former round holds the symbols to insert; its stable count is the last-to-first mapping
            key = (self.group[order] << 8) | symbol
            moved = np.argsort(key, kind="stable")
            same = np.zeros(len(moved), bool)
            sorted_key = key[moved]
            same[1:] = sorted_key[1:] == sorted_key[:-1]
            fresh_common = np.zeros(len(moved), np.int64)
            which = np.flatnonzero(same)
            if len(which):
                fresh_common[which] = np.minimum(_least_between(common, moved[which - 1], moved[which]) + 1, 60_000)
            order = order[moved]
            before = column > self.begin[order]
            transform = np.where(before, self.data[np.maximum(self.at[order] + column - 1 - self.begin[order], 0)], 0)
            self.file.write(order, fresh_common, transform)
            yield column, order, fresh_common


def _contexts(blobs: list, length: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    heads, raws = [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, np.uint32, 1)[0])
        at, part = 4, []
        for kind in _HEAD:
            part.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
        heads.append(part)
        raws.append(np.frombuffer(blob, np.uint8, -1, at))
    if not heads:
        return [np.zeros(0, k) for k in _HEAD], np.zeros(0, np.uint8), np.zeros(0, np.int64)
    heads = [np.concatenate(x) for x in zip(*heads)]
    size = heads[4].astype(np.int64) + length - 1
    return heads, np.concatenate(raws), np.cumsum(size) - size


def later_windows(heads: list[np.ndarray], data: np.ndarray, at: np.ndarray, length: int, file: RoundFile) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows of some contexts that have an earlier equal among them."""
    anchor, doc, start, left, count = heads
    order = np.lexsort((start.astype(np.int64) + left, doc, anchor))
    anchor, doc, start, left, count, at = (x[order] for x in (anchor, doc, start.astype(np.int64), left.astype(np.int64), count.astype(np.int64), at))
    first = runs(anchor)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(anchor))))
    lone = np.diff(np.append(first, len(anchor)))[group] < 2 if len(first) else np.zeros(0, bool)
    keep = ~lone
    doc, start, left, count, at, group = (x[keep] for x in (doc, start, left, count, at, group))
    widest = length - GRAM
    begin = widest - left
    found_doc, found_start = [], []
    for column, ranked, common in Columns(data, at, begin, begin + count + length - 1, group, file).rounds():
        if column > widest:
            continue
        window = column - begin[ranked] < count[ranked]
        fresh = common < length
        # a window's class is a run of common prefixes of at least its length
        classes = np.cumsum(fresh) - 1
        best = np.minimum.reduceat(ranked, np.flatnonzero(fresh)) if len(ranked) else ranked
        first_of = best[classes]
        later = window & ((doc[ranked] != doc[first_of]) | (start[ranked] + column - begin[ranked] != start[first_of] + column - begin[first_of]))
        if later.any():
            mine = ranked[later]
            found_doc.append(doc[mine])
            found_start.append(start[mine] + column - begin[mine])
    if not found_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_doc), np.concatenate(found_start)


def repeated_runs(docs: DataFrame, length: int, work: Workspace, parts: int) -> DataFrame:
    """Packed runs (doc, start, windows) of byte windows that have an earlier equal."""
    folder, hot, total = repeated_anchors(docs, "byte", GRAM, length, work, parts)
    rounds = work.folder("rounds")
    out = None
    for low, high in slices(folder, total, parts):

        def cut(batches: Iterator[pa.RecordBatch], low=low, high=high) -> Iterator[pa.RecordBatch]:
            files, very = AnchorFiles(folder, parts, low, high), AnchorFiles(hot, parts, low, high)
            for chunk in chunks(batches, limit=LIMITS["byte"]):
                w = Windows(chunk, "byte", GRAM, length)
                if not len(w.start):
                    continue
                first = runs(w.anchor)
                count = np.diff(np.append(first, len(w.anchor)))
                hit = files.has(w.keys(w.anchor[first]))
                first, count = first[hit], count[hit]
                if not len(first):
                    continue
                begin, anchor = w.start[first], w.anchor[first]
                key = w.keys(anchor)
                heat = very.has(key)
                if heat.any():  # each window by itself, under its content
                    n = count[heat]
                    alone = np.repeat(begin[heat], n) + spread(n)
                    begin, anchor, count = np.concatenate([begin[~heat], alone]), np.concatenate([anchor[~heat], alone]), np.concatenate([count[~heat], np.ones(len(alone), count.dtype)])
                    key = np.concatenate([key[~heat], hash_slices(chunk.data, alone, np.full(len(alone), length))])
                local = w.doc(begin)
                doc = chunk.column("doc_id")[local]
                size = count + length - 1
                place = begin - w.first[local]
                left = anchor - begin
                one, later = settled(chunk.data, begin, size, left, doc, place)
                reps = count[later]
                marks = as_runs(np.repeat(doc[later], reps), np.repeat(place[later], reps) + spread(reps))
                h = key[one]
                rows = context_rows(bucket(h, parts), [x[one].astype(k) for x, k in zip((key, doc, place, left, count), _HEAD)], chunk.data, begin[one], size[one])
                for kind, bs in ((0, rows), (1, run_rows(marks, parts))):
                    for b in bs:
                        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, kind, np.int32))], ["pid", "blob", "kind"])

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blobs = []
            for b in batches:
                kind = b.column("kind").to_numpy()
                if (kind == 1).any():
                    yield b.filter(pa.array(kind == 1)).select(["pid", "blob"])
                blobs += [x.as_buffer() for x in b.filter(pa.array(kind == 0)).column("blob")]
            heads, data, at = _contexts(blobs, length)
            del blobs
            file = RoundFile(rounds)
            try:
                doc, start = later_windows(heads, data, at, length, file)
            finally:
                file.close()
            yield from run_rows(as_runs(doc, start), parts)

        found = docs.mapInArrow(cut, PACKED + ", kind int").repartitionById(parts, "pid").mapInArrow(build, PACKED)
        out = found if out is None else out.unionByName(found)
    return out


def suffix_dedup(spark: SparkSession, docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts earlier.

    Returns doc_id, n_bytes, n_removed, n_spans, spans (removed stretches as
    pairs start, end), kept (the other bytes; null unless ``keep_bytes``: a cut
    may split a character), kept_sha256.  ``length`` is from 64 to 255.
    """
    if not 64 <= length <= 255:
        raise ValueError("length must be from 64 to 255")
    parts = partitions(spark)
    work = Workspace(spark, "suffixes")
    docs = texts(docs, id_col, text_col)

    def each(pairs) -> Iterator[pa.RecordBatch]:
        for chunk, found in pairs:
            ids = chunk.column("doc_id")
            size, removed, spans, kept, sums = [], [], [], [], []
            for i in range(chunk.n):
                raw = chunk.text(i)
                cut = covered(found, int(ids[i]), len(raw), length)
                size.append(len(raw))
                removed.append(int((cut[:, 1] - cut[:, 0]).sum()))
                spans.append(cut.ravel().tolist())
                if len(cut):
                    edges = [0, *cut.ravel().tolist(), len(raw)]
                    raw = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2]))
                sums.append(hashlib.sha256(raw).hexdigest())
                kept.append(raw if keep_bytes else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) // 2 for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary()), pa.array(sums, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"],
            )

    with small_batches(spark):
        out = apply_runs(docs, repeated_runs(docs, length, work, parts), parts, each, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary, kept_sha256 string")
        out = work.table(ids_back(out), "result")
    work.keep("result")
    return out
