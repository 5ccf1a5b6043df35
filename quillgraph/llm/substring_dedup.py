"""Repeated passages by seed and extend over words.

Seeds are winnowed anchors (:mod:`.repeats`): grams of ``GRAM`` words that two
places share.  Each place brings its *context*, the words of all windows of
``length`` words that chose this anchor, and the contexts of one anchor meet in
one task.  There the matches are extended word by word, to the left and to the
right (:func:`extended`): places that agree so far stay together as long as
their next words are the same, byte for byte.  A window of c words to the left
of the seed and the rest to its right is repeated if an earlier place (smaller
id, then earlier start) agrees with it that far on both sides.  So a group of
places is extended at once, and no pair of them is compared.  What neighbouring
anchors find is put together to maximal repeats, which are at least ``length``
words long by construction.

Equal contexts inside one chunk of text are settled there, and only the earliest
travels on, so a passage in a third of all documents is a record or two for each
chunk.  Around hot anchors each window is a context of its own, dealt by its
content.  Words are runs of other than ASCII white space, unchanged.  Hashes only
bring places together; what is removed has been compared.

A null or empty text has no words.  Rows that repeat an id are the same document
read twice: they do not mark each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .kernels import PACKED, SPACE, Tokens, bucket, chunks, decode, runs, spread
from .repeats import AnchorFiles, Windows, apply_runs, as_runs, context_rows, covered, hash_slices, repeated_anchors, run_rows, same_slices, settled, slices
from .shared import Workspace, ids_back, partitions, small_batches, texts

GRAM = 8
#: Anchor, document, place of the first word, words before the anchor, windows, bytes.
_HEAD = [np.uint64, np.int64, np.uint32, np.uint8, np.uint8, np.uint32]
#: Context bytes that are extended at once.
SLICE_BYTES = 8 << 20


class Texts:
    """Byte stretches in the shape that :class:`Tokens` reads."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1


def single_spaced(chunk, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's bytes with one blank after each word, and where each word begins and ends there."""
    size = tokens.end - tokens.start
    end = np.cumsum(size + 1) - 1
    keep = ~SPACE[chunk.data]
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
    word = np.ones(len(out), bool)
    word[end] = False
    out[word] = chunk.data[keep]
    return out, end - size, end


def word_names(tokens: Tokens, data: np.ndarray) -> np.ndarray:
    """A number for each word, equal just for equal words: by hash, then compared byte for byte."""
    if not len(tokens):
        return np.zeros(0, np.int64)
    _, one, name = np.unique(tokens.hash, return_index=True, return_inverse=True)
    size = tokens.end - tokens.start
    stands = one[name]
    same = size == size[stands]
    same[same] = same_slices(data, tokens.start[same], tokens.start[stands[same]], size[same])
    if not same.all():  # two words share a hash
        known: dict[bytes, int] = {}
        raw = data.tobytes()
        name = np.array([known.setdefault(raw[s:e], len(known)) for s, e in zip(tokens.start.tolist(), tokens.end.tolist())], np.int64)
    return name.ravel()


def extended(anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, left: np.ndarray, count: np.ndarray, words: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows that an earlier place repeats.

    Place i has the words ``first[i]`` to ``first[i + 1]`` (numbers), of which
    ``left[i]`` lie before its seed; places are in the order of (doc, start of the seed).
    """
    reach = length - GRAM
    seed = first[:-1] + left
    many = int(words.max()) + 2 if len(words) else 1

    def further(group: np.ndarray, at: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """Split groups by the word at a place; those without one are alone in group -1."""
        out = np.full(len(group), -1, np.int64)
        some = np.flatnonzero(ok & (group >= 0))
        out[some] = np.unique(group[some] * many + words[at[some]], return_inverse=True)[1].ravel()
        return out

    agree = np.unique(anchor, return_inverse=True)[1].ravel().astype(np.int64)
    for k in range(GRAM):  # the seed itself
        agree = further(agree, seed + k, np.ones(len(seed), bool))
    to_left, to_right = [agree], [agree]
    for k in range(reach):
        to_left.append(further(to_left[-1], seed - k - 1, seed - k - 1 >= first[:-1]))
        to_right.append(further(to_right[-1], seed + GRAM + k, seed + GRAM + k < first[1:]))
    docs, starts = [], []
    for c in range(reach + 1):
        mine = np.flatnonzero((c <= left) & (c > left - count))
        if not len(mine):
            continue
        a, b = to_left[c][mine], to_right[reach - c][mine]
        _, one, name = np.unique(a * (int(b.max()) + 1) + b, return_index=True, return_inverse=True)
        of = mine[one[name.ravel()]]
        at = start + left - c  # the window's first word in the document
        later = (doc[mine] != doc[of]) | (at[mine] != at[of])
        docs.append(doc[mine[later]])
        starts.append(at[mine[later]])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(starts)


def _marked(blobs: list, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Repeated windows of a task's contexts, some anchors at a time."""
    heads, raws = [], []
    for blob in blobs:
        part = decode(blob, _HEAD)
        heads.append(part)
        raws.append(np.frombuffer(blob, np.uint8, -1, 4 + len(part[0]) * sum(np.dtype(k).itemsize for k in _HEAD)))
    if not heads:
        return
    anchor, doc, start, left, count, size = (np.concatenate(x) for x in zip(*heads))
    start, left, count, size = (x.astype(np.int64) for x in (start, left, count, size))
    data = np.concatenate(raws)
    at = np.cumsum(size) - size
    order = np.lexsort((start + left, doc, anchor))
    begin = runs(anchor[order])
    group = np.diff(np.append(begin, len(order)))
    order = order[np.repeat(group > 1, group)]
    begin = runs(anchor[order])
    ends = np.append(begin[1:], len(order))
    heavy = np.cumsum(size[order])[ends - 1] // SLICE_BYTES if len(order) else begin
    for s in runs(heavy):
        e = np.searchsorted(heavy, heavy[s], side="right") - 1
        mine = order[begin[s] : ends[e]]
        n = size[mine]
        part = Texts(data[np.repeat(at[mine], n) + spread(n)], np.concatenate([[0], np.cumsum(n)]))
        tokens = Tokens(part, lower=False)
        yield extended(anchor[mine], doc[mine], start[mine], left[mine], count[mine], word_names(tokens, part.data), tokens.first, length)


def repeated_runs(spark: SparkSession, docs: DataFrame, length: int, work: Workspace, parts: int) -> DataFrame:
    """Packed runs (doc, start, windows) of the windows that have an earlier equal."""
    folder, hot, total = repeated_anchors(docs, "word", GRAM, length, work, parts)
    out = None
    for low, high in slices(folder, total, parts):

        def seeds(batches: Iterator[pa.RecordBatch], low=low, high=high) -> Iterator[pa.RecordBatch]:
            files, very = AnchorFiles(folder, parts, low, high), AnchorFiles(hot, parts, low, high)
            for chunk in chunks(batches):
                w = Windows(chunk, "word", GRAM, length)
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
                data, word, end = single_spaced(chunk, w.tokens)
                heat = very.has(key)
                if heat.any():  # each window by itself, under its content
                    n = count[heat]
                    alone = np.repeat(begin[heat], n) + spread(n)
                    seed = np.repeat(anchor[heat], n)
                    by_content = hash_slices(data, word[alone], end[alone + length - 1] - word[alone])
                    begin, anchor, key = (np.concatenate([x[~heat], y]) for x, y in ((begin, alone), (anchor, seed), (key, by_content)))
                    count = np.concatenate([count[~heat], np.ones(len(alone), count.dtype)])
                local = w.tokens.doc[begin]
                doc, place, left = chunk.column("doc_id")[local], begin - w.first[local], anchor - begin
                at = word[begin]
                size = end[begin + count + length - 2] - at
                head, later = settled(data, at, size, left, doc, place)
                marks = as_runs(np.repeat(doc[later], count[later]), np.repeat(place[later], count[later]) + spread(count[later]))
                rows = context_rows(bucket(key[head], parts), [x[head].astype(k) for x, k in zip((key, doc, place, left, count, size), _HEAD)], data, at[head], size[head])
                for kind, bs in ((0, rows), (1, run_rows(marks, parts))):
                    for b in bs:
                        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, kind, np.int32))], ["pid", "blob", "kind"])

        def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blobs = []
            for b in batches:
                kind = b.column("kind").to_numpy()
                if (kind == 1).any():
                    yield b.filter(pa.array(kind == 1)).select(["pid", "blob"])
                blobs += [x.as_buffer() for x in b.filter(pa.array(kind == 0)).column("blob")]
            for doc, start in _marked(blobs, length):
                yield from run_rows(as_runs(doc, start), parts)

        found = docs.mapInArrow(seeds, PACKED + ", kind int").repartitionById(parts, "pid").mapInArrow(extend, PACKED)
        out = found if out is None else out.unionByName(found)
    return out


def substring_dedup(spark: SparkSession, docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Remove the words of passages of ``length`` words or more that start earlier elsewhere.

    Returns doc_id, n_words, n_removed, spans (removed stretches of words, as
    pairs start, end), kept_text (the other words joined by one space; null
    unless ``keep_text``), kept_sha256.  ``length`` is from 9 to 200.  An empty
    table gives an empty result.
    """
    if not GRAM < length <= 200:
        raise ValueError("length must be from 9 to 200")
    parts = partitions(spark)
    work = Workspace(spark, "passages")
    docs = texts(docs, id_col, text_col)

    def each(pairs) -> Iterator[pa.RecordBatch]:
        for chunk, found in pairs:
            ids = chunk.column("doc_id")
            words, removed, spans, kept, sums = [], [], [], [], []
            for i in range(chunk.n):
                tokens = chunk.text(i).split()
                cut = covered(found, int(ids[i]), len(tokens), length)
                words.append(len(tokens))
                removed.append(int((cut[:, 1] - cut[:, 0]).sum()))
                spans.append(cut.ravel().tolist())
                if len(cut):
                    edges = [0, *cut.ravel().tolist(), len(tokens)]
                    tokens = [t for s, e in zip(edges[::2], edges[1::2]) for t in tokens[s:e]]
                rest = b" ".join(tokens)
                sums.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode() if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.string()), pa.array(sums, pa.string())],
                ["doc_id", "n_words", "n_removed", "spans", "kept_text", "kept_sha256"],
            )

    with small_batches(spark):
        found = repeated_runs(spark, docs, length, work, parts)
        out = apply_runs(docs, found, parts, each, "doc_id long, n_words long, n_removed long, spans array<long>, kept_text string, kept_sha256 string")
        out = work.table(ids_back(out), "result")
    work.keep("result")
    return out
