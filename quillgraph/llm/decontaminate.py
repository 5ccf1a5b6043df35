"""Benchmark passages in documents by the q-gram lemma.

Texts are compared in lower case, with each run of other than ASCII letters,
digits and non-ASCII bytes as one space.  A document holds a passage of an item
if a stretch of ``length`` bytes of the item (the whole item if shorter) aligns
with some stretch of the document within ``rate`` edits per byte, rounded down.

Two strings that align along w bytes with e edits share at least
``w + 1 - q (e + 1)`` q-grams, and these lie within e + 1 diagonals.  So the
shared q-grams of a document and an item are counted in bands of diagonals,
each band overlapping the next by half, over a window of w bytes along the item;
regions that meet the bound are kept (:func:`regions`) and settled by an
alignment confined to the band (:func:`aligned`).  q is 12, or the longest for which
the bound is 1 or more, so that an item of any length has its whole budget.

The alignment needs 4 e + 3 diagonals: the band, and e more on each side, since an
alignment within e edits strays at most that far from any q-gram it keeps.  Every
start of the item's stretch that covers a region is tried, so no passage within
the budget is missed.

Repetitive texts: of an item's stretches that are equal the first stands for all, and
only q-grams of such stretches are looked up.  Shared q-grams are laid out for at most
:data:`HITS` at a time, in runs of the document that overlap by a stretch, and a region
that was settled for the same bytes is not settled again.

The index of the benchmark's q-grams goes to all workers.  Its size is checked:
a benchmark over ``INDEX_BYTES`` is compared in blocks of items, one scan each.
Items of fewer than 12 normalised bytes match nothing.  Null and empty texts
hold nothing, null ids are ids like others, and each row has its own result.
Items that repeat are reported under each of their ids; an item without an id as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import LOWER, Chunk, byte_grams, chunks, spread
from .shared import NO_ID, Workspace, carried_type, ids_back, small_batches, texts, whole_row

Q = 12
INDEX_BYTES = 8 << 20
#: Shared q-grams that are laid out at once, about.
HITS = 1 << 20
#: Settled regions of a chunk that are remembered.
SETTLED = 20_000

_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def normalised(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of some texts, their offsets, and each byte's place in the source."""
    letter = _LETTER[data]
    keep = letter.copy()
    if len(data):
        keep[1:] |= letter[:-1]  # the first separator after a letter stands for its run
        edge = off[:-1][off[:-1] < len(data)]
        keep[edge] = letter[edge]
    at = np.flatnonzero(keep)
    out = np.where(letter[at], LOWER[data[at]], 32).astype(np.uint8)
    return out, np.searchsorted(at, off), at


def budget_of(n: int, length: int, rate: float) -> tuple[int, int, int, int]:
    """For an item of n bytes: compared length, edits allowed, q, q-grams required."""
    w = min(n, length)
    e = int(w * rate + 1e-9)
    q = min(Q, w // (e + 1))
    return w, e, q, w + 1 - q * (e + 1)


def _first_stretches(text: np.ndarray, w: int) -> np.ndarray:
    """Starts of the stretches of w bytes that are equal to none before."""
    h = byte_grams(text, w)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    keep = np.zeros(len(h), bool)
    keep[first] = True
    again = np.flatnonzero(~keep)
    for part in np.array_split(again, max(1, len(again) // 4096)):  # equal hashes are compared
        at = np.arange(w)
        keep[part[(text[part[:, None] + at] != text[first[which[part]][:, None] + at]).any(axis=1)]] = True
    return keep


class Items:
    """The q-grams of some normalised items of one q, sorted, with a quick test."""

    def __init__(self, q: int, ids: list[int], texts_: list[np.ndarray], budgets: list[tuple[int, int, int, int]]):
        self.q, self.ids, self.texts = q, ids, texts_
        self.n = np.array([len(x) for x in texts_], np.int64)
        self.w, self.e, _, self.need = (np.array(x, np.int64) for x in zip(*budgets, strict=True))
        #: For each item, whether a stretch that starts here is to be tried.
        self.starts = [_first_stretches(x, int(w)) for x, w in zip(texts_, self.w, strict=True)]
        hashes, items, places = [], [], []
        for t, (x, starts, w) in enumerate(zip(texts_, self.starts, self.w, strict=True)):
            inside = np.zeros(len(x) + 1, np.int64)
            at = np.flatnonzero(starts)
            np.add.at(inside, at, 1)
            np.add.at(inside, at + int(w) - q + 1, -1)
            place = np.flatnonzero(np.cumsum(inside)[: len(x) - q + 1])
            hashes.append(byte_grams(x, q)[place])
            places.append(place)
            items.append(np.full(len(place), t))
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = np.concatenate(items)[order].astype(np.int32)
        self.place = np.concatenate(places)[order].astype(np.int32)
        self.likely = np.zeros(1 << 22, bool)
        self.likely[self.hash >> np.uint64(42)] = True

    def hits(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Shared q-grams: (document, item, place in the document, place in the item), a run of the data at a time.

        Runs overlap by what a passage spans, so a passage lies within one of them.
        """
        h = byte_grams(data, self.q)
        at = np.flatnonzero(self.likely[h >> np.uint64(42)])
        h = h[at]
        low, high = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, side="right")
        some = high > low
        at, low, count = at[some], low[some], (high - low)[some]
        doc = np.searchsorted(off, at, side="right") - 1
        inside = at + self.q <= off[doc + 1]
        at, low, count, doc = at[inside], low[inside], count[inside], doc[inside]
        span = int((self.w + 2 * self.e).max()) + 2
        total, begin = np.concatenate([[0], np.cumsum(count)]), 0
        while begin < len(at):
            end = int(np.searchsorted(total, total[begin] + HITS, side="right")) - 1
            end = max(end, int(np.searchsorted(at, at[begin] + 2 * span)))  # a run is longer than the overlap
            some = slice(begin, end)
            post = np.repeat(low[some], count[some]) + spread(count[some])
            yield np.repeat(doc[some], count[some]), self.item[post].astype(np.int64), np.repeat((at - off[doc])[some], count[some]), self.place[post].astype(np.int64)
            if end >= len(at):
                break
            begin = int(np.searchsorted(at, at[end] - span))


def grouped(ids: np.ndarray, texts_: list[bytes], length: int, rate: float) -> list[Items]:
    """The items by their q."""
    raw = b"".join(texts_)
    data, off, _ = normalised(np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts_])]).astype(np.int64))
    by_q: dict[int, list[tuple]] = {}
    for t, n in zip(ids, range(len(texts_)), strict=True):
        text = data[off[n] : off[n + 1]]
        if len(text) >= Q:
            budget = budget_of(len(text), length, rate)
            by_q.setdefault(budget[2], []).append((int(t), text, budget))
    return [Items(q, *map(list, zip(*found, strict=True))) for q, found in sorted(by_q.items())]


def regions(items: Items, doc: np.ndarray, item: np.ndarray, j: np.ndarray, i: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, band's least diagonal, first and last start in the item) where a band meets the bound.

    Starts that overlap or touch are one region.
    """
    w, e, q = items.w, items.e, items.q
    for half in (0, 1):
        width = 2 * (e[item] + 1)
        band = (j - i + items.n[item] + half * (e[item] + 1)) // width
        order = np.lexsort((i, band, item, doc))
        d, t, b, p = doc[order], item[order], band[order], i[order]
        fresh = np.ones(len(d), bool)
        if len(d):
            fresh[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (b[1:] != b[:-1]) | (p[1:] != p[:-1])
        d, t, b, p = d[fresh], t[fresh], b[fresh], p[fresh]
        other = np.arange(len(d)) + items.need[t] - 1
        k = np.flatnonzero(other < len(d))
        o = other[k]
        good = (d[k] == d[o]) & (t[k] == t[o]) & (b[k] == b[o]) & (p[o] - p[k] <= w[t[k]] - q)
        k, o = k[good], o[good]
        low, high = np.maximum(0, p[o] + q - w[t[k]]), np.minimum(p[k], (items.n - w)[t[k]])
        d, t, b = d[k], t[k], b[k]
        begins = np.ones(len(k), bool)
        if len(k):
            begins[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (b[1:] != b[:-1]) | (low[1:] > high[:-1] + 1)
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(k))[: len(first)] - 1
        for s, f in zip(first, last, strict=True):
            x = t[s]
            yield int(d[s]), int(x), int(b[s] * 2 * (e[x] + 1) - items.n[x] - half * (e[x] + 1)), int(low[s]), int(high[f])


def any_within(patterns: np.ndarray, texts_: np.ndarray, most: int) -> bool:
    """Whether some row's pattern of w symbols aligns in its band with at most ``most`` edits.

    A text row has w + width - 1 symbols: cell b of the band meets symbol i of
    the pattern with symbol i + b of the text.  The alignment may start and end
    at any cell.
    """
    w = patterns.shape[1]
    steps = np.arange(texts_.shape[1] - w + 1, dtype=np.int16)
    row = np.zeros((len(patterns), len(steps)), np.int16)
    for i in range(w):
        new = row + (texts_[:, i : i + len(steps)] != patterns[:, i : i + 1])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])  # the pattern's symbol is left out
        row = np.minimum.accumulate(new - steps, axis=1) + steps  # symbols of the text are left out
        alive = row.min(axis=1) <= most
        if not alive.all():
            if not alive.any():
                return False
            row, patterns, texts_ = row[alive], patterns[alive], texts_[alive]
    return True


def aligned(items: Items, t: int, text: np.ndarray, diagonal: int, low: int, high: int, settled: set) -> bool:
    """Whether a stretch of the item that starts from ``low`` to ``high`` aligns within the band; ``settled`` has what did not."""
    w, e, whole = int(items.w[t]), int(items.e[t]), items.texts[t]
    starts = np.arange(low, high + 1)
    starts = starts[items.starts[t][starts]]
    if not len(starts):
        return False
    # what is before and after the text matches nothing, so it saves no edits
    begin, end = int(starts[0]) + diagonal - e, int(starts[-1]) + diagonal + 3 * e + w + 2
    key = (items.q, t, low, high, max(0, -begin), text[max(0, begin) : max(0, end)].tobytes())
    if key in settled:
        return False
    for part in np.array_split(starts, -(-len(starts) // 2048)):
        place = part[:, None] + diagonal - e + np.arange(w + 4 * e + 2)
        inside = (place >= 0) & (place < len(text))
        windows = np.where(inside, text[np.clip(place, 0, len(text) - 1)].astype(np.int16), np.int16(256))
        if any_within(whole[part[:, None] + np.arange(w)].astype(np.int16), windows, e):
            return True
    if len(settled) >= SETTLED:
        settled.clear()
    settled.add(key)
    return False


def found_items(groups: list[Items], chunk: Chunk) -> list[list[int]]:
    """For each document of the chunk, the ids of the items of which it holds a passage."""
    data, off, _ = normalised(chunk.data, chunk.offsets)
    out: list[set[int]] = [set() for _ in range(chunk.n)]
    if not len(data):
        return [[] for _ in out]
    for items in groups:
        seen: set[tuple[int, int]] = set()
        settled: set = set()
        for doc, item, j, i in items.hits(data, off):
            for d, t, diagonal, low, high in regions(items, doc, item, j, i):
                if (d, t) not in seen and aligned(items, t, data[off[d] : off[d + 1]], diagonal, low, high, settled):
                    seen.add((d, t))
                    out[d].add(items.ids[t])
    return [sorted(x) for x in out]


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, length: int = 100, rate: float = 0.06, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Returns doc_id, items (ids of the items of which the document holds a passage), n_items, contaminated; one row per row.

    With ``carry`` also ``row``, the columns of docs as a struct.
    """
    if not 0 <= rate < 0.5:
        raise ValueError("rate: from 0 to less than 0.5 edits per byte")
    columns, docs = docs.columns, texts(docs, id_col, text_col, carry)
    extra = ["text", "rest"] if carry else []
    bench = texts(benchmark, "item_id", "text")
    with small_batches(spark):
        work = Workspace(spark, "decontaminate")
        size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = max(1, -(-size // INDEX_BYTES))
        if blocks > 1:  # several scans: the rows need a name
            docs = work.table(docs.withColumn("at", F.monotonically_increasing_id()), "rows")
        found = None
        for k in range(blocks):
            mine = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == k)
            rows = sorted((r[0], r[1]) for r in mine.toLocalIterator())
            sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), [r[1].encode() for r in rows]))
            names = ["doc_id", *extra] if blocks == 1 else ["at"]

            def step(batches: Iterator[pa.RecordBatch], sent=sent, names=names, all_rows=blocks == 1) -> Iterator[pa.RecordBatch]:
                groups = grouped(*sent.value, length, rate)
                for chunk in chunks(batches):
                    held = found_items(groups, chunk)
                    out = pa.RecordBatch.from_arrays([*chunk.carried(names), pa.array(held, pa.list_(pa.int64()))], [*names, "items"])
                    yield out if all_rows else out.filter(pa.array([len(x) > 0 for x in held]))

            part = docs.select(*dict.fromkeys(["text", *names])).mapInArrow(step, f"{names[0]} long{carried_type(docs) if blocks == 1 else ''}, items array<long>")
            part = work.table(part, f"block-{k}")
            found = part if found is None else found.unionByName(part)
        if blocks > 1:
            found = found.groupBy("at").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
            found = docs.select("at", "doc_id", *extra).join(found, "at", "left").select("doc_id", *extra, F.coalesce("items", F.array().cast("array<long>")).alias("items"))
        found = found.withColumn("items", F.transform("items", lambda x: F.when(x != NO_ID, x)))
        return ids_back(found.select("doc_id", "items", F.size("items").cast("long").alias("n_items"), (F.size("items") > 0).alias("contaminated"), *([whole_row(columns, text_col)] if carry else [])))
