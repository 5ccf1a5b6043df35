"""Interpolated modified Kneser-Ney: counted in Spark, mapped by the workers that score.

Words are runs of other than ASCII white space with A-Z in lower case; a text
ends with one end token.  Training takes these steps, each over all documents:

1. The lexicon: word hashes and counts, as sorted files by hash range.  A word's
   number is its rank.
2. Grams of the highest order, as columns of word numbers, summed per chunk and
   dealt by their context, so a context's totals come together.  Contexts of
   very frequent words (at most ``HOT_WORDS`` per partition, by their counts)
   are dealt by the whole gram and their totals added up afterwards.
3. Each lower order counts the distinct left neighbours of its grams.  A gram one
   word longer is in one partition of the order above, so that partition adds up
   the neighbours it has of each shorter gram and sends the sum on.

Step 2 takes ``ROUNDS`` passes over the texts, each for its share of the
partitions, so that only so much of the grams is shuffled at a time; a pass's
shuffle is removed with it.  Every gram is in exactly one pass.

A partition's files hold the sorted 64-bit hashes of its contexts, and for each
context the next words in order with a byte per count (larger counts in a short
second file).  A context's totals are added up from these, but for wide ones,
which have theirs written.  Workers map the files and look up all grams of a
chunk in the order of their contexts.

The model is a distribution over the lexicon and one unknown word for every
context.  Texts begin after order - 1 start symbols, which are never predicted.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import PACKED, Chunk, Tokens, bucket, chunks, mix, packed, runs, splitmix, spread, unpacked
from .shared import Lazy, Workspace, array_names, ids_back, partitions, read_array, small_batches, texts, write_array

END = np.uint64(splitmix(31337))
#: Words whose contexts are split: those with over 1 / (HOT_WORDS * partitions) of all tokens.
HOT_WORDS = 4
#: Passes over the texts for the highest order: what is shuffled at a time is so much less, and the texts are read so often.
ROUNDS = 1
#: Contexts with so many next words have their totals written.
WIDE = 16
#: Text bytes at once: a token takes some hundred bytes while its grams are made or looked up.
CHUNK_BYTES = 2 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the job that made them while the body runs."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def token_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with each text's end, and where the texts begin among them."""
    t = Tokens(chunk, lower=True)
    n = np.diff(t.first) + 1
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(int(first[-1]), np.uint64)
    ends = first[1:] - 1
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word], out[ends] = t.hash, END
    return out, first


def unique_with_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, and the place of each hash among them."""
    order = np.argsort(h)
    h = h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(fresh) - 1
    return h[fresh], back


def build_lexicon(docs: DataFrame, folder: str, parts: int) -> np.ndarray:
    """Write the sorted words and their counts; (words, tokens) by partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            h, n = np.unique(token_hashes(chunk)[0], return_counts=True)
            yield from packed(bucket(h, parts), [h, n.astype(np.uint32)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = unpacked(batches, [np.uint64, np.uint32])
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = runs(h)
        if not len(first):
            return
        total = np.add.reduceat(n.astype(np.int64), first)
        pid = int(bucket(h[:1], parts)[0])
        write_array(folder, f"{pid:08d}.count", total)
        write_array(folder, f"{pid:08d}.word", h[first])
        yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([len(first)], pa.int64()), pa.array([int(total.sum())], pa.int64())], ["pid", "words", "tokens"])

    out = np.zeros((parts, 2), np.int64)
    for r in docs.mapInArrow(count, PACKED).repartitionById(parts, "pid").mapInArrow(add, "pid int, words long, tokens long").collect():
        out[r.pid] = r.words, r.tokens
    return out


class Lexicon:
    """Numbers and counts of words; ``unknown`` and ``start`` are numbers of no word."""

    def __init__(self, folder: str, sizes: np.ndarray):
        self.parts = len(sizes)
        self.first = np.concatenate([[0], np.cumsum(sizes[:, 0])])
        self.size, self.tokens = int(self.first[-1]), int(sizes[:, 1].sum())
        self.start, self.unknown = self.size, self.size + 1
        pids = [int(x[:8]) for x in array_names(folder) if x.endswith(".word")]
        self.files = Lazy(folder, pids, lambda p: (read_array(folder, f"{p:08d}.word", np.uint64), read_array(folder, f"{p:08d}.count", np.int64)))

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of each hash; unknown words have count 0."""
        unique, back = unique_with_places(h)
        number, count = np.full(len(unique), self.unknown, np.int64), np.zeros(len(unique), np.int64)
        pid = bucket(unique, self.parts)
        first = runs(pid)
        for s, e in zip(first, np.append(first[1:], len(pid))):
            if (file := self.files.get(int(pid[s]))) is not None:
                at = np.minimum(np.searchsorted(file[0], unique[s:e]), len(file[0]) - 1)
                hit = np.flatnonzero(file[0][at] == unique[s:e])
                number[s + hit] = self.first[pid[s]] + at[hit]
                count[s + hit] = file[1][at[hit]]
        return number[back], count[back]


def hot_words(spark: SparkSession, folder: str, sizes: np.ndarray) -> np.ndarray:
    """Numbers of the words with over 1 / (HOT_WORDS * partitions) of all tokens: fewer than HOT_WORDS * partitions."""
    parts, tokens = len(sizes), int(sizes[:, 1].sum())
    offsets = np.cumsum(sizes[:, 0]) - sizes[:, 0]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pid in b.column("id").to_pylist():
                if sizes[pid, 0]:
                    count = read_array(folder, f"{pid:08d}.count", np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(offsets[pid] + np.flatnonzero(np.asarray(count) * HOT_WORDS * parts > tokens), pa.int64())], ["word"])

    return np.sort(np.array([r.word for r in spark.range(0, parts, 1, min(parts, 64)).mapInArrow(find, "word long").collect()], np.int64))


def padded(numbers: np.ndarray, first: np.ndarray, pad: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens with ``pad`` start symbols before each text, and the places of the tokens among them."""
    place = np.arange(len(numbers)) + np.repeat(np.arange(1, len(first)), np.diff(first)) * pad
    out = np.full(len(numbers) + pad * (len(first) - 1), start, np.int64)
    out[place] = numbers
    return out, place


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), splitmix(len(columns)), np.uint64)
    for c in columns:
        h = mix(h + c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h


def all_hot(columns: list[np.ndarray], hot: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([np.isin(c, hot) for c in columns])


def dealt(columns: list[np.ndarray], hot: np.ndarray, parts: int) -> np.ndarray:
    """Partition of each gram: its context's, or its own where all words of the context are hot."""
    to = bucket(gram_hash(columns[:-1]), parts)
    if len(split := np.flatnonzero(all_hot(columns[:-1], hot))):
        to[split] = bucket(gram_hash([c[split] for c in columns]), parts)
    return to


def _fresh(columns: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal rows in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    fresh = np.ones(len(columns[0]), bool)
    fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(fresh)


def _order(columns: list[np.ndarray]) -> np.ndarray:
    """Puts rows in the order of their columns, as many of which make one key as 64 bits hold."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    keys, left = [], 0
    for c in columns:
        bits = max(1, int(c.max()).bit_length())
        if bits <= left:
            keys[-1] = keys[-1] << np.uint64(bits) | c.astype(np.uint64)
            left -= bits
        else:
            keys.append(c.astype(np.uint64))
            left = 64 - bits
    return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])


def _summed(columns: list[np.ndarray], count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    order = _order(columns)
    columns, count = [c[order] for c in columns], count[order]
    if not len(count):
        return columns, count
    at = _fresh(columns)
    return [c[at] for c in columns], np.add.reduceat(count.astype(np.int64), at)


def planes(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The bytes of 32-bit columns, those of one place together: high ones are alike and pack well."""
    out = []
    for c in columns:
        b = np.ascontiguousarray(c, np.uint32).view(np.uint8).reshape(-1, 4)
        out += [b[:, i].copy() for i in range(4)]
    return out


def from_planes(arrays: list[np.ndarray]) -> list[np.ndarray]:
    return [np.ascontiguousarray(np.column_stack(arrays[i : i + 4])).view(np.uint32).ravel() for i in range(0, len(arrays), 4)]


class Model:
    """Training: what :func:`train` leaves for the workers, small except for its files."""

    def __init__(self, work: Workspace, order: int, parts: int):
        self.base, self.order, self.parts = work.base, order, parts
        self.sizes = np.zeros((parts, 2), np.int64)
        self.hot = np.zeros(0, np.int64)
        self.discount: dict[int, np.ndarray] = {}
        self.unigram = np.zeros(4)


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 1, 2, 3 and more from the numbers of grams counted 1 to 4 times.

    Small or odd corpora give values that are no discounts (below 0, or the whole count,
    which would leave nothing to a context's grams or nothing to the lower order), so each
    is held between 5 % and 95 % of its count; without grams of a count it is half of it.
    """
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a else k / 2
        out.append(min(max(d, 0.05 * k), 0.95 * k))
    return np.array([0.0, *out])


def write_grams(folder: str, pid: int, columns: list[np.ndarray], count: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Write the sorted grams of a partition; the numbers of those counted 1 to 4 times, and split contexts with their totals here."""
    context = gram_hash(columns[:-1])
    begin = runs(context)
    length = np.diff(np.append(begin, len(context)))
    sort = np.argsort(context[begin])
    order = np.repeat(begin[sort], length[sort]) + spread(length[sort])
    sums = count[order]
    large = np.flatnonzero(sums >= 255)
    # totals of the contexts: sum, and how many grams are counted once, twice, more often
    totals = np.column_stack([np.add.reduceat(x.astype(np.int64), begin) for x in (count, count == 1, count == 2, count >= 3)])
    split = all_hot([c[begin] for c in columns[:-1]], hot)
    wide = np.flatnonzero((~split & ((length >= WIDE) | (np.maximum.reduceat(count, begin) >= 255)))[sort])
    write_array(folder, f"{pid:08d}.word", columns[-1][order].astype(np.uint32))
    write_array(folder, f"{pid:08d}.count", np.minimum(sums, 255).astype(np.uint8))
    write_array(folder, f"{pid:08d}.large", large)
    write_array(folder, f"{pid:08d}.largecount", sums[large].astype(np.int64))
    write_array(folder, f"{pid:08d}.wide", wide)
    write_array(folder, f"{pid:08d}.totals", totals[sort[wide]].ravel())
    write_array(folder, f"{pid:08d}.first", np.concatenate([[0], np.cumsum(length[sort])]).astype(np.uint32))
    write_array(folder, f"{pid:08d}.context", context[begin[sort]])
    part = np.flatnonzero(split)
    return np.array([(count == c).sum() for c in (1, 2, 3, 4)], np.int64), context[begin[part]], totals[part]


def _count_order(given: DataFrame, k: int, model: Model, work: Workspace) -> tuple[DataFrame, np.ndarray]:
    """Write the files of order k, for the highest from texts, for others from what the order above left.

    Returns packed rows for the order below (for order 1 words, else grams,
    with their numbers of left neighbours here), and the numbers of grams
    counted 1 to 4 times.
    """
    parts, hot, sizes, top = model.parts, model.hot, model.sizes, k == model.order
    folder, words, lexicon_first = f"{work.base}/order-{k}", f"{work.base}/lexicon", np.concatenate([[0], np.cumsum(model.sizes[:, 0])])
    rounds = min(ROUNDS, parts)
    names, schema = ["kind", "pid", "blob", "some"], "kind int, pid int, blob binary, some array<long>"

    def grams(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(words, sizes)
        for chunk in chunks(batches, limit=CHUNK_BYTES):
            h, first = token_hashes(chunk)
            text, place = padded(lexicon.look(h)[0], first, k - 1, lexicon.start)
            columns = [text[place - back].astype(np.uint32) for back in range(k - 1, -1, -1)]
            to = dealt(columns, hot, parts)
            mine = np.flatnonzero(to % rounds == turn)
            columns, to = [c[mine] for c in columns], to[mine]
            order = _order(columns)
            columns, to = [c[order] for c in columns], to[order]
            at = _fresh(columns)
            yield from packed(to[at] // rounds, planes([*[c[at] for c in columns], np.diff(np.append(at, len(to)))]))

    def rows(kind: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([kind] * b.num_rows, pa.int32()), *b.columns, pa.nulls(b.num_rows, pa.list_(pa.int64()))], names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kind 0 for the order below, of kind 3 with the totals of split contexts, and one of kind 2 with the statistics."""
        columns = from_planes(unpacked(batches, [np.uint8] * (4 * (k + 1))))
        if not len(columns[0]):
            return
        columns, count = _summed(columns[:-1], columns[-1])
        some, context, totals = write_grams(folder, int(dealt([c[:1] for c in columns], hot, parts)[0]), columns, count, hot)
        yield from rows(3, packed(bucket(context, parts), [context, *totals.T]))
        if k == 2:
            lower, left = _single(columns[1])
            yield from rows(0, packed((np.searchsorted(lexicon_first, lower[0], side="right") - 1).astype(np.int32), [lower[0].astype(np.uint32), left.astype(np.uint32)]))
        else:
            # a gram is in one partition only, so numbers of left neighbours add up
            lower = [c[_order(columns[1:])] for c in columns[1:]]
            at = _fresh(lower)
            left, lower = np.diff(np.append(at, len(lower[0]))), [c[at] for c in lower]
            yield from rows(0, packed(dealt(lower, hot, parts), planes([*lower, left])))
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([some.tolist()], pa.list_(pa.int64()))], names)

    if top:
        tables = []
        for turn in range(rounds):
            dealt_out = given.mapInArrow(lambda batches, turn=turn: grams(batches, turn), PACKED).repartitionById(-(-(parts - turn) // rounds), "pid")
            tables.append(work.table(dealt_out.mapInArrow(settle, schema), f"rows-{k}-{turn}"))
        left = functools.reduce(DataFrame.unionByName, tables)
    else:
        left = work.table(given.repartitionById(parts, "pid").mapInArrow(settle, schema), f"rows-{k}")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, *sums = unpacked(batches, [np.uint64] + [np.int64] * 4)
        order = np.argsort(context)
        begin = runs(context[order])
        if len(begin):
            pid = int(bucket(context[:1], parts)[0])
            write_array(folder, f"{pid:08d}.hottotals", np.add.reduceat(np.column_stack(sums)[order], begin).ravel())
            write_array(folder, f"{pid:08d}.hotcontext", context[order][begin])
        yield pa.RecordBatch.from_arrays([pa.array([len(begin)], pa.int64())], ["n"])

    left.where("kind = 3").select("pid", "blob").repartitionById(parts, "pid").mapInArrow(total, "n long").agg(F.sum("n")).first()
    some = left.where("kind = 2").select(*[F.sum(F.element_at("some", c + 1)).alias(f"n{c}") for c in range(4)]).first()
    return left.where("kind = 0").select("pid", "blob"), np.array([x or 0 for x in some])


def _single(words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    unique, n = np.unique(words, return_counts=True)
    return [unique], n


def train(spark: SparkSession, docs: DataFrame, order: int, work: Workspace, parts: int) -> Model:
    """Count all of docs (doc_id, text)."""
    model = Model(work, order, parts)
    words = work.folder("lexicon")
    model.sizes = build_lexicon(docs, words, parts)
    lexicon = Lexicon(words, model.sizes)
    model.hot = np.concatenate([hot_words(spark, words, model.sizes), [lexicon.start]]).astype(np.int64)
    sizes = model.sizes
    if lexicon.size > 0xFFFFFFF0:
        raise ValueError("word numbers are 32 bits wide")
    rows = docs
    for k in range(order, 1, -1):
        rows, some = _count_order(rows, k, model, work)
        model.discount[k] = discounts(some)
        if k < order:
            work.drop(*names)
        names = [f"rows-{k}-{x}" for x in range(ROUNDS)] if k == order else [f"rows-{k}"]
    folder = work.folder("order-1")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n = unpacked(batches, [np.uint32, np.uint32])
        if not len(word):
            return
        offsets = np.concatenate([[0], np.cumsum(sizes[:, 0])])
        pid = int(np.searchsorted(offsets, word[0], side="right") - 1)
        left = np.bincount(word.astype(np.int64) - offsets[pid], weights=n, minlength=int(sizes[pid, 0])).astype(np.uint32)
        write_array(folder, f"{pid:08d}.left", left)
        yield pa.RecordBatch.from_arrays([pa.array([[int((left == c).sum()) for c in (1, 2, 3, 4)] + [int(left.sum(dtype=np.int64)), int((left >= 3).sum())]], pa.list_(pa.int64()))], ["some"])

    found = [r.some for r in rows.repartitionById(parts, "pid").mapInArrow(single, "some array<long>").collect()]
    total = np.sum(found, axis=0) if found else np.zeros(6)
    model.discount[1] = discounts(total[:4])
    model.unigram = np.array([total[4], total[0], total[1], total[5]], float)
    work.drop(*names)
    return model


class Order:
    """Files of one order, mapped."""

    def __init__(self, folder: str, parts: int):
        self.parts = parts
        read = lambda x, kind: np.asarray(read_array(folder, x, kind))
        names = array_names(folder)
        pids = [int(x[:8]) for x in names if x.endswith(".word")]
        self.context = Lazy(folder, pids, lambda p: (read(f"{p:08d}.context", np.uint64), read(f"{p:08d}.first", np.uint32)))
        self.grams = Lazy(folder, pids, lambda p: (read(f"{p:08d}.word", np.uint32), read(f"{p:08d}.count", np.uint8), read(f"{p:08d}.large", np.int64), read(f"{p:08d}.largecount", np.int64)))
        self.wide = Lazy(folder, pids, lambda p: (read(f"{p:08d}.wide", np.int64), read(f"{p:08d}.totals", np.int64).reshape(-1, 4)))
        self.hot = Lazy(folder, [int(x[:8]) for x in names if x.endswith(".hotcontext")], lambda p: (read(f"{p:08d}.hotcontext", np.uint64), read(f"{p:08d}.hottotals", np.int64).reshape(-1, 4)))

    def spans(self, pid: int, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which contexts the partition has, their ranks, and where their words begin and end."""
        known, first = self.context.get(pid)
        at = np.minimum(np.searchsorted(known, context), len(known) - 1)
        hit = np.flatnonzero(known[at] == context)
        at = at[hit]
        return hit, at, first[at].astype(np.int64), first[at + 1].astype(np.int64)

    def found(self, pid: int, low: np.ndarray, end: np.ndarray, want: np.ndarray) -> np.ndarray:
        """Counts of the wanted words between the given places of a partition."""
        words, count, large, many = self.grams.get(pid)
        out, at, size = np.zeros(len(want), np.int64), low.copy(), end - low
        # the first word that is not less, by halves; contexts of like length together
        for few, most in ((1, 8), (8, 1 << 62)):
            mine = np.flatnonzero((size > few) & (size <= most))
            if not len(mine):
                continue
            l, n, w = at[mine], size[mine], want[mine]
            for _ in range(int(n.max()).bit_length()):
                half = n >> 1
                l += half * (words[np.maximum(l + half - 1, 0)] < w)
                n -= half
            at[mine] = l
        some = np.flatnonzero(size > 0)
        l = at[some]
        l += words[l] < want[some]
        ok = some[l < end[some]]
        low = at
        low[some] = l
        ok = ok[words[low[ok]] == want[ok]]
        n = count[low[ok]].astype(np.int64)
        if len(full := np.flatnonzero(n == 255)):
            n[full] = many[np.searchsorted(large, low[ok[full]])]
        out[ok] = n
        return out

    def look(self, context: np.ndarray, word: np.ndarray, split: np.ndarray, home: np.ndarray, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count of each gram, the sum of its context and what is taken off there; ``home`` has the partitions of the ``split`` grams, others are in their context's."""
        word = word.astype(np.uint32)
        order = np.argsort(context)  # partitions are ranges of hashes
        sorted_ = context[order]
        begin = runs(sorted_)
        unique, size = sorted_[begin], np.diff(np.append(begin, len(sorted_)))
        want, counts, totals = word[order], np.zeros(len(word), np.int64), np.zeros((len(unique), 4))
        pid = bucket(unique, self.parts)
        first = runs(pid)
        for s, e in zip(first, np.append(first[1:], len(pid))):
            if (p := int(pid[s])) not in self.grams:
                continue
            hit, rank, low, end = self.spans(p, unique[s:e])
            a, b = np.zeros(e - s, np.int64), np.zeros(e - s, np.int64)
            a[hit], b[hit] = low, end
            t = slice(begin[s], begin[e - 1] + size[e - 1])
            counts[t] = self.found(p, np.repeat(a, size[s:e]), np.repeat(b, size[s:e]), want[t])
            wide, written = self.wide.get(p)
            if len(wide):
                at = np.minimum(np.searchsorted(wide, rank), len(wide) - 1)
                has = wide[at] == rank
                totals[s + hit[has]] = written[at[has]]
                hit, low, end = hit[~has], low[~has], end[~has]
            narrow = end - low < WIDE  # what is wide and has no totals here is split
            hit, low, length = hit[narrow], low[narrow], (end - low)[narrow]
            if len(hit):
                n = self.grams.get(p)[1][np.repeat(low, length) + spread(length)]
                starts = np.cumsum(length) - length
                one, two = (np.add.reduceat(n == c, starts, dtype=np.int64) for c in (1, 2))
                totals[s + hit] = np.column_stack([np.add.reduceat(n, starts, dtype=np.int64), one, two, length - one - two])
        for s, e in zip(first, np.append(first[1:], len(pid))):
            if (hot := self.hot.get(int(pid[s]))) is not None:
                at = np.minimum(np.searchsorted(hot[0], unique[s:e]), len(hot[0]) - 1)
                hit = np.flatnonzero(hot[0][at] == unique[s:e])
                totals[s + hit] = hot[1][at[hit]]
        out, sums, off = np.empty(len(word), np.int64), np.empty(len(word)), np.empty(len(word))
        out[order], sums[order], off[order] = counts, np.repeat(totals[:, 0], size), np.repeat(totals[:, 1:] @ discount[1:], size)
        at = np.flatnonzero(split)
        if len(at):
            out[at] = 0
            at = at[np.argsort(home[at], kind="stable")]
            first = runs(home[at])
            for s, e in zip(first, np.append(first[1:], len(at))):
                if (p := int(home[at[s]])) in self.grams:
                    mine = at[s:e]
                    hit, _, low, end = self.spans(p, context[mine])
                    out[mine[hit]] = self.found(p, low, end, word[mine[hit]])
        return out, sums, off


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.lexicon = Lexicon(f"{model.base}/lexicon", model.sizes)
        left = f"{model.base}/order-1"
        self.left = Lazy(left, [int(x[:8]) for x in array_names(left)], lambda p: read_array(left, f"{p:08d}.left", np.uint32))
        self.orders = {k: Order(f"{model.base}/order-{k}", model.parts) for k in range(2, model.order + 1)}

    def probabilities(self, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each token after those before it in its text."""
        m, lex = self.model, self.lexicon
        left = np.zeros(len(numbers), np.int64)
        known = np.flatnonzero(numbers < lex.size)
        pid = np.searchsorted(lex.first, numbers[known], side="right") - 1
        for p in np.unique(pid):
            mine = known[pid == p]
            left[mine] = self.left.get(int(p))[numbers[mine] - lex.first[p]]
        total, *n = m.unigram
        d = m.discount[1]
        spare = float(np.dot(d[1:], n)) / total if total else 1.0
        p = (left - d[np.minimum(left, 3)]) / max(total, 1) + spare / (lex.size + 1)
        text, place = padded(numbers, first, m.order - 1, lex.start)
        hot = np.isin(text, m.hot)
        for k in range(2, m.order + 1):
            columns = [text[place - back] for back in range(k - 1, -1, -1)]
            context = gram_hash(columns[:-1])
            split = np.logical_and.reduce([hot[place - back] for back in range(k - 1, 0, -1)])
            home = np.full(len(split), -1, np.int32)
            home[split] = bucket(gram_hash([c[split] for c in columns]), m.parts)
            d = m.discount[k]
            count, total, off = self.orders[k].look(context, columns[-1], split, home, d)
            seen = np.flatnonzero(total)
            count = count[seen]
            p[seen] = (count - d[np.minimum(count, 3)] + off[seen] * p[seen]) / total[seen]
        return p

    def chunk(self, chunk: Chunk) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known ones, base score, score."""
        h, first = token_hashes(chunk)
        numbers, count = self.lexicon.look(h)
        text = np.repeat(np.arange(chunk.n), np.diff(first))
        lex = self.lexicon
        base = np.log10((count + 0.5) / (lex.tokens + 0.5 * (lex.size + 1)))
        score = np.log10(self.probabilities(numbers, first))
        add = lambda w: np.bincount(text, weights=w, minlength=chunk.n)
        return np.diff(first), add(count > 0).astype(np.int64), add(base), add(score)


def score_documents(spark: SparkSession, docs: DataFrame, is_training: Column, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows where ``is_training`` (over doc_id) holds and score all rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-a-half
    unigrams), score (the model's log10 probability) and perplexity (per token).
    Empty and null texts are an end token.  Without training rows every token is
    the unknown word, of probability 1.
    """
    parts = partitions(spark)
    work = Workspace(spark, "kneser-ney")
    docs = texts(docs, id_col, text_col)
    with small_batches(spark), shuffles_removed(spark):
        model = train(spark, docs.where(is_training), order, work, parts)
        tokens = int(model.sizes[:, 1].sum())
        sent = spark.sparkContext.broadcast(model)  # numbers by partition and the hot words

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(sent.value)
            for chunk in chunks(batches, limit=CHUNK_BYTES):
                n, known, base, score = scorer.chunk(chunk)
                yield pa.RecordBatch.from_arrays([pa.array(chunk.column("doc_id")), pa.array(n, pa.int64()), pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

        out = docs.mapInArrow(step, "doc_id long, n_tokens long, n_known long, base_score double, score double")
        out = out.select("doc_id", (~is_training).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
        out = work.table(ids_back(out), "result")
    work.drop("lexicon", *[f"order-{k}" for k in range(1, order + 1)])
    return out
