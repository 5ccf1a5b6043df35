"""Similarity join on word shingles: T-occurrence search after DivideSkip.

A document's partners share at least T of its n distinct shingles, T being the
least whole number with ``T / n`` at or over the threshold.  DivideSkip leaves
the T - 1 longest inverted lists out of the merge: a partner must then occur in
the remaining n - T + 1 short ones, and the long lists are only probed.

* Which lists are long must be agreed on by all documents.  The first scan
  counts, in each chunk of text, shingles that many different documents hold;
  the sums over all chunks order them (:func:`scan`).  A document's short lists
  are its least frequent shingles, ties by hash.
* The short lists meet by hash range, one packed record per chunk and
  partition, and are merged there (:func:`merge_lists`).  A member carries how
  many of its shingles follow in the common order: two classes are judged in the
  first short list they share, where that bounds their overlap.
* Each class is first paired with the one it meets most often
  (:func:`first_pairs`).  Such pairs are settled by binary probes of one class's
  shingles in the other's sorted array, mapped from the shared folder
  (:func:`verify`), against the required overlap of the two sizes.
* Components of these links make most lists uniform.  The lists that still hold
  several components are settled where they lie (:func:`settle`): a task reads
  the members' arrays, finds the links between components and passes on one edge
  for each component it joined, never a pair.  Lists of more than ``BLOCK``
  members are dealt as pairs of blocks in the order of size.

So no link between components is missed, pairs are judged and forgotten inside
a task, and a group of thousands of near copies passes on a row for each member.

Documents with equal shingle sets are one class from the start.
A null or empty text, or one without words, has no shingles and no links; a
text of fewer words than a shingle has one shingle, its whole sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .kernels import PACKED, Chunk, Tokens, bucket, chunks, decode, encode, grams, mix, packed, runs, splitmix, spread, unpacked
from .repeats import AnchorFiles, slices
from .shared import Lazy, Workspace, array_names, ids_back, partitions, read_array, small_batches, texts, write_array

#: A shingle is counted as frequent where this many classes of one chunk hold it.
OFTEN = 2
#: Members of a list that are compared as one block, and shingles of the members of a block or of a row of small lists.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Lists of at most so many members are compared pair by pair, longer ones by counting.
SMALL = 48
#: In a block, a shingle that one in so many members hold has a long list.
LONG_SHARE = 16


class ShingleSets:
    """Distinct shingles of each document of a chunk, ascending; ``first[d]`` to ``first[d + 1]`` are document d's."""

    def __init__(self, chunk: Chunk, k: int):
        tokens = Tokens(chunk, lower=True)
        n = np.diff(tokens.first)
        h = grams(tokens.hash, k)
        long = n >= k
        size = np.where(long, n - k + 1, 0)
        doc = np.repeat(np.arange(chunk.n), size)
        h = h[np.repeat(tokens.first[:-1], size) + spread(size)] if len(doc) else np.zeros(0, np.uint64)
        docs, hashes = [doc], [h]
        for words in range(1, k):
            few = np.flatnonzero(n == words)
            if len(few):
                docs.append(few)
                hashes.append(mix(grams(tokens.hash, words)[tokens.first[few]] + np.uint64(splitmix(words))))
        doc, h = np.concatenate(docs), np.concatenate(hashes)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        self.doc, self.hash = doc[fresh], h[fresh]
        self.first = np.searchsorted(self.doc, np.arange(chunk.n + 1))
        self.n = np.diff(self.first)
        self.cls, self.check = np.zeros(chunk.n, np.uint64), np.zeros(chunk.n, np.uint64)
        some = np.flatnonzero(self.n)
        if len(some):
            at = self.first[some]
            self.cls[some] = mix(np.add.reduceat(mix(self.hash), at) + self.n[some].astype(np.uint64))
            self.check[some] = np.add.reduceat(mix(self.hash ^ np.uint64(splitmix(5))), at)
        # the first document of each class in the chunk stands for it
        self.stands = np.zeros(chunk.n, bool)
        if len(some):
            _, one = np.unique(self.cls[some], return_index=True)
            self.stands[some[one]] = True


def required(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap a set of n shingles has with any partner."""
    return -(-num * n // den)


def linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    return den * shared >= num * (a + b - shared)


def overlap(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least shared shingles of linked sets of a and b shingles."""
    return -(-num * (a + b) // (num + den))


def scan(docs: DataFrame, k: int, work: Workspace, parts: int, digests: bool = False) -> tuple[DataFrame, str]:
    """The table (doc_id, n, cls, check, digest) and the folder of frequent shingles with their counts."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            s = ShingleSets(chunk, k)
            h = np.sort(s.hash[s.stands[s.doc]])
            first = runs(h)
            count = np.diff(np.append(first, len(h)))
            often = count >= OFTEN
            m = chunk.n
            digest = pa.array([hashlib.sha256(chunk.text(i)).digest() for i in range(m)], pa.binary()) if digests else pa.nulls(m, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk.column("doc_id")), pa.array(s.n, pa.int64()), pa.array(s.cls.view(np.int64)), pa.array(s.check.view(np.int64)), digest, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                names,
            )
            for b in packed(bucket(h[first[often]], parts), [h[first[often]], count[often].astype(np.uint32)]):
                yield pa.RecordBatch.from_arrays([*[pa.nulls(b.num_rows, pa.int64()) for _ in range(4)], pa.nulls(b.num_rows, pa.binary()), *b.columns], names)

    names = ["doc_id", "n", "cls", "check", "digest", "pid", "blob"]
    seen = work.table(docs.mapInArrow(look, "doc_id long, n long, cls long, check long, digest binary, pid int, blob binary"), "scan")
    folder = work.folder("frequent")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, count = unpacked(batches, [np.uint64, np.uint32])
        order = np.argsort(h)
        h, count = h[order], count[order]
        first = runs(h)
        if len(first):
            pid = int(bucket(h[:1], parts)[0])
            write_array(folder, f"{pid:08d}.count", np.add.reduceat(count, first).astype(np.uint32))
            write_array(folder, f"{pid:08d}.hash", h[first])
        yield pa.RecordBatch.from_arrays([pa.array([len(first)], pa.int64())], ["n"])

    seen.where("pid is not null").select("pid", "blob").repartitionById(parts, "pid").mapInArrow(keep, "n long").agg(F.sum("n")).first()
    return seen.where("pid is null").select("doc_id", "n", "cls", "check", "digest"), folder


class Frequent:
    """Counts of the frequent shingles, mapped; 0 for the others."""

    def __init__(self, folder: str, parts: int):
        self.parts = parts
        pids = [int(x[:8]) for x in array_names(folder) if x.endswith(".hash")]
        self.files = Lazy(folder, pids, lambda p: (read_array(folder, f"{p:08d}.hash", np.uint64), read_array(folder, f"{p:08d}.count", np.uint32)))

    def of(self, h: np.ndarray) -> np.ndarray:
        order = np.argsort(h)
        sorted_h = h[order]
        pid = bucket(sorted_h, self.parts)
        got = np.zeros(len(h), np.uint32)
        first = runs(pid)
        for s, e in zip(first, np.append(first[1:], len(pid))):
            if (file := self.files.get(int(pid[s]))) is not None:
                at = np.minimum(np.searchsorted(file[0], sorted_h[s:e]), len(file[0]) - 1)
                got[s:e] = np.where(file[0][at] == sorted_h[s:e], file[1][at], 0)
        out = np.zeros(len(h), np.uint32)
        out[order] = got
        return out


#: Shingle, class, its size, and how many of its shingles follow from this one on.
LISTS = [np.uint64, np.uint64, np.uint32, np.uint32]


def merge_lists(docs: DataFrame, k: int, num: int, den: int, frequent: str, parts: int) -> DataFrame:
    """Packed short lists with two members or more: sorted arrays (shingle, class, size, shingles left)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Frequent(frequent, parts)
        for chunk in chunks(batches):
            s = ShingleSets(chunk, k)
            mine = s.stands[s.doc]
            doc, h = s.doc[mine], s.hash[mine]
            if not len(doc):
                continue
            often = counts.of(h)
            if often.any():
                order = np.lexsort((h, often, doc))
                doc, h = doc[order], h[order]
            at = np.arange(len(doc)) - np.repeat(runs(doc), np.diff(np.append(runs(doc), len(doc))))
            n = s.n[doc]
            short = at < n - required(n, num, den) + 1
            doc, h = doc[short], mix(h[short])  # the least hashes, spread evenly again
            yield from packed(bucket(h, parts), [h, s.cls[doc], s.n[doc].astype(np.uint32), (n - at)[short].astype(np.uint32)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, cls, n, left = unpacked(batches, LISTS)
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        first = runs(sorted_h)
        many = np.diff(np.append(first, len(h))) > 1
        order = order[np.repeat(many, np.diff(np.append(first, len(h))))] if len(first) else order
        h, cls, n, left = h[order], cls[order], n[order], left[order]
        order = np.lexsort((cls, h))
        h, cls, n, left = h[order], cls[order], n[order], left[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
        h, cls, n, left = h[fresh], cls[fresh], n[fresh], left[fresh]
        first = runs(h)
        size = np.diff(np.append(first, len(h)))
        keep = np.repeat(size > 1, size) if len(first) else np.zeros(0, bool)
        if keep.any():
            yield from packed(bucket(h[keep], parts), [h[keep], cls[keep], n[keep], left[keep]])

    return docs.mapInArrow(emit, PACKED).repartitionById(parts, "pid").mapInArrow(merge, PACKED)


PAIRS = "a long, b long"


def _fits(a: np.ndarray, b: np.ndarray, left_a: np.ndarray, left_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes and what is left from the shared shingle on allow a link."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    return (den * np.minimum(a, b) >= num * np.maximum(a, b)) & (np.minimum(left_a, left_b) >= overlap(a, b, num, den))


def first_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """For each class the partner it meets in most lists, among the lists' first members, sizes permitting.

    One pair for each class at most: enough to bring a group of near copies
    together, whatever its size.  Ties go to the smaller class.
    """

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, cls, n, left = unpacked([batch], LISTS)
            first = runs(h)
            size = np.diff(np.append(first, len(h)))
            centre = np.repeat(first, size)
            ok = (np.arange(len(h)) != centre) & _fits(n, n[centre], left, left[centre], num, den)
            a, b = cls[centre[ok]].view(np.int64), cls[ok].view(np.int64)
            order = np.lexsort((a, b))
            a, b = a[order], b[order]
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.flatnonzero(fresh)
            met = np.diff(np.append(at, len(a)))
            for s in range(0, len(at), 100_000):
                e = slice(s, s + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(a[at[e]]), pa.array(b[at[e]]), pa.array(met[e], pa.int64())], ["a", "b", "met"])

    met = lists.mapInArrow(star, PAIRS + ", met long").groupBy("a", "b").agg(F.sum("met").alias("met"))
    best = met.groupBy("b").agg(F.max(F.struct("met", (-F.col("a").cast("decimal(20,0)")).alias("low"), "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class Labels:
    """Component labels of classes, mapped; a class without one is its own."""

    def __init__(self, folder: str, parts: int):
        self.parts = parts
        pids = [int(x[:8]) for x in array_names(folder) if x.endswith(".node")]
        self.files = Lazy(folder, pids, lambda p: (read_array(folder, f"{p:08d}.node", np.uint64), read_array(folder, f"{p:08d}.label", np.uint64)))

    def of(self, cls: np.ndarray) -> np.ndarray:
        key = mix(cls)
        order = np.argsort(key)
        sorted_key = key[order]
        pid = bucket(sorted_key, self.parts)
        out = cls.copy()
        first = runs(pid)
        for s, e in zip(first, np.append(first[1:], len(pid))):
            if (file := self.files.get(int(pid[s]))) is not None:
                at = np.minimum(np.searchsorted(file[0], sorted_key[s:e]), len(file[0]) - 1)
                hit = file[0][at] == sorted_key[s:e]
                out[order[s:e][hit]] = file[1][at[hit]]
        return out


def _by_key(keys: DataFrame, columns: list[str], parts: int, write, mixed: bool = True) -> int:
    """Bring long columns to the partition of the first one's (mixed) bits, sorted, and hand them to ``write(pid, arrays)``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                arrays = [b.column(c).to_numpy().view(np.uint64) for c in columns]
                arrays[0] = mix(arrays[0]) if mixed else arrays[0]
                yield from packed(bucket(arrays[0], parts), arrays)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = unpacked(batches, [np.uint64] * len(columns))
        if len(arrays[0]):
            order = np.argsort(arrays[0])
            arrays = [a[order] for a in arrays]
            write(int(bucket(arrays[0][:1], parts)[0]), arrays)
        yield pa.RecordBatch.from_arrays([pa.array([len(arrays[0])], pa.int64())], ["n"])

    return keys.select(*columns).mapInArrow(deal, PACKED).repartitionById(parts, "pid").mapInArrow(store, "n long").agg(F.sum("n")).first()[0] or 0


def write_labels(labels: DataFrame, folder: str, parts: int) -> None:
    def write(pid: int, arrays: list[np.ndarray]) -> None:
        write_array(folder, f"{pid:08d}.label", arrays[1])
        write_array(folder, f"{pid:08d}.node", arrays[0])

    _by_key(labels, ["node", "label"], parts, write)


def write_sets(docs: DataFrame, k: int, reps: DataFrame, folder: str, work: Workspace, name: str, parts: int) -> None:
    """Sorted shingle arrays of the documents in ``reps``, by class, as files that workers map."""
    wanted = work.folder(name)
    count = _by_key(reps, ["doc_id"], parts, lambda pid, arrays: write_array(wanted, f"{pid:08d}", arrays[0]))
    for low, high in slices(wanted, count, parts):

        def take(batches: Iterator[pa.RecordBatch], low=low, high=high) -> Iterator[pa.RecordBatch]:
            files = AnchorFiles(wanted, parts, low, high)
            for chunk in chunks(batches):
                hit = files.has(mix(chunk.column("doc_id").view(np.uint64)))
                if not hit.any():
                    continue
                rows = np.flatnonzero(hit)
                part = Chunk([b for b in chunk.table.take(pa.array(rows)).to_batches()])
                s = ShingleSets(part, k)
                at = np.flatnonzero(s.stands)
                key = mix(s.cls[at])
                pid = bucket(key, parts)
                for p in np.unique(pid):
                    mine = pid == p
                    size = s.n[at[mine]]
                    blob = np.uint32(len(size)).tobytes() + key[mine].tobytes() + size.astype(np.uint32).tobytes() + s.hash[np.repeat(s.first[at[mine]], size) + spread(size)].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([blob], pa.binary())], ["pid", "blob"])

        def store(batches: Iterator[pa.RecordBatch], low=low) -> Iterator[pa.RecordBatch]:
            keys, sizes, data = [], [], []
            for b in batches:
                for x in b.column("blob"):
                    raw = x.as_buffer()
                    n = int(np.frombuffer(raw, np.uint32, 1)[0])
                    keys.append(np.frombuffer(raw, np.uint64, n, 4))
                    sizes.append(np.frombuffer(raw, np.uint32, n, 4 + 8 * n))
                    data.append(np.frombuffer(raw, np.uint64, -1, 4 + 12 * n))
            if keys:
                key, size = np.concatenate(keys), np.concatenate(sizes).astype(np.int64)
                at = np.cumsum(size) - size
                key, one = np.unique(key, return_index=True)
                pid = int(bucket(key[:1], parts)[0])
                write_array(folder, f"{pid:08d}.{low:08d}.data", np.concatenate(data))
                write_array(folder, f"{pid:08d}.{low:08d}.span", np.column_stack([at[one], size[one]]).astype(np.int64).ravel())
                write_array(folder, f"{pid:08d}.{low:08d}.key", key)
            yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64())], ["n"])

        docs.mapInArrow(take, PACKED).repartitionById(parts, "pid").mapInArrow(store, "n long").agg(F.sum("n")).first()
    work.drop(name)


class SetFiles:
    """Sorted shingle arrays by class, mapped."""

    def __init__(self, folders: list[str], parts: int):
        self.parts = parts
        names: dict[int, list] = {}
        for folder in folders:
            for x in array_names(folder):
                if x.endswith(".key"):
                    names.setdefault(int(x[:8]), []).append((folder, x[:-4]))
        self.files = Lazy(folders[0], names, lambda p: [(read_array(f, f"{x}.key", np.uint64), read_array(f, f"{x}.span", np.int64).reshape(-1, 2), read_array(f, f"{x}.data", np.uint64)) for f, x in names[p]])

    def load(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of some classes, one after the other, and where each begins."""
        key = mix(classes)
        order = np.argsort(key)
        pid = bucket(key[order], self.parts)
        found: list = [None] * len(classes)
        first = runs(pid)
        for s, e in zip(first, np.append(first[1:], len(pid))):
            for keys, spans, held in self.files.get(int(pid[s])) or ():
                at = np.minimum(np.searchsorted(keys, key[order[s:e]]), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == key[order[s:e]])
                for i, (lo, size) in zip(order[s:e][hit], spans[at[hit]]):
                    found[i] = held[lo : lo + size]
        if any(x is None for x in found):
            raise KeyError("a class without its set")
        return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])


def verify(pairs: DataFrame, folders: list[str], num: int, den: int, parts: int) -> DataFrame:
    """The pairs that link, found by binary probes of the smaller set in the larger."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = SetFiles(folders, parts)
        for b in batches:
            a, c = b.column("a").to_numpy().view(np.uint64), b.column("b").to_numpy().view(np.uint64)
            if not len(a):
                continue
            order = np.lexsort((c, a))
            a, c = a[order], c[order]
            classes, place = np.unique(np.concatenate([a, c]), return_inverse=True)
            data, first = sets.load(classes)
            ok = _probed(place[: len(a)], place[len(a) :], data, first, num, den)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok].view(np.int64)), pa.array(c[ok].view(np.int64))], ["a", "b"])

    return pairs.mapInArrow(probe, PAIRS)


#: List, class, its size, shingles left, component, and which of two blocks (1, 2; 0: all are compared).
UNITS = [np.uint64, np.uint64, np.uint32, np.uint32, np.uint64, np.uint8]


def _alive(h: np.ndarray, n: np.ndarray, left: np.ndarray, label: np.ndarray, num: int, den: int) -> np.ndarray:
    """Members of lists of several components that can be one of a linked pair there."""
    first = runs(h)
    size = np.diff(np.append(first, len(h)))
    n = n.astype(np.int64)
    # the smaller of a pair has enough left for a partner of its own size
    base = left >= overlap(n, n, num, den)
    least = np.minimum.reduceat(np.where(base, n, 1 << 60), first)
    most = np.maximum.reduceat(np.where(base, n, -1), first)
    keep = (base | (n > np.repeat(least, size))) & (num * n <= den * np.repeat(most, size))
    keep &= np.repeat(np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first), size)
    return np.flatnonzero(keep)


def units(lists: DataFrame, num: int, den: int, labels: str, parts: int) -> DataFrame:
    """Packed rows of what is left to compare: runs of small lists, and blocks of long ones by size."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Labels(labels, parts)

        def row(at: np.ndarray, side: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch:
            key = mix(np.array([len(at)], np.uint64) + arrays[0][at[0]] + mix(arrays[1][at[-1]] + arrays[1][at[0]]))
            return pa.RecordBatch.from_arrays([pa.array(bucket(key, parts), pa.int32()), pa.array([encode([*(a[at] for a in arrays), side])], pa.binary())], ["pid", "blob"])

        for batch in batches:
            h, cls, n, left = unpacked([batch], LISTS)
            if not len(h):
                continue
            label = known.of(cls)
            for _ in range(2):  # a list may hold one component only once others have left
                alive = _alive(h, n, left, label, num, den)
                h, cls, n, left, label = (x[alive] for x in (h, cls, n, left, label))
                if not len(h):
                    break
            if not len(h):
                continue
            order = np.lexsort((cls, n, h))
            arrays = [x[order] for x in (h, cls, n, left, label)]
            h, n = arrays[0], arrays[2].astype(np.int64)
            first = runs(h)
            ends = np.append(first[1:], len(h))
            weight = np.add.reduceat(n, first)
            whole = (ends - first <= BLOCK) & (weight <= BLOCK_SHINGLES)
            # small lists, as many in a row as its shingles allow
            place = (np.cumsum(np.where(whole, weight, 0)) - 1) // BLOCK_SHINGLES
            at = np.flatnonzero(np.repeat(whole, ends - first))
            of = np.repeat(place, ends - first)[at]
            cuts = runs(of)
            for s, e in zip(cuts, np.append(cuts[1:], len(at))):
                yield row(at[s:e], np.zeros(e - s, np.uint8), arrays)
            for s, e in zip(first[~whole], ends[~whole]):
                total = np.cumsum(n[s:e]) - 1
                block = np.maximum.accumulate(np.maximum(total // BLOCK_SHINGLES, 0)) * (e - s) + np.arange(e - s) // BLOCK
                edges = s + np.append(runs(block), e - s)
                for i in range(len(edges) - 1):
                    one = np.arange(edges[i], edges[i + 1])
                    if len(one) > 1:
                        yield row(one, np.zeros(len(one), np.uint8), arrays)
                    for j in range(i + 1, len(edges) - 1):
                        if num * n[edges[j]] > den * n[one[-1]]:
                            break
                        other = np.arange(edges[j], edges[j + 1])
                        yield row(np.concatenate([one, other]), np.repeat(np.array([1, 2], np.uint8), [len(one), len(other)]), arrays)

    return lists.mapInArrow(cut, PACKED)


class Joined:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.up[a], self.up[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))
            while ((higher := self.up[self.up]) != self.up).any():
                self.up = higher


def _probed(a: np.ndarray, b: np.ndarray, data: np.ndarray, first: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of arrays (``first[k]`` to ``first[k + 1]`` of data) link, by binary probes; pairs are sorted by a."""
    n = np.diff(first)
    ok = np.zeros(len(a), bool)
    starts = runs(a)
    for s, e in zip(starts, np.append(starts[1:], len(a))):
        mine = data[first[a[s]] : first[a[s] + 1]]
        for lo in range(s, e, 512):  # all partners of one class by one probe of its sorted array
            others = b[lo : min(e, lo + 512)]
            probes = data[np.repeat(first[others], n[others]) + spread(n[others])]
            at = np.minimum(np.searchsorted(mine, probes), len(mine) - 1)
            shared = np.add.reduceat(mine[at] == probes, np.cumsum(n[others]) - n[others], dtype=np.int64)
            ok[lo : lo + len(others)] = linked(shared, len(mine), n[others], num, den)
    return ok


def _counted(left: np.ndarray, right: np.ndarray, data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shared shingles of each member of ``left`` with each of ``right``.

    Short lists are merged by adding one for each pair that meets there; the
    long ones are probed for all pairs at once, as a product of memberships.
    """
    both = np.concatenate([left, right])
    n = np.diff(first)[both]
    code = np.unique(data[np.repeat(first[both], n) + spread(n)], return_inverse=True)[1].ravel()
    order = np.argsort(code, kind="stable")
    member = np.repeat(np.arange(len(both)), n)[order]
    start = runs(code[order])
    end = np.append(start[1:], len(order))
    out = np.zeros((len(left), len(right)), np.float32 if n.max() < 1 << 24 else np.float64)
    long = end - start > max(8, len(both) // LONG_SHARE)
    for s, e in zip(start[~long & (end - start > 1)], end[~long & (end - start > 1)]):
        cut = s + np.searchsorted(member[s:e], len(left))
        if s < cut < e:
            out[member[s:cut, None], member[cut:e] - len(left)] += 1
    for k in range(0, int(long.sum()), 2048):
        s, e = start[long][k : k + 2048], end[long][k : k + 2048]
        has = np.zeros((len(both), len(s)), out.dtype)
        has[member[np.repeat(s, e - s) + spread(e - s)], np.repeat(np.arange(len(s)), e - s)] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out


def unit_links(arrays: list[np.ndarray], sets: SetFiles, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the components that the lists of a row join."""
    unit, cls, n, left, label, side = arrays
    classes, place = np.unique(cls, return_inverse=True)
    names, group = np.unique(label, return_inverse=True)
    data, first = sets.load(classes)
    joined = Joined(len(names))
    of = np.zeros(len(classes), np.int64)
    of[place] = group
    start = runs(unit)
    size = np.diff(np.append(start, len(unit)))
    small = (size <= SMALL) & np.logical_not(np.maximum.reduceat(side, start))
    for s, e in zip(start[~small], (start + size)[~small]):
        two = side[s:e] > 0
        a, b = (place[s:e][side[s:e] == 1], place[s:e][side[s:e] == 2]) if two.all() else (place[s:e], place[s:e])
        if (joined.up[of[place[s:e]]] == joined.up[of[place[s]]]).all():
            continue
        na, nb = np.diff(first)[a][:, None], np.diff(first)[b]
        x, y = np.nonzero(linked(_counted(a, b, data, first), na, nb, num, den))
        joined.join(of[a[x]], of[b[y]])
    at = np.flatnonzero(np.repeat(small, size))
    after = np.repeat(start + size, size)[at] - at - 1  # partners that follow in the list
    total = np.cumsum(after)
    cuts = np.searchsorted(total, np.arange(1_000_000, total[-1] + 1_000_000, 1_000_000)) + 1 if len(at) else []
    low = 0
    for high in cuts:
        mine, reps = at[low:high], after[low:high]
        low = min(high, len(at))
        x = np.repeat(mine, reps)
        y = x + 1 + spread(reps)
        ok = (joined.up[group[x]] != joined.up[group[y]]) & _fits(n[x], n[y], left[x], left[y], num, den)
        x, y = place[x[ok]], place[y[ok]]
        x, y = np.minimum(x, y), np.maximum(x, y)
        pair, met = np.unique(x * len(classes) + y, return_counts=True)
        pair = pair[np.argsort(-met, kind="stable")]  # those that meet most often first: what they join need not be compared
        step = 256
        while len(pair):
            now, pair = np.sort(pair[:step]), pair[step:]
            x, y = now // len(classes), now % len(classes)
            ok = _probed(x, y, data, first, num, den)
            joined.join(of[x[ok]], of[y[ok]])
            pair = pair[joined.up[of[pair // len(classes)]] != joined.up[of[pair % len(classes)]]]
            step = min(2 * step, 1 << 16)
    moved = np.flatnonzero(joined.up != np.arange(len(names)))
    return names[moved], names[joined.up[moved]]


def classes_of(rows: DataFrame) -> DataFrame:
    """The classes (cls) in some rows of units."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                cls = np.unique(decode(blob.as_buffer(), UNITS)[1])
                yield pa.RecordBatch.from_arrays([pa.array(cls.view(np.int64))], ["cls"])

    return rows.mapInArrow(name, "cls long").distinct()


def settle(rows: DataFrame, folders: list[str], num: int, den: int, parts: int) -> DataFrame:
    """Edges between components that some list's members link."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = SetFiles(folders, parts)
        for batch in batches:
            for blob in batch.column("blob"):
                a, b = unit_links(decode(blob.as_buffer(), UNITS), sets, num, den)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return rows.repartitionById(parts, "pid").mapInArrow(join, PAIRS)


def jaccard_components(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Components of the documents under ``den * |A & B| >= num * |A | B|`` on sets of k-word shingles.

    Returns doc_id, n_shingles, component_id (the least id reachable by links,
    itself included), class_id (documents with equal sets share it), component
    (a name for each component: rows that share a least id may be in several;
    null without shingles), and with ``digests`` text_sha256.  Rows that repeat an
    id are linked if their texts are.
    """
    parts = partitions(spark)
    work = Workspace(spark, "shingles")
    docs = texts(docs, id_col, text_col)
    with small_batches(spark):
        sets, frequent = scan(docs, k, work, parts, digests)
        lists = work.table(merge_lists(docs, k, num, den, frequent, parts), "lists")
        classes = sets.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("check").alias("c0"), F.max("check").alias("c1"))
        classes = work.table(classes.select("cls", F.when(F.col("c0") == F.col("c1"), F.col("doc_id")).otherwise(F.raise_error(F.lit("two shingle sets share a 64-bit class id")).cast("long")).alias("doc_id")), "classes")

        def store(ends: DataFrame, name: str) -> str:
            """Write the sets of some classes."""
            folder = work.folder(f"sets-{name}")
            write_sets(docs, k, classes.join(ends, "cls", "left_semi"), folder, work, f"wanted-{name}", parts)
            return folder

        pairs = work.table(first_pairs(lists, num, den), "first")
        met = work.table(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct(), "met")
        folders = [store(met, "first")]
        edges = work.table(verify(pairs, folders, num, den, parts), "edges")
        labels = components(edges, work, "labels")
        write_labels(labels, work.folder("known"), parts)
        rows = work.table(units(lists, num, den, work.folder("known"), parts), "units")
        work.drop("lists", "frequent", "known", "first")
        ends = work.table(classes_of(rows).join(met, "cls", "left_anti"), "ends")
        folders.append(store(ends, "rest"))
        found = work.table(settle(rows, folders, num, den, parts), "found")
        if found.limit(1).count():
            labels = components(edges.unionByName(found), work, "labels-last")
        work.drop("sets-first", "sets-rest", "units", "met", "ends")
        named = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "doc_id", F.coalesce("label", "cls").alias("label"))
        least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        named = named.join(least, "label").select("cls", "label", "component_id")
        out = sets.join(named, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("cls")).alias("class_id"), F.when(F.col("n") > 0, F.col("label")).alias("component"), *([F.lower(F.hex("digest")).alias("text_sha256")] if digests else []))
        out = work.table(ids_back(out, "doc_id", "component_id"), "result")
        work.keep("result")
    return out
