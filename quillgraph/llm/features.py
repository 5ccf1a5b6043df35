"""Hashed text features for the linear classifiers: extraction, choice and lookup.

A feature is a 64-bit hash.  Models hold a bounded dictionary of hashes chosen
on their training sample, so a score never depends on hash buckets shared with
unseen words.  Features are indicators: a document has one or not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import LOWER, NEVER, Chunk, Tokens, chunks, decode, encode, give_back, grams, mix, powers, splitmix, _BYTE, _Q, _QI
from .shared import carried_type

#: Text bytes at once: a byte of text costs some hundred bytes of features.
SCORED_BYTES = 1 << 20
#: Everything ASCII that is no letter or digit separates words.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _tag(h: np.ndarray, kind: int) -> np.ndarray:
    return mix(h ^ np.uint64(splitmix(9000 + kind)))


def _edges(tokens: Tokens, chunk: Chunk, table: np.ndarray, size: int, head: bool) -> tuple[np.ndarray, np.ndarray]:
    """Words longer than ``size`` bytes, and the hash of their first or last ``size`` bytes."""
    n = len(chunk.data)
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[chunk.data] * powers(_Q, n))])
    which = np.flatnonzero(tokens.end - tokens.start > size)
    start = tokens.start[which] if head else tokens.end[which] - size
    return which, (s[start + size] - s[start]) * powers(_QI, n)[start]


def word_features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Words without case and punctuation, and their beginnings of 3 to 6 bytes: (document, feature), with repeats."""
    tokens = Tokens(chunk, lower=True, space=PUNCTUATION)
    docs, found = [tokens.doc], [_tag(tokens.hash, 0)]
    if len(tokens):
        for size in (3, 4, 5, 6):
            which, h = _edges(tokens, chunk, _BYTE[LOWER], size, head=True)
            docs.append(tokens.doc[which])
            found.append(_tag(h, size))
    return np.concatenate(docs), np.concatenate(found)


def _classes() -> np.ndarray:
    """Byte classes: small, capital, digit, other bytes as they are."""
    out = np.arange(256)
    for b in range(256):
        c = chr(b)
        out[b] = 0 if b >= 128 or c.islower() else 1 if c.isupper() else 2 if c.isdigit() else b
    return _BYTE[out]


_CLASS = _classes()


def ngram_features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Word n-grams of order 1 and 2, and n-grams of word shapes of order 1 to 3: (document, feature), with repeats.

    A shape is the classes of a word's first byte and last three bytes, and
    whether the word repeats the one before it.
    """
    tokens = Tokens(chunk, lower=False)
    n, doc = len(tokens), tokens.doc
    if not n:
        return doc, tokens.hash
    first = _CLASS[chunk.data[tokens.start]] * np.uint64(3)
    shape = first.copy()
    for back in (1, 2, 3):
        at = tokens.end - back
        ok = at >= tokens.start
        shape[ok] += _CLASS[chunk.data[at[ok]]] * np.uint64(_Q >> back | 1)
    again = np.zeros(n, bool)
    again[1:] = (tokens.hash[1:] == tokens.hash[:-1]) & (doc[1:] == doc[:-1])
    shape = mix(shape + again.astype(np.uint64))
    docs, found = [], []
    for kind, h, orders in ((10, tokens.hash, (1, 2)), (20, shape, (1, 2, 3))):
        for k in orders:
            if n >= k:
                ok = doc[: n - k + 1] == doc[k - 1 :]
                docs.append(doc[: n - k + 1][ok])
                found.append(_tag(grams(h, k)[ok] if k > 1 else h[ok], kind + k))
    return np.concatenate(docs), np.concatenate(found)


Extract = Callable[[Chunk], tuple[np.ndarray, np.ndarray]]


def distinct(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    return doc[fresh], feature[fresh]


class Dictionary:
    """Sorted feature hashes; finds which features of a chunk are in it."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.likely = np.zeros(1 << 20, bool)
        self.likely[hashes >> np.uint64(44)] = True

    def find(self, doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, index in the dictionary) of those that are in it."""
        ok = self.likely[feature >> np.uint64(44)]
        doc, feature = doc[ok], feature[ok]
        if not len(self.hashes) or not len(doc):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, feature), len(self.hashes) - 1)
        hit = self.hashes[at] == feature
        key = np.unique(doc[hit].astype(np.int64) * len(self.hashes) + at[hit])
        return key // len(self.hashes), key % len(self.hashes)


def present(hashes: np.ndarray, samples: Samples) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted hashes each training document has: (document, index), by document."""
    dictionary, docs, found = Dictionary(hashes), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(0, len(samples.feature), STEP):
        d, at = dictionary.find(samples.doc[s : s + STEP], samples.feature[s : s + STEP])
        docs.append(d)
        found.append(at)
    return np.concatenate(docs), np.concatenate(found)


#: Features that are handled at once.
STEP = 1 << 20


class Samples:
    """Training documents: features of document i are ``feature[first[i]:first[i + 1]]``."""

    def __init__(self, label: np.ndarray, first: np.ndarray, feature: np.ndarray):
        self.label, self.first, self.feature = label, first, feature
        self.doc = np.repeat(np.arange(len(label), dtype=np.int32), np.diff(first))

    def ranges(self, parts: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The features in order, a range of hashes at a time: their places among all, and where each feature's run begins and how long it is.

        Sorting them at once would take several times the memory of the sample.
        """
        top = (self.feature >> np.uint64(56)).astype(np.uint8)
        cuts = [256 * k // parts for k in range(parts + 1)]
        for low, high in zip(cuts[:-1], cuts[1:]):
            at = np.flatnonzero((top >= low) & (top < high))
            at = at[np.argsort(self.feature[at], kind="stable")]
            if len(at):
                f = self.feature[at]
                first = np.concatenate([[0], np.flatnonzero(f[1:] != f[:-1]) + 1])
                yield at, first, np.diff(np.append(first, len(f)))


def without_copies(samples: Samples, common: float = 0.05, bands: int = 4, size: int = 4) -> Samples:
    """One of each group of near copies with the same label, so that copies don't pass for evidence.

    Near copies are documents that agree on all ``size`` min-hashes of one of
    the ``bands``, over features that few documents have.
    """
    n = len(samples.label)
    few = np.zeros(len(samples.feature), bool)
    for at, _, count in samples.ranges():
        few[at] = np.repeat(count <= max(2, common * n), count)
    least = np.full((bands * size, n), NEVER, np.uint64)
    for s in range(0, len(samples.feature), STEP):
        mine = few[s : s + STEP]
        doc, feature = samples.doc[s : s + STEP][mine], samples.feature[s : s + STEP][mine]
        if not len(doc):
            continue
        at = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1])
        for k in range(bands * size):
            low = np.minimum.reduceat(mix(feature ^ np.uint64(splitmix(100 * (k // size) + k % size))), at)
            least[k, doc[at]] = np.minimum(least[k, doc[at]], low)
    has = np.flatnonzero(least[0] != NEVER)
    keep = np.ones(n, bool)
    for band in range(bands):
        key = samples.label[has].astype(np.uint64)
        for j in range(size):
            key = mix(key + least[band * size + j, has])
        one = np.zeros(n, bool)
        one[has[np.unique(key, return_index=True)[1]]] = True
        keep[has] &= one[has]
    give_back()
    rows = np.flatnonzero(keep)
    size_of = np.diff(samples.first)[rows]
    return Samples(samples.label[rows], np.concatenate([[0], np.cumsum(size_of)]), samples.feature[keep[samples.doc]])


def train(samples: DataFrame, extract: Extract, fit: Callable[[Samples], bytes]) -> bytes:
    """Fit on a bounded sample (columns doc_id, label, text) in one task and bring back the model.

    Rows are taken in the order of doc_id, label, text: the model is a function of the set of rows.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=SCORED_BYTES):
            doc, feature = distinct(*extract(chunk))
            cuts = np.searchsorted(doc, np.arange(chunk.n + 1))
            blobs = [feature[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(chunk.column("doc_id")), pa.array(chunk.column("label")), pa.array(blobs, pa.binary())], ["doc_id", "label", "blob"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Samples:
        ids, label, blobs = [], [], []
        for b in batches:
            ids += b.column("doc_id").to_pylist()
            label += b.column("label").to_pylist()
            blobs += [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("blob")]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], label[i]))  # each at most once
        first = np.concatenate([[0], np.cumsum([len(blobs[i]) for i in order])]).astype(np.int64)
        return Samples(np.array([label[i] for i in order], np.int64), first, np.concatenate([*(blobs[i] for i in order), np.zeros(0, np.uint64)]))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit(gathered(batches))
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    rows = samples.select("doc_id", F.col("label").cast("long"), "text").mapInArrow(features, "doc_id long, label long, blob binary")
    return bytes(rows.repartitionById(1, F.lit(0)).mapInArrow(learn, "model binary").first()[0])


def bounded(rows: DataFrame, most: int, salt: str) -> DataFrame:
    """The ``most`` rows of least hash of their doc_id (distinct), or all where there are fewer: a function of the set of ids."""
    n = rows.count()
    if n <= most:
        return rows
    # about twice as many by their hash alone, so that few are put in order
    share = min(1 << 32, int(2 * most / n * (1 << 32)) + 1000)
    key = F.crc32(F.concat(F.lit(salt), F.col("doc_id").cast("string")).cast("binary"))
    return rows.withColumn("key", key).where(F.col("key") < share).orderBy("key", "doc_id").limit(most).drop("key")


def one_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The chosen documents (a bounded number) with their other columns and a text each: of rows that repeat an id the least."""
    least = docs.join(F.broadcast(ids.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return least.join(F.broadcast(ids), "doc_id")


class Linear:
    """score = logistic(scale * (sum of the weights of the features present) + offset)."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float, scale: float = 1.0, offset: float = 0.0):
        self.dictionary, self.weights, self.bias, self.scale, self.offset = Dictionary(hashes), weights, bias, scale, offset

    def dump(self) -> bytes:
        return np.array([self.bias, self.scale, self.offset]).tobytes() + encode([self.dictionary.hashes, self.weights.astype(np.float64)])

    @classmethod
    def load(cls, blob: bytes) -> Linear:
        bias, scale, offset = np.frombuffer(blob, np.float64, 3).tolist()
        hashes, weights = decode(blob[24:], [np.uint64, np.float64])
        return cls(hashes, weights, bias, scale, offset)

    def margins(self, n: int, doc: np.ndarray, feature: np.ndarray) -> np.ndarray:
        d, at = self.dictionary.find(doc, feature)
        return np.bincount(d, weights=self.weights[at], minlength=n) + self.bias

    def scores(self, chunk: Chunk, extract: Extract) -> np.ndarray:
        doc, feature = extract(chunk)
        return logistic(self.scale * self.margins(chunk.n, doc, feature) + self.offset)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(spark: SparkSession, docs: DataFrame, model: bytes, extract: Extract) -> DataFrame:
    """(doc_id, score) for every row, with what is carried; the model is a few megabytes at most."""
    sent = spark.sparkContext.broadcast(model)
    carry = ["text", "rest"] if "rest" in docs.columns else []

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linear = Linear.load(sent.value)
        for chunk in chunks(batches, limit=SCORED_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(chunk.column("doc_id")), pa.array(linear.scores(chunk, extract)), *chunk.carried(carry)], ["doc_id", "score", *carry])

    return docs.mapInArrow(step, "doc_id long, score double" + carried_type(docs))


def training_ids(ids: str = "doc_id", out: int = 0) -> Column:
    """Rows that labels may be learnt from: crc32 of the id as text, modulo 5, is not ``out``."""
    return F.crc32(F.col(ids).cast("string").cast("binary")) % 5 != out
