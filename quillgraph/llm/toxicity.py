"""Toxicity by non-negative learning from positive and unlabelled text.

The positives are confirmed toxic documents.  The unlabelled text is a sample of
all documents that the label table names, confirmed ones included: their labels
are not looked at, so the sample is what the class prior speaks of.  With class
prior p and loss l, the risk of a scorer g is estimated as

    p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)])

The second term estimates the risk on the negatives without negatives; where it
falls below zero, which only overfitting can do, the step instead undoes it
(the non-negative correction).  The scorer is linear over indicator features of
a dictionary chosen on the sample, trained in numpy by full-batch Adam.

Of near copies with the same label one counts (:func:`~.features.without_copies`), in
the sample of positives and in the unlabelled one, so that what is copied often does
not pass for evidence.  The prior speaks of the same rows: the share of positives
among the labelled training rows, times the share of the positives that stays over
the share of the unlabelled text that stays.  A prior that is given is taken as it is.  Rows of the label table without a label count as unlabelled text.  Empty
and null texts have no features and score as the bias alone.  With no positive
or no other text the model knows nothing and scores 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import Linear, Samples, bounded, logistic, one_text, present, score, train, training_ids, without_copies, word_features
from .shared import Workspace, ids_back, ship, small_batches, texts, whole_row


def choose(samples: Samples, positive: np.ndarray, most: int, sure: float = 3.0, margin: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` features that mark positives best, sorted, with their log ratios.

    A feature counts only if its log ratio is over ``margin`` even ``sure``
    standard errors lower: words that a few copies share by chance are not.
    """
    np_, nb = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    names, ratios, weights = [np.zeros(0, np.uint64)], [np.zeros(0)], [np.zeros(0)]
    for at, first, count in samples.ranges():
        a = np.add.reduceat(positive[samples.doc[at]].astype(np.int64), first)
        b = count - a
        ratio = np.log((a + 0.5) / (np_ + 1)) - np.log((b + 0.5) / (nb + 1))
        weight = ratio - sure * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        good = weight > margin
        names.append(samples.feature[at[first[good]]])
        ratios.append(ratio[good])
        weights.append(weight[good])
    names, ratios, weights = np.concatenate(names), np.concatenate(ratios), np.concatenate(weights)
    best = np.sort(np.lexsort((names, -weights))[:most])  # names are in order
    return names[best], ratios[best]


class Risk:
    """The estimated risk of weights (the last is the bias) and its slope.

    Document i has the features ``index[first[i]:first[i + 1]]``, scaled by
    ``value``; ``positive`` marks the confirmed ones, the others are unlabelled.
    """

    def __init__(self, first: np.ndarray, index: np.ndarray, value: np.ndarray, positive: np.ndarray, prior: float, decay: float):
        self.index, self.value, self.positive, self.prior, self.decay = index, value, positive, prior, decay
        self.n = len(positive)
        self.doc = np.repeat(np.arange(self.n), np.diff(first))
        self.share = np.where(positive, 1 / max(1, positive.sum()), 1 / max(1, (~positive).sum()))

    def margins(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=(w[:-1] * self.value)[self.index], minlength=self.n) + w[-1]

    def terms(self, w: np.ndarray) -> tuple[float, float]:
        """Risk on the positives, and the estimate of the risk on the negatives; sigmoid loss: l(g) = 1 - s, l(-g) = s."""
        s = logistic(self.margins(w)) * self.share
        pos, unl = s[self.positive].sum(), s[~self.positive].sum()
        return self.prior * (1 - pos), unl - self.prior * pos

    def slope(self, w: np.ndarray) -> np.ndarray:
        """Of both terms where the second is not negative; else of what undoes the second."""
        s = logistic(self.margins(w))
        per = s * (1 - s) * self.share
        if self.terms(w)[1] >= 0:
            per[self.positive] *= -2 * self.prior
        else:
            per = np.where(self.positive, self.prior * per, -per)
        out = np.append(np.bincount(self.index, weights=per[self.doc], minlength=len(w) - 1) * self.value, per.sum())
        out[:-1] += self.decay * w[:-1]
        return out


def nnpu(risk: Risk, dims: int, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Weights and bias of least risk by Adam."""
    w = np.zeros(dims + 1)
    w[-1] = -1.0
    m, v = np.zeros(dims + 1), np.zeros(dims + 1)
    for t in range(1, steps + 1):
        grad = risk.slope(w)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def bound_prior(p: float) -> float:
    return min(0.9, max(1e-3, p))


def prior_of_kept(prior: float, before: np.ndarray, after: np.ndarray) -> float:
    """The prior over the rows that are left of a sample, given both samples' labels (1: positive, 0: unlabelled)."""
    left = [(after == x).sum() / max(1, (before == x).sum()) for x in (1, 0)]
    return bound_prior(prior * left[0] / left[1]) if left[0] and left[1] else prior


def fit_toxicity(prior: float, most_features: int, given: bool = False, decay: float = 1e-4):
    def fit(samples: Samples) -> bytes:
        before = samples.label
        samples = without_copies(samples)
        prior_here = prior if given else prior_of_kept(prior, before, samples.label)
        positive = samples.label == 1
        hashes, ratio = choose(samples, positive, most_features)
        if not positive.any() or positive.all() or not len(hashes):
            return Linear(hashes[:0], np.zeros(0), -500.0).dump()
        doc, index = present(hashes, samples)
        first = np.searchsorted(doc, np.arange(len(positive) + 1))
        # features that tell little start with little say
        value = np.abs(ratio)
        w = nnpu(Risk(first, index, value, positive, prior_here, decay), len(hashes))
        return Linear(hashes, w[:-1] * value, float(w[-1])).dump()

    return fit


def toxicity(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    most_positive: int = 4000,
    most_unlabelled: int = 12000,
    most_features: int = 20000,
    prior: float | None = None,
    text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """Score every document; labels (doc_id, toxic) count only where crc32(doc_id) % 5 is not 0.

    ``most_positive`` and ``most_unlabelled`` bound the rows of ``labels`` that
    train the model, ``most_features`` its dictionary; all documents are scored.
    Returns doc_id, held_out, score, predicted (1 at 0.5 or more), one row per row;
    with ``carry`` also ``row``, the columns of docs as a struct.
    """
    ship(spark)
    names, docs = docs.columns, texts(docs, text_col=text_col, carry=carry)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(training_ids())
    given = prior is not None
    if prior is None:
        share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
        prior = bound_prior(share or 0.0)
    ids = bounded(known.where("toxic = 1").select("doc_id"), most_positive, "p").withColumn("label", F.lit(1))
    ids = ids.unionByName(bounded(known.select("doc_id"), most_unlabelled, "u").withColumn("label", F.lit(0)))
    with small_batches(spark):
        work = Workspace(spark, "toxicity")
        ids = work.table(ids, "sample")
        text = one_text(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ids.select("doc_id").distinct()).select("doc_id", "text")
        model = train(text.join(F.broadcast(ids), "doc_id"), word_features, fit_toxicity(prior, most_features, given))
        out = score(spark, docs, model, word_features)
        out = out.select("doc_id", (~training_ids()).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), *([whole_row(names, text_col)] if carry else []))
        out = work.table(ids_back(out), "result")
        work.keep("result")
    return out
