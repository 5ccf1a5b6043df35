"""Quality by naive Bayes support vectors.

Indicator n-grams are scaled by the log ratio of their smoothed class counts;
a linear hinge-loss model over them is fitted by dual coordinate descent, and
its weights are interpolated with their mean magnitude, as the method asks.
A logistic curve fitted to the training margins turns margins into scores.

Empty and null texts have no n-grams and score as the bias alone.  With one
class only, every score is 1 or 0 accordingly; without labels it is 0.5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import Linear, Samples, bounded, logistic, ngram_features, one_text, present, score, train, training_ids
from .shared import Workspace, ids_back, ship, small_batches, texts


def log_count_ratios(samples: Samples, positive: np.ndarray, most: int, alpha: float, least_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of ``least_docs`` documents or more, the most frequent ``most`` of them, with log((p / |p|) / (q / |q|))."""
    names, p, total = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, first, count in samples.ranges():
        kept = count >= least_docs
        names.append(samples.feature[at[first[kept]]])
        p.append(np.add.reduceat(positive[samples.doc[at]].astype(np.int64), first)[kept])
        total.append(count[kept])
    names, p, total = np.concatenate(names), np.concatenate(p), np.concatenate(total)
    kept = np.sort(np.lexsort((names, -total))[:most])  # names are in order
    p, q = p[kept] + alpha, (total - p)[kept] + alpha
    # counts are of documents with the feature; classes are normalised by their documents
    a, b = max(1, positive.sum()), max(1, (~positive).sum())
    return names[kept], np.log(p / (a + 2 * alpha)) - np.log(q / (b + 2 * alpha))


def dual_descent(first: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, dims: int, cost: float, rounds: int, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of the hinge-loss support vector machine, one dual variable at a time."""
    w = np.zeros(dims + 1)
    alpha = np.zeros(len(y))
    norm = np.bincount(np.repeat(np.arange(len(y)), np.diff(first)), weights=value**2, minlength=len(y)) + 1
    pick = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in pick.permutation(len(y)):
            j, x = index[first[i] : first[i + 1]], value[first[i] : first[i + 1]]
            slope = y[i] * (w[j] @ x + w[-1]) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost)
            if change := (new - alpha[i]) * y[i]:
                w[j] += change * x
                w[-1] += change
                alpha[i] = new
                moved = max(moved, abs(change))
        if moved < 1e-3 * cost:
            break
    return w


def curve(margin: np.ndarray, positive: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve for the margins, by Newton's method with smoothed targets."""
    a, b = positive.sum(), (~positive).sum()
    target = np.where(positive, (a + 1) / (a + 2), 1 / (b + 2))
    s, o = 1.0, 0.0
    for _ in range(steps):
        p = logistic(s * margin + o)
        g = np.array([((p - target) * margin).sum() + 1e-3 * (s - 1), (p - target).sum() + 1e-3 * o])
        h = p * (1 - p) + 1e-9
        hess = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        s, o = s - step[0], o - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(s), float(o)


def fit_quality(most_features: int, cost: float, mixing: float, rounds: int, least_docs: int = 3):
    def fit(samples: Samples) -> bytes:
        positive = samples.label == 1
        if not len(positive) or positive.all() or not positive.any():
            sure = 0.0 if not len(positive) else 500.0 if positive.all() else -500.0
            return Linear(np.zeros(0, np.uint64), np.zeros(0), sure).dump()
        hashes, ratio = log_count_ratios(samples, positive, most_features, 1.0, least_docs)
        doc, index = present(hashes, samples)
        first = np.searchsorted(doc, np.arange(len(positive) + 1))
        y = np.where(positive, 1.0, -1.0)
        w = dual_descent(first, index, ratio[index], y, len(hashes), cost, rounds)
        level = np.abs(w[:-1]).mean() if len(hashes) else 0.0
        weights = ((1 - mixing) * level + mixing * w[:-1]) * ratio
        margin = np.bincount(doc, weights=weights[index], minlength=len(y)) + mixing * w[-1]
        slope, offset = curve(margin, positive)
        if slope <= 0:
            slope, offset = 1.0, 0.0
        return Linear(hashes, weights, mixing * float(w[-1]), slope, offset).dump()

    return fit


def quality(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    most_labelled: int = 8000,
    most_features: int = 200_000,
    cost: float = 0.1,
    mixing: float = 0.75,
    rounds: int = 15,
    least_docs: int = 3,
    threshold: float = 0.3,
    text_col: str = "text",
) -> DataFrame:
    """Score every document; labels (doc_id, quality) count only where crc32(doc_id) % 5 is not 0.

    ``most_labelled`` bounds the labelled documents that train the model,
    ``most_features`` its dictionary: the n-grams that most of those have, and
    ``least_docs`` of them at least.  All documents are scored.  Returns doc_id, held_out, score, predicted (1 at ``threshold``
    or more), one row per row.
    """
    ship(spark)
    docs = texts(docs, text_col=text_col)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("label")).where(training_ids())
    with small_batches(spark):
        work = Workspace(spark, "quality")
        model = train(one_text(docs, bounded(known, most_labelled, "q")), ngram_features, fit_quality(most_features, cost, mixing, rounds, least_docs))
        out = score(spark, docs, model, ngram_features)
        out = out.select("doc_id", (~training_ids()).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
        out = work.table(ids_back(out), "result")
        work.keep("result")
    return out
