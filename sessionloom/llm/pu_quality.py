"""Quality by positive-unlabelled learning: non-negative unbiased risk from trusted positives and unlabelled web text.

Features are ratios of counts of one text, computed by built-in functions; the model is a sum of steps over each ratio, so
scoring is again one projection. No negative label is used: the risk on negatives is the risk of the unlabelled texts minus
the share that positives explain, kept from falling below zero, with a class prior estimated from the two samples.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import Adam, sigmoid
from .quality_rules import measures
from .text import let, words

#: Rows of the positive and of the unlabelled sample.
POSITIVE_ROWS, UNLABELLED_ROWS = 8000, 16000
FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "stop_words", "repeat_words", "words_per_line", "distinct_words", "capitals",
            "digits", "marks", "bangs", "bars", "repeated_neighbours")


class Model(NamedTuple):
    """Steps per feature: ``weights[k][j]`` counts when feature k is at least ``knots[k][j]``."""

    knots: list[list[float]]
    weights: list[list[float]]
    intercept: float
    prior: float


def features(text: Column) -> Column:
    """Array of FEATURES of one text; a null or empty text has zeros throughout."""
    safe = F.coalesce(text, F.lit(""))

    def size_of(pattern: str) -> Column:
        return F.length(F.regexp_replace(safe, pattern, ""))

    def of(c: Column) -> Column:
        n, lines, chars = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["n_lines"], F.lit(1)), F.greatest(c["word_chars"], F.lit(1))
        own = let(words(text), lambda w: F.struct(
            F.size(F.array_distinct(w)).alias("distinct"),
            F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).alias("same")))
        return let(own, lambda o: F.array(*[x.cast("double") for x in (
            F.log1p(c["n_words"]), c["word_chars"] / n, c["n_symbols"] / n, c["n_dup_lines"] / lines, c["n_stop_words"] / n,
            c["n_repeat_words"] / n, F.log1p(c["n_words"] / lines), o["distinct"] / n, size_of(r"[^\p{Lu}]+") / chars,
            size_of(r"[^\p{Nd}]+") / chars, size_of(r"[^\p{P}]+") / n, size_of("[^!?]+") / n, size_of(r"[^|]+") / n, o["same"] / n)]))

    return let(measures(text), of)


def steps(x: np.ndarray, knots: list[list[float]]) -> np.ndarray:
    """Indicator columns of the steps, feature by feature."""
    return np.concatenate([x[:, k:k + 1] >= np.array(points)[None, :] for k, points in enumerate(knots) if points], axis=1).astype(np.float32)


#: Shares of the positives at whose feature values steps are set; the last ones mark what positives hardly ever reach.
SHARES = (0.001, 0.005, 0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98, 0.995, 0.999)


def choose_knots(p: np.ndarray, u: np.ndarray) -> list[list[float]]:
    """Steps of each feature: at and just above quantiles of the positives, and where unlabelled texts lie outside these."""
    out = []
    for k in range(p.shape[1]):
        inner = np.quantile(p[:, k], SHARES)
        outer = [x for x in (u[u[:, k] < inner[0], k], u[u[:, k] > inner[-1], k]) if len(x)]
        points = np.concatenate([inner, np.nextafter(inner, np.inf), *[np.quantile(x, (0.25, 0.5, 0.75)) for x in outer]])
        least = min(p[:, k].min(), u[:, k].min())
        out.append(sorted({float(v) for v in points if v > least}))
    return out


def fit_nonnegative(p: np.ndarray, u: np.ndarray, prior: float, turns: int = 500, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept minimising prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]) with logistic loss.

    Where the bracket falls below zero the step goes against it instead, which undoes overfitting.
    """
    w, b = np.zeros(p.shape[1]), 0.0
    adam = Adam(p.shape[1] + 1, 0.03)

    def mean(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.append(r @ x, r.sum()) / len(x)

    for _ in range(turns):
        fp, fu = p @ w + b, u @ w + b
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        of_negative = mean(u, sigmoid(fu)) - prior * mean(p, sigmoid(fp))
        gradient = prior * mean(p, sigmoid(fp) - 1) + of_negative if negative >= 0 else -of_negative
        move = adam.step(gradient + np.append(ridge * w, 0))
        w, b = w - move[:-1], b - move[-1]
    return w, b


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of U(A) to P(A) over regions A above a score.

    A region cannot hold less of U than the prior times what it holds of P; regions rich in positives come close to that.
    The score separates the halves of the samples that are not used for the ratio.
    """
    w, b = fit_nonnegative(p[::2], u[::2], 0.5, turns=200)
    sp, su = np.sort(p[1::2] @ w + b), np.sort(u[1::2] @ w + b)
    if not len(sp) or not len(su):
        return 0.5
    cuts = np.quantile(sp, np.linspace(0, 0.7, 71))
    share_p = 1 - np.searchsorted(sp, cuts, "left") / len(sp)
    share_u = 1 - np.searchsorted(su, cuts, "left") / len(su)
    slack = np.sqrt(share_u * (1 - share_u) / len(su) + 1e-12)
    return float(np.clip(((share_u - slack) / share_p).min(), 0.05, 0.98))


def fit(p: np.ndarray, u: np.ndarray) -> Model:
    """Model from the feature rows of positives and unlabelled texts; without positives every text scores the prior 0.5."""
    if not len(p) or not len(u):
        return Model([[] for _ in FEATURES], [[] for _ in FEATURES], 0.0, 0.5)
    knots = choose_knots(p, u)
    if not any(knots):
        return Model(knots, [[] for _ in FEATURES], 0.0, 0.5)
    sp, su = steps(p, knots), steps(u, knots)
    prior = estimate_prior(sp, su)
    w, b = fit_nonnegative(sp, su, prior)
    cuts = np.cumsum([0, *[len(k) for k in knots]])
    return Model(knots, [w[lo:hi].tolist() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)], float(b), prior)


def train(docs: DataFrame, positives: DataFrame, key: str = "doc_id", text: str = "text", usable: Column | None = None,
          positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model:
    """Model from at most ``positive_rows`` trusted documents (keys in ``positives``) and ``unlabelled_rows`` others, drawn by
    hash of the key; ``usable`` restricts the rows that may be drawn."""
    allowed = docs if usable is None else docs.where(usable)
    order = F.xxhash64(F.col(key).cast("string"))
    trusted = positives.select(key).where(F.col(key).isNotNull()).distinct().orderBy(order, key).limit(positive_rows)
    web = allowed.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(F.lit("u"), F.col(key).cast("string")), key).limit(unlabelled_rows)
    drawn = trusted.withColumn("_p", F.lit(1)).unionByName(web.withColumn("_p", F.lit(0)))
    # At most positive_rows + unlabelled_rows ids are broadcast.
    rows = docs.select(key, F.col(text).alias("_t")).join(F.broadcast(drawn), key).select("_p", features(F.col("_t")).alias("x")).collect()
    both = {k: np.array([r["x"] for r in rows if r["_p"] == k], dtype=float).reshape(-1, len(FEATURES)) for k in (0, 1)}
    return fit(both[1], both[0])


def score(text: Column, model: Model) -> Column:
    """Probability of good quality, between 0 and 1, of a whole text; null and empty texts score as texts of zeros."""
    def margin(x: Column) -> Column:
        total = F.lit(model.intercept)
        for k, (points, weights) in enumerate(zip(model.knots, model.weights, strict=True)):
            for point, weight in zip(points, weights, strict=True):
                if abs(weight) > 1e-6:
                    total = total + F.when(F.get(x, F.lit(k)) >= point, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    return let(features(text), margin)
