"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posterior labels.

Voters are lexicons and word patterns (whole words, beginnings, endings), the latter found on labelled training rows. Each
votes toxic or abstains. The label model estimates by expectation-maximisation how often each voter fires on toxic and on
clean texts, and from what remains correlated within toxic texts how much of its vote others repeat. Its posteriors train a
logistic regression over many more terms; labelled training rows then only set its scale.

Fitting sees a bounded sample of labelled rows; scoring is one pass over all texts in place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package
from .linear import Rows, fit_scale, fit_soft_logistic, sigmoid
from .text import free_name

#: Voters written down beforehand.
LEXICONS = {
    "insults": "idiot idiots moron morons stupid dumb dumbass imbecile loser losers clown clowns fool fools jerk retard retarded".split(),
    "contempt": "pathetic worthless disgusting useless trash garbage scum filth vermin subhuman lowlife degenerate pig pigs".split(),
    "profanity": "fuck fucking fucked shit shitty bitch bastard asshole bullshit crap damn cunt dick whore slut".split(),
    "threats": "kill murder strangle stab lynch rape behead".split(),
}
#: Labelled rows of each class in the sample, terms given to the classifier, voters in the label model.
SAMPLE_ROWS, TERMS, VOTERS = 4000, 6000, 300
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 500_000


def word_terms(word: str) -> list[int]:
    """Hashed terms of a lower-case word: itself, its beginnings of 4 to 6 letters and its last 4 letters."""
    forms = ["=" + word, *["^" + word[:n] for n in (4, 5, 6) if len(word) >= n]]
    if len(word) >= 4:
        forms.append("$" + word[-4:])
    return [zlib.crc32(f.encode()) for f in forms]


class Model(NamedTuple):
    """Weights by term hash, and the scale of the margin: score = sigmoid(slope * (intercept + weights) + shift)."""

    weights: dict[int, float]
    intercept: float
    slope: float
    shift: float


def in_test(key: Column, buckets: int, held: int) -> Column:
    """Whether a row is held out: crc32 of the key as text, modulo ``buckets``, is ``held``."""
    return F.coalesce(F.crc32(key.cast("string")) % buckets == held, F.lit(False))


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, rate on toxic, rate on clean, share of each voter's own evidence) of binary votes (rows, voters).

    No label enters. Abstaining is no evidence, but a row on which all abstain counts as a vote of its own. Rates are
    re-estimated from posteriors; a voter whose fellow voters fire with it beyond what the class explains counts by the
    inverse of that overlap.
    """
    votes = np.concatenate([votes, ~votes.any(axis=1, keepdims=True)], axis=1).astype(float)
    posterior = np.where(votes[:, -1] > 0, 0.02, 0.9)
    own = np.ones(votes.shape[1])
    for turn in range(rounds):
        on = (posterior @ votes + 0.05) / (posterior.sum() + 0.1)
        off = ((1 - posterior) @ votes + 0.05) / ((1 - posterior).sum() + 0.1)
        if turn in (3, 10):
            centred = (votes - on) * np.sqrt(posterior)[:, None]
            spread = np.sqrt((centred ** 2).sum(axis=0)) + 1e-9
            correlation = np.clip((centred.T @ centred) / np.outer(spread, spread), 0, 1)
            correlation[correlation < 0.4] = 0
            own = 1 / np.maximum(1.0, correlation.sum(axis=0))
        evidence = own * (np.log(on) - np.log(off))
        # Voters are toxic voters and silence a clean one: neither may turn round.
        evidence[:-1] = np.maximum(evidence[:-1], 0)
        evidence[-1] = min(evidence[-1], 0)
        posterior = sigmoid(np.log(prior / (1 - prior)) + votes @ evidence)
    return posterior, on[:-1], off[:-1], own[:-1]


def fit(terms: list[np.ndarray], labels: np.ndarray, prior: float, most_terms: int = TERMS, most_voters: int = VOTERS) -> Model:
    """Model from the term sets and labels of the sample; ``prior`` is the share of toxic rows before sampling.

    Without rows of both classes only the lexicons speak, each word at the same weight.
    """
    lexicon = [{zlib.crc32(("=" + w).encode()) for w in group} for group in LEXICONS.values()]
    if not len(labels) or labels.min() == labels.max():
        return Model({h: 4.0 for group in lexicon for h in group}, -2.0, 1.0, 0.0)
    n1, n0 = float(labels.sum()), float((1 - labels).sum())
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    flat = np.concatenate(terms)
    values = np.sort(flat)
    values = values[np.concatenate([[True], values[1:] != values[:-1]])]
    place = np.searchsorted(values, flat).astype(np.int32)
    owner = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms])
    on, off = np.bincount(place, weights=labels[owner]), np.bincount(place, weights=1 - labels[owner])
    a, b = (on + 0.05) / (n1 + 0.1), (off + 0.05) / (n0 + 0.1)
    # How far a term's rates lie apart, in the two-sample likelihood ratio.
    both = (on + off + 0.1) / (n1 + n0 + 0.2)
    gain = n1 * (a * np.log(a / both) + (1 - a) * np.log((1 - a) / (1 - both))) + n0 * (b * np.log(b / both) + (1 - b) * np.log((1 - b) / (1 - both)))
    # Terms beyond what chance among so many would show.
    eligible = (on + off >= 2) & (gain >= 0.5 * np.log(max(2, int((on + off >= 2).sum()))))
    chosen = np.argsort(np.where(eligible, -gain, np.inf), kind="stable")[:min(most_terms, int(eligible.sum()))]
    rank = np.full(len(values), -1)
    rank[chosen] = np.arange(len(chosen))
    kept = rank[place] >= 0
    column, row_of = rank[place][kept], owner[kept]
    cuts = np.searchsorted(row_of, np.arange(len(terms) + 1))
    rows = Rows([column[lo:hi] for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], len(chosen))
    precise = np.flatnonzero((a[chosen] > 20 * b[chosen]) & (on[chosen] >= 2))[:most_voters]
    number = np.full(len(chosen), -1)
    number[precise] = np.arange(len(precise))
    votes = np.zeros((len(terms), len(precise) + len(lexicon)))
    own = number[rows.index] >= 0
    votes[rows.owner[own], number[rows.index][own]] = 1
    for k, group in enumerate(lexicon):
        hit = np.isin(flat, np.array(sorted(group), dtype=flat.dtype))
        votes[np.unique(owner[hit]), len(precise) + k] = 1
    weight = np.where(labels == 1, prior / n1, (1 - prior) / n0)
    posterior, *_ = label_model(votes, n1 / (n1 + n0))
    w, intercept = fit_soft_logistic(rows, posterior, np.ones(len(labels)))
    slope, shift = fit_scale(rows.times(w) + intercept, labels, weight)
    return Model({int(values[c]): float(x) for c, x in zip(chosen, w, strict=True) if abs(x) > 1e-4}, intercept, slope, shift)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            found = {h for w in set(_WORD.findall((text or "").lower())) for h in word_terms(w)}
            out.append(np.array(sorted(found), dtype=np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.binary())], names=["label", "terms"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model fitted on at most ``sample_rows`` labelled rows of each class, drawn by hash of the key.

    Pass only the labels that may be learned from. Keys and labels that are null are left out.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label")).where("_key is not null and label in (0, 1)")
    counts = dict(known.groupBy("label").count().collect())
    order = F.xxhash64(F.col("_key").cast("string"))
    drawn = [known.where(F.col("label") == k).orderBy(order, "_key").limit(sample_rows) for k in (0, 1)]
    # At most 2 * sample_rows ids are broadcast; the texts stay where they are.
    sample = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(drawn[0].unionByName(drawn[1])), "_key")
    rows = sample.select("label", "text").mapInArrow(_sets, "label int, terms binary").collect()
    sets = [np.frombuffer(r["terms"], dtype=np.uint32) for r in rows]
    total = max(1, sum(counts.values()))
    return fit(sets, np.array([r["label"] for r in rows], dtype=float), counts.get(1, 0) / total)


def scores(model: Model, texts: list[str | None], cache: dict[str, tuple]) -> list[float]:
    """Score of each text; ``cache`` keeps the weighted terms of words seen before and is emptied when full."""
    weights = model.weights
    out = []
    for text in texts:
        if len(cache) > _CACHE:
            cache.clear()
        found: dict[int, float] = {}
        for word in set(_WORD.findall((text or "").lower())):
            terms = cache.get(word)
            if terms is None:
                terms = cache[word] = tuple((h, weights[h]) for h in word_terms(word) if h in weights)
            if terms:
                found.update(terms)
        out.append(model.slope * (model.intercept + sum(found.values())) + model.shift)
    return sigmoid(np.array(out, dtype=float)).tolist()


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of toxicity of the whole text in ``out`` (a free name).

    Null and empty texts have no terms and get the score of none. Repeated rows score alike; other columns pass through.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {out} exists already")
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    body = free_name(docs, "_body")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple] = {}
        for batch in batches:
            names = [n for n in batch.schema.names if n != body]
            values = pa.array(scores(shared.value, batch.column(body).to_pylist(), cache), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], values], names=[*names, out])

    return docs.withColumn(body, F.col(text)).mapInArrow(task, _with_double(docs, out))


def _with_double(docs: DataFrame, name: str):
    from pyspark.sql.types import DoubleType, StructField, StructType

    return StructType([*docs.schema.fields, StructField(name, DoubleType())])
