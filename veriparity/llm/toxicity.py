"""Toxicity scores from a counterfactual-regularised linear classifier.

Features of a text are its distinct words, without case and punctuation, and
their beginnings of three to six letters, hashed.  A bounded sample of the
labelled rows, half of it toxic if there are enough, is fitted by logistic
regression with two penalties: the usual one on the weights, and one on how much
the score of a labelled sentence changes when its identity terms are swapped for
others of their group.  The second keeps neutral mentions of a group from
counting as toxic.  Only the weights travel to the tasks that score.  A score is
the probability of the toxic class if both classes were as frequent as in the sample.

Cases: a null or empty text has no features and scores the intercept; rows
without a label are scored alike; without labelled rows of both classes every
score is 0; repeated rows score alike; an empty table gives an empty table;
other columns are ignored.  Equal doc_ids in ``labels`` count once, toxic if
one of them is.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriparity.llm.common import Memo, slices, texts_of

SPACE_BITS = 20
PREFIXES = range(3, 7)
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")

# Identity terms; a term is swapped for the next of its group.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"), ("black", "white", "asian", "latino"),
    ("african", "european", "american", "arab"), ("immigrant", "native", "refugee"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
SWAP = {term: group[(i + 1) % len(group)] for group in IDENTITY_GROUPS for i, term in enumerate(group)}


@dataclass(frozen=True)
class Fit:
    """Settings of the fit; ``sample_rows`` bounds the labelled rows it sees."""

    sample_rows: int = 8_000
    features: int = 1_024
    least_rows: int = 6
    ridge: float = 0.2
    counterfactual: float = 50.0
    steps: int = 12


def feature_hash(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode()) >> (64 - SPACE_BITS)


def features_of_word(word: str) -> tuple[int, ...]:
    return (feature_hash(word), *(feature_hash(f"{word[:n]}*") for n in PREFIXES if len(word) > n))


def feature_memo() -> Memo:
    return Memo(features_of_word, 100_000)


def features(text: str, memo: Memo) -> np.ndarray:
    words = set(WORD.findall(text.lower()))
    found = [h for w in words for h in memo[w]]
    return np.unique(np.array(found, np.int32))


def swapped_sentences(text: str) -> list[tuple[str, str]]:
    """Sentences that name a group, each with its counterfactual."""
    out = []
    for m in SENTENCE.finditer(text.lower()):
        sentence = m[0]
        if any(w in SWAP for w in WORD.findall(sentence)):
            out.append((sentence, WORD.sub(lambda w: SWAP.get(w[0], w[0]), sentence)))
    return out


def sample_of(labels: DataFrame, training: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids in the order of their hash, half of them of each class if there are enough."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & training)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    )
    order = [F.xxhash64(F.lit("toxic"), "doc_id"), F.col("doc_id")]
    halves = [known.where(F.col("toxic") == label).orderBy(*order).limit(rows // 2) for label in (0, 1)]
    return halves[0].unionByName(halves[1])


def collect_sample(docs: DataFrame, labels: DataFrame, training: Column, fit: Fit) -> pa.Table:
    """Features and counterfactual pairs of the sampled rows: at most ``fit.sample_rows`` short arrays."""

    def run(batches):
        memo = feature_memo()
        for part in slices(batches):
            texts = part["text"].to_pylist()
            pairs = [swapped_sentences(x) for x in texts]
            yield pa.RecordBatch.from_arrays([
                part["toxic"],
                pa.array([features(x, memo) for x in texts], pa.list_(pa.int32())),
                pa.array([[features(a, memo) for a, _ in p] for p in pairs], pa.list_(pa.list_(pa.int32()))),
                pa.array([[features(b, memo) for _, b in p] for p in pairs], pa.list_(pa.list_(pa.int32()))),
            ], names=["toxic", "own", "before", "after"])

    chosen = F.broadcast(sample_of(labels, training, fit.sample_rows))  # bounded by the setting
    return (
        texts_of(docs).join(chosen, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
        .mapInArrow(run, "toxic int, own array<int>, before array<array<int>>, after array<array<int>>").toArrow()
    )


class Rows:
    """Sparse rows of 0/1 features, over the chosen features only."""

    def __init__(self, lists: pa.ListArray, index: np.ndarray):
        column = index[np.asarray(lists.flatten())]
        row = np.repeat(np.arange(len(lists), dtype=np.int32), np.asarray(lists.value_lengths()))
        self.column, self.row, self.n = column[column >= 0], row[column >= 0], len(lists)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n)

    def t_dot(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, r[self.row], width)


def solved(times, target: np.ndarray, rounds: int = 60, close: float = 1e-3) -> np.ndarray:
    """Conjugate gradients for a positive definite operator."""
    out, rest = np.zeros_like(target), target.copy()
    direction, size = rest.copy(), rest @ rest
    first = size
    for _ in range(rounds):
        if size <= close * close * first:
            break
        image = times(direction)
        step = size / (direction @ image)
        out += step * direction
        rest -= step * image
        size, before = rest @ rest, size
        direction = rest + size / before * direction
    return out


def fitted(sample: pa.Table, fit: Fit) -> tuple[np.ndarray, np.ndarray, float]:
    """Chosen features, their weights and the intercept."""
    y = sample["toxic"].to_numpy().astype(float)
    none = np.zeros(0, np.int64), np.zeros(0), -np.inf
    if not 0 < y.sum() < len(y):
        return none
    own = sample["own"].combine_chunks()
    seen, labels = np.asarray(own.flatten()), np.repeat(y, np.asarray(own.value_lengths()))
    n, hit = np.bincount(seen, minlength=1 << SPACE_BITS), np.bincount(seen, labels, 1 << SPACE_BITS)
    gap = hit / y.sum() - (n - hit) / (len(y) - y.sum())
    z = np.abs(gap) / np.sqrt(np.maximum(n, 1) / len(y))
    z[n < fit.least_rows] = 0
    chosen = np.sort(np.argsort(-z, kind="stable")[: fit.features])
    chosen = chosen[z[chosen] > 0]
    index = np.full(1 << SPACE_BITS, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    del seen, labels
    k = len(chosen)
    x = Rows(own, index)
    before, after = (Rows(sample[c].combine_chunks().flatten(), index) for c in ("before", "after"))

    def curvature(v: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The Hessian of the penalised loss times a vector; the last entry is the intercept's."""
        r = p * (1 - p) * (x.dot(v[:k]) + v[k])
        out = np.append(x.t_dot(r, k) + fit.ridge * v[:k], r.sum() + 1e-6 * v[k])
        if before.n:
            change = (before.dot(v[:k]) - after.dot(v[:k])) * (fit.counterfactual / before.n)
            out[:k] += before.t_dot(change, k) - after.t_dot(change, k)
        return out

    w, b = np.zeros(k), 0.0
    for _ in range(fit.steps):  # Newton's method, each step solved by conjugate gradients
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + b, -30, 30)))
        gradient = np.append(x.t_dot(p - y, k) + fit.ridge * w, (p - y).sum())
        if before.n:
            change = (before.dot(w) - after.dot(w)) * (fit.counterfactual / before.n)
            gradient[:k] += before.t_dot(change, k) - after.t_dot(change, k)
        if np.abs(gradient).max() < 1e-4 * len(y):
            break
        step = solved(lambda v, p=p: curvature(v, p), -gradient)
        w, b = w + step[:k], b + step[k]
    return chosen, w, float(b)


def toxicity_scores(docs: DataFrame, labels: DataFrame, training: Column, fit: Fit = Fit()) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row, learned from labelled rows where ``training`` holds."""
    chosen, w, b = fitted(collect_sample(docs, labels, training, fit), fit)
    # the chosen features only: their number is a setting
    sent = docs.sparkSession.sparkContext.broadcast((dict(zip(chosen.tolist(), w.tolist(), strict=True)), b))

    def run(batches):
        weights, b = sent.value
        known = Memo(lambda word: tuple(h for h in features_of_word(word) if h in weights))
        get = known.__getitem__

        def score(text: str) -> float:
            found = set().union(*map(get, set(WORD.findall(text.lower()))))
            return b + math.fsum(weights[h] for h in found)

        for part in slices(batches):
            z = np.array([score(x) for x in part["text"].to_pylist()])
            with np.errstate(over="ignore"):  # a score next to 0 is 0
                out = pa.array(1 / (1 + np.exp(-z)))
            yield pa.RecordBatch.from_arrays([part["doc_id"], out], names=["doc_id", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double")
