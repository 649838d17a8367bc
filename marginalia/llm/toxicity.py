"""Toxicity: a factorization machine over hashed terms, which learns single terms and pairs of them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Labelled rows of either class that the machine is fitted to at most, those with the smallest hashes of their ids.
ROWS_PER_CLASS = 4000
BUCKETS = 1 << 20
RANK = 4
STEPS = 300
#: Weight decay of the single terms and of the pairs, against the summed log loss: pairs are for what single terms don't explain.
DECAY, PAIR_DECAY = 0.1, 3.0
#: Terms of fewer rows of the sample have no weights.
MIN_ROWS = 4
#: A term has weights if it tells the classes apart, or if a pair of it with another term does where the single terms
#: don't: by so many standard errors. There are as many pairs as the square of the terms, so pairs need more of them.
ERRORS, PAIR_ERRORS = 4.0, 6.5
#: Terms that all pairs are tried of: those of most rows, a matrix of a fixed size.
PAIR_TERMS = 4096
TRIM = ".,;:!?\"'()[]{}<>*#$%&|~_-=+/\\«»“”‘’…"


class Machine(NamedTuple):
    """score = sigmoid(bias + sum of w + half of (square of the sum of v - sum of the squares)) over a text's known terms."""

    slots: dict[int, int]
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, buckets: list[int]) -> float:
        at = [self.slots[b] for b in buckets if b in self.slots]
        z = self.bias
        if at:
            v = self.v[at]
            z += self.w[at].sum() + 0.5 * ((v.sum(0) ** 2) - (v * v).sum(0)).sum()
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def terms(text: str | None) -> list[int]:
    """Buckets of the distinct lower-cased words of a text, without punctuation at their ends."""
    found = {w.strip(TRIM) for w in set((text or "").lower().split())}
    found.discard("")
    return sorted({xxhash.xxh32_intdigest(w) % BUCKETS for w in found})


class Sample(NamedTuple):
    """Labelled rows by term: entry k says that row ``row[k]`` has term ``term[k]``, in the order of rows."""

    row: np.ndarray
    term: np.ndarray
    labels: np.ndarray
    n_terms: int

    def only(self, kept: np.ndarray) -> "Sample":
        """The same rows with the terms ``kept``, numbered anew."""
        to = np.full(self.n_terms, -1)
        to[kept] = np.arange(len(kept))
        has = to[self.term] >= 0
        return Sample(self.row[has], to[self.term[has]], self.labels, len(kept))


def sampled(rows: list[list[int]], labels: np.ndarray) -> tuple[Sample, np.ndarray]:
    """The rows as a sample, and the bucket of each of its terms, those of most rows first."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    found = np.array([b for r in rows for b in r], dtype=np.int64)
    buckets, of, n = np.unique(found, return_inverse=True, return_counts=True)
    order = np.lexsort((buckets, -n))
    order = order[n[order] >= MIN_ROWS]
    to = np.full(len(buckets), -1)
    to[order] = np.arange(len(order))
    has = to[of] >= 0
    return Sample(row[has], to[of[has]], labels, len(order)), buckets[order]


def descend(own: Sample, rank: int = RANK, steps: int = STEPS, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, w, v) by Adam on the log loss of all rows, with weight decay."""
    n, m = len(own.labels), own.n_terms
    rate = (own.labels.sum() + 1) / (n + 2)
    p = [np.array([math.log(rate / (1 - rate))]), np.zeros(m), np.random.default_rng(seed).normal(0, 0.1, (m, rank))]
    if not m:
        return float(p[0][0]), p[1], p[2]
    by_row = np.flatnonzero(np.r_[True, own.row[1:] != own.row[:-1]])
    some = own.row[by_row]
    order = np.argsort(own.term, kind="stable")
    by_term = np.flatnonzero(np.r_[True, np.diff(own.term[order]) != 0])
    row_of = own.row[order]
    mean, square = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, steps + 1):
        bias, w, v = p
        each, s, z = v[own.term], np.zeros((n, rank)), np.full(n, bias[0])
        s[some] = np.add.reduceat(each, by_row)
        z[some] += np.add.reduceat(w[own.term] - 0.5 * (each * each).sum(1), by_row)
        z += 0.5 * (s * s).sum(1)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - own.labels) / n
        dw = np.add.reduceat(d[row_of], by_term)
        dv = np.add.reduceat(d[row_of, None] * s[row_of], by_term) - dw[:, None] * v
        for i, g in enumerate((np.array([d.sum()]), dw + DECAY / n * w, dv + PAIR_DECAY / n * v)):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            p[i] = p[i] - 0.05 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return float(p[0][0]), p[1], p[2]


def single_terms(own: Sample) -> np.ndarray:
    """Whether each term's rate of label 1 differs from that of all rows by ERRORS standard errors."""
    n, rate = np.bincount(own.term, minlength=own.n_terms), own.labels.mean()
    ones = np.bincount(own.term, weights=own.labels[own.row], minlength=own.n_terms)
    error = np.sqrt(n * rate * (1 - rate) * (1 - n / len(own.labels)))
    return (np.abs(ones - n * rate) > ERRORS * error) & (error > 0)


def paired_terms(own: Sample, expected: np.ndarray) -> np.ndarray:
    """Whether each term is in a pair whose rows' labels differ from ``expected`` (a probability for each row) by PAIR_ERRORS standard errors."""
    m, n = min(PAIR_TERMS, own.n_terms), len(own.labels)
    has = own.term < m
    row, term = own.row[has], own.term[has]
    left, spread = (own.labels - expected).astype(np.float32), (expected * (1 - expected)).astype(np.float32)
    over, around = np.zeros((m, m), np.float32), np.zeros((m, m), np.float32)
    for at in range(0, n, 1000):
        lo, hi = np.searchsorted(row, [at, at + 1000])
        x = np.zeros((min(1000, n - at), m), np.float32)
        x[row[lo:hi] - at, term[lo:hi]] = 1
        over += (x * left[at : at + 1000, None]).T @ x
        around += (x * spread[at : at + 1000, None]).T @ x
    np.fill_diagonal(over, 0)
    out = np.zeros(own.n_terms, bool)
    out[:m] = (over * over > PAIR_ERRORS**2 * np.maximum(around, 0.25)).any(1)
    return out


def fit(rows: list[list[int]], labels: np.ndarray) -> Machine:
    """A machine over the terms that tell the classes apart alone or in a pair.

    Single terms are tried first and fitted additively; what their probabilities don't explain is tried for every
    pair of the PAIR_TERMS terms of most rows, so that terms that are as frequent in either class still get weights
    for what they mean together. The rest of a sample's many thousand terms would only fit noise in its labels.
    """
    if not len(labels) or labels.min() == labels.max():
        rate = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.01
        return Machine({}, math.log(rate / (1 - rate)), np.zeros(0), np.zeros((0, RANK)))
    own, buckets = sampled(rows, labels)
    told = single_terms(own)
    alone = own.only(np.flatnonzero(told))
    bias, w, _ = descend(alone, rank=0)
    z = bias + np.bincount(alone.row, weights=w[alone.term], minlength=len(labels))
    kept = np.flatnonzero(told | paired_terms(own, 1 / (1 + np.exp(-np.clip(z, -30, 30)))))
    bias, w, v = descend(own.only(kept))
    return Machine({b: i for i, b in enumerate(buckets[kept].tolist())}, bias, w, v)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _terms(texts: pd.Series) -> pd.Series:
    return pd.Series([terms(t) for t in texts])


def train(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS) -> Machine:
    """Fit to at most ``per_class`` labelled rows of either class. Only ids and labels choose rows; texts stay on the executors until they are buckets."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = known.where("toxic = 1").orderBy(*order).limit(per_class).union(known.where("toxic = 0").orderBy(*order).limit(per_class))
    # at most 2 * per_class rows of an id and a label: a broadcast of a known size
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", _terms("text").alias("terms")).orderBy("doc_id").toArrow().to_pandas()
    n = known.groupBy("toxic").count().toArrow().to_pandas().set_index("toxic")["count"].to_dict()
    machine = fit([list(x) for x in rows["terms"]], rows["toxic"].to_numpy(dtype=float))
    # the classes' own odds, where the sample has them evened out
    shift = sum((1 if c else -1) * math.log(max(1, n.get(c, 0)) / min(max(1, n.get(c, 0)), per_class)) for c in (0, 1))
    return machine._replace(bias=machine.bias + shift)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; predicted is 1 where score >= 0.5.

    Null and empty texts get the score of no terms. Null ids are never learned from and not held out. Repeated
    rows are scored each; labels that repeat an id count once, a toxic one first; other columns are ignored.
    With no labels every score is the prior. An empty table gives an empty result.
    """
    own = docs.select("doc_id", "text")
    machine = train(own, labels, per_class)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            yield pd.Series([model.score(terms(t)) for t in texts], dtype="float64")

    scored = own.select("doc_id", held_out("doc_id").alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
