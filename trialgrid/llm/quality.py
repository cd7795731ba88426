"""Text quality by positive-unlabelled learning with a non-negative unbiased risk.

Trusted positives are the rows that labels mark as good; everything else is unlabelled, and no row that labels mark as bad is used as
one. With a score f, squared loss l and the class prior p, the risk of a classifier is p * E_positive[l(f, +1)] plus that of negatives,
which unlabelled rows show without bias as E_unlabelled[l(f, -1)] - p * E_positive[l(f, -1)]. The latter can't be negative in truth; where a
fit makes it so, the fit follows chance, and steps go against it until it is not.

f is linear in features of the whole text: how often each kind of character follows each other kind, and how much words and lines repeat.
With squared loss both expectations are quadratic forms of the features' moments, so the risk covers all documents and all trusted
positives exactly, whatever their number, and the driver holds a matrix of the number of features. Features are whole numbers of
1 / UNIT, so sums are exact and a task that runs again changes nothing.

The prior is the least ratio of the shares of unlabelled and of positive rows above a score (with a bound for chance), from counts over all rows;
the fit is made with a guess, the prior is estimated, and the fit is made again. A logistic curve through the counts of positives and of what they
leave of the unlabelled rows, none below 0, makes scores of f.

Defined results: null and empty texts are scored by their features, all 0; a null id is not held out and never trusted; an id that labels mark both ways
isn't trusted; rows without a label or with another one than 1 are just unlabelled; without trusted positives, or without documents of any variety, all scores are 0;
repeated rows get equal scores; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize, partitions_for, read_table, release, sum_rows

UNIT = 1000
WINDOW = 50
RIDGE, FEW, STEPS, FLOOR = 0.02, 40, 4000, 0.02  # the ridge is RIDGE and FEW over the number of positives more
GUESS, CHANCE = 0.5, 0.1
BINS, REACH = 400, 4.0
THRESHOLD = 0.7

#: Kinds of bytes: small letter, capital, digit, blank, line end, mark of prose, other sign, part of a letter beyond ASCII.
_KINDS = np.full(256, 7, np.int64)
_KINDS[:128] = 6
for _kind, _signs in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:!?'\"()-")):
    _KINDS[list(_signs)] = _kind
_line = re.compile(r"[^\n]*\S[^\n]*").findall
DIMS = 64 + 11


def text_features(text: str | None) -> np.ndarray:
    """Features of a whole text as whole numbers from 0 to UNIT."""
    text = text or ""
    kinds = _KINDS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    pairs = np.bincount(kinds[1:] * 8 + kinds[:-1], minlength=64) / max(1, len(kinds) - 1)
    words, lines = text.split(), _line(text)
    n = max(1, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    windows = [words[i : i + WINDOW] for i in range(0, len(words), WINDOW)]
    rest = [
        np.log1p(len(kinds)) / 16, np.log1p(len(words)) / 14, np.log1p(len(lines)) / 12,
        sum(len(set(w)) / len(w) for w in windows) / len(windows) if windows else 0,
        max(Counter(words).values(), default=0) / n, sum(map(str.__eq__, words, words[1:])) / n, len(set(lines)) / len(lines) if lines else 0,
        size.mean() / 20, size.std() / 20, (size == 1).mean(), (size > 20).mean(),
    ]
    return np.rint(np.clip(np.r_[np.sqrt(pairs), rest], 0, 1) * UNIT).astype(np.int16)


def _rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), "<i2").reshape(-1, DIMS)


def featured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the features as bytes, of each row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [text_features(t).astype("<i2").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], ["doc_id", "x"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(build, f"doc_id {dict(df.dtypes)[id_col]}, x binary")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def trusted(features: DataFrame, labels: DataFrame) -> DataFrame:
    """The features of rows that are marked as good and not held out; only ids and features are shuffled."""
    marks = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("_least"))
    return features.join(marks.where("_least = 1").select("doc_id"), "doc_id").select("x")


def moments(features: DataFrame) -> np.ndarray:
    """Sums of products of all two features, the first of them 1 for each row, over all rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DIMS + 1, DIMS + 1), np.int64)
        for batch in batches:
            x = np.c_[np.ones(batch.num_rows), _rows(batch, "x")]
            total += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(DIMS + 1), pa.int32()), pa.array([",".join(map(str, row)) for row in total.tolist()], pa.string())], ["i", "cells"])

    rows = sum_rows(features.select("x").mapInArrow(add, "i int, cells string"), "i", min(DIMS + 1, partitions_for(features.sparkSession, 0, 1)))
    return np.array(rows, object) if rows else np.zeros((DIMS + 1, DIMS + 1), object)


@dataclass
class Model:
    weights: np.ndarray | None  # on features as they are; None where nothing was learnt
    bias: float
    prior: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -40, 40)))


def minimise(unlabelled: np.ndarray, positive: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """(weights, bias) of least non-negative risk from sums of products over unlabelled and over positive rows."""
    n = float(unlabelled[0, 0])
    mean = np.array([float(v) / n for v in unlabelled[0, 1:]])
    spread = np.array([float(unlabelled[0, 0] * unlabelled[k, k] - unlabelled[0, k] ** 2) / n / n for k in range(1, len(unlabelled))])
    scale = np.sqrt(np.maximum(spread, 0)) + FLOOR * UNIT
    to = np.zeros((len(unlabelled),) * 2)  # features as they are to features of mean 0 and about unit spread
    to[0, 0], to[0, 1:] = 1, -mean / scale
    to[range(1, len(to)), range(1, len(to))] = 1 / scale
    u = to.T @ (unlabelled / n).astype(float) @ to
    p = to.T @ (positive / float(positive[0, 0])).astype(float) @ to
    held = RIDGE + FEW / float(positive[0, 0])
    ridge = held * np.diag(np.r_[0, np.ones(len(to) - 1)])
    w = np.zeros(len(to))
    rate = 1 / (np.linalg.eigvalsh(u + p)[-1] / 2 + held)
    best, least = w, np.inf
    for _ in range(STEPS):
        # squared loss (1 - t f)^2 / 4: its mean is (1 - 2 t w'm + w'Mw) / 4
        good, bad = p @ w / 2 - p[0] / 2, p @ w / 2 + p[0] / 2
        against = u @ w / 2 + u[0] / 2 - prior * bad
        negative = (1 + 2 * u[0] @ w + w @ u @ w) / 4 - prior * (1 + 2 * p[0] @ w + w @ p @ w) / 4
        risk = prior * (1 - 2 * p[0] @ w + w @ p @ w) / 4 + max(0.0, negative) + w @ ridge @ w / 2
        if risk < least and negative >= 0:
            best, least = w, risk
        step = prior * good + against + ridge @ w if negative >= 0 else -against
        w = w - rate * step
        if np.abs(step).max() < 1e-9:
            break
    weights = to[1:, 1:] @ best[1:]
    return weights, float(best[0] + to[0, 1:] @ best[1:])


def counts(features: DataFrame, model: Model) -> np.ndarray:
    """How many rows have a margin in each of BINS parts of -REACH to REACH."""
    shared = features.sparkSession.sparkContext.broadcast(model)  # a number a feature

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            at = (np.clip(shared.value.margin(_rows(batch, "x")), -REACH, REACH) + REACH) * (BINS / (2 * REACH))
            total += np.bincount(np.minimum(at.astype(np.int64), BINS - 1), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([",".join(map(str, total.tolist()))], pa.string())], ["i", "cells"])

    rows = sum_rows(features.select("x").mapInArrow(add, "i int, cells string"), "i", 1)
    return np.array(rows[0] if rows else [0] * BINS, float)


def class_prior(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The share of positives among unlabelled rows from counts by score: the least ratio of shares above a score, each with its bound for chance."""
    n, m = unlabelled.sum(), positive.sum()
    u, p = (np.cumsum(x[::-1]) / max(1, x.sum()) for x in (unlabelled, positive))
    u, p = u[p > 0], p[p > 0]
    chance = np.sqrt(np.log(4 / CHANCE) / 2) * (1 / np.sqrt(n) + 1 / np.sqrt(m))
    at = np.argmin((u + chance) / p)
    return float(np.clip(u[at] / p[at], 0.02, 0.98))


def curve(unlabelled: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve through counts by score, by Newton's steps, slightly shrunk."""
    good = prior * positive / positive.sum()
    # what positives leave of the unlabelled rows up to each score: it never falls, and ends at 1 - prior
    left = np.cumsum(unlabelled / unlabelled.sum() - good)
    bad = np.diff(np.minimum(np.maximum.accumulate(np.maximum(left, 0)), 1 - prior), prepend=0)
    f = (np.arange(BINS) + 0.5) * (2 * REACH / BINS) - REACH
    a, b = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        d, h = (good + bad) * q - good, (good + bad) * q * (1 - q) + 1e-9
        g = np.array([(d * f).sum() + 1e-3 * a, d.sum()])
        step = np.clip(np.linalg.solve([[(h * f * f).sum() + 1e-3, (h * f).sum()], [(h * f).sum(), h.sum() + 1e-6]], g), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def fit(features: DataFrame, positives: DataFrame) -> Model:
    """A model from features of all rows, as unlabelled, and of trusted positives; both are read several times, so they should be written tables."""
    u, p = moments(features), moments(positives)
    model = Model(None, 0.0, GUESS)
    if not p[0, 0] or not u[0, 0]:
        return model
    for _ in range(2):
        model = Model(*minimise(u, p, model.prior), model.prior)
        seen, good = counts(features, model), counts(positives, model)
        model.prior = class_prior(seen, good)
    model.slope, model.offset = curve(seen, good, model.prior)
    return model


def score_features(features: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted from the rows of `featured`."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(_rows(batch, "x"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "x").mapInArrow(rate, f"doc_id {dict(features.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; labels: doc_id, quality."""
    features = materialize(featured(docs, id_col, text_col), "features")
    positives = materialize(trusted(features, labels), "trusted")
    model = fit(features, positives)
    release(positives)
    return score_features(features, model, threshold)


def op11_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
