"""Toxicity by cumulative-link ordinal regression.

Grades are ordered: P(grade > k) = sigmoid(w x - theta_k) with one weight vector for all thresholds; the score is the
expected grade, the sum of these. Features are the presence of words and word beginnings, so that inflected forms of a
stem share weights. The labels tell toxic from clean only, so grade 2 (severe) is given to toxic training rows that
hold at least ``SEVERE`` different features which toxic rows have much more often than clean ones, grade 1 to the
others. Training takes at most ``SAMPLE`` labelled rows in one task; features without a clear
association with the labels and, by L1 shrinkage, further neutral ones have no weight, so long clean texts do not add up to anything. Scoring is one pass without a shuffle.

Null and empty texts have no features and get the score of the thresholds alone. Without labels nothing is toxic.
Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import features, runtime
from millrace.llm import textkernel as tk

SAMPLE, EPOCHS, BITS, BATCH = 20_000, 6, 19, 16
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.5, 0.1
GRADES = 3
#: Marker features of a severe row, the log-odds that makes a marker, and the toxic rows it must occur in.
SEVERE, MARKER_ODDS, MARKER_ROWS = 8, 2.5, 3
#: Features whose log-odds ratio is within so many standard errors of zero get no weight.
LEAST_Z = 2.5
#: Expected grade from which a text is toxic.
CUT = 0.3


def odds(xs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each feature: its log-odds ratio between toxic and clean rows, that in standard errors, and the toxic rows that hold it."""
    df = np.zeros((2, size))
    for x, t in zip(xs, toxic, strict=True):
        df[int(t), x[0]] += 1
    rows = np.array([[(toxic == 0).sum()], [(toxic == 1).sum()]])
    p = np.log(df + 0.5) - np.log(rows - df + 0.5)
    ratio = p[1] - p[0]
    return ratio, ratio / np.sqrt((1 / (df + 0.5) + 1 / (rows - df + 0.5)).sum(0)), df[1]


def grades(xs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, marker: np.ndarray) -> np.ndarray:
    """0 for clean, 1 or 2 for toxic rows, by the number of marker features."""
    return np.array([0 if not t else 2 if marker[x[0]].sum() >= SEVERE else 1 for x, t in zip(xs, toxic, strict=True)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(xs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, size: int) -> np.ndarray:
    """Weights, then the thresholds, in ascending order."""
    theta = np.array([2.0, 3.0])
    w = np.zeros(size)
    if not len(toxic) or not toxic.any():
        return np.concatenate([w, theta + 30])
    ratio, z_score, held = odds(xs, toxic, size)
    y = grades(xs, toxic, (ratio > MARKER_ODDS) & (held >= MARKER_ROWS))
    use = np.abs(z_score) >= LEAST_Z
    xs = [(x[0][use[x[0]]], x[1]) for x in xs]
    z, n, tn = np.zeros(size), np.zeros(size), np.ones(2)
    order = np.random.default_rng(11).permutation(len(y))
    for _ in range(EPOCHS):
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            f = np.concatenate([xs[i][0] for i in rows])
            if not len(f):
                continue
            of = np.repeat(np.arange(len(rows)), [len(xs[i][0]) for i in rows])
            eta = np.bincount(of, w[f], len(rows))
            # likelihood of the grade: the difference of neighbouring cumulative probabilities
            edge = np.concatenate([[-np.inf], theta, [np.inf]])
            lo, hi = edge[y[rows]], edge[y[rows] + 1]
            a, b = _sigmoid(hi - eta), _sigmoid(lo - eta)
            p = np.maximum(a - b, 1e-9)
            da, db = a * (1 - a), b * (1 - b)
            geta = (da - db) / p  # minus the gradient of the log-likelihood by eta, up to sign
            touched, where = np.unique(f, return_inverse=True)
            g = np.bincount(where, geta[of])
            sigma = (np.sqrt(n[touched] + g * g) - np.sqrt(n[touched])) / ALPHA
            z[touched] += g - sigma * w[touched]
            n[touched] += g * g
            w[touched] = np.where(np.abs(z[touched]) <= L1, 0, -(z[touched] - np.sign(z[touched]) * L1) / ((BETA + np.sqrt(n[touched])) / ALPHA + L2))
            gt = np.array([(-(da / p)[y[rows] == k]).sum() + ((db / p)[y[rows] == k + 1]).sum() for k in range(2)])
            tn += gt * gt
            theta = theta - 0.3 * gt / np.sqrt(tn)
            theta[1] = max(theta[1], theta[0] + 0.1)
    return np.concatenate([w, theta])


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = SAMPLE) -> np.ndarray:
    runtime.prepare(docs.sparkSession)
    return features.fitted(features.sample(docs, labels, column, sample), features.toxic_features, BITS, fit)


def severity(docs: DataFrame, weights: np.ndarray, text: str = "text", score: str = "expected_severity", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep`` of it) with the expected grade as ``score``; a column of that name is replaced."""
    runtime.prepare(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c != score]
    src = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(runtime.fresh(names)))
    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema.add(score, "double")
    told = docs.sparkSession.sparkContext.broadcast(weights if len(weights) else np.concatenate([np.zeros(1 << BITS), [32.0, 33.0]]).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, theta = told.value[:-2], told.value[-2:]
        for batch in batches:
            data, offsets = tk.raw(batch.column(len(names)))
            eta = features.sums_by_text(data, offsets, w, features.toxic_features)
            expected = sum(_sigmoid(eta - t) for t in theta)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(expected, pa.float64())], [*names, score])

    return src.mapInArrow(run, schema)
