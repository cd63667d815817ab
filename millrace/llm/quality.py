"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

It learns from at most ``SAMPLE`` labelled rows in one task (FTRL-proximal with L1 and L2 terms, rows in hashed order,
``EPOCHS`` passes in small batches). The last fifth of the sample in hashed order, a random fifth, sets a shift of the
log-odds such that a score of 0.3 is where both classes are told apart best. Scoring is a sparse dot product per text over the whole table, without a
shuffle; the weights are a vector of fixed size.

Null and empty texts have no features and score by the bias alone. Without any label every score is 0.5. Repeated rows
score alike. Nothing but the text is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import features, runtime
from millrace.llm import textkernel as tk

SAMPLE, EPOCHS, BITS, BATCH = 12_000, 4, 18, 16
ALPHA, BETA, L1, L2 = 0.25, 1.0, 0.02, 0.5
CUT = 0.3


def ftrl(xs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the last of them the bias."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    w = np.zeros(size + 1)
    order = np.random.default_rng(7).permutation(len(y))
    for _ in range(epochs):
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            f = np.concatenate([np.append(xs[i][0], size) for i in rows])
            v = np.concatenate([np.append(xs[i][1], 1.0) for i in rows])
            of = np.repeat(np.arange(len(rows)), [len(xs[i][0]) + 1 for i in rows])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[f] * v, len(rows)), -30, 30)))
            touched, where = np.unique(f, return_inverse=True)
            g = np.bincount(where, (p - y[rows])[of] * v)
            sigma = (np.sqrt(n[touched] + g * g) - np.sqrt(n[touched])) / ALPHA
            z[touched] += g - sigma * w[touched]
            n[touched] += g * g
            l1 = np.where(touched == size, 0, L1)
            w[touched] = np.where(np.abs(z[touched]) <= l1, 0, -(z[touched] - np.sign(z[touched]) * l1) / ((BETA + np.sqrt(n[touched])) / ALPHA + L2))
    return w


def fit(xs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int) -> np.ndarray:
    """Weights and bias; the bias holds the shift for the cut."""
    if not len(y):
        return np.zeros(size + 1)
    part = len(y) * 4 // 5
    logit = lambda w, rows: np.array([float(w[xs[i][0]] @ xs[i][1]) + w[size] for i in rows])
    shift = 0.0
    if part and 0 < y[part:].sum() < len(y) - part:
        s = logit(ftrl(xs[:part], y[:part], size), range(part, len(y)))
        t = y[part:]
        cuts = np.unique(s)
        mids = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2])
        bad, good = np.sort(s[t == 0]), np.sort(s[t == 1])
        balanced = np.searchsorted(bad, mids) / len(bad) + 1 - np.searchsorted(good, mids) / len(good)
        close = mids[balanced >= balanced.max() - 0.005]
        shift = np.log(CUT / (1 - CUT)) - float(np.median(close))
    w = ftrl(xs, y, size)
    w[size] += shift
    return w


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights of the whole model. ``labels (doc_id, column)`` are those it may learn from."""
    runtime.prepare(docs.sparkSession)
    return features.fitted(features.sample(docs, labels, column, sample), features.quality_features, BITS, fit)


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)``."""
    runtime.prepare(docs.sparkSession)
    src = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    told = docs.sparkSession.sparkContext.broadcast(weights if len(weights) else np.zeros((1 << BITS) + 1, np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = told.value
        for batch in batches:
            data, offsets = tk.raw(batch.column(1))
            s = features.sums_by_text(data, offsets, w[:-1], features.quality_features) + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30))))], ["doc_id", "score"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
