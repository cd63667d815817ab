"""Sparse text features for the two classifiers, hashed with numpy, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textkernel as tk

_PUNCT = ~tk.ALNUM & tk.NON_SPACE
_TOKEN = tk.NON_SPACE
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _per_text(words: tk.Words, at: np.ndarray) -> np.ndarray:
    """The text that each word stands in."""
    return np.searchsorted(words.of, at, "right") - 1


def toxic_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Presence of words and of word beginnings of 4 to 7 bytes: text, feature, value."""
    w = tk.Words(data, offsets, tk.ALNUM)
    n = len(w.data)
    up, down = tk.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((w.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    text = _per_text(w, np.arange(len(w)))
    ids, of = [w.hashes], [text]
    for length in (4, 5, 6, 7):
        long = np.flatnonzero(w.ends - w.starts >= length)
        s = w.starts[long]
        ids.append(tk.mix(((sums[s + length] - sums[s]) * down[s]) ^ np.uint64(length * 0x1000193)))
        of.append(text[long])
    cell = np.unique((np.concatenate(of).astype(np.uint64) << np.uint64(bits)) | (np.concatenate(ids) >> np.uint64(64 - bits)))
    return (cell >> np.uint64(bits)).astype(np.int64), (cell & np.uint64((1 << bits) - 1)).astype(np.int64), np.ones(len(cell), np.float32)


def quality_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word 1- and 2-grams and 1- to 3-grams of word shapes, as shares of the text's n-grams: text, feature, value.

    A shape tells case, digits, trailing and leading punctuation, a length class and whether the word repeats the one before.
    """
    w = tk.Words(data, offsets, _TOKEN)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    n = len(w.data)
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    span = lambda c: c[w.ends] - c[w.starts]
    length = w.ends - w.starts
    upper, digit = span(count(_UPPER[data])), span(count((w.data >= 48) & (w.data < 58)))
    punct = span(count(_PUNCT[w.data]))
    last, second = w.data[w.ends - 1].astype(np.int64), w.data[np.maximum(w.ends - 2, w.starts)].astype(np.int64)
    tail = np.where(_PUNCT[last], last * 256 + np.where(_PUNCT[second], second, 0), 0)
    same = np.zeros(len(w), np.int64)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    same[w.of[:-1][w.of[:-1] < len(w)]] = 0  # a text's first word repeats none
    case = np.where(upper == 0, 0, np.where(upper >= np.maximum(2, (length - punct) * 0.6), 2, 1))
    shape = tail + (case << 20) + (np.minimum(digit, 3) << 24) + (np.minimum(punct, 4).astype(np.int64) << 28) + (same << 32) + (np.minimum(length, 24) // 4 << 36)
    shape = tk.mix(shape.astype(np.uint64) ^ np.uint64(0x51A9E))
    text = _per_text(w, np.arange(len(w)))
    ids, of = [], []
    for hashes, most in ((w.hashes, 2), (shape, 3)):
        for k in range(1, most + 1):
            h = tk.shingles(hashes, k) if k > 1 else hashes
            inside = text[: len(h)] == text[k - 1 : k - 1 + len(h)]
            ids.append(tk.mix(h[inside] + np.uint64(k)))
            of.append(text[: len(h)][inside])
    cell = (np.concatenate(of).astype(np.uint64) << np.uint64(bits)) | (np.concatenate(ids) >> np.uint64(64 - bits))
    cell, times = np.unique(cell, return_counts=True)
    text = (cell >> np.uint64(bits)).astype(np.int64)
    value = np.log1p(times).astype(np.float32)
    norm = np.sqrt(np.bincount(text, value.astype(np.float64) ** 2, len(offsets) - 1))
    return text, (cell & np.uint64((1 << bits) - 1)).astype(np.int64), (value / norm[text]).astype(np.float32)


Extract = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def sums_by_text(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, extract: Extract) -> np.ndarray:
    """The weighted sum of each text's features."""
    bits = len(weights).bit_length() - 1
    out = np.zeros(len(offsets) - 1)
    for i, j in tk.slices(offsets):
        text, feature, value = extract(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
        out[i:j] = np.bincount(text, weights[feature] * value, j - i)
    return out


def sample(docs: DataFrame, labels: DataFrame, column: str, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(h, text, y)`` of at most ``most`` labelled rows, chosen by a hash of the key, ``h``. Null labels and keys are left out; of rows that share a key the one whose text has the least hash counts."""
    held = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    chosen = held.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    named = F.broadcast(chosen.select(F.col("doc_id").alias("__id"), "y"))  # at most ``most`` rows of two numbers
    src = docs.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    joined = src.join(named, F.col("__key") == F.col("__id"))
    one = joined.groupBy("__id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return one.select(F.xxhash64("__id").alias("h"), "text", "y")


def fitted(rows: DataFrame, extract: Extract, bits: int, fit: Callable[[list[tuple[np.ndarray, np.ndarray]], np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Runs ``fit(features of each row, labels, size)`` in one task over a bounded sample and returns its vector."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        one = np.float32(1)
        for batch in batches:
            data, offsets = tk.raw(batch.column(1))
            ys += batch.column(2).to_pylist()
            for i, j in tk.slices(offsets):
                t, f, v = extract(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
                cut = np.searchsorted(t, np.arange(j - i + 1))
                weighted = bool((v != 1).any())
                xs += [(f[a:b].astype(np.int32), v[a:b].copy() if weighted else np.broadcast_to(one, b - a)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([fit(xs, np.array(ys, np.int64), 1 << bits).astype(np.float32).tobytes()], pa.binary())], ["w"])

    # in hashed order whatever the order of arrival, so that a run can be repeated and a part of the rows is a random one
    got = rows.repartition(1).sortWithinPartitions("h", "text", "y").mapInArrow(train, "w binary").collect()  # one row
    return np.frombuffer(bytes(got[0]["w"]), np.float32) if got else np.zeros(0, np.float32)
