"""Features, scores and training of both classifiers against plain Python, word by word and row by row."""

import math
import re
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import features, ordinal, quality
from millrace.llm import textkernel as tk

SF = "/root/testdata/sf0.001"
M = (1 << 64) - 1
BITS = 12
ALNUM = set(range(48, 58)) | set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256))


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def poly(b):
    base = 0x9E3779B97F4A7C15 | 1
    return sum((c + 1) * pow(base, j, 1 << 64) for j, c in enumerate(b)) & M


def word_hash(b):
    return mix(poly(b) ^ (len(b) << 56 & M))


def lower(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def runs(b, inside):
    out, at = [], None
    for i, c in enumerate(b + b" "):
        if i < len(b) and inside(c):
            at = i if at is None else at
        elif at is not None:
            out.append((at, i))
            at = None
    return out


def toxic(text):
    b = lower((text or "").encode())
    cells = set()
    for s, e in runs(b, lambda c: c in ALNUM):
        w = b[s:e]
        cells.add(word_hash(w) >> (64 - BITS))
        for n in (4, 5, 6, 7):
            if len(w) >= n:
                cells.add(mix(poly(w[:n]) ^ (n * 0x1000193)) >> (64 - BITS))
    return dict.fromkeys(sorted(cells), 1.0)


def odd(i):
    return ((0xD6E8FEB86659FD93 * (2 * i + 1) ^ (i << 33)) & M) | 1


def gram(hs):
    return hs[0] if len(hs) == 1 else mix(sum(h * odd(i) for i, h in enumerate(hs)) & M)


def good(text):
    raw = (text or "").encode()
    b = lower(raw)
    words, shapes, last = [], [], None
    for s, e in runs(b, lambda c: c not in (0x20, *range(0x09, 0x0E))):
        w = b[s:e]
        h = word_hash(w)
        punct = [c not in ALNUM for c in w]
        upper = sum(65 <= c <= 90 for c in raw[s:e])
        digit = sum(48 <= c < 58 for c in w)
        second = w[max(len(w) - 2, 0)]
        tail = (w[-1] * 256 + (second if second not in ALNUM else 0)) if punct[-1] else 0
        case = 0 if upper == 0 else 2 if upper >= max(2, (len(w) - sum(punct)) * 0.6) else 1
        shape = tail + (case << 20) + (min(digit, 3) << 24) + (min(sum(punct), 4) << 28) + (int(h == last) << 32) + (min(len(w), 24) // 4 << 36)
        words.append(h)
        shapes.append(mix(shape ^ 0x51A9E))
        last = h
    n = Counter()
    for hs, most in ((words, 2), (shapes, 3)):
        for k in range(1, most + 1):
            for i in range(len(hs) - k + 1):
                n[mix((gram(hs[i : i + k]) + k) & M) >> (64 - BITS)] += 1
    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    value = {c: f32(math.log1p(t)) for c, t in n.items()}
    norm = math.sqrt(sum(v * v for v in value.values()))
    return {c: v / norm for c, v in sorted(value.items())}


TEXTS = ["Hello, HELLO world!! 12 x9 wörld", "", None, " \n\t", "a", "a a a B. (c) --", "one", "one", "Ünïcode Wörds -- 漢字 и так далее...", "x" * 30 + " " + "Y" * 30, "don't stop: 3.14, 1,000; end. nbsp"]


@pytest.mark.parametrize(("extract", "plain"), [(features.toxic_features, toxic), (features.quality_features, good)], ids=["toxicity", "quality"])
def test_features(spark, extract, plain):
    import pyarrow as pa

    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(25).collect()] + TEXTS
    data, offsets = tk.raw(pa.array(texts, pa.string()))
    of, cell, value = extract(data, offsets, BITS)
    got = [{} for _ in texts]
    for t, c, v in zip(of.tolist(), cell.tolist(), value.tolist(), strict=True):
        assert c not in got[t]
        got[t][c] = v
    for g, text in zip(got, texts, strict=True):
        want = plain(text)
        assert sorted(g) == sorted(want) and all(g[c] == pytest.approx(want[c], rel=1e-6) for c in g)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_scores(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(quality, "BITS", BITS)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    w = rng.standard_normal(1 << BITS).astype(np.float32)
    got = {r["doc_id"]: r["expected_severity"] for r in ordinal.severity(df, np.concatenate([w, [0.5, 1.5]]).astype(np.float32)).collect()}
    for i, t in enumerate(TEXTS):
        eta = sum(float(w[c]) for c in toxic(t))
        assert got[i] == pytest.approx(sigmoid(eta - 0.5) + sigmoid(eta - 1.5), abs=1e-5)
    got = {r["doc_id"]: r["score"] for r in quality.score(df, np.append(w, np.float32(0.25))).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == pytest.approx(sigmoid(sum(float(w[c]) * v for c, v in good(t).items()) + 0.25), abs=1e-5)


def rows_of(seed, n=120, size=40):
    rng = np.random.default_rng(seed)
    xs = []
    for _ in range(n):
        f = np.sort(rng.choice(size, rng.integers(0, 12), replace=False)).astype(np.int32)
        xs.append((f, rng.uniform(0.1, 1, len(f)).astype(np.float32)))
    y = np.array([int(sum(x[1][x[0] < size // 3]) + rng.normal(0, 0.3) > 0.8) for x in xs])
    return xs, y, size


def plain_ftrl(xs, y, size, epochs):
    """Per coordinate, with dictionaries."""
    z, n, w = dict.fromkeys(range(size + 1), 0.0), dict.fromkeys(range(size + 1), 0.0), dict.fromkeys(range(size + 1), 0.0)
    order = np.random.default_rng(7).permutation(len(y)).tolist()
    for _ in range(epochs):
        for at in range(0, len(order), quality.BATCH):
            g = {}
            for i in order[at : at + quality.BATCH]:
                row = [*zip(xs[i][0].tolist(), xs[i][1].tolist(), strict=True), (size, 1.0)]
                p = sigmoid(max(-30, min(30, sum(w[f] * v for f, v in row))))
                for f, v in row:
                    g[f] = g.get(f, 0.0) + (p - y[i]) * v
            for f, x in g.items():
                z[f] += x - (math.sqrt(n[f] + x * x) - math.sqrt(n[f])) / quality.ALPHA * w[f]
                n[f] += x * x
                l1 = 0 if f == size else quality.L1
                w[f] = 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((quality.BETA + math.sqrt(n[f])) / quality.ALPHA + quality.L2)
    return np.array([w[f] for f in range(size + 1)])


def test_ftrl():
    xs, y, size = rows_of(1)
    assert quality.ftrl(xs, y, size, 3) == pytest.approx(plain_ftrl(xs, y, size, 3), abs=1e-9)


def test_quality_cut_is_where_both_classes_are_told_apart():
    xs, y, size = rows_of(4, 600)
    w = quality.fit(xs, y, size)
    s = np.array([sigmoid(float(w[x[0]] @ x[1]) + w[size]) for x in xs])
    balanced = lambda c: ((s >= c)[y == 1].mean() + (s < c)[y == 0].mean()) / 2
    assert balanced(quality.CUT) >= max(balanced(c) for c in np.linspace(0.02, 0.98, 49)) - 0.05


def plain_ordinal(xs, toxic_rows, size):
    """The same updates, row by row, with the likelihood's slope taken by differences."""
    ratio, z_score, held = ordinal.odds(xs, toxic_rows, size)
    y = ordinal.grades(xs, toxic_rows, (ratio > ordinal.MARKER_ODDS) & (held >= ordinal.MARKER_ROWS))
    use = np.abs(z_score) >= ordinal.LEAST_Z
    theta, w, z, n, tn = [2.0, 3.0], [0.0] * size, [0.0] * size, [0.0] * size, [1.0, 1.0]
    order = np.random.default_rng(11).permutation(len(y)).tolist()

    def loss(k, eta, th):
        edge = [-math.inf, *th, math.inf]
        cum = lambda e: 0.0 if e == -math.inf else 1.0 if e == math.inf else sigmoid(e - eta)
        return -math.log(max(cum(edge[k + 1]) - cum(edge[k]), 1e-300))

    h = 1e-5
    for _ in range(ordinal.EPOCHS):
        for at in range(0, len(order), ordinal.BATCH):
            g, gt = {}, [0.0, 0.0]
            batch = order[at : at + ordinal.BATCH]
            if not any(use[f] for i in batch for f in xs[i][0]):
                continue
            for i in batch:
                fs = [f for f in xs[i][0].tolist() if use[f]]
                eta, k = sum(w[f] for f in fs), int(y[i])
                slope = (loss(k, eta + h, theta) - loss(k, eta - h, theta)) / (2 * h)
                for f in fs:
                    g[f] = g.get(f, 0.0) + slope
                for j in range(2):
                    up, down = list(theta), list(theta)
                    up[j] += h
                    down[j] -= h
                    gt[j] += (loss(k, eta, up) - loss(k, eta, down)) / (2 * h)
            for f, x in g.items():
                z[f] += x - (math.sqrt(n[f] + x * x) - math.sqrt(n[f])) / ordinal.ALPHA * w[f]
                n[f] += x * x
                w[f] = 0.0 if abs(z[f]) <= ordinal.L1 else -(z[f] - math.copysign(ordinal.L1, z[f])) / ((ordinal.BETA + math.sqrt(n[f])) / ordinal.ALPHA + ordinal.L2)
            for j in range(2):
                tn[j] += gt[j] ** 2
                theta[j] -= 0.3 * gt[j] / math.sqrt(tn[j])
            theta[1] = max(theta[1], theta[0] + 0.1)
    return np.array(w + theta)


def test_cumulative_link():
    rng = np.random.default_rng(3)
    xs, toxic_rows = [], []
    for i in range(300):
        t = i % 4 == 0
        f = set(rng.choice(60, rng.integers(3, 15), replace=False).tolist())
        f |= set(rng.choice(np.arange(60, 90), rng.integers(1, 14), replace=False).tolist()) if t else set()
        xs.append((np.array(sorted(f), np.int32), np.ones(len(f), np.float32)))
        toxic_rows.append(int(t))
    toxic_rows = np.array(toxic_rows)
    got, want = ordinal.fit(xs, toxic_rows, 90), plain_ordinal(xs, toxic_rows, 90)
    assert len(set(ordinal.grades(xs, toxic_rows, np.arange(90) >= 60).tolist())) == 3
    assert got == pytest.approx(want, abs=1e-3) and got[-2] < got[-1]
    # one weight vector serves both thresholds: the chance of a higher grade is always the lesser one
    eta = np.linspace(-5, 8, 50)
    assert (1 / (1 + np.exp(-(eta - got[-1]))) < 1 / (1 + np.exp(-(eta - got[-2])))).all()


def test_samples(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(7, 0), (None, 1), (60, None), (99, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(7, "another"), (7, "a third"), (None, "no id"), (60, "no label"), (8, None)], "doc_id long, text string")
    rows = features.sample(docs, labels, "toxic", 1000).collect()
    assert len(rows) == 50 and len({r["h"] for r in rows}) == 50
    same = {r["h"]: (r["text"], r["y"]) for r in features.sample(docs.repartition(7), labels.repartition(3), "toxic", 1000).collect()}
    assert same == {r["h"]: (r["text"], r["y"]) for r in rows}
    few = features.sample(docs, labels, "toxic", 20).collect()
    assert len(few) <= 20 and {r["h"] for r in few} <= set(same)


def test_odd_rows(spark):
    """Nulls, blanks, very long texts, repeated rows, and columns with the names that the operators use."""
    long = "Some words, WORDS and 12 numbers. " * 40_000
    rows = [(None, None), (1, ""), (2, " \n"), (3, long), (4, "idiot moron"), (4, "idiot moron"), (5, long + "idiot")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("score", "expected_severity", "label", "h", "y", "__id", "__key", "__text"):
        df = df.withColumn(c, F.lit("x"))
    w = np.zeros((1 << 10) + 2, np.float32)
    for c in toxic_cells("idiot", 10):
        w[c] = 3.0
    w[-2:] = [1.0, 2.0]
    out = sorted(((r["doc_id"] or 0, round(r["expected_severity"], 5)) for r in ordinal.severity(df, w).collect()))
    none, some = sigmoid(-1) + sigmoid(-2), None
    some = next(s for d, s in out if d == 4)
    assert out == [(d, round(none, 5)) for d in (0, 1, 2)] + [(3, out[3][1]), (4, some), (4, some), (5, out[6][1])]
    assert out[6][1] > out[3][1] - 1e-6 and some > 1.5
    assert ordinal.severity(df, w).columns == [c for c in df.columns if c != "expected_severity"] + ["expected_severity"]
    q = quality.score(df, np.append(np.full(1 << 10, 0.1, np.float32), np.float32(0.5)))
    assert q.columns == ["doc_id", "score"]
    got = sorted((r["doc_id"] or 0, round(r["score"], 6)) for r in q.collect())
    assert [s for d, s in got if d < 3] == [round(sigmoid(0.5), 6)] * 3 and got[4] == got[5] and len(got) == 7
    for f, column in ((ordinal.train, "toxic"), (quality.train, "quality")):
        labels = spark.createDataFrame([(4, 1), (3, 0), (1, 0)], f"doc_id long, {column} int")
        assert np.isfinite(f(df, labels)).all()
    assert ordinal.severity(df.limit(0), w).collect() == [] and quality.score(df.limit(0), w[:-1]).collect() == []


def toxic_cells(word, bits):
    return {h >> (64 - bits) for h in [word_hash(word.encode()), *[mix(poly(word.encode()[:n]) ^ (n * 0x1000193)) for n in (4, 5)]]}


def test_words_match_a_regex():
    text = "Ab-cd 'quoted' été x_y 12a"
    assert [lower(text.encode())[s:e].decode() for s, e in runs(lower(text.encode()), lambda c: c in ALNUM)] == re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
