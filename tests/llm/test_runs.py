"""Periodic runs against all periods tried one by one."""

import binascii
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, runs

SF = "/root/testdata/sf0.001"


def brute(ids, least=24, times=3):
    ids, found = np.asarray(ids), {}
    n = len(ids)
    for q in range(1, n // times + 1):
        same = np.concatenate([[0], ids[:-q] == ids[q:], [0]]).astype(np.int8)
        edge = np.diff(same)
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if b - a + q >= max(least, times * q):
                found.setdefault((int(a), int(b) + q), q)  # q grows, so the first is the smallest
    return sorted((a, b - a, q) for (a, b), q in found.items())


def test_z_function():
    rng = np.random.default_rng(1)
    for _ in range(300):
        s = rng.integers(0, 2, rng.integers(0, 40)).tolist()
        z = runs.z_function(s)
        assert z[1:] == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]


@pytest.mark.parametrize("least", [24, 12])
def test_random_sequences(least):
    rng = np.random.default_rng(least)
    some = 0
    for t in range(1500):
        n = int(rng.integers(0, 400))
        ids = rng.integers(0, rng.choice([1, 2, 3, 50]), n)
        for _ in range(rng.integers(0, 4)):  # runs over any midpoint, next to and inside one another
            p, length = int(rng.integers(1, 40)), int(rng.integers(1, 160))
            at = int(rng.integers(0, n + 1))
            block = np.resize(rng.integers(0, 4, p), length)[: max(0, n - at)]
            ids[at : at + len(block)] = block
        got = runs.find_runs(ids, least)
        assert got == brute(ids, least), t
        some += len(got)
    assert some > 1000


def test_words_of_fibonacci_and_thue_morse():
    f = [[0], [0, 1]]
    while len(f[-1]) < 1200:
        f.append(f[-1] + f[-2])
    t = [bin(i).count("1") & 1 for i in range(2048)]
    for ids in (f[-1], t, t[:700] * 3, [7] * 1000, [*range(300), 5, *([1, 2, 3] * 100), *range(300)], [1] * 23, [1] * 24, list(range(8)) * 3, list(range(9)) * 3, [*range(9), *range(9), *range(8)]):
        assert runs.find_runs(np.array(ids)) == brute(ids)
    with pytest.raises(ValueError, match="three"):
        runs.find_runs(np.array([1] * 99), 24, 2)


def test_long_texts_take_n_log_n():
    import time

    for ids in (np.zeros(300_000, np.int64), np.arange(300_000) % 1000, np.arange(300_000), np.random.default_rng(0).integers(0, 3, 300_000)):
        began = time.perf_counter()
        got = runs.find_runs(ids)
        assert time.perf_counter() - began < 40
        if len(np.unique(ids)) in (1, 1000):
            assert got == [(0, 300_000, len(np.unique(ids)))]


def plain(doc_id, text, damage=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = binascii.crc32(str(doc_id).encode())
    g = h // 10
    if damage and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    number = {}
    got = brute([number.setdefault(x, len(number)) for x in w]) if n else []
    dropped = {i for s, m, q in got for i in range(s + q, s + m)}
    best = max(got, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    tell = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(got), *tell, sha("".join(f"{s},{m},{q}\n" for s, m, q in got)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_by_plain_python(spark):
    got = queries.op11_runs(spark, SF)
    want = [plain(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 5


def test_odd_rows(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(None, passage), (None, None), (1, None), (2, ""), (3, " \n\t\x0b "), (4, "one"), (4, "one"), (5, "a b " * 20), (5, "a b " * 20), (6, "ä b \x1c " * 30), (7, f"{passage}\n" * 5), (8, "x " * 100_000)]
    rows += [(i, passage * (i % 4) + " b" * (i % 50)) for i in range(20, 140)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("runs", "collapsed", "start", "length", "period", "n", "h", "g", "words", "Runs"):
        if c != "Runs":
            df = df.withColumn(c, F.lit("x"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_runs(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r))
    want = [plain(d, t, damage=d is not None) for d, t in rows]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=key) == sorted(want, key=key)
    out = runs.periodic_runs(df)
    assert out.columns == ["doc_id", "start", "length", "period", "n", "h", "g", "words", "runs", "collapsed"]
    assert runs.periodic_runs(df.limit(0)).collect() == []
    five = out.where("doc_id = 5").first()
    assert [tuple(r) for r in five["runs"]] == [(0, 40, 2)] and five["collapsed"] == "a b"
