"""Sharding and decontamination on nulls, blanks, very long texts, repeated rows, empty tables and clashing columns, value by value."""

import binascii
import hashlib
import math
import re

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import decontam, setjoin, sharding

LONG = " ".join(f"w{i % 997} x{i % 31}" for i in range(60_000))
ROWS = [(None, "no id"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (4, "two"), (5, LONG), (6, "ünï 漢字"), (-7, "minus"), (2**62, "far")]


def clashing(spark, rows, ddl, names):
    df = spark.createDataFrame(rows, ddl)
    for c in names:
        df = df.withColumn(c, F.lit("x"))
    return df


def rendezvous(rows, weights, grown=1.0):
    """``(doc_id, size, crc, shard, slot, grown_shard)`` by plain Python."""
    out = []
    for d, t in rows:
        k, b = "" if d is None else str(d), (t or "").encode()
        scores = []
        for i, w in enumerate([*weights, grown]):
            u = (int(hashlib.md5(f"{k}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
            scores.append(w / -math.log(u))
        crc = binascii.crc32(b)
        block = int(hashlib.md5(f"{k}:{crc}".encode()).hexdigest()[:8], 16) % sharding.BLOCKS
        best = lambda s: max(range(len(s)), key=lambda i: (s[i], -i))
        out.append((d, len(b) + 1, crc, best(scores[:-1]), block, best(scores)))
    slots = {}
    done = []
    for d, size, crc, shard, _, g in sorted(out, key=lambda r: (r[3], r[4], r[0] is not None, r[0] or 0, r[2], r[1])):
        slots[shard] = slots.get(shard, -1) + 1
        done.append((d, size, crc, "key", shard, slots[shard], g))
    return sorted(done, key=str)


def test_sharding_by_plain_python(spark):
    names = ["size", "shard", "slot", "law", "grown_shard", "text_crc32", "k", "h", "block", "n", "s0", "r", "first"]
    rows = ROWS + [(100 + i, f"text {i % 50}") for i in range(400)]
    for weights, grown in (([1.0] * 16, 1.0), ([1.0, 2.5, 0.5], 4.0), ([3.0], 1.0)):
        got = sharding.assign(clashing(spark, rows, "doc_id long, text string", names), weights, grown).collect()
        assert sorted((tuple(r) for r in got), key=str) == rendezvous(rows, weights, grown)
    assert sharding.assign(clashing(spark, [], "doc_id long, text string", names), [1.0] * 16).collect() == []


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def grams(w, k=5):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def contained(docs, items):
    out = []
    for d, t in docs:
        w = words(t)
        have = grams(w)
        for i, x in items:
            v = words(x)
            s = grams(v)
            n = int(any(w[j : j + len(v)] == v for j in range(len(w) - len(v) + 1))) if 0 < len(v) < 5 else len(s & have) if len(v) >= 5 else 0
            if s and 5 * n >= 4 * len(s):
                out.append((d, i, len(s), n))
    return sorted(out, key=str)


def test_containment_by_plain_python(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pool = [f"q{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(pool, n))) for i, n in enumerate((1, 2, 4, 5, 6, 8, 15, 21, 40, 90))] + [(20, None), (21, ""), (22, "?!"), (None, "null id item of seven words here"), (3, "q1 q2 q3 q4 q5 q6"), (3, "q1 q2 q3 q4 q5 q6"), (30, "ÉTÉ")]
    docs = [*ROWS, (40, "before null ID item, of seven WORDS here after"), (41, "q1 Q2 q3 q4 q5 q6 again q1 q2 q3 q4 q5 q6"), (42, "été"), (42, "ÉTÉ"), (43, "É")]
    for i, t in items[:10]:
        docs += [(100 + i, f"{LONG} {t}, {LONG}"), (200 + i, t.upper()), (200 + i, t), (300 + i, " ".join(t.split()[:-1]))]
    names = ["item_id", "n_item", "n_common", "__hit"]
    d, q = clashing(spark, docs, "doc_id long, text string", names), clashing(spark, items, "item_id long, text string", ["doc_id", "n_item"])
    want = contained(docs, items)
    assert sorted((tuple(r) for r in decontam.containment(d, q).collect()), key=str) == want and len(want) > 30
    gone = {r[0] for r in want}
    kept = decontam.clean(d, q)
    assert kept.columns == d.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(x or 0 for x, _ in docs if x is None or x not in gone)
    for items_a_block, bytes_a_block in ((2, 1 << 20), (1000, 60), (1, 1)):
        monkeypatch.setattr(decontam, "BLOCK_ITEMS", items_a_block)
        monkeypatch.setattr(decontam, "BLOCK_BYTES", bytes_a_block)
        assert sorted((tuple(r) for r in decontam.containment(spark.createDataFrame(docs[-20:], "doc_id long, text string"), q).collect()), key=str) == contained(docs[-20:], items)
    assert decontam.containment(d.limit(0), q).collect() == [] == decontam.containment(d, q.limit(0)).collect()


def test_buckets_follow_the_shingles(spark, monkeypatch):
    seen = []
    whole = setjoin.ties
    monkeypatch.setattr(setjoin, "ties", lambda *a: seen.append(a[-1]) or whole(*a))
    df = spark.createDataFrame([(i, " ".join(f"v{i % 7}x{j}" for j in range(120))) for i in range(40)], "doc_id long, text string")
    once = sorted(map(tuple, setjoin.jaccard_join(df).collect()))
    monkeypatch.setattr(setjoin, "BUCKET_SHINGLES", 50)
    assert sorted(map(tuple, setjoin.jaccard_join(df).collect())) == once and seen == [setjoin.LEAST_BUCKETS, -(-40 * 116 // 50)]
    assert len({c for _, _, c in once}) == 7
