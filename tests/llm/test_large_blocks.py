"""Blocks of many sets: near copies of one text, chains whose ends share nothing, and both at once."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import setjoin


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def copies(rng, n, words=80, most=3):
    base = [f"v{i}" for i in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.integers(0, most + 1)):
            t[rng.integers(words)] = f"n{rng.integers(10**6)}"
        out.append(" ".join(t))
    return out


def chain(n, words=60, step=2):
    return [" ".join(f"c{i * step + j}" for j in range(words)) for i in range(n)]


@pytest.mark.parametrize("name", ["copies", "far copies", "chain", "both"])
def test_large_blocks(spark, monkeypatch, name):
    rng = np.random.default_rng(len(name))
    near = copies(rng, 90)
    texts = {"copies": near, "far copies": copies(rng, 70, most=6), "chain": chain(70), "both": near[:40] + chain(40) + [f"{a} {b}" for a, b in zip(near[40:60], chain(20), strict=True)]}[name]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    monkeypatch.setattr(setjoin, "BLOCK", 6)
    monkeypatch.setattr(setjoin, "PIVOTS", 3)
    got = sorted(map(tuple, setjoin.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()))
    assert got == brute(rows, 4, 85, 100)


def test_sending_does_not_walk_all_buckets():
    """Steps follow the elements sent, however many buckets there are."""
    import numpy as np

    from millrace.llm import setjoin

    t = np.sort(np.random.default_rng(3).integers(0, 2**64, 5000, dtype=np.uint64))
    for parts in (1, 7, 4096, 3_000_000_000):
        of = setjoin.buckets(t, parts)
        assert int(of.max()) < parts and (np.diff(of.astype(np.int64)) >= 0).all()
        got = list(setjoin._ranges(of))
        assert len(got) == len(np.unique(of)) <= len(t) and got[0][1] == 0 and got[-1][2] == len(t)
        assert all((of[p:q] == b).all() for b, p, q in got) and all(x[2] == y[1] for x, y in zip(got, got[1:], strict=False))
    assert list(setjoin._ranges(t[:0])) == []


def test_copies_in_different_tasks_make_no_ties(spark, monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(120)) for i in range(20)]
    texts.append(" ".join([*texts[0].split()[:-1], "end"]))  # linked with the first
    rows = [(c * 1000 + i, t) for c in range(12) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12, (F.col("doc_id") / 1000).cast("int"))
    real, n = setjoin.ties, []
    monkeypatch.setattr(setjoin, "ties", lambda *a: n.append((t := real(*a).cache()).count()) or t)
    got = {r["doc_id"]: r["component_id"] for r in setjoin.jaccard_join(docs, 4, 85, 100).collect()}
    assert got == {d: 0 if d % 1000 == 20 else d % 1000 for d, _ in rows}
    assert n[0] <= 2 * setjoin.LEAST_BUCKETS, "only two different texts have lists in common"


def members_of(monkeypatch):
    """How many sets each call of ``block_links`` gets."""
    real, n = setjoin.block_links, []
    monkeypatch.setattr(setjoin, "block_links", lambda ws, docs, members, *a: n.append(members.count()) or real(ws, docs, members, *a))
    return n


def test_sets_of_far_sizes_make_no_block(spark, monkeypatch):
    """Long texts that each quote a short one used to be one block, and all its sets were compared."""
    short = [f"s{j}" for j in range(32)]
    rows = [(0, " ".join(short))] + [(i, " ".join([*(f"w{i}x{j}" for j in range(300)), *short])) for i in range(1, 41)]
    rows += [(50, rows[1][1].replace("w1x0 ", "other "))]  # linked with 1
    n = members_of(monkeypatch)
    monkeypatch.setattr(setjoin, "FREQUENT", 1000)
    got = sorted(map(tuple, setjoin.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()))
    assert got == brute(rows, 4, 85, 100) and n == [2]


def test_chance_of_one_common_shingle_makes_no_block(spark, monkeypatch):
    def text(i):
        """Four phrases, each shared with one other text; 23 shingles."""
        shared = [" ".join(f"p{j % 30}d{d}w{w}" for w in range(4)) for d in (1, 3) for j in (i, i - d)]
        return " ".join(f"u{i}x{k} v{i}x{k} {s}" for k, s in enumerate(shared)) + f" y{i} z{i}"

    rows = [(i, text(i)) for i in range(30)]
    n = members_of(monkeypatch)
    monkeypatch.setattr(setjoin, "FREQUENT", 1000)
    monkeypatch.setattr(setjoin, "MOST_LIGHT", 0)
    got = sorted(map(tuple, setjoin.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()))
    assert got == brute(rows, 4, 85, 100) and n == [0]


@pytest.mark.parametrize("bits", [4, 10])
def test_links_do_not_depend_on_what_lists_keep(spark, monkeypatch, bits):
    rng = np.random.default_rng(bits)
    texts = copies(rng, 60) + chain(30)
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    monkeypatch.setattr(setjoin, "KEPT_BITS", np.uint64((1 << bits) - 1 << 64 - bits))
    monkeypatch.setattr(setjoin, "FREQUENT", 1000)
    got = sorted(map(tuple, setjoin.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()))
    assert got == brute(rows, 4, 85, 100)
