"""Near-duplicate vectors at the ends of the double range, with odd ids, and in split buckets, against all pairs."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import neardup

SCHEMA = "vec_id long, embedding array<double>, label int"


def exact(rows, threshold):
    """``{row number: (links, component)}`` by exact rational arithmetic, over all pairs."""
    usable = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    f = {i: [Fraction(x) for x in rows[i][1]] for i in usable}
    t = Fraction(threshold)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    near = {i: {i} for i in range(len(rows))}
    for i in usable:
        for j in usable:
            if i < j and rows[i][2] == rows[j][2] and len(f[i]) == len(f[j]) and (d := dot(f[i], f[j])) > 0 and d * d >= t * t * dot(f[i], f[i]) * dot(f[j], f[j]):
                near[i].add(j)
                near[j].add(i)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(near[i]) - 1, min((rows[j][0] for j in seen if rows[j][0] is not None), default=None))
    return out


def result(spark, rows, threshold=0.93):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, neardup.near_duplicates(df, threshold).collect()), key=str)


def want(rows, threshold=0.93):
    told = exact(rows, threshold)
    return sorted(((r[0], told[i][0], told[i][1], r[0] is not None and r[0] == told[i][1]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("scale", [1.0, 1e200, 1e-170, 1e300, 5e-324, 2.0**-1000])
def test_extreme_doubles(spark, scale):
    rng = np.random.default_rng(7)
    base = [[1.0, 0.0, 0.0, 0.0], [0.83, 0.5577, 0.0, 0.0], [0.83, -0.5577, 0.0, 0.0], [1.0, 0.1, 0.0, 0.0]]
    base += [(rng.integers(-3, 4, 4) * 1.0).tolist() for _ in range(40)]
    if scale == 5e-324:
        base = [np.round(np.array(v) * 50).tolist() for v in base]
    rows = [(i, (np.array(v) * scale).tolist(), i % 2 if i >= 4 else 0) for i, v in enumerate(base)]
    assert result(spark, rows) == want(rows)


def test_scales_of_one_direction_link(spark):
    v = np.array([0.3, -0.7, 0.2])
    rows = [(i, (v * s).tolist(), 1) for i, s in enumerate((1.0, 1e300, 1e-300, 1e-10, 4.0, -1.0))]
    got = result(spark, rows)
    assert [r[1] for r in got] == [4, 4, 4, 4, 4, 0] and [r[2] for r in got] == [0, 0, 0, 0, 0, 5]


def test_odd_ids_and_rows(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    rows = [(None, v, 0), (None, v, 0), (5, v, 0), (5, w, 0), (6, w, 0), (6, w, 0), (None, [0.0, 0.0, 1.0], 0), (7, v, None), (8, None, 0), (9, [], 0), (10, [0.0, -0.0, 0.0], 0)]
    rows += [(11, [float("nan"), 1.0], 0), (12, [float("inf"), 1.0], 0), (13, [None, 1.0], 0), (14, [1.0, 2.0], 0), (15, [-0.0, 2.0], 0), (16, [0.0, 2.0], 0), (None, None, None)]
    assert result(spark, rows) == want(rows)
    assert result(spark, rows[:0]) == []


def test_split_buckets(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, (np.ones(16) + rng.standard_normal(16) * 0.2).tolist(), 3) for i in range(150)] + [(200 + i, rng.standard_normal(16).tolist(), 3) for i in range(100)]
    whole = result(spark, rows)
    monkeypatch.setattr(neardup, "SPLIT", 8)
    assert result(spark, rows) == whole == want(rows)


def test_split_pairs_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SPLIT", 4)
    dealt = spark.range(41).select(F.col("id").alias("c"), F.expr("int(id div 39)").alias("label"), F.lit(1).alias("code"), F.lit(2).alias("dim"))
    got = sorted(map(tuple, neardup.split_pairs(dealt.unionAll(dealt.withColumn("code", F.lit(9)))).collect()))
    assert got == [(i, j) for i in range(41) for j in range(i + 1, 41) if (i // 39) == (j // 39)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0)], SCHEMA)
    for c in ("sig", "v", "c", "code", "rep", "n_links", "component_id", "kept", "parts"):
        df = df.withColumn(c, F.lit("x"))
    assert sorted(map(tuple, neardup.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
