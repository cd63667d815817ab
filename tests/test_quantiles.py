"""Order statistics against sorted lists, on odd values and a group that has most of the rows."""

import math
import random
import statistics

from pyspark.sql import functions as F

from millrace.operators import quantiles

NAN, INF = float("nan"), float("inf")


def sort_key(x):
    return (math.isnan(x), 0 if math.isnan(x) else x, 0 if math.isnan(x) else math.copysign(1, x))


def test_against_sorted_lists(spark):
    rng = random.Random(4)
    groups = {
        "hot": [rng.gauss(0, 1e3) for _ in range(6000)] + [0.1 + k * 2.0**-60 for k in range(50)],
        "odd": [0.0, -0.0, INF, -INF, NAN, 5e-324, -5e-324, 1.7976931348623157e308, -1.0, -1.0, -1.0000000000000002, 1.0],
        "one": [3.5], "same": [7.0] * 400, None: [1.0, 2.0, None], "none": [None, None],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").withColumn("name", F.lit("x")).withColumn("rank", F.lit(1))
    got = {r["g"]: r for r in quantiles.nearest(df, ["g"], "v", {"p1": 1, "p50": 50, "p95": 95, "p100": 100}).collect()}
    mid = {r["g"]: r["median"] for r in quantiles.medians(df, ["g"], "v").collect()}
    assert set(got) == set(mid) == {"hot", "odd", "one", "same", None}
    for g, r in got.items():
        vs = sorted((v for v in groups[g] if v is not None), key=sort_key)
        for name, p in (("p1", 1), ("p50", 50), ("p95", 95), ("p100", 100)):
            want = vs[max(math.ceil(len(vs) * p / 100) - 1, 0)]
            assert r[name] == want or (math.isnan(r[name]) and math.isnan(want)), (g, name)
        if g != "odd":
            assert mid[g] == statistics.median(vs)


def test_bounded_work(spark):
    df = spark.range(30_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 30_011).cast("double").alias("v"))
    plan = quantiles.at_ranks(df, ["g"], "v", spark.createDataFrame([(0, "m", 7000), (1, "m", 20_000)], "g long, name string, rank long"))
    assert [r["g"] for r in plan.collect()] == [0], "a rank beyond the group is left out"
    assert quantiles.nearest(df.limit(0), ["g"], "v", {"p": 50}).collect() == []
    assert quantiles.spread_pct(df.where("v between 10 and 20"), [], "v").first()["spread"] == 10 / 15 * 100
