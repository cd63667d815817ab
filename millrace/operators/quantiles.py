"""Exact order statistics of groups of any size.

A value is mapped to 64 bits that sort as it does, and a rank is sought by its digits: one pass counts the values of each
group by the first 16 bits, which combines map-side to at most 65,536 counts a group and task; the digit in which the rank
falls is fixed, and the next pass counts the values with that digit by the next 16 bits. A bin whose values are all equal
ends the search, as the fourth pass does. So no task holds the values of a group, one group may have most of the rows, and
each pass reads the group and the value alone.

Null values are left out; a group without any has no row. NaN is the greatest value; -0.0 counts before 0.0. A null group is a
group. Repeated rows count as often as they are there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.tables import Workspace

DIGIT = 16
_FLIP = (1 << 63) - 1


def sorting_key(value: Column) -> Column:
    """64 bits of a double that sort as signed numbers as the double does."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double")).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(_FLIP))).otherwise(bits)


def _same(groups: list[str], other: str = "__r_") -> Column:
    return reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"{other}{g}")) for g in groups], F.lit(True))


def _aside(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"__r_{c}") if c in names else F.col(c) for c in df.columns])


def at_ranks(rows: DataFrame, groups: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """``ranks (groups..., name, rank)``, rank from 0 among the values of a group, as ``(groups..., name, value)``. Ranks that a group has not got are left out."""
    ws = Workspace(rows.sparkSession)
    v = F.col(value)
    live = rows.where(v.isNotNull()).select(*groups, v.alias("__v"), sorting_key(v).alias("__k"))
    targets = ranks.select(*groups, "name", F.col("rank").cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("prefix"))
    done: list[DataFrame] = []
    for nth in range(64 // DIGIT):
        shift = 64 - DIGIT * (nth + 1)
        here = live.withColumn("__p", F.shiftright("__k", shift))
        if nth:
            wanted = _aside(targets.select(*groups, "prefix").distinct(), groups)
            here = here.join(wanted, _same(groups) & (F.shiftright("__k", shift + DIGIT) == F.col("prefix")), "left_semi")
        bins = here.groupBy(*groups, "__p").agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.min("__k").alias("first"), F.max("__k").alias("last"))
        bins = ws.keep(bins, "bins")
        parent = F.shiftright("__p", DIGIT) if nth else F.lit(0).cast("bigint")
        # at most 2 ** DIGIT bins in a window
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*groups, "__parent").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = _aside(bins.withColumn("__parent", parent).withColumn("before", before), groups)
        inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
        hit = targets.join(placed, _same(groups) & (F.col("prefix") == F.col("__parent")) & inside)
        hit = ws.keep(hit.select(*groups, "name", (F.col("rank") - F.col("before")).alias("rank"), F.col("__p").alias("prefix"), F.col("low"), (F.col("first") == F.col("last")).alias("known")), "targets")
        done.append(hit.where("known").select(*groups, "name", F.col("low").alias("value")))
        targets = hit.where("not known").select(*groups, "name", "rank", "prefix")
        ws.drop(bins)
        if targets.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def _sizes(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.count("*").alias("__n"))


def _wide(found: DataFrame, groups: list[str], names: list[str]) -> DataFrame:
    return found.groupBy(*groups).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def nearest(rows: DataFrame, groups: list[str], value: str, percents: dict[str, int]) -> DataFrame:
    """``(groups..., name, ...)``: for each name the smallest value that at least so many percent of its group's values do not exceed."""
    rank = lambda p: F.greatest(F.ceil((F.col("__n") * p) / F.lit(100)).cast("bigint") - 1, F.lit(0))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(p).alias("rank")) for name, p in percents.items()]))
    ranks = _sizes(rows, groups, value).select(*groups, asked.alias("a")).select(*groups, "a.name", "a.rank")
    return _wide(at_ranks(rows, groups, value, ranks), groups, list(percents))


def medians(rows: DataFrame, groups: list[str], value: str, name: str = "median") -> DataFrame:
    """``(groups..., median)``: the middle value of each group, or the mean of the two."""
    middle = F.explode(F.array(*[F.struct(F.lit(s).alias("name"), F.floor((F.col("__n") - 1 + i) / 2).alias("rank")) for i, s in enumerate(("__low", "__high"))]))
    ranks = _sizes(rows, groups, value).select(*groups, middle.alias("a")).select(*groups, "a.name", "a.rank")
    both = _wide(at_ranks(rows, groups, value, ranks), groups, ["__low", "__high"])
    return both.select(*groups, ((F.col("__low") + F.col("__high")) / 2.0).alias(name))


def spread_pct(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``(groups..., spread)``: (max - min) / median in percent, 0 for no positive median."""
    ends = rows.groupBy(*groups).agg(F.min(value).alias("__min"), F.max(value).alias("__max"))
    m = _aside(medians(rows, groups, value, "__m"), groups)
    pct = F.when(F.col("__m") > 0, (F.col("__max") - F.col("__min")) / F.nullif(F.col("__m"), F.lit(0.0)) * 100)
    return ends.join(m, _same(groups), "left").select(*groups, F.coalesce(pct, F.lit(0.0)).alias("spread"))
