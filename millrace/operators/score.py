"""Scores of predictions against gold: a missing or invalid prediction is wrong, not excluded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import schema
from millrace.errors import none_of
from millrace.functions import cost, normalize

COUNTS = ("tp", "fp", "fn", "em", "support")


def as_set(name: str, v: Column, side: str) -> Column:
    """A normalised value as a set of strings: absent is empty, a scalar is a set of one. NaN equals nothing, so its text names the side."""
    if name in schema.SETS:
        return v
    value = v
    if name in schema.FLOATS + schema.INTEGERS:
        value = F.when(F.isnan(v), f"NaN {side}").otherwise((v + 0.0).cast("string"))
    return F.when(normalize.absent_normalised(name, v), F.array().cast("array<string>")).otherwise(F.array(value))


def field_counts(g: Column, p: Column, valid: Column) -> dict[str, Column]:
    """tp, fp, fn, em and support of one field of one document, from ``as_set`` values. Without a valid prediction all of gold is missed."""
    both = F.when(valid, F.size(F.array_intersect(g, p))).otherwise(0)
    more = F.when(valid, F.size(p)).otherwise(0)
    em = valid & (F.size(g) == both) & (F.size(p) == both)
    return {"tp": both, "fp": more - both, "fn": F.size(g) - both, "em": em.cast("int"), "support": F.size(g)}


def joined(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """``(doc_id, g struct, p struct, valid)``: every gold row, with its prediction if there is one."""
    g = gold.select("doc_id", F.struct(*schema.FIELDS).alias("g"))
    p = predictions.select("doc_id", "parsed", "schema_valid")
    return g.join(p, "doc_id", "left").select("doc_id", "g", F.col("parsed").alias("p"), F.coalesce("schema_valid", F.lit(False)).alias("valid"))


def per_field(pairs: DataFrame) -> DataFrame:
    """Counts, precision, recall, F1 and exact match of each field.

    One rule serves all fields, since a scalar is a set of at most one value: the plan has a normalisation for each field
    and side and one set of sums, and each document's sixteen rows are added up before they are shuffled.
    """
    # each value is normalised once, in a projection of its own
    plain = pairs.select("valid", *[normalize.norm_field(f, F.col(f"{s}.{f}")).alias(f"{s}__{f}") for f in schema.FIELDS for s in "gp"])
    each = [F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), as_set(f, F.col(f"g__{f}"), "g").alias("g"), as_set(f, F.col(f"p__{f}"), "p").alias("p")) for i, f in enumerate(schema.FIELDS)]
    long = plain.select("valid", F.explode(F.array(*each)).alias("x"))
    counts = long.select("x.ord", "x.field", *[c.cast("bigint").alias(n) for n, c in field_counts(F.col("x.g"), F.col("x.p"), F.col("valid")).items()])
    sums = counts.groupBy("ord", "field").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in COUNTS])
    fields = pairs.sparkSession.createDataFrame(list(enumerate(schema.FIELDS)), "ord int, field string")
    whole = fields.join(F.broadcast(sums), ["ord", "field"], "left")  # one row for each field
    return _rated(whole.select("ord", "field", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n", *COUNTS)]))


def _rated(sums: DataFrame) -> DataFrame:
    p, r = cost.ratio(F.col("tp"), F.col("tp") + F.col("fp")), cost.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumn("precision", p).withColumn("recall", r).withColumn("f1", cost.f1(F.col("precision"), F.col("recall"))).withColumn("em_rate", cost.ratio(F.col("em"), F.col("n")))


def merged(parts: DataFrame) -> DataFrame:
    """Counts of the same fields from several runs or shards as one: counts add up, ratios are worked out anew."""
    return _rated(parts.groupBy("ord", "field").agg(*[F.sum(c).alias(c) for c in ("n", *COUNTS)]))


def compared(headers: DataFrame) -> DataFrame:
    """Arms by macro F1, best first; equal ones keep the order of ``ord``."""
    return headers.orderBy(F.desc("macro_f1"), "ord")


def placed(headers: DataFrame) -> DataFrame:
    """The same order as a column ``place``, from 1; one row for each arm, so one window holds them."""
    return headers.withColumn("place", F.row_number().over(Window.orderBy(F.desc("macro_f1"), "ord")).cast("bigint"))


def macro_f1(fields: DataFrame) -> DataFrame:
    """The mean of the unrounded F1s, added up in the fields' order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "f1"))), lambda x: x["f1"])
    return fields.agg((F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x) / len(schema.FIELDS)).alias("macro_f1"))


def empty_posting() -> Column:
    value = lambda f: F.lit("unknown") if f in schema.ENUMS else F.array().cast("array<string>") if f in schema.SETS else F.lit(None).cast(schema.field_type(f))
    return F.struct(*[value(f).alias(f) for f in schema.FIELDS])


def null_baseline(gold: DataFrame) -> DataFrame:
    """Pairs of gold and the empty posting, to be scored like an arm."""
    return gold.select("doc_id", F.struct(*schema.FIELDS).alias("g"), empty_posting().alias("p"), F.lit(True).alias("valid"))


def header(pairs: DataFrame, gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """n, share of valid predictions, and gold rows without one."""
    missing = gold.join(predictions, "doc_id", "left_anti").agg(F.count("*").alias("n_missing"))
    return pairs.agg(F.count("*").alias("n"), cost.ratio(F.count_if("valid"), F.count("*")).alias("schema_valid_rate")).crossJoin(missing)  # one row each


def faults(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """``(doc_id, what)``: ids that occur twice on a side, and predictions for ids that gold lacks."""
    twice = [side.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(f"duplicate in {name}").alias("what")) for side, name in ((gold, "gold"), (predictions, "predictions"))]
    extra = predictions.select("doc_id").join(gold.select("doc_id"), "doc_id", "left_anti").distinct().select("doc_id", F.lit("unknown to gold").alias("what"))
    return twice[0].unionByName(twice[1]).unionByName(extra)


def check(gold: DataFrame, predictions: DataFrame) -> None:
    """Any fault is an error; the first kind found is named with its ids."""
    found = faults(gold, predictions)
    for what in ("duplicate in gold", "duplicate in predictions", "unknown to gold"):
        none_of(found.where(F.col("what") == what), "doc_id", f"ids {what}")


def teacher_predictions(pool: DataFrame, gold: DataFrame) -> DataFrame:
    """The labels of the gold ids in the pool, as predictions."""
    kept = pool.join(gold.select("doc_id"), "doc_id", "left_semi")
    return kept.select("doc_id", F.struct(*schema.FIELDS).alias("parsed"), F.lit(True).alias("schema_valid"))
