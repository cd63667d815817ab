"""Latency, throughput and cost summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import cost
from millrace.operators import quantiles


def latency_summary(samples: DataFrame, by: str, value: str = "ms") -> DataFrame:
    """n, p50, p95, mean, min, max and sample deviation (0 for one sample) of each group; percentiles are by nearest rank."""
    v = F.col(value)
    plain = samples.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"))
    ranks = quantiles.nearest(samples, [by], value, {"p50": 50, "p95": 95}).withColumnRenamed(by, "__by")
    return plain.join(ranks, F.col(by).eqNullSafe(F.col("__by")), "left").select(by, "n", "p50", "p95", "mean", "min", "max", "stdev")


def median_pass(passes: DataFrame) -> DataFrame:
    """Of the repeats (arm, ord, p50) the one closest to the arm's median p50; the first of equals."""
    med = quantiles.medians(passes, ["arm"], "p50", "med")
    return passes.join(med, "arm").groupBy("arm").agg(F.min_by("ord", F.struct(F.abs(F.col("p50") - F.col("med")), F.col("ord"))).alias("ord"))


def best_rows(sweep: DataFrame) -> DataFrame:
    """The fastest usable row (first of equals) and the largest usable batch of each arm; rows out of memory are not usable."""
    ok = ~F.col("oom")
    fastest = F.max_by(F.when(ok, F.col("batch_size")), F.when(ok, F.struct(F.col("throughput"), -F.col("ord"))))
    return sweep.groupBy("arm").agg(fastest.alias("fastest_batch"), F.max(F.when(ok, F.col("throughput"))).alias("throughput"), F.max(F.when(ok, F.col("batch_size"))).alias("largest_batch"))


def index_build(timings: DataFrame) -> DataFrame:
    """Construction plus what the first call takes beyond the median of the others: (arm, ord, ms), ord 0 the construction."""
    rest = quantiles.medians(timings.where("ord > 1"), ["arm"], "ms", "rest").withColumnRenamed("arm", "__arm")
    one = timings.groupBy("arm").agg(*[F.max(F.when(F.col("ord") == i, F.col("ms"))).alias(c) for i, c in enumerate(("built", "first"))])
    both = one.join(rest, F.col("arm").eqNullSafe(F.col("__arm")), "left")
    return both.select("arm", (F.col("built") + F.greatest(F.lit(0.0), F.col("first") - F.col("rest"))).alias("build_ms"))


def teacher_summary(calls: DataFrame) -> DataFrame:
    """Calls ``(ok, ms, input_tokens, output_tokens, model)``: failed ones are counted and left out of everything else; cost is at standard rates."""
    ok = F.col("ok")
    of = lambda c: F.when(ok, c)
    usd = F.sum(of(cost.cost(F.col("input_tokens"), F.col("output_tokens"), F.col("model"))))
    out = calls.agg(F.count_if(ok).alias("n_calls_ok"), F.count_if(~ok).alias("n_calls_failed"), F.avg(of(F.col("input_tokens"))).alias("mean_prompt_tokens"), F.avg(of(F.col("output_tokens"))).alias("mean_completion_tokens"), usd.alias("total_usd"))
    p50 = quantiles.nearest(calls.where(ok).withColumn("__all", F.lit(0)), ["__all"], "ms", {"p50_ms": 50}).drop("__all")
    out = out.join(p50, F.lit(True), "left").select("n_calls_ok", "n_calls_failed", "p50_ms", "mean_prompt_tokens", "mean_completion_tokens", "total_usd")  # one row each
    return out.withColumn("cost_per_1k_docs_usd", F.try_divide("total_usd", "n_calls_ok") * 1000.0).withColumn("throughput_docs_per_s", F.coalesce(F.try_divide(F.lit(1000.0), "p50_ms"), F.lit(0.0)))


def latest_checkpoint(paths: DataFrame) -> DataFrame:
    """The path with the highest step number; others are ignored."""
    step = F.regexp_extract("path", r"checkpoint-(\d+)$", 1).try_cast("bigint")
    return paths.agg(F.max_by("path", step).alias("path"), F.max(step).alias("step"))


def final_losses(log: DataFrame, reported: DataFrame) -> DataFrame:
    """Losses of a run: what it reports of itself first, ``reported (train_loss, eval_loss, best_metric)`` in one row, and the log for what it does not; NaN for what neither has."""
    nan = F.lit(float("nan"))
    j = losses(log).crossJoin(reported)  # one row each
    return j.select(F.coalesce("train_loss", "final_loss", nan).alias("final_train_loss"), F.coalesce("best_metric", "best_eval_loss", "eval_loss", nan).alias("best_eval_loss"))


def losses(log: DataFrame) -> DataFrame:
    """Last training loss by step and best evaluation loss."""
    return log.agg(F.max_by("loss", F.when(F.col("loss").isNotNull(), F.col("step"))).alias("final_loss"), F.min("eval_loss").alias("best_eval_loss"))
