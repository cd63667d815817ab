"""Queries of scoring, prediction, benchmarks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import schema
from millrace.functions import cost, text
from millrace.operators import benchmarks, curate, label, predict, quantiles, report, score
from millrace.plans import fixtures as fx
from millrace.plans.curation import norm_sql
from millrace.plans.fixtures import table

S = SparkSession


def _pairs(spark: S, d: str) -> DataFrame:
    return score.joined(fx.gold(spark, d), fx.predictions(spark, d))


def score_per_field(spark: S, d: str) -> DataFrame:
    return score.per_field(_pairs(spark, d)).select("ord", "field", "tp", "fp", "fn", "em", "support", "precision", "recall", "f1", "em_rate")


def null_baseline(spark: S, d: str) -> DataFrame:
    return score.per_field(score.null_baseline(fx.gold(spark, d))).select("ord", "field", "tp", "fp", "fn", "em", "support", "f1")


def _absent(f: str, v: str) -> str:
    return f"({v} IS NULL)" if f in schema.FLOATS + schema.INTEGERS else f"({v} IS NULL OR lower({v}) = 'unknown')"


def _one(i: int, f: str) -> str:
    g, p = norm_sql(f, f"g.{f}"), norm_sql(f, f"p.{f}")
    if f in schema.SETS:
        both = f"len(list_intersect({g}, {p}))"
        parts = (f"CASE WHEN v THEN {both} ELSE 0 END", f"CASE WHEN v THEN len({p}) - {both} ELSE 0 END", f"len({g}) - CASE WHEN v THEN {both} ELSE 0 END", f"CASE WHEN v AND len({g}) = {both} AND len({p}) = {both} THEN 1 ELSE 0 END", f"len({g})")
    else:
        a, b, eq = _absent(f, g), _absent(f, p), f"({g} = {p})"
        parts = (
            f"CASE WHEN v AND NOT {a} AND NOT {b} AND {eq} THEN 1 ELSE 0 END", f"CASE WHEN v AND NOT {b} AND ({a} OR NOT {eq}) THEN 1 ELSE 0 END",
            f"CASE WHEN NOT {a} AND (NOT v OR {b} OR NOT {eq}) THEN 1 ELSE 0 END", f"CASE WHEN v AND (({a} AND {b}) OR (NOT {a} AND NOT {b} AND {eq})) THEN 1 ELSE 0 END", f"CASE WHEN {a} THEN 0 ELSE 1 END",
        )
    names = ("tp", "fp", "fn", "em", "support")
    return f"SELECT {i}::INT AS ord, '{f}' AS field, count(*) AS n, " + ", ".join(f"sum({e})::BIGINT AS {x}" for e, x in zip(parts, names, strict=True)) + " FROM j"


def _score_sql(pred: str, cols: str, more: str = "") -> str:
    fields = " UNION ALL ".join(_one(i, f).replace("FROM j", "FROM gold g LEFT JOIN pr p ON p.doc_id = g.doc_id") for i, f in enumerate(schema.FIELDS))
    ratio = lambda a, b: f"CASE WHEN {b} = 0 THEN 0::DOUBLE ELSE {a}::DOUBLE / ({b})::DOUBLE END"
    return (
        f"WITH {fx.gold_cte()}, {pred}, f AS ({fields}), r AS (SELECT *, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall, {ratio('em', 'n')} AS em_rate FROM f), "
        f"z AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r){more} SELECT {cols}"
    )


def _with_v(sql: str) -> str:
    return sql.replace("WHEN v THEN", "WHEN coalesce(p.v, false) THEN").replace("WHEN v AND", "WHEN coalesce(p.v, false) AND").replace("(NOT v OR", "(NOT coalesce(p.v, false) OR")


_PRED = f"{fx.pred_cte()}, pr AS (SELECT *, schema_valid AS v FROM pred)"
_EMPTY = "pr AS (SELECT doc_id, true AS v, " + ", ".join(f"'unknown' AS {f}" if f in schema.ENUMS else f"CAST([] AS VARCHAR[]) AS {f}" if f in schema.SETS else f"CAST(NULL AS {'DOUBLE' if f in schema.FLOATS + schema.INTEGERS else 'VARCHAR'}) AS {f}" for f in schema.FIELDS) + " FROM gold)"
_SCORE = _with_v(_score_sql(_PRED, "ord, field, tp, fp, fn, em, support, precision, recall, f1, em_rate FROM z"))
_NULL = _with_v(_score_sql(_EMPTY, "ord, field, tp, fp, fn, em, support, f1 FROM z"))


def macro(spark: S, d: str) -> DataFrame:
    g, p = fx.gold(spark, d), fx.predictions(spark, d)
    pairs = score.joined(g, p)
    return score.macro_f1(score.per_field(pairs)).crossJoin(score.header(pairs, g, p))


_TERMS = " + ".join(f"max(CASE WHEN ord = {i} THEN f1 END)" for i in range(16))
_MACRO = _with_v(_score_sql(_PRED, f"({_TERMS}) / 16 AS macro_f1, max(n) AS n, (SELECT count(*) FILTER (schema_valid) FROM pred)::DOUBLE / max(n)::DOUBLE AS schema_valid_rate, max(n) - (SELECT count(*) FROM pred) AS n_missing FROM z"))


def teacher_arm(spark: S, d: str) -> DataFrame:
    g = fx.gold(spark, d)
    held = g.where("doc_id % 3 = 0")
    pairs = score.joined(held, score.teacher_predictions(g.where("doc_id % 2 = 0"), held))
    return pairs.groupBy("valid").agg(F.count("*").alias("n"))


def extra_and_duplicate(spark: S, d: str) -> DataFrame:
    """Predictions for unknown ids, and ids that occur twice."""
    docs = table(spark, d, "documents")
    known, preds = docs.where("doc_id % 4 <> 0").select("doc_id"), docs.select("doc_id").unionAll(docs.where("doc_id % 5 = 0").select("doc_id"))
    return score.faults(known, preds).select("doc_id", F.when(F.col("what") == "unknown to gold", "extra").otherwise("duplicate").alias("what"))


def messages(spark: S, d: str) -> DataFrame:
    m = predict.student_messages("sys", [("u1", "a1"), ("u2", "a2")], F.col("text"))
    t = F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"]))
    return table(spark, d, "documents").select("doc_id", F.size(m).cast("bigint").alias("n"), F.md5(F.array_join(t, "|").cast("binary")).alias("digest"))


def few_shot(spark: S, d: str) -> DataFrame:
    """Turns of each conversation in order, as one prompt."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.size("m").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "|").cast("binary")).alias("digest"))


def targets(spark: S, d: str) -> DataFrame:
    """Compact JSON targets: numbers left out, whose rendering differs between engines."""
    g = fx.gold(spark, d)
    keep = [f for f in schema.FIELDS if f not in schema.FLOATS]
    return g.select("doc_id", predict.compact_json(F.struct(*keep)).alias("target"))


_TARGET = f"WITH {fx.gold_cte()} SELECT doc_id, to_json({{" + ", ".join(f"'{f}': {f}" for f in schema.FIELDS if f not in schema.FLOATS) + "})::VARCHAR AS target FROM gold"


def resume(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return predict.remaining(docs, docs.where("doc_id % 3 = 0").withColumn("arm", F.lit("lora_ft")), "lora_ft")


def prediction_summary(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "documents").select((F.col("doc_id") % 9 != 0).alias("schema_valid"), F.least(F.col("n_chars"), F.lit(1024)).alias("completion_tokens"))
    return predict.summary(p)


def stride(spark: S, d: str) -> DataFrame:
    rows = predict.stride_sample(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", 7, 100)
    return rows.agg(*[F.expr(f"percentile_disc({q}) within group (order by n_chars)").alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"))], F.max("n_chars").alias("max"))


def records(spark: S, d: str) -> DataFrame:
    raw = fx.from_documents(spark, d, f"SELECT doc_id, {fx.RAW} AS raw_output FROM documents")
    return predict.records(raw, "lora_ft").select("doc_id", "arm", "schema_valid", "parsed.employment_type", "parsed.salary_min", "parsed.years_experience_min")


def latency(spark: S, d: str) -> DataFrame:
    return benchmarks.latency_summary(table(spark, d, "events"), "event_type", "value").select("event_type", "n", "p50", "p95", "min", "max")


def spread(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("v"))
    return quantiles.spread_pct(e.select((F.col("user_id") % 5).alias("g"), "v"), ["g"], "v")


_SWEEP = "SELECT user_id % 40 AS ord, 'a' || CAST(user_id % 5 AS STRING) AS arm, 1 + user_id % 40 AS batch_size, CAST(event_id % 17 AS DOUBLE) + 1 AS throughput, event_id % 11 = 0 AS oom FROM events"


def _sweep(spark: S, d: str) -> DataFrame:
    return spark.sql(_SWEEP.replace("FROM events", "FROM {e}"), e=table(spark, d, "events")).groupBy("arm", "ord", "batch_size").agg(F.max("throughput").alias("throughput"), F.max("oom").alias("oom"))


_SWEPT = f"w AS (SELECT arm, ord, batch_size, max(throughput) AS throughput, bool_or(oom) AS oom FROM ({_SWEEP}) GROUP BY 1, 2, 3)"


def best_rows(spark: S, d: str) -> DataFrame:
    return benchmarks.best_rows(_sweep(spark, d))


_BEST = f"WITH {_SWEPT}, u AS (SELECT *, row_number() OVER (PARTITION BY arm, oom ORDER BY throughput DESC, ord) AS r FROM w) SELECT arm, max(batch_size) FILTER (r = 1 AND NOT oom) AS fastest_batch, max(throughput) FILTER (NOT oom) AS throughput, max(batch_size) FILTER (NOT oom) AS largest_batch FROM u GROUP BY 1"


def unit_costs(spark: S, d: str) -> DataFrame:
    r = table(spark, d, "events")
    thr = (F.col("event_id") % 50 + 1).cast("double") / 100
    return r.select("event_id", cost.cost_per_1k(thr, F.lit(0.35)).alias("usd"), cost.whole_batches(F.col("event_id"), F.lit(8)).alias("whole"), cost.implausible(F.col("value"), F.col("event_id") % 60).alias("implausible"), cost.effective_batch(F.lit(2), F.col("event_id") % 3, F.lit(8)).cast("bigint").alias("effective"))


_UNIT = """
SELECT event_id, 1000.0::DOUBLE / ((event_id % 50 + 1)::DOUBLE / 100) / 3600.0::DOUBLE * 0.35::DOUBLE AS usd, event_id - event_id % 8 AS whole,
  event_id % 60 <= 0 OR value <= (event_id % 60) * 1000.0::DOUBLE / 500.0::DOUBLE AS implausible, (16 * greatest(1, event_id % 3))::BIGINT AS effective FROM events
"""


def median_pass(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "events").select(F.col("event_type").alias("arm"), F.col("event_id").alias("ord"), F.col("value").alias("p50"))
    return benchmarks.median_pass(p)


_MEDPASS = "WITH p AS (SELECT event_type AS arm, event_id AS ord, value AS p50 FROM events), m AS (SELECT arm, median(p50) AS med FROM p GROUP BY 1), r AS (SELECT arm, ord, row_number() OVER (PARTITION BY arm ORDER BY abs(p50 - med), ord) AS r FROM p JOIN m USING (arm)) SELECT arm, ord FROM r WHERE r = 1"


def index_build(spark: S, d: str) -> DataFrame:
    t = table(spark, d, "events").select((F.col("event_id") % 10).cast("string").alias("arm"), F.floor(F.col("event_id") / 10).alias("ord"), F.col("value").alias("ms"))
    return benchmarks.index_build(t)


_INDEX = "WITH t AS (SELECT CAST(event_id % 10 AS VARCHAR) AS arm, event_id // 10 AS ord, value AS ms FROM events) SELECT arm, max(ms) FILTER (ord = 0) + greatest(0.0, max(ms) FILTER (ord = 1) - median(ms) FILTER (ord > 1)) AS build_ms FROM t GROUP BY 1"


def checkpoint(spark: S, d: str) -> DataFrame:
    paths = table(spark, d, "documents").select(F.concat(F.lit("out/checkpoint-"), F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise((F.col("doc_id") * 37 % 1009).cast("string"))).alias("path"))
    return benchmarks.latest_checkpoint(paths)


def losses(spark: S, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("event_id").alias("step"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("loss"), F.when(F.col("event_id") % 100 == 0, F.col("value")).alias("eval_loss"))
    return benchmarks.losses(log)


_ARMS = "(VALUES (0, 'base_fewshot'), (1, 'base_fewshot_constrained'), (2, 'lora_ft'), (3, 'lora_ft_constrained'), (4, 'teacher')) v(ord, arm)"


def _arms(spark: S) -> DataFrame:
    return spark.createDataFrame(list(enumerate(schema.ARMS)), "ord int, arm string")


def headline(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id % 5 <> 3")
    arm = F.element_at(F.array(*map(F.lit, schema.ARMS)), (F.col("doc_id") % 5 + 1).cast("int"))
    metrics = docs.groupBy(arm.alias("arm")).agg((F.count_if(F.col("n_chars") > 2000) / F.count("*")).alias("macro_f1"))
    bench = docs.where("doc_id % 5 <> 1").groupBy(arm.alias("arm")).agg(F.max("n_chars").cast("double").alias("p50_ms"), F.lit(0.35).alias("hourly"))
    sweep = docs.where("doc_id % 5 in (0, 2)").select(arm.alias("arm"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("batch_size"), (F.col("n_chars") % 50 + 1).cast("double").alias("throughput"), (F.col("n_chars") % 3 == 0).alias("oom"))
    return report.headline(_arms(spark), metrics, bench, sweep)


_HEAD = f"""
WITH a AS (SELECT * FROM {_ARMS}), d AS (SELECT a.arm, doc_id, n_chars FROM documents JOIN a ON a.ord = doc_id % 5 WHERE doc_id % 5 <> 3),
m AS (SELECT arm, count(*) FILTER (n_chars > 2000) / count(*) AS macro_f1 FROM d GROUP BY 1), b AS (SELECT arm, max(n_chars)::DOUBLE AS p50_ms FROM d WHERE doc_id % 5 <> 1 GROUP BY 1),
s AS (SELECT arm, doc_id AS batch_size, (n_chars % 50 + 1)::DOUBLE AS thr, row_number() OVER (PARTITION BY arm ORDER BY n_chars % 50 DESC, doc_id) AS r FROM d WHERE doc_id % 5 IN (0, 2) AND n_chars % 3 <> 0)
SELECT a.ord, a.arm, macro_f1, macro_f1 - (SELECT macro_f1 FROM m WHERE arm = 'teacher') AS delta_vs_teacher, p50_ms, batch_size, 1000.0::DOUBLE / thr AS amortized_ms, 1000.0::DOUBLE / thr / 3600.0::DOUBLE * CASE WHEN p50_ms IS NOT NULL THEN 0.35::DOUBLE END AS cost_per_1k
FROM a LEFT JOIN m USING (arm) LEFT JOIN b USING (arm) LEFT JOIN (SELECT * FROM s WHERE r = 1) s USING (arm)
"""


def field_pivot(spark: S, d: str) -> DataFrame:
    f = score.per_field(_pairs(spark, d)).select("ord", "field", "support", F.col("em_rate").alias("em"), "f1")
    both = f.withColumn("arm", F.lit("lora_ft")).unionByName(f.withColumn("arm", F.lit("teacher")).withColumn("f1", F.col("f1") / 2))
    w = report.per_field(both).select("field", "support", "lora_ft_em", "lora_ft_f1", "teacher_em", "teacher_f1", "base_fewshot_f1")
    return w.withColumn("flag", report.low_n(F.col("support"))).select("*", F.rank().over(Window.orderBy(F.coalesce("lora_ft_f1", "base_fewshot_f1"), "field")).cast("bigint").alias("place"))


_PIVOT = _with_v(_score_sql(_PRED, "field, support, em_rate AS lora_ft_em, f1 AS lora_ft_f1, em_rate AS teacher_em, f1 / 2 AS teacher_f1, CAST(NULL AS DOUBLE) AS base_fewshot_f1, CASE WHEN support < 30 THEN 'low-n' END AS flag, rank() OVER (ORDER BY f1, field) AS place FROM z"))


def sweep_marks(spark: S, d: str) -> DataFrame:
    rows = _sweep(spark, d)
    files = rows.groupBy("arm").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "batch_size", "throughput", "oom"))), lambda x: F.struct(x["batch_size"].alias("batch_size"), x["throughput"].alias("throughput"), x["oom"].alias("oom"))).alias("sweep"))
    return report.sweep_rows(files).select("arm", "batch_size", "mark")


_MARKS = f"WITH {_SWEPT}, r AS (SELECT *, row_number() OVER (PARTITION BY arm, oom ORDER BY throughput DESC, ord) AS r FROM w) SELECT arm, batch_size, CASE WHEN oom THEN 'OOM' WHEN r = 1 THEN 'fastest' END AS mark FROM r"
_LINE = "CASE doc_id % 4 WHEN 0 THEN 'p50 of ' || CAST(n_chars AS STRING) || ' ms, ' || CAST(doc_id % 90 AS STRING) || '.5% valid' WHEN 1 THEN 'cost $' || CAST(doc_id % 7 AS STRING) || '.25 at 0.' || CAST(doc_id % 9 AS STRING) || '1 macro-F1' WHEN 2 THEN '3x larger than a Frontier model' ELSE 'p50 10 runs' END"


def claims(spark: S, d: str) -> DataFrame:
    lines = spark.sql(f"SELECT doc_id, {_LINE} AS line FROM {{docs}}", docs=table(spark, d, "documents"))
    return lines.select("doc_id", F.array_join(report.claim_numbers(F.col("line")), ",").alias("numbers"), F.array_join(report.word_violations(F.col("line")), ",").alias("words"))


_CLAIMS = f"""
WITH l AS (SELECT doc_id, {_LINE} AS line FROM documents), f AS (SELECT doc_id, line, list_concat(list_concat(regexp_extract_all(line, '(?:^|[^\\w.])(\\d+(?:\\.\\d+)?)\\s*%', 1), regexp_extract_all(line, '(?:^|[^\\w.])(\\d+(?:\\.\\d+)?)\\s*ms\\b', 1)),
  list_concat(regexp_extract_all(line, '\\$\\s*(\\d+(?:\\.\\d+)?)', 1), regexp_extract_all(line, '(?:^|[^\\w.])([+-]?\\d+(?:\\.\\d+)?)\\s*(?:macro-)?F1\\b', 1))) AS n FROM l)
SELECT doc_id, array_to_string(list_sort(list_distinct(n)), ',') AS numbers, array_to_string([x FOR x IN [CASE WHEN regexp_matches(line, '(?i)\\d\\s*[x×]\\s*(larger|bigger|smaller)') THEN 'ratio' END, CASE WHEN regexp_matches(line, '(?i)\\bfrontier\\b') THEN 'frontier' END, CASE WHEN regexp_matches(line, '(?i)\\b45\\s*ms\\b') THEN '45ms' END] IF x IS NOT NULL], ',') AS words FROM f
"""


def unknown_claims(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lines = spark.sql(f"SELECT {_LINE} AS line FROM {{docs}}", docs=docs)
    facts = docs.where("doc_id % 8 = 0").select(F.concat(F.lit("a__"), F.when(F.col("doc_id") % 16 == 0, "p50_ms").otherwise("x")).alias("key"), F.col("n_chars").cast("double").alias("value"), F.lit(None).cast("string").alias("text"))
    return report.unknown_claims(lines, facts.unionByName(spark.createDataFrame([("note", None, "0.11 and 7.5")], "key string, value double, text string")))


_UNKNOWN = f"""
WITH l AS (SELECT {_LINE} AS line FROM documents), f AS (SELECT unnest(list_concat(list_concat(regexp_extract_all(line, '(?:^|[^\\w.])(\\d+(?:\\.\\d+)?)\\s*%', 1), regexp_extract_all(line, '(?:^|[^\\w.])(\\d+(?:\\.\\d+)?)\\s*ms\\b', 1)),
  list_concat(regexp_extract_all(line, '\\$\\s*(\\d+(?:\\.\\d+)?)', 1), regexp_extract_all(line, '(?:^|[^\\w.])([+-]?\\d+(?:\\.\\d+)?)\\s*(?:macro-)?F1\\b', 1)))) AS n FROM l),
a AS (SELECT n_chars::VARCHAR AS n FROM documents WHERE doc_id % 8 = 0 UNION SELECT n_chars || '.000' FROM documents WHERE doc_id % 8 = 0 UNION SELECT n_chars * 100 || '.0' FROM documents WHERE doc_id % 8 = 0 UNION SELECT '0.11' UNION SELECT '7.5')
SELECT DISTINCT n AS number FROM f WHERE n NOT IN (SELECT n FROM a)
"""


def conflated(spark: S, d: str) -> DataFrame:
    """Every figure there is against every line."""
    lines = spark.sql(f"SELECT {_LINE} AS line FROM {{docs}}", docs=table(spark, d, "documents"))
    figures = table(spark, d, "documents").select(F.concat(F.lit("arm"), "doc_id").alias("arm"), F.col("n_chars").cast("string").alias("shown"))
    return report.conflated(lines, figures).select("line", "arm")


_CONFLATED = f"WITH l AS (SELECT {_LINE} AS line FROM documents), a AS (SELECT 'arm' || doc_id AS arm, CAST(n_chars AS VARCHAR) AS shown FROM documents) SELECT line, arm FROM l JOIN a ON contains(lower(line), 'p50') AND NOT contains(lower(line), 'amortized') AND regexp_matches(line, '\\b' || shown || '\\s*ms\\b')"


def missing_artifacts(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.element_at(F.array(*map(F.lit, schema.ARMS)), (F.col("doc_id") % 5 + 1).cast("int")).alias("arm"), (F.col("doc_id") % 5).alias("ord"))
    there = lambda cond: docs.where(cond).select("arm").distinct()
    return report.warnings(_arms(spark), there("ord < 4"), there("ord <> 2"), there("ord in (0, 2)"))


_MISSING = f"WITH a AS (SELECT * FROM {_ARMS}), d AS (SELECT DISTINCT doc_id % 5 AS ord FROM documents) SELECT arm, 'metrics' AS missing FROM a WHERE ord NOT IN (SELECT ord FROM d WHERE ord < 4) UNION ALL SELECT arm, 'bench' FROM a WHERE ord NOT IN (SELECT ord FROM d WHERE ord <> 2) UNION ALL SELECT arm, 'sweep' FROM a WHERE ord < 4 AND ord NOT IN (SELECT ord FROM d WHERE ord IN (0, 2))"


def first_and_falsy(spark: S, d: str) -> DataFrame:
    r = table(spark, d, "events").select((F.col("user_id") % 9).alias("g"), "event_id", F.when(F.col("event_id") % 4 == 0, F.col("event_id")).alias("x"))
    return r.groupBy("g").agg(report.first_present(F.col("x"), F.col("event_id")).alias("first_x"), F.sum(report.truthy_or(F.col("event_id") % 3, F.lit(10))).alias("falsy"))


def top_members(spark: S, d: str) -> DataFrame:
    """The three most frequent members of each enumeration; a report of three."""
    dist = label.enum_distribution(fx.gold(spark, d))
    return dist.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "ord"))).where("r <= 3").select("field", "member", "n", F.col("r").cast("bigint").alias("r"))


_TOP = f"WITH {fx.gold_cte()}, e AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {i} AS ord, '{m}' AS member, count(*) FILTER ({f} = '{m}') AS n FROM gold" for f, ms in schema.ENUMS.items() for i, m in enumerate(ms)) + "), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, ord) AS r FROM e) SELECT field, member, n, r FROM r WHERE r <= 3"


def page_of(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").orderBy("doc_id").offset(20).limit(30)


def date_shapes(spark: S, d: str) -> DataFrame:
    return fx.gold(spark, d).select("doc_id", text.date_shaped(F.trim("posting_date")).alias("ok"))


def column_inference(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").orderBy("doc_id")
    t = curate.pick_text_column(docs)
    return spark.createDataFrame([(t, curate.pick_key_column(docs, t))], "text_column string, key_column string")


def projected_spend(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", label.projection((F.col("n_chars") / 1000), F.col("doc_id") / 100, F.col("doc_id"), F.lit(5)).alias("usd"), label.terminal(F.when(F.col("doc_id") % 4 == 0, "completed").when(F.col("doc_id") % 4 == 1, "failed").when(F.col("doc_id") % 4 == 2, "expired").otherwise("running"), F.col("doc_id") % 3).alias("next"))


_PROJECTED = "SELECT doc_id, CASE WHEN doc_id >= 50 THEN greatest(doc_id::DOUBLE / 100 * 5, n_chars::DOUBLE / 1000) ELSE n_chars::DOUBLE / 1000 END AS usd, CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 3 > 0 THEN 'requeue_missing' ELSE 'harvested' END WHEN 1 THEN 'resubmit' WHEN 2 THEN 'harvest_and_requeue' ELSE 'wait' END AS next FROM documents"

QUERIES = {
    "a1_a3_score_per_field": (score_per_field, _SCORE),
    "a4_null_baseline": (null_baseline, _NULL),
    "a3_jn1_jn3_macro": (macro, _MACRO),
    "jn4_teacher_arm": (teacher_arm, "SELECT doc_id % 2 = 0 AS valid, count(*) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY 1"),
    "jn2_x4_x6_checks": (extra_and_duplicate, "SELECT doc_id, 'extra' AS what FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'duplicate' FROM documents WHERE doc_id % 5 = 0"),
    "m1_m2_t10_messages": (messages, "SELECT doc_id, 6::BIGINT AS n, md5('system:sys|user:u1|assistant:a1|user:u2|assistant:a2|user:' || substr(text, 1, 6000)) AS digest FROM documents"),
    "m2_conversation_prompts": (few_shot, "SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || text, '|' ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY 1"),
    "j9_m5_targets": (targets, _TARGET),
    "jn9_resume": (resume, "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0"),
    "a19_prediction_summary": (prediction_summary, "SELECT count(*) FILTER (doc_id % 9 <> 0) AS n_valid, count(*) FILTER (doc_id % 9 = 0) AS n_invalid, count(*) FILTER (n_chars >= 1024) AS n_truncated, sum(least(n_chars, 1024))::DOUBLE / count(*) AS mean_tokens FROM documents"),
    "a20_o9_stride_lengths": (stride, "WITH s AS (SELECT n_chars FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE r % 7 = 0 AND r < 700) SELECT quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, max(n_chars) AS max FROM s"),
    "a15_a16_latency": (latency, "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, min(value) AS min, max(value) AS max FROM events GROUP BY 1"),
    "c6_spread": (spread, "WITH e AS (SELECT user_id, count(*)::DOUBLE AS v FROM events GROUP BY 1) SELECT user_id % 5 AS g, CASE WHEN median(v) > 0 THEN (max(v) - min(v)) / median(v) * 100 ELSE 0 END AS spread FROM e GROUP BY 1"),
    "a21_best_rows_all": (best_rows, _BEST),
    "c4_c5_c7_c8_unit_costs_all": (unit_costs, _UNIT),
    "a17_median_pass_all": (median_pass, _MEDPASS),
    "a25_index_build_all": (index_build, _INDEX),
    "w8_latest_checkpoint": (checkpoint, "SELECT arg_max('out/checkpoint-' || doc_id * 37 % 1009, doc_id * 37 % 1009) AS path, max(doc_id * 37 % 1009) AS step FROM documents WHERE doc_id % 7 <> 0"),
    "c11_losses": (losses, "SELECT arg_max(value, event_id) FILTER (event_id % 3 = 0) AS final_loss, min(value) FILTER (event_id % 100 = 0) AS best_eval_loss FROM events"),
    "r1_jn12_headline_all": (headline, _HEAD),
    "r2_o4_fl8_per_field": (field_pivot, _PIVOT),
    "r3_fl10_sweep_all": (sweep_marks, _MARKS),
    "t13_t14_claims": (claims, _CLAIMS),
    "r6_r7_jn14_unknown_claims": (unknown_claims, _UNKNOWN),
    "jn15_conflated_all": (conflated, _CONFLATED),
    "r8_missing_artifacts": (missing_artifacts, _MISSING),
    "a23_a24_first_and_falsy": (first_and_falsy, "SELECT user_id % 9 AS g, min(event_id) FILTER (event_id % 4 = 0) AS first_x, sum(CASE WHEN event_id % 3 = 0 THEN 10 ELSE event_id % 3 END)::BIGINT AS falsy FROM events GROUP BY 1"),
    "o6_top_members": (top_members, _TOP),
    "o10_page": (page_of, "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 30 OFFSET 20"),
    "t12_date_shapes": (date_shapes, f"WITH {fx.gold_cte()} SELECT doc_id, regexp_matches(trim(posting_date), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AS ok FROM gold"),
    "s6_s7_column_inference": (column_inference, "SELECT 'text' AS text_column, 'doc_id' AS key_column"),
    "c10_st6_projection": (projected_spend, _PROJECTED),
}
