"""Queries of provider results, retries, review queues, rendering and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import errors, schema
from millrace.functions import normalize
from millrace.operators import benchmarks, gold, label, predict, report, score
from millrace.plans import analysis, curation
from millrace.plans import fixtures as fx
from millrace.plans.fixtures import table
from millrace.sources import files

S = SparkSession
_MESSAGE = "struct<content:string,refusal:string>"
_LINE = f"struct<custom_id:string,error:struct<code:string,message:string>,response:struct<status_code:int,body:struct<choices:array<struct<index:int,finish_reason:string,message:{_MESSAGE}>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>,error:struct<message:string>>>>"
_USAGE = '"usage": {"prompt_tokens": \' || n_chars || \', "completion_tokens": \' || doc_id % 300 || \'}'
#: Result lines: a request error, a bad status, no choices, a refusal, no content, cut off, and plain.
_ANSWERS = (
    '"error": {"code": "c1", "message": "m1"}, "response": null', '"error": null, "response": {"status_code": 500, "body": {"error": {"message": "oops"}}}',
    f'"response": {{"status_code": 200, "body": {{"choices": [], {_USAGE}}}}}', f'"response": {{"status_code": 200, "body": {{"choices": [{{"index": 0, "finish_reason": "stop", "message": {{"content": null, "refusal": "no"}}}}], {_USAGE}}}}}',
    f'"response": {{"status_code": 200, "body": {{"choices": [{{"index": 0, "finish_reason": "stop", "message": {{"content": ""}}}}], {_USAGE}}}}}',
    f'"response": {{"status_code": 200, "body": {{"choices": [{{"index": 0, "finish_reason": "length", "message": {{"content": "cut"}}}}], {_USAGE}}}}}', f'"response": {{"status_code": 200, "body": {{"choices": [{{"index": 0, "finish_reason": "stop", "message": {{"content": "whole"}}}}], {_USAGE}}}}}',
)


def _results(spark: S, d: str) -> DataFrame:
    answer = " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_ANSWERS))
    raw = fx.from_documents(spark, d, f"SELECT '{{\"custom_id\": \"' || doc_id || '\", ' || CASE doc_id % 7 {answer} END || '}}' AS line FROM documents")
    lines = raw.select(F.from_json("line", _LINE).alias("l")).select("l.*")
    failed = lines.where("error is not null")
    return label.parse_results(lines.where("error is null").unionByName(failed), "gpt-4o-mini", "cur", "b1")  # output and error files


def parsed_results(spark: S, d: str) -> DataFrame:
    return _results(spark, d).select(F.col("doc_id").cast("bigint").alias("doc_id"), "raw_output", "usage.input_tokens", "usage.output_tokens", "ok", "error", "finish_reason")


_RESULTS = """
SELECT doc_id, CASE doc_id % 7 WHEN 5 THEN 'cut' WHEN 6 THEN 'whole' END AS raw_output, CASE WHEN doc_id % 7 < 2 THEN 0 ELSE n_chars END::BIGINT AS input_tokens, CASE WHEN doc_id % 7 < 2 THEN 0 ELSE doc_id % 300 END::BIGINT AS output_tokens, doc_id % 7 >= 5 AS ok,
  CASE doc_id % 7 WHEN 0 THEN 'request_error: c1: m1' WHEN 1 THEN 'http_500: oops' WHEN 2 THEN 'empty_content' WHEN 3 THEN 'refusal: no' WHEN 4 THEN 'empty_content' END AS error, CASE doc_id % 7 WHEN 3 THEN 'stop' WHEN 4 THEN 'stop' WHEN 5 THEN 'length' WHEN 6 THEN 'stop' END AS finish_reason FROM documents
"""


def accounted(spark: S, d: str) -> DataFrame:
    return label.account(_results(spark, d))


_ACCOUNT = """
SELECT sum(n_chars)::BIGINT AS tokens_in, sum(doc_id % 300)::BIGINT AS tokens_out, sum(0.5::DOUBLE * (n_chars / 1e6::DOUBLE * 0.15::DOUBLE + (doc_id % 300) / 1e6::DOUBLE * 0.6::DOUBLE)) AS usd FROM documents WHERE doc_id % 7 >= 2
"""


def missing_ids(spark: S, d: str) -> DataFrame:
    """Batches of 64 documents each, as they are sent; grouped by batch number modulo 11 to be counted."""
    batches = table(spark, d, "documents").groupBy((F.col("doc_id") % 11).alias("group"), F.floor(F.col("doc_id") / (11 * 64)).alias("nth")).agg(F.collect_list(F.col("doc_id").cast("string")).alias("doc_ids"))
    lost = label.missing(batches.select(F.struct("group", "nth").alias("batch"), "doc_ids"), _results(spark, d))
    return lost.groupBy(F.col("batch.group").alias("batch")).agg(F.count("*").alias("n"), F.sum(F.col("doc_id").cast("bigint")).alias("ids"))


def _classified(spark: S, d: str) -> DataFrame:
    return label.outcomes(table(spark, d, "documents").select("doc_id"), fx.cache(spark, d)).select("doc_id", "outcome")


def outcome_buckets(spark: S, d: str) -> DataFrame:
    counts = label.buckets(_classified(spark, d))
    label.check_buckets(counts)
    return counts


_O = curation._OUTCOME.strip()
_BUCKETS = f"SELECT count(*) AS n_requested, {', '.join(f'''count(*) FILTER (outcome = '{b}') AS n_{b}''' for b in label.OUTCOMES)} FROM ({_O})"


def retried(spark: S, d: str) -> DataFrame:
    return label.retry_round(_classified(spark, d))


def prompt_at_fault(spark: S, d: str) -> DataFrame:
    return label.failing(label.buckets(_classified(spark, d)))


def capacity(spark: S, d: str) -> DataFrame:
    m = F.element_at(F.array(*map(F.lit, ("Enqueued 5", "Token LIMIT reached", "tokens gone", "rate limit", "quota", "other"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", label.capacity_error(m).alias("capacity"))


def floor_of_agreement(spark: S, d: str) -> DataFrame:
    """Fields below the floor, and the three least agreed ones, marked."""
    agreed = curation.agreement(spark, d)
    low = gold.agreement_warnings(agreed).select("field", F.lit("below the floor").alias("what"))
    return low.unionByName(gold.least_agreed(agreed).select("field", F.lit("least").alias("what")))


_FLOOR = f"WITH a AS ({curation._AGREE}) SELECT field, 'below the floor' AS what FROM a WHERE agreement < 0.75 UNION ALL (SELECT field, 'least' FROM a ORDER BY agreement, field LIMIT 3)"


def queue(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string"), "lang")
    wanted = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").cast("string"), (F.col("doc_id") * 31 % 1009).alias("ord"))
    return gold.review_queue(docs, wanted, gold.replay(fx.log(spark, d)).where("doc_id % 2 = 0")).select("doc_id", "lang", "ord")


_DECIDED = f"l AS ({fx.LOG_DUCK}), s AS (SELECT DISTINCT doc_id FROM l WHERE action <> 'edit' AND doc_id::BIGINT % 2 = 0)"
_QUEUE = f"WITH {_DECIDED} SELECT doc_id::VARCHAR AS doc_id, lang, doc_id * 31 % 1009 AS ord FROM documents WHERE doc_id % 3 = 0 AND doc_id::VARCHAR NOT IN (SELECT doc_id FROM s)"


def first_unreviewed(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string"))
    return gold.first_unreviewed(docs, gold.replay(fx.log(spark, d)).where("doc_id % 2 = 0"))


_FIRST = f"WITH {_DECIDED} SELECT min(doc_id::VARCHAR) AS doc_id, count(*) AS left FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT doc_id FROM s)".replace("AS left", 'AS "left"')


def teacher_bench(spark: S, d: str) -> DataFrame:
    calls = table(spark, d, "documents").select((F.col("doc_id") % 6 != 0).alias("ok"), F.col("n_chars").cast("double").alias("ms"), F.col("n_chars").alias("input_tokens"), (F.col("doc_id") % 300).alias("output_tokens"), F.lit("gpt-4o-mini").alias("model"))
    return benchmarks.teacher_summary(calls)


_BENCH = """
WITH c AS (SELECT *, doc_id % 6 <> 0 AS ok, n_chars / 1e6::DOUBLE * 0.15::DOUBLE + (doc_id % 300) / 1e6::DOUBLE * 0.6::DOUBLE AS usd FROM documents),
s AS (SELECT count(*) FILTER (ok) AS n_calls_ok, count(*) FILTER (NOT ok) AS n_calls_failed, quantile_disc(n_chars, 0.5) FILTER (ok)::DOUBLE AS p50_ms, avg(n_chars) FILTER (ok) AS mean_prompt_tokens, avg(doc_id % 300) FILTER (ok) AS mean_completion_tokens, sum(usd) FILTER (ok) AS total_usd FROM c)
SELECT *, total_usd / n_calls_ok * 1000 AS cost_per_1k_docs_usd, 1000 / p50_ms AS throughput_docs_per_s FROM s
"""


def merged_counts(spark: S, d: str) -> DataFrame:
    """Scores of the even and of the odd documents, merged: those of all."""
    pairs = analysis._pairs(spark, d)
    parts = score.per_field(pairs.where("doc_id % 2 = 0")).unionByName(score.per_field(pairs.where("doc_id % 2 = 1")))
    return score.merged(parts).select("ord", "field", "tp", "fp", "fn", "em", "support", "precision", "recall", "f1", "em_rate")


def compared(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("arm", F.element_at(F.array(*map(F.lit, schema.ARMS)), (F.col("doc_id") % 5 + 1).cast("int")))
    heads = docs.groupBy("arm", (F.col("doc_id") % 5).alias("ord")).agg((F.count_if(F.col("n_chars") > 2000) / F.count("*")).alias("macro_f1"))
    return score.compared(heads)


def requests(spark: S, d: str) -> DataFrame:
    r = predict.request(F.col("doc_id").cast("string"), "gpt-4o-mini", predict.teacher_messages("sys", F.col("text")))
    return table(spark, d, "documents").select(r.alias("r")).select("r.custom_id", "r.method", "r.url", "r.body.model", F.col("r.body.max_tokens").alias("most"), F.md5(F.array_join(F.transform("r.body.messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").cast("binary")).alias("digest"))


def tuning_examples(spark: S, d: str) -> DataFrame:
    """Prompt, target and end mark of each document; the target is a fixed part of the posting."""
    g = fx.gold(spark, d)
    text = predict.training_example(predict.teacher_messages("sys", F.col("text")), F.struct("seniority", "remote_mode"), "<|end|>")
    return g.select("doc_id", F.md5(text.cast("binary")).alias("digest"), F.length(text).cast("bigint").alias("n"))


_TUNING = f"WITH {fx.gold_cte()}, t AS (SELECT doc_id, '<|system|>\n' || 'sys\n<|user|>\n' || substr(text, 1, 6000) || '\n<|assistant|>\n' || '{{\"seniority\":\"' || seniority || '\",\"remote_mode\":\"' || remote_mode || '\"}}<|end|>' AS t FROM gold) SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS n FROM t"


def frozen(spark: S, d: str) -> DataFrame:
    return predict.frozen_exemplars(table(spark, d, "documents").select("doc_id", "lang"), [7, 3, 11])


def in_order(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return predict.in_gold_order(docs.where("doc_id % 4 <> 1").select("doc_id", "lang"), docs.where("doc_id % 2 = 1").select("doc_id", (-F.col("doc_id")).alias("ord")))


def rendered(spark: S, d: str) -> DataFrame:
    g = fx.gold(spark, d)
    return g.select("doc_id", *[gold.rendered(f, F.col(f)).alias(f) for f in ("title", "seniority", "required_skills", "posting_date")])


_RENDERED = f"WITH {fx.gold_cte()} SELECT doc_id, coalesce(title, 'null') AS title, seniority, CASE WHEN required_skills IS NULL THEN 'null' WHEN len(required_skills) = 0 THEN '[]' ELSE array_to_string(required_skills, ', ') END AS required_skills, coalesce(posting_date, 'null') AS posting_date FROM gold"


def shown(spark: S, d: str) -> DataFrame:
    v = F.when(F.col("doc_id") % 10 != 0, (F.col("doc_id") % 997).cast("double") / 7.0)
    return table(spark, d, "documents").select("doc_id", *[report.shown(v, k).alias(k) for k in report.FORMATS])


_V = "CASE WHEN doc_id % 10 <> 0 THEN (doc_id % 997)::DOUBLE / 7.0::DOUBLE END"
_FMT = {"pct1": f"format('{{:.1f}}', v * 100)", "f3": "format('{:.3f}', v)", "signed3": "format('{:+.3f}', v)", "ms0": "format('{:.0f}', v)", "usd5": "format('{:.5f}', v)", "usd2": "format('{:.2f}', v)", "num1": "format('{:.1f}', v)", "num2": "format('{:.2f}', v)", "num4": "format('{:.4f}', v)", "int0": "floor(v)::BIGINT::VARCHAR"}
_SHOWN = f"WITH t AS (SELECT doc_id, {_V} AS v FROM documents) SELECT doc_id, " + ", ".join(f"coalesce({e}, '—') AS {k}" for k, e in _FMT.items()) + " FROM t"


def batch_sizes(spark: S, d: str) -> DataFrame:
    lists = F.element_at(F.array(*map(F.lit, ("8, 1,,8 ", "4,2,16", "0,1", "x,2", " , ", "32"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.array_join(files.batch_sizes(lists), ",").alias("sizes"))


def overlap(spark: S, d: str) -> DataFrame:
    """Skills of gold and prediction: common ones, invented ones and missed ones."""
    a, b = normalize.norm_skills(F.col("g.required_skills")), normalize.norm_skills(F.col("p.required_skills"))
    pairs = analysis._pairs(spark, d).where("valid").select("doc_id", a.alias("a"), b.alias("b"))
    both, more, less = F.array_intersect("a", "b"), F.array_except("b", "a"), F.array_except("a", "b")
    return pairs.select("doc_id", F.array_join(F.array_sort(both), ",").alias("both"), F.array_join(F.array_sort(more), ",").alias("more"), F.array_join(F.array_sort(less), ",").alias("less"))


def _skills(t: str) -> str:
    return curation.norm_sql("required_skills", f"{t}.required_skills")


_OVERLAP = f"""
WITH {fx.gold_cte()}, {fx.pred_cte()}, j AS (SELECT g.doc_id, {_skills('g')} AS a, {_skills('p')} AS b FROM gold g JOIN pred p USING (doc_id) WHERE schema_valid)
SELECT doc_id, array_to_string(list_sort(list_intersect(a, b)), ',') AS "both", array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS more, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS less FROM j
"""


def facts(spark: S, d: str) -> DataFrame:
    s = score.per_field(analysis._pairs(spark, d)).select("field", F.col("em_rate").alias("em"), "f1", "precision", "recall").withColumn("arm", F.lit("lora_ft"))
    return report.score_facts(s).select("key", "value")


_FACTS = f"WITH s AS ({analysis._SCORE}) " + " UNION ALL ".join(f"SELECT 'lora_ft__per_field__' || field || '__{n}' AS key, {c} AS value FROM s" for n, c in (("em", "em_rate"), ("f1", "f1"), ("precision", "precision"), ("recall", "recall")))


def error_sample(spark: S, d: str) -> DataFrame:
    """How an error names its ids: the first ten in order, and how many more there are."""
    bad = errors.sampled(table(spark, d, "documents").where("doc_id % 13 = 0"), "doc_id")
    return bad.select(F.substring_index(errors.message(F.lit(""), F.col("n"), F.col("sample")), ": ", -1).alias("sample"))


_RECORDS = f"""
WITH x AS (SELECT doc_id, regexp_extract({fx.RAW}, '(?s)\\{{.*\\}}') AS t FROM documents), y AS (SELECT doc_id, CASE WHEN json_valid(t) THEN t END AS j FROM x),
z AS (SELECT doc_id, j, coalesce(j IS NOT NULL AND len(json_keys(j)) = 16 AND {curation._TYPES}, false) AS v FROM y)
SELECT doc_id, 'lora_ft' AS arm, v AS schema_valid, CASE WHEN v THEN json_extract_string(j, '$.employment_type') END AS employment_type,
  CASE WHEN v THEN CAST(json_extract_string(j, '$.salary_min') AS DOUBLE) END AS salary_min, CASE WHEN v THEN CAST(json_extract_string(j, '$.years_experience_min') AS BIGINT) END AS years_experience_min FROM z
"""

QUERIES = {
    "j2_j6_records": (analysis.records, _RECORDS),
    "j4_s9_x1_parse_results": (parsed_results, _RESULTS),
    "a11_accounted": (accounted, _ACCOUNT),
    "jn8_missing_ids": (missing_ids, "SELECT doc_id % 11 AS batch, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id % 7 < 5 GROUP BY 1"),
    "a10_outcome_buckets": (outcome_buckets, _BUCKETS),
    "st5_retry_round": (retried, f"SELECT doc_id FROM ({_O}) WHERE outcome IN ('parse_failed', 'api_error')"),
    "st5_prompt_at_fault": (prompt_at_fault, f"WITH o AS ({_O}), s AS (SELECT (count(*) FILTER (outcome IN ('parse_failed', 'api_error')))::DOUBLE / count(*)::DOUBLE AS share FROM o) SELECT share, share > 0.2 AS prompt_at_fault FROM s"),
    "fl9_capacity_errors": (capacity, "SELECT doc_id, doc_id % 6 < 2 AS capacity FROM documents"),
    "fl6_o3_agreement_floor_all": (floor_of_agreement, _FLOOR),
    "jn17_review_queue": (queue, _QUEUE),
    "st9_first_unreviewed": (first_unreviewed, _FIRST),
    "a22_teacher_bench": (teacher_bench, _BENCH),
    "a2_x2_merged_counts": (merged_counts, analysis._SCORE),
    "o5_arms_compared": (compared, f"SELECT a.arm, a.ord::BIGINT AS ord, count(*) FILTER (n_chars > 2000) / count(*) AS macro_f1 FROM documents JOIN (SELECT * FROM {analysis._ARMS}) a ON a.ord = doc_id % 5 GROUP BY 1, 2"),
    "m4_requests": (requests, "SELECT doc_id::VARCHAR AS custom_id, 'POST' AS method, '/v1/chat/completions' AS url, 'gpt-4o-mini' AS model, 1024 AS most, md5('system:sys|user:' || substr(text, 1, 6000)) AS digest FROM documents"),
    "m3_tuning_examples": (tuning_examples, _TUNING),
    "m6_frozen_exemplars": (frozen, "SELECT doc_id, lang, CASE doc_id WHEN 7 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS ord FROM documents WHERE doc_id IN (3, 7, 11)"),
    "st8_o1_gold_order": (in_order, "SELECT doc_id, -doc_id AS ord, lang FROM documents WHERE doc_id % 4 = 3"),
    "t16_rendered_values": (rendered, _RENDERED),
    "t15_shown_numbers": (shown, _SHOWN),
    "t17_batch_sizes": (batch_sizes, "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '1,8' WHEN 1 THEN '2,4,16' WHEN 5 THEN '32' END AS sizes FROM documents"),
    "x5_skill_overlap": (overlap, _OVERLAP),
    "r4_j7_score_facts": (facts, _FACTS),
    "o7_error_sample": (error_sample, "WITH b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents WHERE doc_id % 13 = 0) SELECT string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id) || CASE WHEN max(n) > 10 THEN ' (+' || (max(n) - 10) || ' more)' ELSE '' END AS sample FROM b WHERE r <= 10"),
}
