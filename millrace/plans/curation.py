"""Queries of curation, labelling and gold sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schema
from millrace.functions import cost, extract, identity, normalize, text
from millrace.operators import curate, gold, label
from millrace.plans import fixtures as fx
from millrace.plans.fixtures import table

S = SparkSession
_ID = "'jp_' || substr(sha256(source || chr(0) || CAST(doc_id AS VARCHAR)), 1, 10)"


def _docs(spark: S, d: str) -> DataFrame:
    return _identified(table(spark, d, "documents"))


def _identified(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").alias("seq"), "text", "source", "lang", F.col("doc_id").cast("string").alias("key"))
    return curate.identified(rows.withColumn("text", text.clean(F.col("text"))), F.col("source"), F.col("key")).withColumn("char_len", F.length("text"))


def clean_pages(spark: S, d: str) -> DataFrame:
    return curate.cleaned(table(spark, d, "pages").withColumnRenamed("html", "text")).select("page_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("bigint").alias("n"))


_CLEAN = r"""
WITH e AS (SELECT page_id, replace(replace(replace(replace(html, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM pages WHERE trim(html) <> ''),
s AS (SELECT page_id, CASE WHEN regexp_matches(t, '(?i)<\s*/?\s*(p|br|li|ul|ol|div|span|strong|em|b|i|h[1-6]|table|tr|td|th|a|hr|blockquote)\b[^>]*>') THEN regexp_replace(t, '<[^>]+>', ' ', 'g') ELSE t END AS t FROM e),
n AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM s)
SELECT page_id, md5(t) AS digest, length(t)::BIGINT AS n FROM n
"""


def split_of_docs(spark: S, d: str) -> DataFrame:
    return _docs(spark, d).select("seq", "id", "prefix", identity.bucket(F.col("id")).alias("bucket"), "split", identity.prompt_sha(F.col("id"), F.col("lang")).alias("sha16"), F.sha2("text", 256).alias("fallback"))


_SPLIT = f"""
WITH d AS (SELECT doc_id AS seq, lang, text, {_ID} AS id FROM documents)
SELECT seq, id, sha1(substr(text, 1, 600)) AS prefix, b AS bucket, CASE WHEN b < 5 THEN 'eval_pool' WHEN b < 10 THEN 'dev' ELSE 'train' END AS split,
  substr(sha256(id || chr(0) || lang), 1, 16) AS sha16, sha256(text) AS fallback
FROM (SELECT *, ('0x' || substr(sha256(id), 1, 8))::BIGINT % 100 AS b FROM d)
"""


def split_counts(spark: S, d: str) -> DataFrame:
    rows = _docs(spark, d).withColumn("reason", curate.reason(F.col("char_len"))).where("reason is null")
    return curate.split_counts(curate.dedupe_unique(rows.select("seq", "prefix", "split")).where("drop is null"))


_KEPT = f"""
kept AS (SELECT * FROM (SELECT doc_id, text, {_ID} AS id, length(text) AS char_len, row_number() OVER (PARTITION BY sha1(substr(text, 1, 600)) ORDER BY doc_id) AS r FROM documents WHERE length(text) BETWEEN 400 AND 40000) WHERE r = 1)"""
_COUNTS = f"""
WITH {_KEPT}, b AS (SELECT ('0x' || substr(sha256(id), 1, 8))::BIGINT % 100 AS b FROM kept),
c AS (SELECT CASE WHEN b < 5 THEN 'eval_pool' WHEN b < 10 THEN 'dev' ELSE 'train' END AS split, count(*) AS n FROM b GROUP BY 1)
SELECT s AS split, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('train'), ('dev'), ('eval_pool')) v(s) LEFT JOIN c ON c.split = s
"""


def drop_counts(spark: S, d: str) -> DataFrame:
    """Counters of a run that stops at the 500th kept row."""
    raw = table(spark, d, "documents").withColumn("seq", F.col("doc_id"))
    prepare = lambda rows: _identified(rows).select("seq", "id", "prefix", curate.reason(F.col("char_len")).alias("reason"))
    seen, _ = curate.take_until(raw, 500, prepare)
    return seen.agg(F.count("*").alias("seen"), F.count_if(F.col("reason") == "short").alias("short"), F.count_if(F.col("reason") == "long").alias("long"), F.count_if(F.col("drop").isNotNull()).alias("duplicates"), F.count_if(F.col("reason").isNull() & F.col("drop").isNull()).alias("kept"))


_DROPS = """
WITH f AS (SELECT doc_id, CASE WHEN length(text) < 400 THEN 'short' WHEN length(text) > 40000 THEN 'long' END AS reason, text FROM documents),
g AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY reason IS NULL, sha1(substr(text, 1, 600)) ORDER BY doc_id) END AS r FROM f),
h AS (SELECT *, sum(CASE WHEN r = 1 THEN 1 ELSE 0 END) OVER (ORDER BY doc_id) AS k FROM g),
l AS (SELECT min(doc_id) AS last FROM h WHERE k = 500)
SELECT count(*) AS seen, count(*) FILTER (reason = 'short') AS short, count(*) FILTER (reason = 'long') AS long, count(*) FILTER (r > 1) AS duplicates, count(*) FILTER (r = 1) AS kept
FROM h, l WHERE last IS NULL OR doc_id <= last
"""


def coupled_dedupe(spark: S, d: str) -> DataFrame:
    """Exact copies share an id through the fallback key, so id and prefix interact."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), identity.doc_id(F.lit("s"), identity.fallback_key(F.col("text"))).alias("id"), identity.prefix_hash(F.col("text")).alias("prefix"))
    return curate.dedupe(rows).groupBy(F.coalesce("drop", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"), F.sum("seq").alias("ids"))


_COUPLED = """
WITH d AS (SELECT doc_id AS seq, sha256(text) AS id, sha1(substr(text, 1, 600)) AS p FROM documents),
w AS (SELECT *, min(seq) OVER (PARTITION BY p) AS fp, min(seq) OVER (PARTITION BY id) AS fi FROM d),
o AS (SELECT seq, CASE WHEN seq = fp THEN 'kept' WHEN fi = fp THEN 'duplicate_id' ELSE 'duplicate_prefix' END AS outcome FROM w)
SELECT outcome, count(*) AS n, sum(seq)::BIGINT AS ids FROM o GROUP BY 1
"""


def length_percentiles(spark: S, d: str) -> DataFrame:
    return curate.length_percentiles(table(spark, d, "documents").select(F.length("text").alias("char_len")))


_PCT = """
WITH v AS (SELECT length(text) AS v, row_number() OVER (ORDER BY length(text)) - 1 AS j, count(*) OVER () - 1 AS m FROM documents),
p AS (SELECT q, max(CASE WHEN j = q * m // 100 THEN v END) AS a, max(CASE WHEN j = least(q * m // 100 + 1, m) THEN v END) AS b, max(q * m % 100) AS d FROM v, (VALUES (5), (50), (95)) t(q) GROUP BY q)
SELECT max(CASE WHEN q = 5 THEN (a * (100 - d) + b * d) // 100 END)::BIGINT AS p5, max(CASE WHEN q = 50 THEN (a * (100 - d) + b * d) // 100 END)::BIGINT AS p50,
  max(CASE WHEN q = 95 THEN (a * (100 - d) + b * d) // 100 END)::BIGINT AS p95, (SELECT max(length(text)) FROM documents)::BIGINT AS max FROM p
"""


def normalised(spark: S, d: str) -> DataFrame:
    g = fx.gold(spark, d)
    return g.select("doc_id", *[normalize.norm_field(f, F.col(f)).alias(f) if f not in schema.SETS else F.array_join(F.array_sort(normalize.norm_field(f, F.col(f))), ",").alias(f) for f in schema.FIELDS])


def ns(c: str) -> str:
    return f"nullif(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '')"


def norm_sql(f: str, c: str) -> str:
    if f in schema.SETS:
        return f"list_distinct(list_filter(list_transform(coalesce({c}, CAST([] AS VARCHAR[])), lambda x: {ns('x')}), lambda x: x IS NOT NULL))"
    if f in schema.FLOATS + schema.INTEGERS:
        return f"CAST({c} AS DOUBLE)"
    if f == "posting_date":
        return f"nullif(trim({c}), '')"
    return f"upper({ns(c)})" if f in schema.UPPER else ns(c)


_NORM = f"WITH {fx.gold_cte()} SELECT doc_id, " + ", ".join(f"array_to_string(list_sort({norm_sql(f, f)}), ',') AS {f}" if f in schema.SETS else f"{norm_sql(f, f)} AS {f}" for f in schema.FIELDS) + " FROM gold"


def null_rates(spark: S, d: str) -> DataFrame:
    return label.null_rates(fx.gold(spark, d))


def _null_sql(f: str) -> str:
    return f"coalesce({f} = 'unknown', true)" if f in schema.ENUMS else f"coalesce(len({f}) = 0, true)" if f in schema.SETS else f"{f} IS NULL"


_NULLS = f"WITH {fx.gold_cte()} " + " UNION ALL ".join(f"SELECT {i}::INT AS ord, '{f}' AS field, count(*) FILTER ({_null_sql(f)})::DOUBLE / count(*)::DOUBLE AS null_rate FROM gold" for i, f in enumerate(schema.FIELDS))


def enum_distribution(spark: S, d: str) -> DataFrame:
    return label.enum_distribution(fx.gold(spark, d))


_ENUMS = f"WITH {fx.gold_cte()} " + " UNION ALL ".join(f"SELECT '{f}' AS field, {i}::INT AS ord, '{m}' AS member, count(*) FILTER ({f} = '{m}') AS n FROM gold" for f, ms in schema.ENUMS.items() for i, m in enumerate(ms))


def quality_warnings(spark: S, d: str) -> DataFrame:
    g = fx.gold(spark, d).withColumn("seniority", F.when(F.col("doc_id") % 50 == 0, "mid").otherwise("unknown")).withColumn("required_skills", F.when(F.col("doc_id") % 3 == 0, F.col("required_skills")).otherwise(F.array().cast("array<string>")))
    return label.quality_warnings(label.enum_distribution(g), label.null_rates(g), g.agg(F.count("*").alias("n_ok")))


_WARN = """
SELECT 'seniority' AS field, 'unknown' AS what, (count(*) FILTER (doc_id % 50 <> 0))::DOUBLE / count(*) AS share FROM documents HAVING (count(*) FILTER (doc_id % 50 <> 0))::DOUBLE / count(*) > 0.95 AND count(*) >= 200
UNION ALL SELECT 'required_skills', 'empty', (count(*) FILTER (doc_id % 3 <> 0))::DOUBLE / count(*) FROM documents HAVING (count(*) FILTER (doc_id % 3 <> 0))::DOUBLE / count(*) > 0.5 AND count(*) >= 200
"""


def outcomes(spark: S, d: str) -> DataFrame:
    return label.outcomes(table(spark, d, "documents").select("doc_id"), fx.cache(spark, d)).select("doc_id", "outcome")


_TYPES = " AND ".join(
    f"json_extract_string(j, '$.{f}') IN ({', '.join(repr(m) for m in schema.ENUMS[f])})" if f in schema.ENUMS
    else f"json_type(j, '$.{f}') = 'ARRAY'" if f in schema.SETS
    else f"json_type(j, '$.{f}') IN ('NULL', 'UBIGINT', 'BIGINT', 'DOUBLE')" if f in schema.FLOATS
    else f"json_type(j, '$.{f}') IN ('NULL', 'UBIGINT', 'BIGINT')" if f in schema.INTEGERS
    else f"json_type(j, '$.{f}') IN ('NULL', 'VARCHAR')"
    for f in schema.FIELDS
)
_LAST = f"c AS ({fx.CACHE}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS r FROM c) WHERE r = 1)"
_OUTCOME = f"""
WITH {_LAST}, x AS (SELECT d.doc_id, l.ok, regexp_extract(coalesce(raw_output, ''), '(?s)\\{{.*\\}}') AS t FROM documents d LEFT JOIN l USING (doc_id)),
y AS (SELECT doc_id, ok, CASE WHEN json_valid(t) THEN t END AS j FROM x)
SELECT doc_id, CASE WHEN NOT coalesce(ok, false) THEN 'api_error' WHEN j IS NULL THEN 'parse_failed'
  WHEN len(json_keys(j)) = 16 AND {_TYPES} THEN 'ok' ELSE 'schema_invalid' END AS outcome FROM y
"""


def cache_todo(spark: S, d: str) -> DataFrame:
    return label.todo(table(spark, d, "documents").select("doc_id"), label.cache_hits(fx.cache(spark, d), "gpt-4o-mini", "cur"))


_TODO = f"WITH {_LAST} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l WHERE teacher_model = 'gpt-4o-mini' AND prompt_sha = 'cur' AND ok)"


def spend(spark: S, d: str) -> DataFrame:
    rows = fx.cache(spark, d).withColumn("batch", cost.batch_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("teacher_model"))).withColumn("full", cost.cost(F.col("tokens_in"), F.col("tokens_out"), F.col("teacher_model")))
    return rows.select("seq", "batch", "full")


_SPEND = f"WITH c AS ({fx.CACHE}), p AS (SELECT *, CASE teacher_model WHEN 'gpt-4o' THEN 2.5::DOUBLE ELSE 0.15::DOUBLE END AS pi, CASE teacher_model WHEN 'gpt-4o' THEN 10::DOUBLE ELSE 0.6::DOUBLE END AS po FROM c) SELECT seq, 0.5::DOUBLE * (tokens_in / 1e6::DOUBLE * pi + tokens_out / 1e6::DOUBLE * po) AS batch, 1::DOUBLE * (tokens_in / 1e6::DOUBLE * pi + tokens_out / 1e6::DOUBLE * po) AS \"full\" FROM p"


def estimate(spark: S, d: str) -> DataFrame:
    return label.estimate(table(spark, d, "documents"), 1200)


_EST = "SELECT sum(ceil((1200 + least(length(text), 6000)) / 4.0) + 32)::BIGINT AS tokens_in, (count(*) * 350)::BIGINT AS tokens_out FROM documents"


def selected(spark: S, d: str) -> DataFrame:
    rows = _docs(spark, d).select(F.col("id").alias("doc_id"), "split")
    return label.select_docs(rows, limit=300, caps={"train": 200, "dev": 20})


_SELECTED = f"""
WITH b AS (SELECT {_ID} AS doc_id FROM documents), s AS (SELECT doc_id, ('0x' || substr(sha256(doc_id), 1, 8))::BIGINT % 100 AS b FROM b),
t AS (SELECT doc_id, CASE WHEN b < 5 THEN 'eval_pool' WHEN b < 10 THEN 'dev' ELSE 'train' END AS split FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS r FROM t)
SELECT doc_id, split FROM r WHERE r <= CASE split WHEN 'train' THEN 200 WHEN 'dev' THEN 20 ELSE 1000000000 END ORDER BY doc_id LIMIT 300
"""


def batched(spark: S, d: str) -> DataFrame:
    ids = _docs(spark, d).select(F.col("id").alias("doc_id"))
    return label.batches(ids, 64).groupBy("batch").agg(F.count("*").alias("n"), identity.ids_digest(F.col("doc_id")).alias("docs_sha"))


_BATCHED = f"WITH b AS (SELECT {_ID} AS doc_id FROM documents), n AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM b) SELECT batch::BIGINT AS batch, count(*) AS n, sha256(string_agg(doc_id, ',' ORDER BY doc_id)) AS docs_sha FROM n GROUP BY 1"


def adopted(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    mine = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("tag"), (F.col("doc_id") % 40).cast("string").alias("input_file_id"), F.md5(F.col("source").cast("binary")).alias("docs_sha"))
    there = docs.select(F.concat(F.lit("b"), "doc_id").alias("batch_id"), F.col("doc_id").alias("ord"), (F.col("doc_id") % 70).cast("string").alias("input_file_id"), F.md5(F.col("source").cast("binary")).alias("docs_sha"))
    return label.adopt(mine, there)


_ADOPT = """
WITH m AS (SELECT doc_id AS tag, CAST(doc_id % 40 AS VARCHAR) AS f, md5(source) AS s FROM documents WHERE doc_id % 3 = 0),
r AS (SELECT 'b' || doc_id AS batch_id, doc_id AS ord, CAST(doc_id % 70 AS VARCHAR) AS f, md5(source) AS s FROM documents)
SELECT tag, arg_min(batch_id, ord) AS batch_id FROM m JOIN r ON m.f = r.f OR m.s = r.s GROUP BY 1
"""


def strata(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.length("text").alias("char_len"))
    return gold.sample(rows, 120).select("doc_id", "stratum")


_STRATA = """
WITH p AS (SELECT doc_id, CASE WHEN length(text) < 1500 THEN '400-1500' WHEN length(text) < 3000 THEN '1500-3000' WHEN length(text) < 8000 THEN '3000-8000' ELSE '8000-40000' END AS stratum FROM documents),
c AS (SELECT stratum, count(*) AS c, sum(count(*)) OVER () AS total FROM p GROUP BY 1),
e AS (SELECT *, c * 120.0::DOUBLE / total AS exact FROM c), b AS (SELECT *, least(floor(exact), c) AS base FROM e),
k AS (SELECT *, 120 - sum(base) OVER () AS seats, row_number() OVER (PARTITION BY base < c ORDER BY exact - base DESC, stratum DESC) AS rank FROM b),
q AS (SELECT stratum, least(c, base + CASE WHEN base < c AND rank <= seats THEN 1 ELSE 0 END) AS quota FROM k),
r AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('1337:' || doc_id), doc_id) AS r FROM p)
SELECT doc_id, r.stratum FROM r JOIN q ON q.stratum = r.stratum WHERE r <= quota
"""


def replayed(spark: S, d: str) -> DataFrame:
    s = gold.replay(fx.log(spark, d))
    return s.select("doc_id", "status", "verified_at", F.array_join(F.transform(F.array_sort(F.map_entries("edits")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("edits"))


_REPLAY = f"""
WITH l AS ({fx.LOG_DUCK}),
e AS (SELECT doc_id, field, arg_max(new, seq) AS new FROM l WHERE action = 'edit' GROUP BY 1, 2), m AS (SELECT doc_id, string_agg(field || '=' || new, ';' ORDER BY field) AS edits FROM e GROUP BY 1),
s AS (SELECT doc_id, arg_max(action, seq) FILTER (action <> 'edit') AS status, arg_max("at", seq) FILTER (action = 'accept') AS verified_at FROM l GROUP BY 1)
SELECT s.doc_id, status, verified_at, edits FROM s LEFT JOIN m USING (doc_id)
"""


def review_counts(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string"))
    return gold.review_counts(gold.replay(fx.log(spark, d)), docs)


_REVIEW = f"""
WITH l AS ({fx.LOG_DUCK}), s AS (SELECT doc_id, arg_max(action, seq) FILTER (action <> 'edit') AS status, count(*) FILTER (action = 'edit') > 0 AS edited FROM l GROUP BY 1),
j AS (SELECT status, edited FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents) d LEFT JOIN s USING (doc_id))
SELECT count(*) AS candidates, count(status) AS reviewed, count(*) FILTER (status = 'accept') AS accepted, count(*) FILTER (status = 'accept' AND NOT edited) AS as_is,
  count(*) FILTER (status = 'accept' AND edited) AS edited, count(*) FILTER (status = 'reject_doc') AS rejected FROM j
"""


def edit_rates(spark: S, d: str) -> DataFrame:
    return gold.edit_rates(gold.replay(fx.log(spark, d)), 200)


_EDITS = f"""
WITH l AS ({fx.LOG_DUCK}), s AS (SELECT doc_id FROM l GROUP BY 1 HAVING arg_max(action, seq) FILTER (action <> 'edit') = 'accept')
SELECT field, count(DISTINCT l.doc_id) AS edited, count(DISTINCT l.doc_id) / 200.0::DOUBLE AS rate FROM l JOIN s USING (doc_id) WHERE action = 'edit' GROUP BY 1
"""


def median_gap(spark: S, d: str) -> DataFrame:
    return gold.median_gap(fx.log(spark, d))


_GAP = f"""
WITH l AS ({fx.LOG_DUCK}), t AS (SELECT seq, try_strptime("at", '%Y-%m-%dT%H:%M:%SZ') AS t FROM l WHERE action <> 'edit' AND "at" <> 'bad')
SELECT coalesce(median(g), 0)::DOUBLE AS median_s FROM (SELECT epoch(t) - lag(epoch(t)) OVER (ORDER BY seq) AS g FROM t)
"""


def agreement(spark: S, d: str) -> DataFrame:
    cand = fx.predictions(spark, d).where("schema_valid").select("doc_id", "parsed.*")
    return gold.agreement(fx.gold(spark, d), cand)


def _same(f: str) -> str:
    a, b = norm_sql(f, f"g.{f}"), norm_sql(f, f"p.{f}")
    return f"list_sort({a}) = list_sort({b})" if f in schema.SETS else f"{a} IS NOT DISTINCT FROM {b}"


_AGREE = f"WITH {fx.gold_cte()}, {fx.pred_cte()}, j AS (SELECT " + ", ".join(f"{_same(f)} AS {f}" for f in schema.FIELDS) + " FROM gold g JOIN pred p USING (doc_id) WHERE schema_valid) " + " UNION ALL ".join(f"SELECT {i}::INT AS ord, '{f}' AS field, count(*) FILTER ({f}) / count(*) AS agreement FROM j" for i, f in enumerate(schema.FIELDS))


def hints(spark: S, d: str) -> DataFrame:
    g = fx.gold(spark, d).withColumn("text", F.concat("text", F.lit(" senior engineer 3 region co 5 python € us")))
    return gold.hints(g).select("doc_id", F.array_join("low", ",").alias("low"))


def _hint(f: str) -> str:
    v = norm_sql(f, f)
    if f in schema.SETS:
        return f"len(list_filter({v}, lambda x: NOT contains(t, x))) > 0"
    if f == "salary_currency":
        return f"{v} IS NOT NULL AND NOT (contains(t, lower({v})) OR CASE {v} WHEN 'USD' THEN contains(t, '$') OR contains(t, 'us$') WHEN 'EUR' THEN contains(t, '€') WHEN 'GBP' THEN contains(t, '£') END)"
    if f in gold.GROUNDED:
        return f"{v} IS NOT NULL AND lower({v}) <> 'unknown' AND NOT contains(t, lower({v}))"
    if f in schema.FLOATS:
        return "salary_min > salary_max"
    return "years_experience_min > 40" if f in schema.INTEGERS else "NOT regexp_matches(posting_date, '^\\d{4}-\\d{2}-\\d{2}$')"


_HINTED = [f for f in schema.FIELDS if f not in schema.ENUMS]
_HINTS = f"WITH {fx.gold_cte()}, t AS (SELECT *, coalesce({ns("text || ' senior engineer 3 region co 5 python € us'")}, '') AS t FROM gold) SELECT doc_id, array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN {_hint(f)} THEN '{f}' END" for f in _HINTED) + "] IF x IS NOT NULL], ',') AS low FROM t"


def finalized(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string"), "lang")
    return gold.finalize(gold.replay(fx.log(spark, d)), docs, 50).select("doc_id", "lang", "verified_at")


_FINAL = f"""
WITH l AS ({fx.LOG_DUCK}), s AS (SELECT doc_id, arg_max(action, seq) FILTER (action <> 'edit') AS status, arg_max("at", seq) FILTER (action = 'accept') AS verified_at FROM l GROUP BY 1)
SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, lang, verified_at FROM documents d JOIN s ON s.doc_id = CAST(d.doc_id AS VARCHAR) WHERE status = 'accept' ORDER BY 1 LIMIT 50
"""


_SPLITS = ("eval_pool", "dev", "train")


def split_leakage(spark: S, d: str) -> DataFrame:
    """Held-out documents of the splits whose id or text occurs in a later split."""
    docs = table(spark, d, "documents").select(identity.doc_id(F.col("source"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    return gold.split_leaks(docs.withColumn("split", identity.split(F.col("doc_id"))), _SPLITS)


_SPLIT_LEAKS = f"""
WITH b AS (SELECT {_ID} AS doc_id, text FROM documents), s AS (SELECT *, ('0x' || substr(sha256(doc_id), 1, 8))::BIGINT % 100 AS b FROM b),
t AS (SELECT doc_id, text, CASE WHEN b < 5 THEN 0 WHEN b < 10 THEN 1 ELSE 2 END AS n, CASE WHEN b < 5 THEN 'eval_pool' WHEN b < 10 THEN 'dev' ELSE 'train' END AS split FROM s),
i AS (SELECT DISTINCT doc_id AS k, n, split FROM t), x AS (SELECT DISTINCT text AS k, n, split FROM t)
SELECT t.doc_id, t.split AS held_out, i.split AS other, 'doc_id' AS "by" FROM t JOIN i ON i.k = t.doc_id AND t.n < i.n
UNION ALL SELECT t.doc_id, t.split, x.split, 'text' FROM t JOIN x ON x.k = t.text AND t.n < x.n
"""


def length_bins(spark: S, d: str) -> DataFrame:
    labels = spark.createDataFrame([(b,) for b in gold.LABELS], "stratum string")
    got = table(spark, d, "documents").groupBy(gold.stratum(F.length("text")).alias("stratum")).agg(F.count("*").alias("n"))
    return labels.join(got, "stratum", "left").select("stratum", F.coalesce("n", F.lit(0)).alias("n"))


_BINS = "WITH p AS (SELECT CASE WHEN length(text) < 1500 THEN '400-1500' WHEN length(text) < 3000 THEN '1500-3000' WHEN length(text) < 8000 THEN '3000-8000' ELSE '8000-40000' END AS s FROM documents) SELECT v.s AS stratum, count(p.s) AS n FROM (VALUES ('400-1500'), ('1500-3000'), ('3000-8000'), ('8000-40000')) v(s) LEFT JOIN p ON p.s = v.s GROUP BY 1"


def extracted(spark: S, d: str) -> DataFrame:
    raw = fx.from_documents(spark, d, f"SELECT doc_id, {fx.RAW} AS raw FROM documents")
    v = extract.extract_json(F.col("raw"))
    return raw.select("doc_id", F.try_variant_get(v, "$.title", "string").alias("title"), F.size(F.json_object_keys(F.to_json(v))).cast("bigint").alias("n_keys"))


_EXTRACT = f"WITH r AS (SELECT doc_id, regexp_extract({fx.RAW}, '(?s)\\{{.*\\}}') AS t FROM documents), j AS (SELECT doc_id, CASE WHEN json_valid(t) THEN t END AS j FROM r) SELECT doc_id, json_extract_string(j, '$.title') AS title, len(json_keys(j))::BIGINT AS n_keys FROM j"

QUERIES = {
    "t1_t2_clean_pages": (clean_pages, _CLEAN),
    "h1_h6_identity": (split_of_docs, _SPLIT),
    "curate_split_counts_fl1_w1_a7": (split_counts, _COUNTS),
    "o2_a5_drop_counts": (drop_counts, _DROPS),
    "w1_coupled_dedupe": (coupled_dedupe, _COUPLED),
    "a6_length_percentiles": (length_percentiles, _PCT),
    "t3_t8_normalise": (normalised, _NORM),
    "a8_null_rates": (null_rates, _NULLS),
    "a9_jn13_enum_distribution": (enum_distribution, _ENUMS),
    "fl5_quality_warnings": (quality_warnings, _WARN),
    "j1_extract_json": (extracted, _EXTRACT),
    "jn7_j3_outcomes": (outcomes, _OUTCOME),
    "fl3_jn6_w2_todo": (cache_todo, _TODO),
    "c1_c2_spend": (spend, _SPEND),
    "c3_estimate": (estimate, _EST),
    "w5_fl2_select_docs": (selected, _SELECTED),
    "w6_h7_batches": (batched, _BATCHED),
    "jn16_adopt_batches_all": (adopted, _ADOPT),
    "o8_stratified_sample": (strata, _STRATA),
    "w3_jn11_replay": (replayed, _REPLAY),
    "a12_review_counts_all": (review_counts, _REVIEW),
    "a13_edit_rates": (edit_rates, _EDITS),
    "w4_a18_median_gap": (median_gap, _GAP),
    "jn10_agreement_all": (agreement, _AGREE),
    "fl4_t11_hints": (hints, _HINTS),
    "w7_finalize": (finalized, _FINAL),
    "jn5_x3_leakage_all": (split_leakage, _SPLIT_LEAKS),
    "a14_length_bins": (length_bins, _BINS),
}
