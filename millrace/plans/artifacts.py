"""Queries of sources, sinks, streams, checks and reports: what is written is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace import errors, schema
from millrace.functions import identity
from millrace.operators import benchmarks, curate, gold, label, predict, report, score, waves
from millrace.plans import analysis, curation, delivery
from millrace.plans import fixtures as fx
from millrace.plans.fixtures import table
from millrace.sources import files
from millrace.streaming import ingest, replay
from millrace.tables import Workspace

S = SparkSession


def json_lines(spark: S, d: str) -> DataFrame:
    """Documents written as JSON lines in two goes, the second appended, and read back."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text", F.when(F.col("doc_id") % 3 != 0, "source").alias("none"))
    path = f"{Workspace(spark).base}/lines"
    n = files.write_jsonl(docs.where("doc_id % 2 = 0"), path) + files.write_jsonl(docs.where("doc_id % 2 <> 0"), path, "append")
    back = files.read_jsonl(spark, path, docs.schema)
    return back.select("doc_id", "lang", "none", F.md5(F.col("text").cast("binary")).alias("digest"), F.lit(n).cast("bigint").alias("written"))


_LINES = "SELECT doc_id, lang, CASE WHEN doc_id % 3 <> 0 THEN 'source' END AS none, md5(text) AS digest, (SELECT count(*) FROM documents) AS written FROM documents"


def malformed_lines(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    line = F.concat(F.lit('{"doc_id": '), F.col("doc_id"), F.when(F.col("doc_id") % 7 != 0, "}").otherwise(F.when(F.col("doc_id") % 2 == 0, "")))
    path = f"{Workspace(spark).base}/lines"
    docs.select(F.coalesce(line, F.lit(" ")).alias("value")).write.text(path)
    return files.malformed(spark, path, docs.select("doc_id").schema).select(F.col("_corrupt_record").alias("line"))


_MALFORMED = "SELECT '{\"doc_id\": ' || doc_id AS line FROM documents WHERE doc_id % 14 = 0"


def malformed_places(spark: S, d: str) -> DataFrame:
    """Where malformed lines stand, in one file that is read in many splits."""
    docs = table(spark, d, "documents")
    line = F.concat(F.lit('{"doc_id": '), F.col("doc_id"), F.when(F.col("doc_id") % 7 != 0, "}").otherwise(F.when(F.col("doc_id") % 2 == 0, "")))
    path = f"{Workspace(spark).base}/lines"
    rows = docs.select("doc_id", F.coalesce(line, F.lit(" ")).alias("value"))
    rows.coalesce(1).sortWithinPartitions("doc_id").select("value").write.text(path)
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "4k")
        return Workspace(spark).keep(files.malformed_lines(spark, path, docs.select("doc_id").schema).select("line", "value"), "places")
    finally:
        spark.conf.set(size, before)


_PLACES = "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS line FROM documents) SELECT line, '{\"doc_id\": ' || doc_id AS value FROM n WHERE doc_id % 14 = 0"


def corpus_sources(spark: S, d: str) -> DataFrame:
    """Text and key of two tables of unlike shape."""
    parts = [files.corpus_rows(table(spark, d, t)).select(F.lit(t).alias("source"), "source_key", F.md5(F.col("text").cast("binary")).alias("digest")) for t in ("documents", "pages")]
    return parts[0].unionByName(parts[1])


_SOURCES = """
SELECT 'documents' AS source, doc_id::VARCHAR AS source_key, md5(text) AS digest FROM documents WHERE regexp_matches(text, '\\S')
UNION ALL SELECT 'pages', sha256(html), md5(html) FROM pages WHERE regexp_matches(html, '\\S')
"""


def remote_sources(spark: S, d: str) -> DataFrame:
    """Text and key of the first rows of a store that is read through a source of its own; rows with a blank text count as read."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 9 == 4, " \n").otherwise(F.col("text")).alias("text"), "source")
    path = f"{Workspace(spark).base}/store"
    docs.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.option("parquet.block.size", 64 * 1024).parquet(path)
    most = docs.count() * 2 // 3
    return files.remote_rows(spark, path, most).select("source_key", F.md5(F.col("text").cast("binary")).alias("digest"))


_REMOTE = "SELECT doc_id::VARCHAR AS source_key, md5(text) AS digest FROM (SELECT * FROM documents ORDER BY doc_id LIMIT (SELECT count(*) * 2 // 3 FROM documents)) WHERE doc_id % 9 <> 4 AND regexp_matches(text, '\\S')"


def inferred_columns(spark: S, d: str) -> DataFrame:
    """What is taken for the text and the key of each table, the first rows by id."""
    out = []
    for name, by in (("documents", "doc_id"), ("pages", "page_id")):
        rows = table(spark, d, name).orderBy(by)
        t = curate.pick_text_column(rows)
        out.append((name, t, curate.pick_key_column(rows, t)))
    return spark.createDataFrame(out, "source string, text_column string, key_column string")


_INFERRED = """
WITH d AS (SELECT * FROM documents ORDER BY doc_id LIMIT 20), p AS (SELECT * FROM pages ORDER BY page_id LIMIT 20),
m AS (SELECT 'documents' AS source, 1 AS o, 'text' AS c, median(length(text)) AS n FROM d UNION ALL SELECT 'documents', 2, 'lang', median(length(lang)) FROM d UNION ALL SELECT 'documents', 3, 'source', median(length(source)) FROM d
  UNION ALL SELECT 'pages', 1, 'url', median(length(url)) FROM p UNION ALL SELECT 'pages', 2, 'html', median(length(html)) FROM p)
SELECT source, arg_max(c, n) AS text_column, CASE WHEN source = 'documents' AND (SELECT count(doc_id) = count(*) FROM d) THEN 'doc_id' END AS key_column FROM m GROUP BY source
"""


def written_splits(spark: S, d: str) -> DataFrame:
    """Held-out splits written in one pass and read back, beside the counts that the writer tells."""
    docs = table(spark, d, "documents").select("doc_id", identity.split(identity.doc_id(F.col("source"), F.col("doc_id").cast("string"))).alias("split"))
    folder, scope = Workspace(spark).base, ("dev", "eval_pool", "spare")
    told = files.write_splits(docs, folder, scope)
    parts = [files.read_jsonl(spark, f"{folder}/{s}", docs.select("doc_id").schema).select("doc_id", F.lit(s).alias("split"), F.lit(told[s]).cast("bigint").alias("n")) for s in scope]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_WRITTEN = f"""
WITH b AS (SELECT doc_id, ('0x' || substr(sha256({curation._ID}), 1, 8))::BIGINT % 100 AS b FROM documents)
SELECT doc_id, CASE WHEN b < 5 THEN 'eval_pool' ELSE 'dev' END AS split, count(*) OVER (PARTITION BY b < 5) AS n FROM b WHERE b < 10
"""


def streamed(spark: S, d: str) -> DataFrame:
    """A review log in four files, replayed as a stream of one file a micro-batch."""
    base = Workspace(spark).base
    fx.log(spark, d).withColumn("old", F.lit(None).cast("string")).select(*replay.LOG.names).repartition(4, "seq").write.json(f"{base}/log")
    replay.replay_stream(spark, f"{base}/log", f"{base}/state", f"{base}/checkpoint", files_per_batch=1)
    s = gold.replay(replay.states(spark, f"{base}/state"))
    return s.select("doc_id", "status", "verified_at", F.array_join(F.transform(F.array_sort(F.map_entries("edits")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("edits"))


def ingested(spark: S, d: str) -> DataFrame:
    """Documents that arrive in three waves of files, ingested as a stream that is started anew for each; the key is the text's, so ids and prefixes interact."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.lit(None).cast("string").alias("source_key"), "text")
    base = Workspace(spark).base
    low, high = docs.agg(F.min("seq"), F.max("seq")).first()
    wave = F.floor((F.col("seq") - F.lit(low)) * 3 / (F.lit(high) - F.lit(low) + 1))
    for k in range(3):
        docs.where(wave == k).write.mode("append").option("ignoreNullFields", False).json(f"{base}/pages")
        ingest.ingest_stream(spark, f"{base}/pages", f"{base}/out", f"{base}/checkpoint", source="s")
    ids = ingest.docs(spark, f"{base}/out").agg(F.sum("seq").alias("ids"))
    return ingest.counters(spark, f"{base}/out").join(ids, F.col("what") == "kept", "left")


_INGESTED = """
WITH d AS (SELECT doc_id AS seq, sha256(text) AS id, sha1(substr(text, 1, 600)) AS p, length(text) AS n FROM documents WHERE regexp_matches(text, '\\S')),
w AS (SELECT *, min(seq) OVER (PARTITION BY p) AS fp, min(seq) OVER (PARTITION BY id) AS fi FROM d WHERE n BETWEEN 400 AND 40000),
o AS (SELECT seq, CASE WHEN seq = fp THEN 'kept' WHEN fi = fp THEN 'duplicate_id' ELSE 'duplicate_prefix' END AS what FROM w UNION ALL SELECT seq, CASE WHEN n < 400 THEN 'short' ELSE 'long' END FROM d WHERE n NOT BETWEEN 400 AND 40000)
SELECT v.what, count(o.seq) AS n, CASE WHEN v.what = 'kept' THEN sum(o.seq)::BIGINT END AS ids FROM (VALUES ('kept'), ('short'), ('long'), ('duplicate_id'), ('duplicate_prefix')) v(what) LEFT JOIN o ON o.what = v.what GROUP BY v.what
"""


def gates(spark: S, d: str) -> DataFrame:
    """What the corpus has too few rows of."""
    docs = table(spark, d, "documents").select(identity.split(identity.doc_id(F.col("source"), F.col("doc_id").cast("string"))).alias("split"))
    return curate.too_small(curate.split_counts(docs), total=50_000, each=120)


_GATES = f"""
WITH b AS (SELECT ('0x' || substr(sha256({curation._ID}), 1, 8))::BIGINT % 100 AS b FROM documents),
c AS (SELECT 'corpus' AS what, count(*) AS n, 50000::BIGINT AS least FROM b UNION ALL SELECT 'eval_pool', count(*) FILTER (b < 5), 120 FROM b UNION ALL SELECT 'dev', count(*) FILTER (b >= 5 AND b < 10), 120 FROM b)
SELECT * FROM c WHERE n < least
"""


def faults(spark: S, d: str) -> DataFrame:
    """Ids that occur twice on either side, and predictions that gold does not know."""
    docs = table(spark, d, "documents").select("doc_id")
    known = docs.where("doc_id % 4 <> 0").unionAll(docs.where("doc_id % 6 = 1"))
    return score.faults(known, docs.unionAll(docs.where("doc_id % 5 = 0")))


_FAULTS = """
SELECT doc_id, 'duplicate in gold' AS what FROM documents WHERE doc_id % 6 = 1 AND doc_id % 4 <> 0 UNION ALL SELECT doc_id, 'duplicate in predictions' FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 'unknown to gold' FROM documents WHERE doc_id % 4 = 0 AND doc_id % 6 <> 1
"""


def error_message(spark: S, d: str) -> DataFrame:
    """How an error names ids, for offending sets larger and smaller than the sample."""
    docs = table(spark, d, "documents")
    found = [errors.sampled(docs.where(f"doc_id % {k} = 1"), "doc_id").select(F.lit(k).alias("k"), errors.message(F.lit("odd ids"), F.col("n"), F.col("sample")).alias("message")) for k in (13, 60)]
    return found[0].unionByName(found[1])


def _message(k: int) -> str:
    return f"SELECT {k}::INT AS k, 'odd ids: ' || string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id) || CASE WHEN max(n) > 10 THEN ' (+' || (max(n) - 10) || ' more)' ELSE '' END AS message FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents WHERE doc_id % {k} = 1) WHERE r <= 10"


def teacher_scores(spark: S, d: str) -> DataFrame:
    """The teacher's labels, there for every other document, scored as an arm."""
    g = fx.gold(spark, d)
    return score.per_field(score.joined(g, score.teacher_predictions(g.where("doc_id % 2 = 0"), g))).select("ord", "field", "tp", "fp", "fn", "em", "support", "f1")


_TEACHER = analysis._with_v(analysis._score_sql("pr AS (SELECT *, true AS v FROM gold WHERE doc_id % 2 = 0)", "ord, field, tp, fp, fn, em, support, f1 FROM z"))


def placed_arms(spark: S, d: str) -> DataFrame:
    return score.placed(delivery.compared(spark, d))


_PLACED = f"WITH h AS (SELECT a.arm, a.ord::BIGINT AS ord, count(*) FILTER (n_chars > 2000) / count(*) AS macro_f1 FROM documents JOIN (SELECT * FROM {analysis._ARMS}) a ON a.ord = doc_id % 5 GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY macro_f1 DESC, ord) AS place FROM h"


def ordered_file(spark: S, d: str) -> DataFrame:
    """Records written in gold's order; ``line`` is a record's place in the files."""
    docs = table(spark, d, "documents")
    path = f"{Workspace(spark).base}/predictions"
    ordered = predict.in_gold_order(docs.where("doc_id % 4 <> 1").select("doc_id", "lang"), docs.where("doc_id % 2 = 1").select("doc_id", (F.col("doc_id") * 31 % 1009 * 100000 + F.col("doc_id")).alias("ord")))
    files.write_jsonl(ordered, path)
    back = files.numbered(spark, path, whole=True)
    return back.select(F.from_json("value", ordered.schema)["doc_id"].alias("doc_id"), "line")


_ORDERED = "SELECT doc_id, row_number() OVER (ORDER BY doc_id * 31 % 1009 * 100000 + doc_id) AS line FROM documents WHERE doc_id % 4 = 3"


def latency_spread(spark: S, d: str) -> DataFrame:
    return benchmarks.latency_summary(table(spark, d, "events"), "event_type", "value").select("event_type", F.round("mean", 9).alias("mean"), F.round("stdev", 9).alias("stdev"))


def run_summary(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    p = docs.select("doc_id", (F.col("doc_id") % 9 != 0).alias("schema_valid"), F.least(F.col("n_chars"), F.lit(1024)).alias("completion_tokens"))
    return predict.run_summary(p, docs.where("doc_id % 3 = 0").select("doc_id")).select("n", "n_valid", "n_invalid", "n_truncated", "n_resumed")


def final_losses(spark: S, d: str) -> DataFrame:
    """A run that reports its training loss only; one that reports its best metric; one of which only the log tells."""
    e = table(spark, d, "events")
    log = e.select(F.col("event_id").alias("step"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("loss"), F.when(F.col("event_id") % 100 == 0, F.col("value")).alias("eval_loss"))
    kinds = {"trained": (0.5, None, None), "best": (None, 0.25, 0.125), "logged": (None, 9.0, None)}
    runs = [benchmarks.final_losses(log, spark.createDataFrame([v], "train_loss double, eval_loss double, best_metric double")).withColumn("run", F.lit(k)) for k, v in kinds.items()]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


_FINAL = """
WITH l AS (SELECT arg_max(value, event_id) FILTER (event_id % 3 = 0) AS final_loss, min(value) FILTER (event_id % 100 = 0) AS best FROM events)
SELECT 'trained' AS run, 0.5::DOUBLE AS final_train_loss, best AS best_eval_loss FROM l UNION ALL SELECT 'best', final_loss, 0.125 FROM l UNION ALL SELECT 'logged', final_loss, best FROM l
"""


def drifted_targets(spark: S, d: str) -> DataFrame:
    """Targets with a key too few, two keys changed over, or none at all; the rest as training examples."""
    g = fx.gold(spark, d)
    right = F.struct(*schema.FIELDS)
    swapped = F.struct(schema.FIELDS[1], schema.FIELDS[0], *schema.FIELDS[2:])
    target = F.when(F.col("doc_id") % 6 == 0, predict.compact_json(swapped)).when(F.col("doc_id") % 6 == 1, predict.compact_json(F.struct(*schema.FIELDS[1:]))).when(F.col("doc_id") % 6 == 2, "none").otherwise(predict.compact_json(right))
    rows = g.select("doc_id", "text", target.alias("gold"), predict.drifted(F.json_object_keys(target)).alias("drifted"))
    made = predict.training_rows(rows.where("not drifted"), "sys", "<|end|>").select("doc_id", F.lit(True).alias("made"))
    return rows.select("doc_id", "drifted").join(made, "doc_id", "left").select("doc_id", "drifted", F.coalesce("made", F.lit(False)).alias("made"))


def greedy_exemplars(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    covers = {lang: F.col("lang") == lang for lang in ("en", "de", "fr")} | {"long": F.col("n_chars") > 2000, "third": F.col("doc_id") % 3 == 0}
    ids = predict.pick_exemplars(docs, covers, 3)
    return spark.createDataFrame(list(enumerate(ids)), "place int, doc_id long")


_MASK = "CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 4 ELSE 0 END + CASE WHEN n_chars > 2000 THEN 8 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 16 ELSE 0 END"
_GREEDY = f"""
WITH r AS (SELECT doc_id, {_MASK} AS m, sha256(doc_id::VARCHAR) AS h FROM documents WHERE length(text) <= 3500),
a AS (SELECT doc_id, m FROM r ORDER BY bit_count(m) DESC, h LIMIT 1),
b AS (SELECT r.doc_id, r.m | a.m AS m FROM r, a WHERE r.doc_id <> a.doc_id ORDER BY bit_count(r.m & (31 - a.m)) DESC, h LIMIT 1),
c AS (SELECT r.doc_id FROM r, a, b WHERE r.doc_id NOT IN (a.doc_id, b.doc_id) ORDER BY bit_count(r.m & (31 - b.m)) DESC, h LIMIT 1)
SELECT 0::INT AS place, doc_id FROM a UNION ALL SELECT 1, doc_id FROM b UNION ALL SELECT 2, doc_id FROM c
"""


def quality_summary(spark: S, d: str) -> DataFrame:
    """The three most frequent members of each enumeration and the five fields that are absent most often."""
    top = analysis.top_members(spark, d).select("field", "member", F.col("n").cast("double").alias("figure"), "r")
    absent = label.most_absent(label.null_rates(fx.gold(spark, d)))
    return top.unionByName(absent.select("field", F.lit("absent").alias("member"), F.col("null_rate").alias("figure"), F.row_number().over(Window.orderBy(F.desc("null_rate"), "ord")).cast("bigint").alias("r")))


_SUMMARY = f"WITH n AS ({curation._NULLS}) SELECT field, member, n::DOUBLE AS figure, r FROM ({analysis._TOP}) UNION ALL SELECT field, 'absent', null_rate, r FROM (SELECT field, null_rate, row_number() OVER (ORDER BY null_rate DESC, ord) AS r FROM n) WHERE r <= 5"


def _arm(c: str = "doc_id") -> F.Column:
    return F.element_at(F.array(*map(F.lit, schema.ARMS)), (F.col(c) % 5 + 1).cast("int"))


def _metrics(docs: DataFrame) -> DataFrame:
    return docs.groupBy(_arm().alias("arm")).agg((F.count_if(F.col("n_chars") > 2000) / F.count("*")).alias("macro_f1"), (F.count_if(F.col("n_chars") > 100) / F.count("*")).alias("schema_valid_rate"), F.max(F.when(F.col("doc_id") % 5 > 0, (F.col("doc_id") % 5) / 10.0)).alias("macro_f1_null_baseline"))


def headline_rows(spark: S, d: str) -> DataFrame:
    """The headline's arms and its floor."""
    docs = table(spark, d, "documents").where("doc_id % 5 <> 3")
    bench = docs.where("doc_id % 5 <> 1").groupBy(_arm().alias("arm")).agg(F.max("n_chars").cast("double").alias("p50_ms"), F.lit(0.35).alias("hourly"))
    sweep = docs.where("doc_id % 5 in (0, 2)").select(_arm().alias("arm"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("batch_size"), (F.col("n_chars") % 50 + 1).cast("double").alias("throughput"), (F.col("n_chars") % 3 == 0).alias("oom"))
    return report.headline_rows(analysis._arms(spark), _metrics(docs), bench, sweep)


_RATE = "(SELECT arm, count(*) FILTER (n_chars > 100) / count(*) AS schema_valid_rate FROM d GROUP BY 1)"
_FLOOR_ROWS = (
    analysis._HEAD.rstrip()
    .replace("SELECT a.ord, a.arm, macro_f1,", "SELECT a.ord, a.arm, schema_valid_rate, macro_f1,")
    .replace("FROM a LEFT JOIN m", f"FROM a LEFT JOIN {_RATE} v USING (arm) LEFT JOIN m")
    + f" UNION ALL SELECT 5, '{report.NULL_BASELINE}', NULL, 0.1::DOUBLE, NULL, NULL, NULL, NULL, NULL"
)


def all_facts(spark: S, d: str) -> DataFrame:
    """Every fact of a report, from artefacts that are as small as real ones: five arms, and a sweep of forty rows each."""
    docs = table(spark, d, "documents").where("doc_id % 5 <> 3")
    metrics = {r["arm"]: r.asDict() | {"n": 300} for r in _metrics(docs).collect()}  # one row for each arm
    single = docs.where("doc_id % 5 <> 1").groupBy(_arm().alias("arm")).agg(F.max("n_chars").cast("double").alias("p50_ms"))
    bench = {r["arm"]: r.asDict() | {"p95_ms": r["p50_ms"] * 2, "gpu_hourly_usd": 0.35, "cost_per_1k_docs_usd": 0.125, "gpu_name": "T4"} for r in single.collect()}  # one row for each arm
    rows = docs.where("doc_id % 5 in (0, 2)").groupBy(_arm().alias("arm"), (F.col("doc_id") % 40).alias("batch_size")).agg((F.max("n_chars") % 50 + 1).cast("double").alias("throughput_docs_per_s"), (F.max("n_chars") % 3 == 0).alias("oom"))
    sweep: dict[str, dict] = {}
    for r in rows.orderBy("arm", "batch_size").collect():  # forty rows an arm at most
        sweep.setdefault(r["arm"], {"sweep": []})["sweep"].append(r.asDict() | {"amortized_ms_per_doc": 1000.0 / r["throughput_docs_per_s"]})
    agreed = {r["field"]: r["agreement"] for r in curation.agreement(spark, d).collect()}  # sixteen rows
    stats = {"gold": {"teacher_field_agreement": agreed, "reviewer": "human", "n_final": 300}, "corpus": {"n_kept": 7500, "source": "s"}, "train": {"train_runtime_s": 5400, "epochs": 3}, "teacher": {"n_ok": 4999, "spend_usd": 1.5}}
    tree = report.facts(metrics, bench, sweep, stats, "gpt-4o-mini", "base", 0.03, 30, {"generated_at": "then", "git_sha": "none"})
    return report.fact_table(spark, tree)


_PER_ARM = ("schema_valid_rate", "macro_f1", "delta_vs_teacher", "p50_ms", "p95_ms", "amortized_ms_per_doc", "best_batch_size", "cost_per_1k_docs_usd", "cost_per_1k_docs_usd_batch1")
_CONSTANT = {
    "n_eval_gold": 300, "n_train": 4999, "n_corpus": 7500, "corpus_source": "s", "corpus_license": None, "teacher_model": "gpt-4o-mini", "base_model": "base", "adapter_repo": None, "gpu_name": "T4", "gpu_hourly_usd": 0.35, "dtype": None,
    "bench_n_docs": None, "bench_repeats": None, "spend_usd": 1.5, "trainable_pct": None, "peak_vram_gb": None, "train_runtime_s": 5400, "train_runtime_h": 1.5, "train_epochs": 3, "best_eval_loss": None,
    "macro_f1_null_baseline": 0.1, "gold_reviewer": "human", "gold_audit_n": None, "gold_audit_doc_error_rate": None, "noise_f1": 0.03, "low_support": 30, "generated_at": "then", "git_sha": "none", "lowest_teacher_agreement": None,
}


def _fact(key: str, v: object) -> str:
    return f"SELECT '{key}' AS key, {'NULL' if v is None or isinstance(v, str) else v}::DOUBLE AS value, {repr(v) if isinstance(v, str) else 'NULL'}::VARCHAR AS text"


_ALL_FACTS = (
    f"WITH ag AS ({curation._AGREE}), a AS (SELECT * FROM {analysis._ARMS}), d AS (SELECT a.arm, doc_id, n_chars FROM documents JOIN a ON a.ord = doc_id % 5 WHERE doc_id % 5 <> 3), "
    "m AS (SELECT arm, count(*) FILTER (n_chars > 2000) / count(*) AS macro_f1, count(*) FILTER (n_chars > 100) / count(*) AS schema_valid_rate FROM d GROUP BY 1), "
    "b AS (SELECT arm, max(n_chars)::DOUBLE AS p50_ms FROM d WHERE doc_id % 5 <> 1 GROUP BY 1), s0 AS (SELECT arm, doc_id % 40 AS batch, max(n_chars) AS x FROM d WHERE doc_id % 5 IN (0, 2) GROUP BY 1, 2), "
    "s AS (SELECT arm, batch, (x % 50 + 1)::DOUBLE AS thr, row_number() OVER (PARTITION BY arm ORDER BY x % 50 DESC, batch) AS r FROM s0 WHERE x % 3 <> 0), "
    "j AS (SELECT a.arm, schema_valid_rate, macro_f1, macro_f1 - (SELECT macro_f1 FROM m WHERE arm = 'teacher') AS delta_vs_teacher, p50_ms, p50_ms * 2 AS p95_ms, 1000 / thr AS amortized_ms_per_doc, batch AS best_batch_size, "
    "coalesce(1000 / thr / 3600 * 0.35, CASE WHEN p50_ms IS NOT NULL THEN 0.125 END) AS cost_per_1k_docs_usd, CASE WHEN p50_ms IS NOT NULL THEN 0.125 END AS cost_per_1k_docs_usd_batch1 "
    "FROM a LEFT JOIN m USING (arm) LEFT JOIN b USING (arm) LEFT JOIN (SELECT * FROM s WHERE r = 1) s USING (arm)) "
    + " UNION ALL ".join([*[f"SELECT arm || '__{k}' AS key, {k}::DOUBLE AS value, NULL::VARCHAR AS text FROM j" for k in _PER_ARM], *[_fact(k, v) for k, v in _CONSTANT.items()]])
    + " UNION ALL SELECT 'lowest_teacher_agreement_str', NULL, string_agg('`' || field || '` ' || format('{:.3f}', agreement), ', ' ORDER BY agreement, field) FROM (SELECT * FROM ag ORDER BY agreement, field LIMIT 3)"
)


def rendered_table(spark: S, d: str) -> DataFrame:
    """Rows of each language as a table, spliced into a document whose template is filled, line by line."""
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # one row for each language
    block = report.pipe_table(["lang", "n"], ["l", "r"], [[str(r["lang"]), str(r["n"])] for r in counts])
    whole = report.rendered("{{ n }} languages", {"n": str(len(counts))})
    text = report.splice(f"# {whole}\n{report.BEGIN}\nold\n{report.END}\nend", block)
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "i long, line string")


_TABLE = f"""
WITH c AS (SELECT coalesce(lang, 'None') AS lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) AS r FROM documents GROUP BY documents.lang), k AS (SELECT count(*) AS k FROM c)
SELECT 0::BIGINT AS i, '# ' || k || ' languages' AS line FROM k UNION ALL SELECT 1, '{report.BEGIN}' UNION ALL SELECT 2, '| lang | n |' UNION ALL SELECT 3, '| :--- | ---: |' UNION ALL SELECT 3 + r, '| ' || lang || ' | ' || n || ' |' FROM c
UNION ALL SELECT k + 4, '' FROM k UNION ALL SELECT k + 5, '{report.END}' FROM k UNION ALL SELECT k + 6, 'end' FROM k
"""


def appended_block(spark: S, d: str) -> DataFrame:
    """A block added to a document that has no markers, then made anew in place; line by line."""
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # one row for each language
    first = report.splice("# Title\n\nprose\n", report.pipe_table(["lang"], ["c"], [[str(r["lang"])] for r in counts]))
    text = report.splice(first, report.pipe_table(["n"], ["r"], [[str(r["n"])] for r in counts]))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "i long, line string")


_APPENDED = f"""
WITH c AS (SELECT count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) AS r FROM documents GROUP BY lang), k AS (SELECT count(*) AS k FROM c)
SELECT i::BIGINT AS i, line FROM (VALUES (0, '# Title'), (1, ''), (2, 'prose'), (3, ''), (4, '{report.BEGIN}'), (5, '| n |'), (6, '| ---: |')) v(i, line) UNION ALL SELECT 6 + r, '| ' || n || ' |' FROM c
UNION ALL SELECT k + 7, '' FROM k UNION ALL SELECT k + 8, '{report.END}' FROM k UNION ALL SELECT k + 9, '' FROM k
"""


def artifacts(spark: S, d: str) -> DataFrame:
    """Results of the arms and their sweeps, a JSON file each, written and read back as a folder."""
    docs = table(spark, d, "documents").where("doc_id % 5 <> 3")
    folder = f"{Workspace(spark).base}/bench"
    for first in ("lora_ft", "teacher"):  # written twice; the last writer's file is the one there
        files.write_json(f"{folder}/{first}.json", {"arm": "none"})
    for r in _metrics(docs).collect():  # one row for each arm
        files.write_json(f"{folder}/{r['arm']}.json", {"arm": r["arm"], "macro_f1": r["macro_f1"]} if r["arm"] != "teacher" else {"macro_f1": r["macro_f1"]})
        files.write_json(f"{folder}/{r['arm']}_sweep.json", {"sweep": [{"batch_size": 1}, {"batch_size": 2}]})
    files.write_text(f"{folder}/notes.txt", "not read")
    one, sweeps = files.read_artifacts(spark, folder, T.StructType.fromDDL("arm string, macro_f1 double, sweep array<struct<batch_size:int>>"))
    return one.select("arm", F.lit("result").alias("kind"), "macro_f1").unionByName(sweeps.select("arm", F.concat(F.lit("sweep of "), F.size("sweep")).alias("kind"), "macro_f1"))


_ARTIFACTS = f"WITH m AS (SELECT a.arm, count(*) FILTER (n_chars > 2000) / count(*) AS macro_f1 FROM documents JOIN (SELECT * FROM {analysis._ARMS}) a ON a.ord = doc_id % 5 WHERE doc_id % 5 <> 3 GROUP BY 1) SELECT arm, 'result' AS kind, macro_f1 FROM m UNION ALL SELECT arm, 'sweep of 2', NULL FROM m"


def contract(spark: S, d: str) -> DataFrame:
    """The posting's JSON Schema, a row for each property, and how many of the documents' postings have a value there and one that the property allows."""
    tree = schema.json_schema()
    kind = lambda p: "enum" if "enum" in p else p["type"] if "type" in p else "|".join(x["type"] for x in p["anyOf"])
    rows = [(i, f, kind(p), len(p.get("enum", [])), f in tree["required"]) for i, (f, p) in enumerate(tree["properties"].items())]
    g = fx.gold(spark, d)
    json = g.select(predict.compact_json(F.struct(*schema.FIELDS)).alias("j"))
    v = json.select(F.from_json("j", "map<string,string>").alias("v"))
    allows = lambda f, p: F.col("v")[f].isin(p["enum"]) if "enum" in p else F.map_contains_key("v", f)
    sums = v.agg(*[F.count(F.col("v")[f]).alias(f"there_{f}") for f in tree["properties"]], *[F.count_if(allows(f, p)).alias(f"ok_{f}") for f, p in tree["properties"].items()])
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"there_{f}").alias("n_there"), F.col(f"ok_{f}").alias("n_allowed")) for f in tree["properties"]])).alias("x")).select("x.*")
    return spark.createDataFrame(rows, "ord int, field string, kind string, members int, required boolean").join(long, "field")


_CONTRACT = f"""
WITH {fx.gold_cte()}, c AS (SELECT * FROM (VALUES (0, 'title', 'string|null', 0), (1, 'company', 'string|null', 0), (2, 'employment_type', 'enum', 6), (3, 'seniority', 'enum', 7), (4, 'remote_mode', 'enum', 4), (5, 'location_city', 'string|null', 0),
  (6, 'location_region', 'string|null', 0), (7, 'location_country', 'string|null', 0), (8, 'salary_min', 'number|null', 0), (9, 'salary_max', 'number|null', 0), (10, 'salary_currency', 'string|null', 0), (11, 'salary_period', 'enum', 6),
  (12, 'years_experience_min', 'integer|null', 0), (13, 'education_level', 'enum', 7), (14, 'required_skills', 'array', 0), (15, 'posting_date', 'string|null', 0)) v(ord, field, kind, members), (SELECT true AS required)),
n AS ({" UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS n_there, count(*) AS n_allowed FROM gold" for f in schema.FIELDS)})
SELECT c.*, n_there, n_allowed FROM c JOIN n USING (field)
"""


def waves_of(spark: S, d: str) -> DataFrame:
    """Batches of a capped selection, each written as a file of requests and answered by a file of results that lacks some rows the first time; a batch is harvested by a join of the two. Before them a crash has left one batch open. How often each id was sent, and answered."""
    ids = curation.selected(spark, d).select("doc_id")
    base = Workspace(spark).base
    held = label.batches(ids, 64).groupBy("batch").agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).orderBy("batch")
    batches = ({"tag": f"b{r['batch']}", "doc_ids": list(r["ids"])} for r in held.toLocalIterator())  # one batch at a time
    one = T.StructType([T.StructField("doc_id", T.StringType())])

    def submit(batch: dict) -> str:
        at = f"at-{batch['tag']}"
        asked = spark.createDataFrame([(x,) for x in batch["doc_ids"]], one)  # a batch's ids
        files.write_jsonl(asked, f"{base}/requests/{at}")
        lost = F.col("doc_id").endswith("0") & F.lit("requeue" not in at and at != "at-again")
        files.write_jsonl(asked.where(~lost).withColumn("ok", F.lit(True)), f"{base}/results/{at}")
        return at

    def harvest(at: str) -> list[str]:
        asked = files.read_jsonl(spark, f"{base}/requests/{at}", one).agg(F.collect_list("doc_id").alias("doc_ids")).withColumn("batch", F.lit(at))
        answered = files.read_jsonl(spark, f"{base}/results/{at}", T.StructType([*one.fields, T.StructField("ok", T.BooleanType())]))
        return [r["doc_id"] for r in label.missing(asked, answered).orderBy("doc_id").collect()]  # of one batch

    first, second = next(batches), next(batches, {"tag": "none", "doc_ids": []})
    ledger = [{"tag": first["tag"], "batch_id": submit(first)}, {"tag": "never", "doc_ids": second["doc_ids"]}]
    again = waves.resume(ledger, lambda row: None, harvest, lambda row: None)
    lost = [x for x in again if x not in second["doc_ids"]]
    rest = ({"tag": "again", "doc_ids": lost}, second, *batches)
    waves.run_wave(rest, submit, harvest, lambda batch, state: None, most_incomplete=1 << 30)
    count = lambda what: spark.read.schema(one).option("recursiveFileLookup", True).json(f"{base}/{what}").groupBy("doc_id").agg(F.count("*").alias(what))
    return count("requests").join(count("results"), "doc_id", "left").select("doc_id", F.col("requests").alias("sent"), F.coalesce("results", F.lit(0)).alias("harvested"))


_WAVES = f"SELECT doc_id, CASE WHEN doc_id LIKE '%0' THEN 2 ELSE 1 END::BIGINT AS sent, 1::BIGINT AS harvested FROM ({curation._SELECTED})"

QUERIES = {
    "s3_s4_k3_k4_artifacts": (artifacts, _ARTIFACTS),
    "j8_contract": (contract, _CONTRACT),
    "st3_st4_st7_waves": (waves_of, _WAVES),
    "s1_k1_k2_json_lines": (json_lines, _LINES),
    "s1_malformed_places": (malformed_places, _PLACES),
    "s2_malformed_lines": (malformed_lines, _MALFORMED),
    "s5_s8_corpus_sources": (corpus_sources, _SOURCES),
    "s5_remote_sources": (remote_sources, _REMOTE),
    "s6_s7_inferred_columns": (inferred_columns, _INFERRED),
    "k5_written_splits": (written_splits, _WRITTEN),
    "st1_ingest_stream": (ingested, _INGESTED),
    "st1_st2_streaming_replay": (streamed, curation._REPLAY),
    "fl7_gates": (gates, _GATES),
    "jn2_x4_x6_faults": (faults, _FAULTS),
    "o7_error_message": (error_message, f"{_message(13)} UNION ALL {_message(60)}"),
    "jn4_teacher_scores": (teacher_scores, _TEACHER),
    "o5_placed_arms": (placed_arms, _PLACED),
    "st8_o1_ordered_file": (ordered_file, _ORDERED),
    "a16_latency_spread": (latency_spread, "SELECT event_type, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS stdev FROM events GROUP BY 1"),
    "a19_run_summary": (run_summary, "SELECT count(*) AS n, count(*) FILTER (doc_id % 9 <> 0) AS n_valid, count(*) FILTER (doc_id % 9 = 0) AS n_invalid, count(*) FILTER (n_chars >= 1024) AS n_truncated, count(*) FILTER (doc_id % 3 = 0) AS n_resumed FROM documents"),
    "c11_final_losses": (final_losses, _FINAL),
    "m5_drifted_targets": (drifted_targets, "SELECT doc_id, doc_id % 6 < 3 AS drifted, doc_id % 6 >= 3 AS made FROM documents"),
    "m6_greedy_exemplars": (greedy_exemplars, _GREEDY),
    "o6_quality_summary": (quality_summary, _SUMMARY),
    "r1_headline_rows": (headline_rows, _FLOOR_ROWS),
    "r4_j7_all_facts": (all_facts, _ALL_FACTS),
    "k9_appended_block": (appended_block, _APPENDED),
    "k8_k9_r5_rendered_table": (rendered_table, _TABLE),
}
