"""Labelling: results, cache, outcomes, spend and quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import schema
from millrace.errors import ContractError
from millrace.functions import cost, extract, normalize
from millrace.tables import Workspace

CAPS = {"train": 5000, "dev": 300}
OUTCOMES = ("ok", "schema_invalid", "parse_failed", "api_error")
MOST_FAILED = 0.2
BATCH_ROWS, LEAST_OK, MOST_ENUM_SHARE, MOST_EMPTY_SKILLS = 500, 200, 0.95, 0.5


def parse_results(lines: DataFrame, model: str, prompt_sha: str, batch_id: str) -> DataFrame:
    """Provider result lines as cache rows: a request error, a status other than 200, no choices, a refusal, no content, or ok, in this order."""
    r, b = F.col("response"), F.col("response.body")
    choice = F.try_element_at(b["choices"], F.lit(1))
    code = r["status_code"]
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    failed, http = F.col("error").isNotNull(), ~F.coalesce(code == 200, F.lit(False))
    none = F.coalesce(F.size(b["choices"]), F.lit(0)) <= 0
    refused, empty = F.coalesce(choice["message"]["refusal"], F.lit("")) != "", F.coalesce(choice["message"]["content"], F.lit("")) == ""
    error = (
        F.when(failed, F.concat(F.lit("request_error: "), text(F.col("error.code")), F.lit(": "), text(F.col("error.message"))))
        .when(http, F.concat(F.lit("http_"), text(code), F.lit(": "), text(b["error"]["message"])))
        .when(none, "empty_content")
        .when(refused, F.concat(F.lit("refusal: "), choice["message"]["refusal"]))
        .when(empty, "empty_content")
    )
    billed = ~failed & ~http
    use = lambda c: F.when(billed, F.coalesce(b["usage"][c], F.lit(0))).otherwise(0).cast("bigint")
    return lines.select(
        F.col("custom_id").alias("doc_id"), F.lit(model).alias("teacher_model"), F.lit(prompt_sha).alias("prompt_sha"),
        F.when(error.isNull(), choice["message"]["content"]).alias("raw_output"),
        F.struct(use("prompt_tokens").alias("input_tokens"), use("completion_tokens").alias("output_tokens")).alias("usage"),
        error.isNull().alias("ok"), error.alias("error"), F.when(billed & ~none, choice["finish_reason"]).alias("finish_reason"), F.lit(batch_id).alias("batch_id"),
    )


def last_per_key(log: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """The last row of each key; an aggregation with map-side combining, so a hot key costs nothing."""
    best = log.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*log.columns), F.col(seq)).alias("r"))
    return best.select("r.*")


def cache_hits(cache: DataFrame, model: str, prompt_sha: str) -> DataFrame:
    """Ids with a usable row, after the last row has won."""
    return last_per_key(cache).where((F.col("teacher_model") == model) & (F.col("prompt_sha") == prompt_sha) & F.col("ok")).select("doc_id")


def todo(selected: DataFrame, hits: DataFrame) -> DataFrame:
    return selected.join(hits, "doc_id", "left_anti")


def select_docs(docs: DataFrame, splits: tuple[str, ...] = schema.SPLITS, limit: int | None = None, caps: dict[str, int] | None = None) -> DataFrame:
    """The first ids of each split up to its cap, then the first of all. Caps are part of the request, not a guard against skew."""
    caps = CAPS if caps is None else caps
    # a sorted limit for each split: tasks send on no more than the cap, and no split is numbered as a whole
    parts = [docs.where(F.col("split") == s).orderBy("doc_id").limit(caps[s]) for s in splits if s in caps]
    free = [s for s in splits if s not in caps]
    if free:
        parts.append(docs.where(F.col("split").isin(*free)))
    out = reduce(DataFrame.unionByName, parts) if parts else docs.limit(0)
    return out.orderBy("doc_id").limit(limit) if limit is not None else out


def outcomes(selected: DataFrame, cache: DataFrame) -> DataFrame:
    """Every selected row with its outcome; one without a cache row is an api_error."""
    last = last_per_key(cache).select("doc_id", "raw_output", "ok")
    v = extract.extract_json(F.col("raw_output"))
    return selected.join(last, "doc_id", "left").withColumn("v", v).withColumn("outcome", extract.outcome(F.col("ok"), F.col("v")))


def estimate(docs: DataFrame, system_chars: int, text: str = "text") -> DataFrame:
    """Tokens in and out that a run is expected to take."""
    chars = F.lit(system_chars) + F.least(F.length(text), F.lit(cost.TRUNCATE_CHARS))
    tokens = F.ceil(chars / F.lit(cost.CHARS_PER_TOKEN)) + cost.OVERHEAD_TOKENS
    return docs.agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("tokens_in"), (F.count("*") * cost.OUTPUT_TOKENS).cast("bigint").alias("tokens_out"))


def projection(estimated: Column, observed_mean: Column, priced: Column, n: Column) -> Column:
    """Dollars that a run will cost: the estimate, or the larger of it and the observed mean once enough calls are priced."""
    return F.when(priced >= cost.LEAST_PRICED, F.greatest(observed_mean * n, estimated)).otherwise(estimated)


def guard_spend(projected: float, most: float = cost.MOST_SPEND) -> None:
    if projected > most:
        raise ContractError(f"projected spend of ${projected:.2f} is over the cap of ${most:.2f}")


def null_rates(postings: DataFrame) -> DataFrame:
    """Share of null values of each field; one pass, wide to long after the aggregation."""
    n = postings.agg(F.count("*").alias("n"), *[F.count_if(normalize.null_valued(f, F.col(f))).alias(f) for f in schema.FIELDS])
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), cost.ratio(F.col(f), F.col("n")).alias("null_rate")) for i, f in enumerate(schema.FIELDS)]))
    return n.select(pairs.alias("p")).select("p.*")


def most_absent(rates: DataFrame, n: int = 5) -> DataFrame:
    """The n fields that are null most often, ties in the fields' order."""
    return rates.orderBy(F.desc("null_rate"), "ord").limit(n)


def enum_distribution(postings: DataFrame) -> DataFrame:
    """Rows of each member of each enumeration, zeros kept."""
    spark = postings.sparkSession
    domain = spark.createDataFrame([(f, i, m) for f, ms in schema.ENUMS.items() for i, m in enumerate(ms)], "field string, ord int, member string")
    long = postings.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("member")) for f in schema.ENUMS])).alias("p")).select("p.*")
    got = long.groupBy("field", "member").agg(F.count("*").alias("n"))
    return domain.join(got, ["field", "member"], "left").select("field", "ord", "member", F.coalesce("n", F.lit(0)).alias("n"))  # the domain is fixed


def quality_warnings(distribution: DataFrame, rates: DataFrame, counted: DataFrame) -> DataFrame:
    """Enumerations with one member above the share, and skills that are mostly empty; none below the least number of rows. ``counted (n_ok)`` has one row."""
    enough = F.broadcast(counted.where(F.col("n_ok") >= LEAST_OK))
    top = distribution.groupBy("field").agg(F.max_by("member", F.struct("n", -F.col("ord"))).alias("what"), F.max("n").alias("n"))
    share = F.col("n") / F.col("n_ok").cast("double")
    enums = top.crossJoin(enough).where(share > MOST_ENUM_SHARE).select("field", "what", share.alias("share"))
    skills = rates.where((F.col("field") == "required_skills") & (F.col("null_rate") > MOST_EMPTY_SKILLS)).crossJoin(enough)
    return enums.unionByName(skills.select("field", F.lit("empty").alias("what"), F.col("null_rate").alias("share")))


def batches(ids: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """Numbers the ids in order and cuts them into batches. Numbers come from counts per range of ids, the ranges from the ids themselves, so no task holds all ids whatever they look like."""
    ranges = Workspace(ids.sparkSession).keep(ids.select("doc_id").repartitionByRange("doc_id").withColumn("block", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("block").count()
    first = counts.select("block", F.coalesce(F.sum("count").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # one row for each range
    nth = ranges.withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy("doc_id")) - 1)
    return nth.join(first, "block").select("doc_id", F.floor((F.col("first") + F.col("r")) / rows).cast("bigint").alias("batch"))


def adopt(open_batches: DataFrame, remote: DataFrame) -> DataFrame:
    """For each ledger row ``(tag, input_file_id, docs_sha)`` without a batch id the first remote batch with its input file or its digest of ids.

    The first batch of each file and of each digest is found before either join, so both joins give at most a row for each
    ledger row, however many batches share a key. Rows that meet no batch are left out; null keys meet none; rows of one
    tag are one batch and take the first of their hits.
    """
    first = lambda key: remote.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"__{key}")).agg(F.min(F.struct("ord", "batch_id")).alias(f"by_{key}"))
    hit = open_batches
    for key in ("input_file_id", "docs_sha"):
        hit = hit.join(first(key), F.col(key) == F.col(f"__{key}"), "left")
    best = hit.groupBy("tag").agg(F.min(F.least("by_input_file_id", "by_docs_sha")).alias("best"))
    return best.where("best is not null").select("tag", F.col("best.batch_id").alias("batch_id"))


def terminal(status: Column, incomplete: Column) -> Column:
    """What a finished batch leads to."""
    return F.when(status == "completed", F.when(incomplete > 0, "requeue_missing").otherwise("harvested")).when(status.isin("expired", "cancelled"), "harvest_and_requeue").when(status == "failed", "resubmit").otherwise("wait")


def capacity_error(message: Column) -> Column:
    """Whether a batch failed because too many tokens are queued: a token limit, or anything enqueued."""
    m = F.lower(message)
    return (m.contains("token") & m.contains("limit")) | m.contains("enqueued")


def missing(batch_ids: DataFrame, rows: DataFrame) -> DataFrame:
    """``batch_ids (batch, doc_ids array)`` as ``(batch, doc_id)`` of the ids without a usable row."""
    sent = batch_ids.select("batch", F.explode("doc_ids").alias("doc_id"))
    return sent.join(rows.where("ok").select("doc_id"), "doc_id", "left_anti").select("batch", "doc_id")


def account(rows: DataFrame) -> DataFrame:
    """Tokens and dollars of result rows, at batch rates; rows without usage count as none."""
    i, o = F.coalesce(F.col("usage.input_tokens"), F.lit(0)), F.coalesce(F.col("usage.output_tokens"), F.lit(0))
    return rows.agg(F.coalesce(F.sum(i), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum(o), F.lit(0)).alias("tokens_out"), F.coalesce(F.sum(cost.batch_cost(i, o, F.col("teacher_model"))), F.lit(0.0)).alias("usd"))


def buckets(classified: DataFrame) -> DataFrame:
    """Rows of each outcome, zeros kept. They add up to the rows requested, since each row has one outcome; ``check_buckets`` says so."""
    return classified.agg(F.count("*").alias("n_requested"), *[F.count_if(F.col("outcome") == b).alias(f"n_{b}") for b in OUTCOMES])


def check_buckets(counts: DataFrame) -> None:
    r = counts.first()
    if sum(r[f"n_{b}"] for b in OUTCOMES) != r["n_requested"]:
        raise ContractError("the outcomes do not add up to the rows requested")


def retry_round(classified: DataFrame) -> DataFrame:
    """The ids worth one more round: lost calls and output that did not parse. A wrong shape is deterministic and stays as it is."""
    return classified.where(F.col("outcome").isin("parse_failed", "api_error")).select("doc_id")


def failing(counts: DataFrame) -> DataFrame:
    """The share of rows that a retry round would take, and whether it is so large that the prompt is at fault."""
    share = cost.ratio(F.col("n_parse_failed") + F.col("n_api_error"), F.col("n_requested"))
    return counts.select(share.alias("share"), (share > MOST_FAILED).alias("prompt_at_fault"))
