"""The registered queries of these operators, over whole tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontam, divergence, neardup, ordinal, pseudonyms, quality, runs, runtime, secrets, setjoin, sharding, transcript, turns

#: Production parameters.
SHARDS = [1.0] * 16


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_read(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_join(_read(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    weights = ordinal.train(docs, _read(spark, sf_dir, "labels"))
    out = ordinal.severity(docs, weights, keep=["doc_id"])
    return out.select("doc_id", "expected_severity", F.round("expected_severity").cast("int").alias("grade"), (F.col("expected_severity") >= ordinal.CUT).alias("toxic"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = runtime.Workspace(spark).keep(transcript.assemble(_read(spark, sf_dir, "conversations")), "pieces")
    return transcript.digest(transcript.recovered(pieces, transcript.learn(pieces)))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.containment(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents"), SHARDS)


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    weights = quality.train(docs, _read(spark, sf_dir, "labels").where(_fold(F.col("doc_id")) != 0))
    out = quality.score(docs, weights)
    return out.select("doc_id", (_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, pseudonyms.key_of(spark), found="n_replaced")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_read(spark, sf_dir, "documents")))


def _looped(text: Column, doc_id: Column) -> Column:
    """A tenth of the texts, chosen by the id's checksum, with their end replaced by repetitions of a stretch of words."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")

    def loop(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.concat(F.slice(w, 1, a.cast("int")), F.transform(F.sequence(a, n - 1), lambda i: F.get(w, (a + (i - a) % p).cast("int")))), " ")

    # a blank text has no word and stays as it is
    return F.when(h % 10 == 0, F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, loop(w))), 1)).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", _looped(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.periodic_runs(docs).withColumn("best", runs.strongest(F.col("runs")))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return divergence.judge(docs, divergence.references(docs)).drop("chars_distance", "words_distance")


def _damaged(rows: DataFrame) -> DataFrame:
    """Rows by their checksum: dropped, emptied, without sentence ends, repeated next to themselves, or made the user's."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    told = rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1)))
    return told.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    fixed = turns.repair(_damaged(rows))
    told = fixed.summary.withColumnRenamed("conv", "c1")
    hashed = turns.digests(fixed.turns).withColumnRenamed("conv", "c2")
    every = rows.select("conv_id").distinct()
    out = every.join(told, every.conv_id.eqNullSafe(told.c1), "left").join(hashed, every.conv_id.eqNullSafe(hashed.c2), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_bpe, op2_jaccard, op3_toxicity, op4_chat, op5_neardup, op6_decontamination, op7_sharding, op8_quality, op9_pii, op10_secrets, op11_runs, op12_rules, op13_turns)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard": setjoin.ORACLE, "op5_neardup": neardup.ORACLE, "op6_decontamination": decontam.ORACLE, "op7_sharding": sharding.ORACLE, "op12_rules": divergence.ORACLE}
