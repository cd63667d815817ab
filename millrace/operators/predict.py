"""Prompts, batched generation behind a seam, records, and resuming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace import schema
from millrace.errors import ContractError, none_of
from millrace.functions import cost, extract
from millrace.tables import Workspace

Generate = Callable[[list[str]], list[str]]
BATCH = 8
FEWSHOT_CHARS = 3500


def truncated(text: Column) -> Column:
    return F.substring(text, 1, cost.TRUNCATE_CHARS)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def teacher_messages(system: str, text: Column) -> Column:
    return F.array(message("system", F.lit(system)), message("user", truncated(text)))


def student_messages(system: str, shots: list[tuple[str, str]], text: Column) -> Column:
    """System, user and assistant of each shot, user."""
    pairs = [m for u, a in shots for m in (message("user", F.lit(u)), message("assistant", F.lit(a)))]
    return F.array(message("system", F.lit(system)), *pairs, message("user", truncated(text)))


def request(doc_id: Column, model: str, messages: Column, most_tokens: int = 1024) -> Column:
    body = F.struct(F.lit(model).alias("model"), messages.alias("messages"), F.lit(0.0).alias("temperature"), F.lit(most_tokens).alias("max_tokens"))
    return F.struct(doc_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))


def compact_json(posting: Column) -> Column:
    """The posting in its contract's key order, nulls kept."""
    return F.to_json(posting, {"ignoreNullFields": "false"})


def training_example(messages: Column, posting: Column, end: str) -> Column:
    """The rendered prompt, the target and the end mark."""
    prompt = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n"))), "")
    return F.concat(prompt, F.lit("<|assistant|>\n"), compact_json(posting), F.lit(end))


def in_gold_order(done: DataFrame, gold: DataFrame, order: str = "ord") -> DataFrame:
    """The records of gold's ids with gold's place, sorted by it, so that part files in order are in gold's order."""
    return gold.select("doc_id", order).join(done, "doc_id").orderBy(order)


def pick_exemplars(rows: DataFrame, covers: dict[str, Column], n: int, key: str = "doc_id", text: str = "text") -> list:
    """Greedy: each round takes the row that adds most predicates, ties by hash of the key. Fewer than n rows are an error.

    A round is one aggregation over (key, predicates, hash), which are written once; each task sends one row. A null
    predicate does not hold. Repeated keys are rows of their own.
    """
    if n <= 0:
        raise ContractError(f"n must be positive, not {n}")
    held = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in covers.items()])) if covers else F.array().cast("array<string>")
    hashed = F.sha2(F.concat(F.lit(""), F.col(key).cast("string")), 256)
    short = rows.where(F.length(text) <= FEWSHOT_CHARS).select(F.col(key).alias("key"), held.alias("held"), hashed.alias("h"), F.monotonically_increasing_id().alias("nth"))
    pool = Workspace(rows.sparkSession).keep(short, "pool")
    there = pool.limit(n).count()
    if there < n:
        raise ContractError(f"{there} exemplars of the {n} needed")
    seen: list[str] = []
    taken: list[int] = []
    out = []
    for _ in range(n):
        gain = F.size(F.array_except("held", F.array(*map(F.lit, seen)).cast("array<string>")))
        top = pool.where(~F.col("nth").isin(taken)).agg(F.min_by(F.struct("key", "held", "nth"), F.struct(-gain, F.col("h"), F.col("nth"))).alias("r")).first()["r"]
        seen = sorted({*seen, *top["held"]})
        taken.append(top["nth"])
        out.append(top["key"])
    return out


def frozen_exemplars(rows: DataFrame, ids: list, key: str = "doc_id") -> DataFrame:
    """The rows of given ids in their order; a missing one is an error."""
    want = rows.sparkSession.createDataFrame(list(enumerate(ids)), f"ord int, {key} {rows.schema[key].dataType.simpleString()}")
    out = rows.join(F.broadcast(want), key).orderBy("ord")  # as long as the given list
    if out.count() != len(ids):
        raise ContractError("an exemplar is missing", 1, ids[:10])
    return out


def generate(prompts: DataFrame, call: Generate, prompt: str = "prompt", batch: int = BATCH) -> DataFrame:
    """Adds ``raw_output`` by calling ``call`` with batches; the number of outputs must be that of the inputs."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            outs: list[str] = []
            for i in range(0, len(pdf), batch):
                part = pdf[prompt].iloc[i : i + batch].tolist()
                got = call(part)
                if len(got) != len(part):
                    raise ContractError(f"{len(got)} outputs for {len(part)} prompts")
                outs += got
            yield pdf.assign(raw_output=outs)

    return prompts.mapInPandas(run, T.StructType([*prompts.schema.fields, T.StructField("raw_output", T.StringType())]))


def records(outputs: DataFrame, arm: str) -> DataFrame:
    """Prediction records. Output with a thinking block fails the job."""
    raw = F.when(F.col("raw_output").contains("<think>"), F.raise_error(F.lit("a thinking block in the output")).cast("string")).otherwise(F.col("raw_output"))
    base = outputs.withColumn("raw_output", raw).withColumn("parsed", extract.posting(extract.extract_json(F.col("raw_output"))))
    return base.withColumn("arm", F.lit(arm)).withColumn("schema_valid", F.col("parsed").isNotNull())


def remaining(todo: DataFrame, partial: DataFrame, arm: str) -> DataFrame:
    """What a resumed run has still to do; a partial file of another arm is an error."""
    other = partial.where(F.col("arm") != arm).limit(1).collect()
    if other:
        raise ContractError(f"partial predictions are of arm {other[0]['arm']!r}, not {arm!r}")
    return todo.join(partial, "doc_id", "left_anti")


def summary(preds: DataFrame, most_tokens: int = 1024) -> DataFrame:
    valid = F.col("schema_valid")
    return preds.agg(F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_invalid"), F.count_if(F.col("completion_tokens") >= most_tokens).alias("n_truncated"), F.avg("completion_tokens").alias("mean_tokens"))


def run_summary(preds: DataFrame, resumed: DataFrame, most_tokens: int = 1024) -> DataFrame:
    """The summary of a run with its size and the rows that an earlier run had done, ``resumed (doc_id)``."""
    before = preds.join(resumed.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.count("*").alias("n_resumed"))
    return summary(preds, most_tokens).withColumn("n", F.col("n_valid") + F.col("n_invalid")).crossJoin(before)  # one row each


def stride_sample(rows: DataFrame, order: str, stride: int, most: int) -> DataFrame:
    """Every stride-th row in order, ``most`` of them at most. Only the first ``stride * most`` rows are numbered; each task sends on no more."""
    return rows.orderBy(order).limit(stride * most).withColumn("__r", F.row_number().over(Window.orderBy(order)) - 1).where((F.col("__r") % stride == 0) & (F.col("__r") < stride * most)).drop("__r")


def drifted(keys: Column) -> Column:
    """Whether a posting's keys are not the contract's, in order; null keys are."""
    return ~F.coalesce(keys == F.array(*map(F.lit, schema.FIELDS)), F.lit(False))


def training_rows(rows: DataFrame, system: str, end: str, key: str = "doc_id", text: str = "text", target: str = "gold") -> DataFrame:
    """``(key, example)`` of rows whose target is JSON text. Keys that are not the contract's, in order, are an error, as is a prompt that ends with the end mark."""
    none_of(rows.where(drifted(F.json_object_keys(target))), key, "targets whose keys are not the fields in order")
    none_of(rows.where(truncated(F.col(text)).endswith(end)), key, "prompts that end with the end mark")
    posting = F.from_json(target, schema.POSTING)
    return rows.select(key, training_example(teacher_messages(system, F.col(text)), posting, end).alias("example"))
