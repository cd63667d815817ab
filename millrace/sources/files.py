"""Reading and writing of tables, artefacts and logs through Spark's sources."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace import schema
from millrace.errors import ContractError
from millrace.functions.text import BLANK
from millrace.operators import curate
from millrace.sources import rowstore, stores
from millrace.tables import Workspace


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def malformed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines that are not objects of the schema, with their file."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    parsed = lines.withColumn("p", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.where("p._corrupt_record is not null").select(F.col("value").alias("_corrupt_record"), "file")


def numbered(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """``(file, line, value)`` of every line, numbered from 1 within its file, or with ``whole`` through all files by name.

    A large file is read in splits by many tasks. Lines of a split are numbered by the task, and a split's first number is
    the sum of the counts of the splits before it; these are one row a split and come from the same scan.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("nth"))
    splits = Workspace(spark).keep(lines.groupBy("file", "at").agg(F.min("nth").alias("first"), F.count("*").alias("n")), "splits")
    order = Window.orderBy("file", "at") if whole else Window.partitionBy("file").orderBy("at")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "at", (before - F.col("first") + 1).alias("shift"))
    return lines.join(starts, ["file", "at"]).select("file", (F.col("nth") + F.col("shift")).alias("line"), "value")


def malformed_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``(file, line, value)`` of the lines that are not objects of the schema; blank lines count and are not malformed."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return numbered(spark, path).where((F.trim("value", F.lit(BLANK)) != "") & parsed["_corrupt_record"].isNotNull())


def checked_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``read_jsonl`` after a look for malformed lines; the error names the first of them as ``file:line``. One more pass over the file."""
    bad = malformed_lines(spark, path, schema).orderBy("file", "line").limit(10).collect()
    if bad:
        places = [f"{r['file'].rpartition('/')[2]}:{r['line']}" for r in bad]
        raise ContractError(f"malformed JSON at {places[0]}: {bad[0]['value'][:80]!r}", len(bad), places)
    return read_jsonl(spark, path, schema)


def corpus_rows(rows: DataFrame, most: int | None = None) -> DataFrame:
    """``(source_key, text)`` of a corpus table of any shape: the text and key columns are found by a look at its first rows, and only these two are read.

    ``most`` bounds the rows read, as part of the request. Without a key column the key is the text's hash; null and blank texts are left out.
    """
    text, key = _columns(rows)
    read = rows.select(*[F.col(f"`{c}`") for c in ((text,) if key is None else (key, text))])
    return _keyed(read if most is None else read.limit(most), text, key)


def remote_rows(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The same of a store outside Spark: a look at its first rows, then a scan that fetches two columns of the first ``most`` rows, blank ones counted."""
    text, key = _columns(rowstore.read(spark, path, limit=curate.PEEK_ROWS))
    return _keyed(rowstore.read(spark, path, [text] if key is None else [key, text], most), text, key)


def _columns(rows: DataFrame) -> tuple[str, str | None]:
    text = curate.pick_text_column(rows)
    return text, curate.pick_key_column(rows, text)


def _keyed(read: DataFrame, text: str, key: str | None) -> DataFrame:
    t = F.col(f"`{text}`")
    kept = read.where(t.isNotNull() & (F.trim(t, F.lit(BLANK)) != ""))
    return kept.select((F.sha2(t, 256) if key is None else F.col(f"`{key}`").cast("string")).alias("source_key"), t.alias("text"))


def enough_space(path: str, least: int, free: Callable[[str], int] = lambda p: shutil.disk_usage(p).free) -> None:
    """An error if the file system of a driver's folder has less than ``least`` bytes free; for other stores give ``free``."""
    left = free(path)
    if left < least:
        raise ContractError(f"only {left / 1024**3:.1f} GB free at {path}, {least / 1024**3:.1f} GB are needed")


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_artifacts(spark: SparkSession, folder: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """All JSON files of a folder: (metrics or bench, sweeps). The arm is the file's field, else its stem; a stem that ends in _sweep is a sweep."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    arm = F.coalesce(F.col("arm"), F.regexp_replace(stem, "_sweep$", "")) if "arm" in schema.names else F.regexp_replace(stem, "_sweep$", "")
    named = rows.select("*", stem.alias("stem")).withColumn("arm", arm)
    return named.where(~F.col("stem").endswith("_sweep")), named.where(F.col("stem").endswith("_sweep"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """The number of rows written, counted as they are. The job's commit makes it atomic; null fields are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", False).json(path)
    return seen.get["n"]


def write_splits(rows: DataFrame, folder: str, splits: Iterable[str]) -> dict[str, int]:
    """One folder for each split in scope, an empty one too; others are not touched. Returns rows by split.

    One pass over the rows writes all splits beside the target; each is then moved to its place, where an older one goes first.
    """
    splits = list(splits)
    seen = Observation()
    staged = f"{folder}/.staged-{uuid.uuid4().hex}"
    mine = rows.where(F.col("split").isin(*splits)).observe(seen, F.lit(0).alias("_"), *[F.count_if(F.col("split") == s).alias(s) for s in splits])
    mine.write.option("ignoreNullFields", False).partitionBy("split").json(staged)
    counts = seen.get
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in splits:
        if counts[s]:
            fs.delete(path(f"{folder}/{s}"), True)
            fs.rename(path(f"{staged}/split={s}"), path(f"{folder}/{s}"))
        else:
            write_jsonl(rows.drop("split").limit(0), f"{folder}/{s}")
    fs.delete(path(staged), True)
    return {s: counts[s] for s in splits}


def write_text(path: str, text: str) -> None:
    """Atomic: readers see the old file or the new one. A path with a scheme is written on its store, any other on the driver's disk."""
    if re.match(r"[a-z][a-z0-9+.-]*:/", path):
        stores.write_text(path, text)
        return
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(tmp, path)


def write_json(path: str, obj: object, sort_keys: bool = True) -> None:
    write_text(path, json.dumps(obj, indent=2, sort_keys=sort_keys, ensure_ascii=False) + "\n")


# The order of the keys of the two result files.
METRICS_KEYS = ("arm", "split", "n", "schema_valid_rate", "macro_f1", "macro_f1_null_baseline", "n_missing_predictions", "per_field", "generated_at", "git_sha")
TRAIN_KEYS = (
    "base_model", "adapter_repo", "n_train", "n_dev", "epochs", "lora_r", "trainable_params", "trainable_pct", "final_train_loss", "best_eval_loss", "train_runtime_s",
    "gpu_name", "n_gpus", "dtype", "peak_vram_gb", "generated_at", "git_sha", "load_in_4bit", "max_length", "token_p95", "effective_batch_size", "n_steps", "lr", "seed",
)


def write_metrics(path: str, result: dict) -> None:
    """An arm's scores, the keys and the fields of ``per_field`` in their order; a missing one is an error and others are left out."""
    required_keys(result, METRICS_KEYS)
    required_keys(result["per_field"], schema.FIELDS)
    write_json(path, {k: result[k] for k in METRICS_KEYS} | {"per_field": {f: result["per_field"][f] for f in schema.FIELDS}}, sort_keys=False)


def write_train_stats(path: str, stats: dict) -> None:
    """A training run's statistics in their order; a missing one is an error and others are left out."""
    required_keys(stats, TRAIN_KEYS)
    write_json(path, {k: stats[k] for k in TRAIN_KEYS}, sort_keys=False)


def required_keys(obj: dict, keys: Iterable[str]) -> None:
    missing = sorted(set(keys) - set(obj))
    if missing:
        raise ContractError("keys are missing", len(missing), missing[:10])


def parse_batch_sizes(text: str) -> list[int]:
    """A comma list of positive whole numbers, each once, in order."""
    out = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        if not part.isdigit() or int(part) <= 0:
            raise ContractError(f"not a positive whole number: {part!r}")
        out.add(int(part))
    if not out:
        raise ContractError("no batch sizes")
    return sorted(out)


def batch_sizes(text: Column) -> Column:
    """The same for a column; a part that is not a positive whole number, or no part at all, gives null."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    bad = F.exists(parts, lambda p: ~p.rlike("^[0-9]{1,9}$") | p.rlike("^0+$"))
    return F.when(~bad & (F.size(parts) > 0), F.array_sort(F.array_distinct(F.transform(parts, lambda p: F.try_to_number(p, F.lit("999999999")).cast("int")))))
