"""A training-corpus pipeline over ``documents`` and its stages.

toxicity (documents of an expected severity from the cut on go), near duplicates by word shingles (five words,
similarity 0.8; the smallest id of each group stays), benchmark decontamination (documents that contain an item go),
pseudonyms for personal data, and BPE encoding. Each stage reads what the one before has written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontam, ordinal, pseudonyms, runtime, setjoin


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the cut; the classifier learns from the labels of documents that are there.

    Null, empty and blank texts have no features and stay, as do all rows where there are no labels; rows without an id
    are scored by their text as others are; repeated rows stay or go together. Columns are those of ``docs``.
    """
    weights = ordinal.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = runtime.fresh(docs.columns, "__severity")
    return ordinal.severity(docs, weights, score=score).where(F.col(score) < ordinal.CUT).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts, the one with the smallest id; links by five-word shingles from a similarity of 0.8 on.

    Rows of one id are one document and stay or go together; rows without an id stay, as do null, empty and blank texts,
    which link with nothing. Columns are those of ``docs``.
    """
    groups = setjoin.jaccard_join(docs, k=5, num=4, den=5)
    name = runtime.fresh(docs.columns, "__gone")
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    gone = runtime.Workspace(spark).keep(gone, "gone")
    return docs.join(gone, docs.doc_id == gone[name], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark, containment being 0.8 of an item's distinct five-word shingles.

    Rows of one id go together if one of them contains an item; rows without an id stay, as do null and empty texts and,
    with an empty benchmark, all rows. Columns are those of ``docs``.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms of the session's key; ``n_chars``, if there, is counted anew.

    Null texts stay null, empty ones empty; repeated rows get the same pseudonyms. Columns are those of ``docs``.
    """
    out = pseudonyms.pseudonymise(docs, pseudonyms.key_of(spark))
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, ids, decoded)`` of every document.

    Null and empty texts have no ids and decode to the empty text; repeated rows give repeated rows, an empty table an
    empty one. Other columns do not pass.
    """
    return bpe.encode_decode(docs, full=True, keep=["doc_id", "lang", "source"])


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity), ("jaccard_join", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each one's rows written as Parquet and read again."""
    ws = runtime.Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
    return docs


#: The encoder and the classifier can't be said in SQL.
ORACLE_SQL = None
