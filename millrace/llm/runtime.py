"""Shared plumbing: worker imports and batch sizes, and the library's durable tables and components."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

from millrace.tables import Workspace, components, shared_dir

__all__ = ["BATCH_ROWS", "Workspace", "components", "fresh", "prepare", "shared_dir"]

#: Rows of an Arrow batch at most; a batch of texts is held by the executor and by its Python worker.
BATCH_ROWS = 2000
_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from wherever the driver found it, and keep Arrow batches of whole texts small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def fresh(names: list[str], base: str = "__x") -> str:
    """A column name that is not among ``names``."""
    taken = {n.lower() for n in names}
    while base in taken:
        base += "_"
    return base
