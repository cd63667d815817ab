"""Small files on any store that Spark reaches: atomic writes, listings, folders.

All of it goes through Hadoop's file systems on the driver, so a path may have any scheme that the session knows. A file is
written under a name of its own beside its place and renamed over it, which readers see as a whole or not at all.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[Any, Any, Any]:
    """(file system, path, JVM)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p), jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _at(spark, path)
    return fs.exists(p)


def make_dir(spark: SparkSession, path: str) -> None:
    fs, p, _ = _at(spark, path)
    fs.mkdirs(p)


def remove(spark: SparkSession, *paths: str) -> None:
    """Files or folders with all that is in them; one that is not there is no error."""
    for path in paths:
        fs, p, _ = _at(spark, path)
        fs.delete(p, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's visible files; none if it is not there."""
    fs, p, _ = _at(spark, folder)
    if not fs.exists(p):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n for n in found if n[0] not in "._")


def write_text(path: str, text: str, spark: SparkSession | None = None) -> None:
    """Atomic: the last of several writers wins as a whole. Folders above are made."""
    spark = spark or SparkSession.active()
    fs, p, jvm = _at(spark, path)
    fs.mkdirs(p.getParent())
    staged = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(staged, p, options)
    except Exception:
        fs.delete(staged, False)
        raise


def read_text(path: str, spark: SparkSession | None = None) -> str:
    """A small file as a whole."""
    fs, p, jvm = _at(spark or SparkSession.active(), path)
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
