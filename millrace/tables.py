"""Durable intermediate tables in the folder that driver and executors share, and connected components built on them."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_ROOT = str(Path(__file__).resolve().parents[1])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a private one only if the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


class Workspace:
    """Intermediate tables in the shared folder.

    Written tables cut lineage and survive the loss of executors. ``drop`` removes one that is no longer read; what is
    left goes when the JVM ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        let_workers_import(spark)
        self.base = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.base = self._fs.makeQualified(path).toString()  # with the scheme, so that others take it for what it is
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        self._n += 1
        path = f"{self.base}/{self._n}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self._paths.pop(id(df), None)
            if path:
                self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (a, b)`` as ``(node, root)``, root being the smallest node of its component.

    In each round a node points to its neighbour of lowest rank, if that is lower than its own, pointers are followed twice,
    and the edges are contracted to the nodes pointed at. The first two rounds rank nodes as they are, which ends stars and
    groups in which all are linked; from then on they are ranked by a hash of node and round, which keeps
    chains of pointers short, so that a path whose nodes are in order shrinks by a constant factor too. The smallest node
    is looked up at the end. All steps are partial aggregations and equi-joins; nothing is gathered on the driver. Null
    ends and loops are ignored.
    """
    clean = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    left = ws.keep(clean.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots: DataFrame | None = None
    nth = 0
    while not left.isEmpty():
        first = F.lit(0).cast("bigint") if nth < 2 else None
        rank = lambda c: F.struct((F.xxhash64(c, F.lit(nth)) if first is None else first).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min(rank("b")).alias("low")).select(F.col("a").alias("node"), F.least(rank("a"), "low")["n"].alias("to"))
        up = ws.keep(up, "up")
        for _ in range(2):
            far = up.alias("x").join(up.alias("y"), F.col("x.to") == F.col("y.node"), "left")
            jumped = ws.keep(far.select("x.node", F.coalesce("y.to", "x.to").alias("to")), "up")
            ws.drop(up)
            up = jumped
        a = left.join(up, left.a == up.node).select(F.col("to").alias("a"), "b")
        b = a.join(up, a.b == up.node).select("a", F.col("to").alias("b"))
        small = b.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        nxt = ws.keep(small, "edges")
        if roots is None:
            new = up.select("node", F.col("to").alias("root"))
        else:
            m = roots.join(up.withColumnRenamed("node", "n2"), F.col("root") == F.col("n2"), "left")
            new = m.select("node", F.coalesce("to", "root").alias("root"))
        new = ws.keep(new, "roots")
        ws.drop(left, up, *([roots] if roots is not None else []))
        roots, left, nth = new, nxt, nth + 1
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))  # no edges
    least = roots.groupBy(F.col("root").alias("__root")).agg(F.min("node").alias("__least"))
    out = ws.keep(roots.join(least, F.col("root") == F.col("__root")).select("node", F.col("__least").alias("root")), "roots")
    ws.drop(left, roots)
    return out
