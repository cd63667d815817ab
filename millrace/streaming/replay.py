"""Review logs as a stream: the last row of each slot of a document is kept in the state store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import stores

LOG = T.StructType([T.StructField("seq", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("doc_id", "field", "old", "new", "at", "action")]])


def fold(rows: DataFrame) -> DataFrame:
    """The last row of each (document, field or decision): all that a replay needs, and mergeable."""
    slot = F.when(F.col("action") == "edit", F.concat(F.lit("edit:"), "field")).otherwise(F.when(F.col("action") == "accept", "accept").otherwise("reject"))
    return rows.withColumn("slot", slot).groupBy("doc_id", "slot").agg(F.max_by(F.struct("seq", "field", "old", "new", "at", "action"), F.col("seq")).alias("r")).select("doc_id", "r.*")


#: Changes of so many micro-batches are folded into one table.
FOLDED = 16


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished versions below a folder, in order. There are few, since they are folded."""
    found = [int(n[2:]) for n in stores.names(spark, folder) if n.startswith("v=")]
    return sorted(v for v in found if stores.exists(spark, f"{folder}/v={v}/_SUCCESS"))


def replay_stream(spark: SparkSession, log_dir: str, state_dir: str, checkpoint_dir: str, files_per_batch: int = 1000, after_write=None) -> None:  # noqa: ANN001
    """Reads what is new in a folder of JSON lines and keeps the last row of each slot; run again it goes on where it stopped.

    The slots are keyed state in Spark's state store, so a micro-batch costs what it changes. It writes the changed slots as
    a version of its own, again the same if it is run twice; when there are more than ``FOLDED`` versions, the older ones
    are folded into one table, which is finished before they go. ``after_write(batch_id)`` is called when a micro-batch is
    written and not committed, for tests of crashes.
    """
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).json(log_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch.select(*LOG.names).write.mode("overwrite").json(f"{state_dir}/changes/v={batch_id + 1}")
        _fold_older(session, state_dir, batch_id)
        if after_write:
            after_write(batch_id)

    query = fold(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    query.awaitTermination()


def _fold_older(spark: SparkSession, state_dir: str, upto: int) -> None:
    """Folds all versions up to one, if they are many, and removes them once that is written."""
    old = [v for v in _versions(spark, f"{state_dir}/changes") if v <= upto]
    if len(old) > FOLDED:
        fold(states(spark, state_dir, upto)).select(*LOG.names).write.mode("overwrite").json(f"{state_dir}/folded/v={upto}")
        stores.remove(spark, *[f"{state_dir}/changes/v={v}" for v in old])
        stores.remove(spark, *[f"{state_dir}/folded/v={v}" for v in _versions(spark, f"{state_dir}/folded") if v < upto])


def states(spark: SparkSession, state_dir: str, version: int | None = None) -> DataFrame:
    """The folded log, from which ``gold.replay`` gives the same answer as from the whole log; by default of the last version. A version that was folded into a later one is not there any more."""
    most = (1 << 62) if version is None else version
    base = [v for v in _versions(spark, f"{state_dir}/folded") if v <= most][-1:]
    after = [v for v in _versions(spark, f"{state_dir}/changes") if v <= most and (not base or v > base[0])]
    paths = [f"{state_dir}/folded/v={v}" for v in base] + [f"{state_dir}/changes/v={v}" for v in after]
    return fold(spark.read.schema(LOG).json(paths)).select(*LOG.names) if paths else spark.createDataFrame([], LOG)
