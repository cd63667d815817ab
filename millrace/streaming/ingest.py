"""Ingest of raw pages as a stream: clean, filter by length, keep the first of each id and prefix, and count every drop.

The rows kept so far are keyed state in Spark's state store: the 16-byte digests of each id and each prefix that a kept row
has claimed, ``BUCKETS`` entries of them, since Python is called once for each entry that a micro-batch touches and a call
costs far more than a key. An entry that gets claims is written again as a whole. A micro-batch asks the state for its own keys only. Rows without a claimed key compete among themselves by the
rule of ``curate.dedupe``; what these keep is written and comes back as claims with the next micro-batch, through a second
source of the same query, so the state holds what was kept and nothing that was dropped, as in a run over a table.

The order of rows is that of micro-batches and within one that of ``seq``; if later files hold later numbers, the result is
that of the batch. Keys are salted, so rows that share an opening are asked for by ``SALTS`` groups; a claim goes to each of
them. A micro-batch's tables are written below its number and counted once a manifest of that number exists, which is put
there last by an atomic rename: a batch that is run again after a crash writes the same again, or
brings the state store up to date and writes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions import identity, text
from millrace.operators import curate
from millrace.sources import stores
from millrace.tables import Workspace

PAGE = "seq long, source_key string, text string"
_CLAIM = "id string, prefix string"
DOC = "seq long, id string, prefix string, text string, char_len int"
#: Groups over which the rows of one key are dealt.
SALTS = 4
#: Entries of the state for each salt; a checkpoint goes with their number.
BUCKETS = 1024
_DIGEST = 16
REASONS = ("short", "long", "duplicate_id", "duplicate_prefix")
_EVENT = "seq long, kind string, id string, prefix string, text string, char_len int, reason string, claimed boolean"


def _claimed(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one bucket of keys, with whether their key was claimed before this micro-batch. A claim that comes with it is passed on, since rows may have come first."""
    held = state.get[0] if state.exists else b""
    before = {held[i : i + _DIGEST] for i in range(0, len(held), _DIGEST)}
    new: dict[bytes, None] = {}
    for rows in parts:
        digests = rows["digest"].map(bytes)
        new.update(dict.fromkeys(digests[rows["kind"] == "claim"]))
        yield rows.drop(columns=["bucket", "salt", "digest"]).assign(claimed=[d in before for d in digests])  # isin() would take digests that end in zero bytes for others
    added = [d for d in new if d not in before]
    if added:
        state.update((held + b"".join(added),))


def _key(kind: str, value: str) -> Column:
    return F.coalesce(F.concat(F.lit(f"{kind}:"), F.col(value)), F.lit(f"no {kind}"))


def _events(pages: DataFrame, claims: DataFrame, source: str) -> DataFrame:
    c = F.col("text")
    full = pages.where(c.isNotNull() & (F.trim(c, F.lit(text.BLANK)) != "")).withColumn("text", text.clean(c, text.once_streamed))
    rows = full.withColumn("char_len", F.length("text")).withColumn("reason", curate.reason(F.col("char_len")))
    rows = rows.withColumn("id", identity.doc_id(F.lit(source), F.coalesce("source_key", identity.fallback_key(F.col("text"))))).withColumn("prefix", identity.prefix_hash(F.col("text")))
    salt = F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int")
    # the text goes along with one of a row's two questions, and with none if its length is wrong
    question = lambda kind, key, body: F.struct(F.lit(kind).alias("kind"), key.alias("key"), body.alias("body"))
    nothing = F.lit(None).cast("string")
    both = F.array(question("prefix", _key("p", "prefix"), c), question("id", _key("i", "id"), nothing))
    asked = F.when(F.col("reason").isNull(), both).otherwise(F.array(question("dropped", F.concat(F.lit("x:"), F.pmod(F.xxhash64("seq"), F.lit(997))), nothing)))
    names = ["bucket", "salt", "digest", "seq", "kind", "id", "prefix", "text", "char_len", "reason"]
    new = rows.select("seq", "id", "prefix", "char_len", "reason", salt.alias("salt"), F.explode(asked).alias("q")).select(F.col("q.key").alias("key"), "salt", "seq", F.col("q.kind").alias("kind"), "id", "prefix", F.col("q.body").alias("text"), "char_len", "reason")
    each = claims.select("id", "prefix", F.explode(F.array(_key("p", "prefix"), _key("i", "id"))).alias("key")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    none = lambda t: F.lit(None).cast(t)
    old = each.select("key", "salt", none("long").alias("seq"), F.lit("claim").alias("kind"), F.col("key").alias("id"), none("string").alias("prefix"), none("string").alias("text"), none("int").alias("char_len"), none("string").alias("reason"))
    bucketed = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")).withColumn("digest", F.unhex(F.md5(F.col("key").cast("binary"))))
    return bucketed(new).select(*names).unionByName(bucketed(old).select(*names))


def ingest_stream(spark: SparkSession, pages_dir: str, out_dir: str, checkpoint_dir: str, source: str = "pages", files_per_batch: int = 1000, after_write=None) -> None:  # noqa: ANN001
    """Reads what is new in a folder of JSON lines ``(seq, source_key, text)`` and adds what it keeps to ``out_dir``; run again it goes on where it stopped.

    ``after_write(batch_id)`` is called when a micro-batch is written and not committed, for tests of crashes. Blank texts
    are not counted. Null keys are replaced by the text's hash.
    """
    stores.make_dir(spark, f"{out_dir}/claims")
    pages = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_batch).json(pages_dir)
    claims = spark.readStream.schema(_CLAIM).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{out_dir}/claims")
    told = _events(pages, claims, source).groupBy("bucket", "salt").applyInPandasWithState(_claimed, _EVENT, "claimed binary", "append", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if stores.exists(session, f"{out_dir}/manifests/{batch_id}"):
            batch.write.format("noop").mode("overwrite").save()  # all is written; only the state has still to take its claims
            return
        ws = Workspace(session)
        events = ws.keep(batch, "events")
        if events.where("kind <> 'claim'").isEmpty():  # claims of the batch before alone
            ws.drop(events)
            return
        # "id" of a claim is its key
        fresh = events.where("kind = 'claim'").select(F.col("id").alias("claim")).distinct()
        asked = events.where("kind in ('id', 'prefix')").withColumn("key", F.when(F.col("kind") == "id", _key("i", "id")).otherwise(_key("p", "prefix")))
        known = asked.join(fresh, F.col("key") == F.col("claim"), "left").groupBy("seq").agg(
            *[F.bool_or((F.col("kind") == k) & (F.col("claimed") | F.col("claim").isNotNull())).alias(f"by_{k}") for k in ("id", "prefix")]
        )
        before = F.when(F.col("by_id"), "duplicate_id").when(F.col("by_prefix"), "duplicate_prefix")
        rows = ws.keep(events.where("kind = 'prefix'").select("seq", "id", "prefix", "text", "char_len").join(known, "seq").withColumn("before", before).drop("by_id", "by_prefix"), "rows")
        ranked = curate.dedupe(rows.where("before is null").drop("before"))
        ranked = ws.keep(ranked, "ranked")
        kept = ranked.where("drop is null")
        kept.drop("drop").write.mode("overwrite").parquet(f"{out_dir}/docs/batch={batch_id}")
        # a row whose prefix was claimed before counts under its id if a row of this micro-batch has claimed that first
        mine = kept.select(F.col("id").alias("i"), F.col("seq").alias("at"))
        late = rows.where("before is not null").join(mine, (F.col("id") == F.col("i")) & (F.col("at") < F.col("seq")), "left")
        late = late.select(F.when(F.col("i").isNotNull(), "duplicate_id").otherwise(F.col("before")))
        drops = events.where("kind = 'dropped'").select(F.col("reason").alias("what")).unionAll(late).unionAll(ranked.where("drop is not null").select("drop"))
        counts = drops.unionAll(kept.select(F.lit("kept"))).groupBy("what").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").json(f"{out_dir}/counts/batch={batch_id}")
        kept.select("id", "prefix").write.mode("overwrite").option("ignoreNullFields", False).json(f"{out_dir}/claims/batch={batch_id}")
        ws.drop(events, rows, ranked)
        stores.write_text(f"{out_dir}/manifests/{batch_id}", "written\n", session)
        if after_write:
            after_write(batch_id)

    query = told.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint_dir).start()
    try:
        query.processAllAvailable()  # claims of the last batch included
    finally:
        query.stop()


def _written(spark: SparkSession, out_dir: str, what: str) -> list[str]:
    """The folders of finished micro-batches."""
    done = stores.names(spark, f"{out_dir}/manifests")  # one a micro-batch with rows
    return [f"{out_dir}/{what}/batch={n}" for n in sorted(done, key=int)]


def docs(spark: SparkSession, out_dir: str) -> DataFrame:
    """The rows kept so far."""
    at = _written(spark, out_dir, "docs")
    return spark.read.schema(DOC).parquet(*at) if at else spark.createDataFrame([], DOC)


def counters(spark: SparkSession, out_dir: str) -> DataFrame:
    """``(what, n)``: rows kept, and dropped for each reason, zeros kept."""
    at = _written(spark, out_dir, "counts")
    got = spark.read.schema("what string, n long").json(at) if at else spark.createDataFrame([], "what string, n long")
    every = spark.createDataFrame([(w,) for w in ("kept", *REASONS)], "what string")
    return every.join(got.groupBy("what").agg(F.sum("n").alias("n")), "what", "left").select("what", F.coalesce("n", F.lit(0)).alias("n"))
