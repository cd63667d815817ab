"""Weighted rendezvous hashing of stable record keys over shards.

Every (key, shard) pair has a hash u in (0, 1) and the score weight / -ln(u); a record goes to the shard with the
highest score, the lower shard at a tie. Only the key and the shards decide, so adding a shard moves records into it and
nowhere else, and in proportion to its weight. All of it is built-in functions.

Slots number the records of a shard from 0 without gaps. They are dealt in two steps: each shard has ``BLOCKS`` blocks
chosen by a hash of key and text, a small count table gives each block's first slot, and rows are numbered within
(shard, block) by key, so no task holds a whole shard.

A null key is one key of its own, the empty string's hash; its rows share a shard and are numbered by checksum and size.
Null text has size 1 and checksum 0. Repeated rows get slots of their own. No other column is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import runtime

BLOCKS = 256


def _unit(key: Column, shard: int) -> Column:
    """48 bits of the MD5 of key and shard, as a double in (0, 1)."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 48))


def score(key: Column, shard: int, weight: float) -> Column:
    return F.lit(float(weight)) / -F.log(_unit(key, shard))


def best(scores: list[Column]) -> Column:
    """Position of the highest score; the first of equals."""
    if len(scores) == 1:
        return F.lit(0)
    top = F.greatest(*[F.struct(s.alias("s"), F.lit(-i).alias("i")) for i, s in enumerate(scores)])
    return -top["i"]


def assign(docs: DataFrame, weights: list[float], grown_weight: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``."""
    ws = runtime.Workspace(docs.sparkSession)
    k = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    n = len(weights)
    base = docs.select(
        F.col(f"`{key}`").alias("doc_id"),
        k.alias("k"),
        (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col(f"`{text}`").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
    )
    scored = base.select("*", *[score(F.col("k"), i, w).alias(f"s{i}") for i, w in enumerate([*weights, grown_weight])])
    shards = [F.col(f"s{i}") for i in range(n + 1)]
    placed = scored.select(
        "doc_id", "size", "text_crc32",
        best(shards[:n]).cast("int").alias("shard"),
        best(shards).cast("int").alias("grown_shard"),
        F.conv(F.substring(F.md5(F.concat("k", F.lit(":"), F.col("text_crc32").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint").alias("h"),
    ).withColumn("block", F.pmod("h", F.lit(BLOCKS)).cast("int")).drop("h")
    placed = ws.keep(placed, "placed")
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("r", F.row_number().over(within) - 1)
    # at most (number of shards) * BLOCKS rows
    out = ranked.join(F.broadcast(first), ["shard", "block"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("r")).cast("bigint").alias("slot"), "grown_shard")


#: The same in DuckDB for 16 shards of weight 1 and one more. The checksum goes over the bytes with the usual table.
ORACLE = f"""
WITH crc0 AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t
  FROM range(256) r(i)),
tab AS (SELECT list(t::BIGINT ORDER BY i) AS t FROM crc0),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (
  SELECT doc_id, k, (length(x) // 2 + 1)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i:
      ((instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT)),
      lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM d, tab),
s AS (
  SELECT doc_id, size, text_crc32, ('0x' || substr(md5(k || ':' || text_crc32), 1, 8))::BIGINT % {BLOCKS} AS block,
    list_transform(range(17), lambda j: 1.0::DOUBLE / -ln((('0x' || substr(md5(k || ':' || j), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)) AS s
  FROM b),
p AS (
  SELECT doc_id, size, text_crc32, block, list_position(s[1:16], list_max(s[1:16])) - 1 AS shard, list_position(s, list_max(s)) - 1 AS grown_shard
  FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown_shard::INT AS grown_shard
FROM p
"""
