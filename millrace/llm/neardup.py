"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact verification, connected components.

Only vectors of one label meet. Equal vectors of a label are one class from the start, with its size; hashing,
candidates and links are between classes, and ``n_links`` counts the vectors behind them, so copies are never expanded.
The number of sign bits of a table follows the number of classes in the label of an average class (about ``PER_BUCKET`` to a
bucket), so that a label with a large share of all vectors counts by its own size however many small labels there are, and the
number of tables follows from the bits: as many as leave a pair at the threshold unfound with a probability of at most
``MISS``; closer pairs are missed less. Candidate pairs of all tables are made distinct and verified by the cosine in
double precision, so there is no link below the threshold. Vectors are first scaled by a power of two to components of
about 1 at most, which changes no cosine and keeps sums of squares finite and above zero for all finite doubles. Buckets
have no cap: one of over ``SPLIT`` classes is cut into parts, and each pair of parts is a join key of its own.

A vector that is null, empty, zero or holds null or non-finite numbers, and one whose label is null, links with nothing
and is its own component; vectors of different lengths do not link with each other. Rows that share an id are vectors of
their own. A row without an id counts as a vector for links; its component is the smallest id that its links lead to, null
if they lead to none, and it is not kept. An empty table gives an empty one. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import runtime

PER_BUCKET, MISS = 8, 2e-4
LEAST_BITS, MOST_BITS = 8, 30
#: Classes of a bucket that one join key holds.
SPLIT = 2048


def tables_for(rows_per_label: float, threshold: float) -> tuple[int, int]:
    """Bits of a table and number of tables."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1.0, rows_per_label) / PER_BUCKET + 1))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-same))


def codes(vectors: list[np.ndarray], bits: int, tables: int, seed: int = 1) -> np.ndarray:
    """Code of each vector (rows) in each table (columns)."""
    dim = len(vectors[0])
    planes = np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))
    sign = (np.stack(vectors) @ planes > 0).reshape(len(vectors), tables, bits)
    return sign @ (1 << np.arange(bits, dtype=np.int64))


def scaled(v: Column) -> Column:
    """The vector times a power of two, in two exact steps, so that its largest component is about 1; minus zero is zero."""
    let = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  # worked out once, not for each component
    power = lambda e: F.pow(F.lit(2.0), -e)
    steps = let(F.floor(F.log2(F.array_max(F.transform(v, F.abs)))), lambda e: F.struct(power(F.floor(e / 2)).alias("a"), power(e - F.floor(e / 2)).alias("b")))
    return let(steps, lambda s: F.transform(v, lambda x: x * s["a"] * s["b"] + 0.0))


def split_pairs(dealt: DataFrame) -> DataFrame:
    """Distinct ``(p, q)``, p < q, of the classes that share a bucket in some table. ``dealt (c, label, code, dim)``."""
    key = ["label", "code", "dim"]
    hot = dealt.groupBy(*key).agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64("c"), parts).cast("int")
    held = dealt.join(hot, key, "left").select(*key, "c", part.alias("part"), parts.alias("parts"))
    x = held.select(*key, "c", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j")).alias("x")
    y = held.select(*key, "c", F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j")).alias("y")
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in (*key, "i", "j")]
    pairs = x.join(y, reduce(and_, same) & ((F.col("x.i") < F.col("x.j")) | (F.col("x.c") < F.col("y.c"))))
    return pairs.select(F.least("x.c", "y.c").alias("p"), F.greatest("x.c", "y.c").alias("q")).distinct()


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row."""
    spark = vectors.sparkSession
    runtime.prepare(spark)
    ws = runtime.Workspace(spark)
    v = F.col(f"`{embedding}`").cast("array<double>")
    src = vectors.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), v.alias("v"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    some = F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = src.select("vec_id", "label", F.when(finite & some & F.col("label").isNotNull(), scaled(F.col("v"))).alias("v"))
    ids = rows.select("vec_id", "label", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("label", "v")).cast("binary"), 256)).alias("sig"), "v")
    ids = ws.keep(ids, "ids")
    held = ids.select("vec_id", "sig")
    grouped = ids.where("sig is not null").groupBy("sig").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = ws.keep(grouped.withColumn("c", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay
    told = classes.groupBy("label").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("square"), F.sum("n").alias("n")).first()
    bits, tables = tables_for((told["square"] or 0.0) / (told["n"] or 1.0), threshold)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = [np.array(x) for x in batch.column(2).to_pylist()]
            for dim in sorted({len(x) for x in vs}):
                at = [i for i, x in enumerate(vs) if len(x) == dim]
                code = codes([vs[i] for i in at], bits, tables)
                pick = batch.take(pa.array(np.repeat(at, tables)))
                keys = (np.tile(np.arange(tables, dtype=np.int64), len(at)) << 32) | code.ravel()
                yield pa.RecordBatch.from_arrays([pick.column(0), pick.column(1), pa.array(keys), pa.array(np.full(len(keys), dim, np.int64))], ["c", "label", "code", "dim"])

    kind = classes.schema["label"].dataType.simpleString()
    dealt = ws.keep(classes.select("c", "label", "v").mapInArrow(hashed, f"c bigint, label {kind}, code bigint, dim bigint"), "codes")
    pairs = split_pairs(dealt)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))
    unit = classes.select("c", "v", norm.alias("norm"))
    left = pairs.join(unit.select(F.col("c").alias("p"), F.col("v").alias("pv"), F.col("norm").alias("pn")), "p")
    both = left.join(unit.select(F.col("c").alias("q"), F.col("v").alias("qv"), F.col("norm").alias("qn")), "q")
    dot = F.aggregate(F.zip_with("pv", "qv", lambda a, b: a * b), F.lit(0.0), lambda a, e: a + e)
    cosine = dot / (F.col("pn") * F.col("qn"))
    links = ws.keep(both.where((cosine >= threshold) & ~F.isnan(cosine)).select("p", "q"), "links")
    small = classes.select("c", "rep", "size", "sig")
    ends = links.unionAll(links.select(F.col("q").alias("p"), F.col("p").alias("q")))
    counted = ends.join(small.select(F.col("c").alias("q"), "size"), "q").groupBy("p").agg(F.sum("size").alias("out"))
    roots = runtime.components(ws, links.select(F.col("p").alias("a"), F.col("q").alias("b")))
    rooted = small.join(roots, small.c == roots.node, "left").select("c", "sig", "rep", "size", F.coalesce("root", "c").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    told_classes = rooted.join(least, "root").join(counted, rooted.c == counted.p, "left").select("sig", "component", (F.col("size") - 1 + F.coalesce("out", F.lit(0))).alias("n"))
    told_classes = ws.keep(told_classes, "result")
    ws.drop(dealt, links)
    out = held.join(told_classes, "sig", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").cast("bigint").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: The same in DuckDB by comparing all pairs of a label.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY 1)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id)::BIGINT AS n_links, c.c::BIGINT AS component_id, e.vec_id = c.c AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id
"""
