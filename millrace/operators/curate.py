"""From raw rows to a deduplicated, split corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import schema
from millrace.errors import ContractError
from millrace.functions import identity, text
from millrace.tables import Workspace, components

LEAST_CHARS, MOST_CHARS = 400, 40_000
# Columns that may hold a stable key, by preference.
KEY_COLUMNS = ("job_id", "id", "doc_id", "uuid", "guid", "posting_id")
PEEK_ROWS, LEAST_MEDIAN = 20, 400


def pick_text_column(rows: DataFrame) -> str:
    """The string column with the greatest median length over a peek; ties go to the first."""
    names = [f.name for f in rows.schema if f.dataType.typeName() == "string"]
    if not names:
        raise ContractError("no string column")
    peek = rows.limit(PEEK_ROWS)
    med = peek.agg(*[F.median(F.length(F.col(f"`{c}`"))).alias(c) for c in names]).first()
    best = max(names, key=lambda c: med[c] or 0)
    if (med[best] or 0) < LEAST_MEDIAN:
        raise ContractError(f"no column of long texts; the longest is {best!r}")
    return best


def pick_key_column(rows: DataFrame, text_column: str) -> str | None:
    """The first candidate that is a scalar and never null in a peek."""
    plain = {f.name for f in rows.schema if f.dataType.typeName() not in ("array", "map", "struct", "variant")}
    names = [c for c in KEY_COLUMNS if c in plain and c != text_column]
    if not names:
        return None
    got = rows.limit(PEEK_ROWS).agg(F.count("*").alias("__n"), *[F.count(F.col(c)).alias(c) for c in names]).first()
    return next((c for c in names if got["__n"] and got[c] == got["__n"]), None)


def cleaned(rows: DataFrame, raw: str = "text") -> DataFrame:
    """Rows with a non-blank text, cleaned. The filter stands before the cleaning."""
    c = F.col(raw)
    return rows.where(c.isNotNull() & (F.trim(c, F.lit(text.BLANK)) != "")).withColumn(raw, text.clean(c))


def reason(length: Column) -> Column:
    return F.when(length < LEAST_CHARS, "short").when(length > MOST_CHARS, "long")


def identified(rows: DataFrame, source: Column, key: Column) -> DataFrame:
    """Adds the content id, the near-duplicate key and the split."""
    return rows.withColumn("id", identity.doc_id(source, key)).withColumn("prefix", identity.prefix_hash(F.col("text"))).withColumn("split", identity.split(F.col("id")))


def dedupe_unique(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """First row of each prefix, for ids that are unique. Adds ``drop``: null or duplicate_prefix. No row is lost.

    The rows are written once, the first of each prefix comes from a map-side minimum and goes back by an equi-join, so a
    prefix with a large share of the rows (boilerplate) is not one task's window. Select the columns that are needed first.
    """
    ws = Workspace(rows.sparkSession)
    held = ws.keep(rows, "rows")
    first = held.groupBy(F.col("prefix").alias("__p")).agg(F.min(seq).alias("__first"))
    flagged = held.join(first, held.prefix.eqNullSafe(first["__p"]), "left")
    return flagged.withColumn("drop", F.when(F.col(seq) > F.col("__first"), "duplicate_prefix")).drop("__p", "__first")


#: Rounds of minima that are tried whatever they decide; after these, rounds go on while each leaves half of its rows at most.
LEAST_ROUNDS = 4


def dedupe(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """First-seen-wins on id, then on prefix, where a dropped row registers neither. ``seq`` is unique.

    With ids and prefixes as nodes and rows as edges, the rows kept are the greedy matching in the order of ``seq``. It is
    found in two steps. Rounds of minima: a row that is the first left of its id and of its prefix is kept, and all others
    of that id or prefix go; minima combine map-side, so a hot id or prefix is not one task's. Rounds stop when one leaves
    more than half of its rows, which only chains do, in which rows wait for one another; so there are at most
    ``LEAST_ROUNDS`` and the logarithm of the number of rows. What is left falls into components, which are found by
    contraction in a logarithmic number of rounds too, and each component's rows are decided in their order by one task,
    which streams them and holds the ids and prefixes that still have rows to come. Null ids are one id, null prefixes one prefix.
    """
    ws = Workspace(rows.sparkSession)
    held = ws.keep(rows, "rows")
    left = ws.keep(held.select(F.col(seq).alias("seq"), "id", "prefix"), "left")
    kept: list[DataFrame] = []
    n, rounds, halved = left.count(), 0, True
    while n and (rounds < LEAST_ROUNDS or halved):
        by_id = left.groupBy(F.col("id").alias("i")).agg(F.min("seq").alias("first_i"))
        by_prefix = left.groupBy(F.col("prefix").alias("p")).agg(F.min("seq").alias("first_p"))
        marked = left.join(by_id, F.col("id").eqNullSafe(F.col("i"))).join(by_prefix, F.col("prefix").eqNullSafe(F.col("p")))
        won = ws.keep(marked.where("seq = first_i and seq = first_p").select("seq", "id", "prefix"), "kept")
        kept.append(won)
        rest = left.join(won.select(F.col("id").alias("i")), F.col("id").eqNullSafe(F.col("i")), "left_anti")
        rest = ws.keep(rest.join(won.select(F.col("prefix").alias("p")), F.col("prefix").eqNullSafe(F.col("p")), "left_anti"), "left")
        ws.drop(left)
        left, m = rest, rest.count()
        n, rounds, halved = m, rounds + 1, 2 * m <= n
    if n:
        kept.append(ws.keep(_by_component(ws, left), "kept"))
    out = held
    if not kept:
        return out.withColumn("drop", F.lit(None).cast("string"))
    winners = ws.keep(reduce(DataFrame.unionAll, kept), "winners")
    by_id = winners.select(F.col("id").alias("__i"), F.col("seq").alias("__by_id"))
    by_prefix = winners.select(F.col("prefix").alias("__p"), F.col("seq").alias("__by_prefix"))
    out = held.join(by_id, held.id.eqNullSafe(F.col("__i")), "left").join(by_prefix, held.prefix.eqNullSafe(F.col("__p")), "left")
    drop = F.when(F.col("__by_id") < F.col(seq), "duplicate_id").when(F.col("__by_prefix") < F.col(seq), "duplicate_prefix")
    return out.withColumn("drop", drop).drop("__i", "__p", "__by_id", "__by_prefix")


def _by_component(ws: Workspace, left: DataFrame) -> DataFrame:
    """The rows ``(seq, id, prefix)`` kept, each component of ids and prefixes in the order of its rows."""
    node = lambda kind: F.coalesce(F.concat(F.lit(f"{kind}:"), F.col({"i": "id", "p": "prefix"}[kind])), F.lit(f"no {kind}"))
    edges = left.select("seq", "id", "prefix", node("i").alias("a"), node("p").alias("b"))
    roots = components(ws, edges.select("a", "b"))
    last = lambda c: edges.groupBy(F.col(c).alias(f"{c}_")).agg(F.max("seq").alias(f"last_{c}"))
    told = edges.join(roots, edges.a == roots.node).join(last("a"), F.col("a") == F.col("a_")).join(last("b"), F.col("b") == F.col("b_"))
    rows = told.select("root", "seq", "id", "prefix", "a", "b", "last_a", "last_b")
    return rows.repartition("root").sortWithinPartitions("root", "seq").mapInArrow(_in_order, left.schema)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows kept of components whose rows come in order. An id or prefix is forgotten behind its last row."""
    root, taken = None, set()
    for batch in batches:
        keep = []
        for r, seq, a, b, last_a, last_b in zip(*[batch.column(c).to_pylist() for c in ("root", "seq", "a", "b", "last_a", "last_b")], strict=True):
            if r != root:
                root, taken = r, set()
            new = a not in taken and b not in taken
            keep.append(new)
            if new:
                taken |= {a, b}
            if seq == last_a:
                taken.discard(a)
            if seq == last_b:
                taken.discard(b)
        yield batch.select(["seq", "id", "prefix"]).filter(pa.array(keep))


def take_until(raw: DataFrame, target: int, prepare: Callable[[DataFrame], DataFrame], seq: str = "seq") -> tuple[DataFrame, int]:
    """Rows of ``raw`` in the order of ``seq`` up to the target-th kept one, with ``reason`` and ``drop``, and how many rows were read for them.

    ``prepare`` makes ``(seq, id, prefix, reason, ...)`` of rows. Ranges of ``seq`` are read, the first of about ``target``
    rows and each further one of as many as all before it, so at most about twice the rows that the answer needs are read;
    their ends come from an approximate look at ``seq`` alone and shape the work, not the result. What was kept before is
    carried along by its ids and prefixes. ``seq`` is unique and not null.
    """
    ws = Workspace(raw.sparkSession)
    n = raw.agg(F.count(seq)).first()[0]
    at = [target * 2**k / n for k in range(64) if target * 2**k < n] if n else []
    accuracy = min(10_000_000, max(10_000, 20 * n // max(target, 1)))
    ends = raw.agg(F.percentile_approx(seq, [*at, 1.0], accuracy)).first()[0] if n and target > 0 else []
    parts, keys, kept, read, low = [], None, 0, 0, None
    for k, end in enumerate(ends):
        if kept >= target or (k and end == low):
            continue
        here = F.col(seq) <= end if k < len(ends) - 1 else F.lit(True)
        part = ws.keep(prepare(raw.where(here if low is None else here & (F.col(seq) > low))), "part")
        low, read = end, read + part.count()
        ok = part.where("reason is null")
        flagged = _flagged_after(ok, keys, seq)
        flagged = ws.keep(flagged.unionByName(part.where("reason is not null").withColumn("drop", F.lit(None).cast("string"))), "flagged")
        mine = flagged.where("reason is null and drop is null")
        new = mine.count()
        if kept + new > target:
            flagged = take_kept(flagged, target - kept, seq)
        parts.append(flagged)
        kept += new
        mine = mine.select("seq" if seq == "seq" else F.col(seq).alias("seq"), "id", "prefix")
        keys = mine if keys is None else keys.unionByName(mine)
    if not parts:
        return prepare(raw.limit(0)).withColumn("drop", F.lit(None).cast("string")), read
    return reduce(DataFrame.unionByName, parts), read


def _flagged_after(rows: DataFrame, keys: DataFrame | None, seq: str) -> DataFrame:
    """``dedupe`` of rows behind those whose keys ``(seq, id, prefix)`` were kept before and which all come first."""
    if keys is None:
        return dedupe(rows, seq)
    one = lambda c: rows.select(F.col(c).alias("__k")).distinct()
    met = keys.join(one("id"), F.col("id").eqNullSafe(F.col("__k")), "left_semi").unionByName(keys.join(one("prefix"), F.col("prefix").eqNullSafe(F.col("__k")), "left_semi")).distinct()
    light = rows.select(F.col(seq).alias("seq"), "id", "prefix", F.lit(True).alias("new"))
    marks = dedupe(light.unionByName(met.withColumn("new", F.lit(False)))).where("new").select(F.col("seq").alias("__seq"), "drop")
    return rows.join(marks, F.col(seq) == F.col("__seq")).drop("__seq")


def take_kept(flagged: DataFrame, target: int, seq: str = "seq") -> DataFrame:
    """The rows up to the target-th kept one, so that counters cover only what was read."""
    kept = flagged.where("reason is null and drop is null").orderBy(seq).limit(target)
    last = kept.agg(F.max(seq).alias("__last"), F.count("*").alias("__n"))
    return flagged.crossJoin(F.broadcast(last)).where((F.col("__n") < target) | (F.col(seq) <= F.col("__last"))).drop("__last", "__n")  # one row


def length_percentiles(lengths: DataFrame, column: str = "char_len") -> DataFrame:
    """p5, p50, p95 and max with linear interpolation, truncated; all in integers."""
    w = Window.orderBy(column)
    # exact counts per length keep the sort small: one row for each different length
    counts = lengths.where(F.col(column).isNotNull()).groupBy(column).count()
    cum = counts.withColumn("hi", F.sum("count").over(w)).withColumn("lo", F.col("hi") - F.col("count"))
    n = lengths.agg(F.count(column).alias("n"))
    cum = cum.crossJoin(F.broadcast(n))  # one row
    at = lambda k: F.max(F.when((F.col("lo") <= k) & (k < F.col("hi")), F.col(column)))
    m = F.col("n") - 1
    cols = []
    for p in (5, 50, 95):
        j = F.floor(F.lit(p) * m / 100)
        cols += [at(j).alias(f"a{p}"), at(F.least(j + 1, m)).alias(f"b{p}"), F.max(F.pmod(F.lit(p) * m, F.lit(100))).alias(f"d{p}")]
    got = cum.agg(*cols, F.max(column).alias("max"))
    value = lambda p: F.floor((F.col(f"a{p}") * (100 - F.col(f"d{p}")) + F.col(f"b{p}") * F.col(f"d{p}")) / 100).cast("bigint").alias(f"p{p}")
    return got.select(*[value(p) for p in (5, 50, 95)], F.col("max").cast("bigint").alias("max"))


#: Rows that a corpus and its held-out splits need.
LEAST_ROWS, LEAST_SPLIT_ROWS = 7000, 340


def too_small(counts: DataFrame, total: int = LEAST_ROWS, each: int = LEAST_SPLIT_ROWS, held_out: tuple[str, ...] = ("dev", "eval_pool")) -> DataFrame:
    """``(what, n, least)``: the corpus and the splits of ``counts (split, n)`` that have too few rows. Empty if the corpus is large enough."""
    all_rows = counts.agg(F.lit("corpus").alias("what"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.lit(total).cast("bigint").alias("least"))
    splits = counts.where(F.col("split").isin(*held_out)).select(F.col("split").alias("what"), "n", F.lit(each).cast("bigint").alias("least"))
    return all_rows.unionByName(splits).where("n < least")


def expect_rows(rows: DataFrame, n: int, what: str) -> None:
    """An error unless ``rows`` has n rows; 0 turns the check off. At most n + 1 rows are counted."""
    if n:
        got = rows.limit(n + 1).count()
        if got != n:
            raise ContractError(f"{what} has {f'{got} rows' if got < n else f'over {n} rows'}, expected {n}: a part is not comparable with the whole")


def split_counts(docs: DataFrame) -> DataFrame:
    """Rows of each split, zero for an empty one."""
    names = docs.sparkSession.createDataFrame([(s,) for s in schema.SPLITS], "split string")
    return names.join(docs.groupBy("split").agg(F.count("*").alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))


