"""Gold sets: stratified sampling, review logs and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import schema
from millrace.errors import none_of
from millrace.functions import normalize, text
from millrace.operators import quantiles
from millrace.tables import Workspace

# Edges of the length strata, years that make a hint, and what a text may show for a currency.
BINS = (400, 1500, 3000, 8000, 40000)
LABELS = tuple(f"{a}-{b}" for a, b in zip(BINS, BINS[1:], strict=False))
MOST_YEARS, LEAST_AGREEMENT = 40, 0.75
CURRENCY_SYMBOLS = {
    "USD": ("$", "us$", "usd"), "EUR": ("€", "eur"), "GBP": ("£", "gbp"), "JPY": ("¥", "jpy"), "INR": ("₹", "inr", "rs."), "CAD": ("c$", "cad", "$"), "AUD": ("a$", "aud", "$"),
}
GROUNDED = ("title", "company", "location_city", "location_region", "location_country", "salary_currency", "required_skills")


def stratum(length: Column) -> Column:
    """Half-open bins; what lies outside is clamped to the first and last."""
    out = F.lit(LABELS[-1])
    for hi, label in reversed(list(zip(BINS[1:-1], LABELS, strict=False))):
        out = F.when(length < hi, label).otherwise(out)
    return out


def rendered(name: str, value: Column) -> Column:
    """A value as a reviewer sees it: null, an empty list and the word unknown all look different."""
    if name in schema.SETS:
        return F.when(value.isNull(), "null").when(F.size(value) == 0, "[]").otherwise(F.array_join(value, ", "))
    return F.coalesce(value.cast("string"), F.lit("null"))


def quotas(counts: DataFrame, n: int) -> DataFrame:
    """Largest-remainder seats for ``counts (stratum, c)``: ties go to the last label. Doubles in this order of operations, on purpose."""
    total = F.sum("c").over(Window.partitionBy())
    exact = F.col("c") * F.lit(float(n)) / F.col("total")
    base = counts.withColumn("total", total).withColumn("exact", exact).withColumn("base", F.least(F.floor("exact"), F.col("c")))
    left = F.lit(n) - F.sum("base").over(Window.partitionBy())
    room = F.col("base") < F.col("c")
    rank = F.row_number().over(Window.partitionBy(room).orderBy(F.desc(F.col("exact") - F.col("base")), F.desc("stratum")))
    return base.withColumn("left", left).withColumn("rank", rank).select("stratum", F.least(F.col("c"), F.col("base") + F.when(room & (F.col("rank") <= F.col("left")), 1).otherwise(0)).cast("bigint").alias("quota"))


def sample(pool: DataFrame, n: int, seed: int = 1337, length: str = "char_len") -> DataFrame:
    """``n`` rows without replacement by stratum, in hashed order. The draw differs from a random generator's, quotas do not."""
    rows = pool.withColumn("stratum", stratum(F.col(length)))
    q = quotas(rows.groupBy("stratum").agg(F.count("*").alias("c")), n)
    w = Window.partitionBy("stratum").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), "doc_id")
    # no quota is over n, and a literal bound lets each task send on its first n rows of a stratum only
    ranked = rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    return ranked.join(F.broadcast(q), "stratum").where("__r <= quota").drop("__r", "quota")  # four rows


def replay(log: DataFrame) -> DataFrame:
    """State of each document of an append-only log: last accept or reject, its time, edited fields, last edit of each field."""
    edits = log.where("action = 'edit'").groupBy("doc_id", "field").agg(F.max_by("new", "seq").alias("new"))
    edits = edits.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "new")))).alias("edits"))
    decided = F.col("action").isin("accept", "reject_doc")
    state = log.groupBy("doc_id").agg(F.max_by(F.when(decided, F.col("action")), F.when(decided, F.col("seq"))).alias("status"), F.max_by(F.when(F.col("action") == "accept", F.col("at")), F.when(F.col("action") == "accept", F.col("seq"))).alias("verified_at"))
    return state.join(edits, "doc_id", "left")


def review_counts(states: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates, reviewed, accepted (as is, edited) and rejected; log rows without a candidate are ignored."""
    j = candidates.select("doc_id").join(states, "doc_id", "left")
    acc, edited = F.col("status") == "accept", F.col("edits").isNotNull()
    return j.agg(F.count("*").alias("candidates"), F.count_if(F.col("status").isNotNull()).alias("reviewed"), F.count_if(acc).alias("accepted"), F.count_if(acc & ~edited).alias("as_is"), F.count_if(acc & edited).alias("edited"), F.count_if(F.col("status") == "reject_doc").alias("rejected"))


def edit_rates(states: DataFrame, n: Column | int) -> DataFrame:
    """Share of accepted documents with an edit of each field."""
    fields = states.where("status = 'accept' and edits is not null").select(F.explode(F.map_keys("edits")).alias("field"))
    return fields.groupBy("field").agg(F.count("*").alias("edited")).withColumn("rate", F.col("edited") / F.lit(n).cast("double"))


def parsed_time(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


#: Sequence numbers of a log that one window orders.
BLOCK = 1 << 16


def median_gap(log: DataFrame) -> DataFrame:
    """Median seconds between consecutive decisions: within blocks of sequence numbers, and from each block's last decision to the next one's first."""
    rows = log.where("action <> 'edit'").select("seq", F.unix_timestamp(parsed_time(F.col("at"))).alias("t"), F.floor(F.col("seq") / BLOCK).alias("block")).where("t is not null")
    inside = rows.select((F.col("t") - F.lag("t").over(Window.partitionBy("block").orderBy("seq"))).alias("gap"))
    ends = rows.groupBy("block").agg(F.min_by("t", "seq").alias("first"), F.max_by("t", "seq").alias("last"))
    between = ends.select((F.col("first") - F.lag("last").over(Window.orderBy("block"))).alias("gap"))  # one row for each block
    gaps = inside.unionAll(between).withColumn("__all", F.lit(0))
    m = quantiles.medians(gaps, ["__all"], "gap")
    return gaps.sparkSession.range(1).join(m, F.lit(True), "left").select(F.coalesce("median", F.lit(0.0)).alias("median_s"))  # one row each


def agreement(final: DataFrame, candidates: DataFrame) -> DataFrame:
    """Share of documents whose normalised value is that of the candidate, by field; both sides wide, one join, then long."""
    x, y = final.alias("x"), candidates.alias("y")
    same = []
    for i, f in enumerate(schema.FIELDS):
        a, b = normalize.norm_field(f, F.col(f"x.{f}")), normalize.norm_field(f, F.col(f"y.{f}"))
        eq = a.eqNullSafe(b) if f not in schema.SETS else (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
        same.append(F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), eq.cast("int").alias("same")))
    long = x.join(y, F.col("x.doc_id") == F.col("y.doc_id")).select(F.explode(F.array(*same)).alias("s")).select("s.*")
    return long.groupBy("ord", "field").agg((F.sum("same") / F.count("*")).alias("agreement"))


def agreement_warnings(agreed: DataFrame) -> DataFrame:
    """Fields whose agreement is below the floor, by name."""
    return agreed.where(F.col("agreement") < LEAST_AGREEMENT).select("field", "agreement").orderBy("field")


def least_agreed(agreed: DataFrame, n: int = 3) -> DataFrame:
    """The n fields of least agreement, ties by name."""
    return agreed.select("field", "agreement").orderBy("agreement", "field").limit(n)


def review_queue(rows: DataFrame, queue: DataFrame, states: DataFrame) -> DataFrame:
    """The rows that ``queue (doc_id, ord)`` names and that have no decision yet, with ``ord`` to be sorted by."""
    decided = states.where("status is not null").select("doc_id")
    return rows.join(queue.select("doc_id", "ord"), "doc_id").join(decided, "doc_id", "left_anti")


def first_unreviewed(candidates: DataFrame, states: DataFrame) -> DataFrame:
    """Where a resumed review goes on: the smallest id without a decision, and how many have none."""
    left = candidates.select("doc_id").join(states.where("status is not null").select("doc_id"), "doc_id", "left_anti")
    return left.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("left"))


def hints(rows: DataFrame, document: str = "text") -> DataFrame:
    """The fields of a row that deserve a look: values not in the text, salaries the wrong way round, too many years, odd dates."""
    t = F.coalesce(normalize.norm_str(F.col(document)), F.lit(""))
    inside = lambda v: F.contains(t, F.lower(v))
    low = {}
    for f in GROUNDED:
        v = normalize.norm_field(f, F.col(f))
        if f in schema.SETS:
            bad = F.exists(v, lambda x: ~inside(x))
        elif f == "salary_currency":
            symbols = F.create_map(*[x for k, s in CURRENCY_SYMBOLS.items() for x in (F.lit(k), F.array(*map(F.lit, s)))])
            bad = ~(F.exists(F.coalesce(symbols[v], F.array().cast("array<string>")), lambda s: F.contains(t, s)) | inside(v))
        else:
            bad = ~inside(v)
        low[f] = bad & ~normalize.absent(f, F.col(f))
    turned = normalize.norm_number(F.col("salary_min")) > normalize.norm_number(F.col("salary_max"))
    low["salary_min"] = low["salary_max"] = turned
    low["years_experience_min"] = F.col("years_experience_min") > MOST_YEARS
    low["posting_date"] = ~text.date_shaped(F.col("posting_date"))
    out = F.array_compact(F.array(*[F.when(F.coalesce(low[f], F.lit(False)), f) for f in schema.FIELDS if f in low]))
    return rows.withColumn("low", out)


def leaked(held_out: DataFrame, other: DataFrame, key: str = "doc_id") -> DataFrame:
    """The held-out rows whose key occurs in the other table."""
    return held_out.join(other.select(key), key, "left_semi")


def split_leaks(docs: DataFrame, splits: tuple[str, ...], text: str = "text") -> DataFrame:
    """``(doc_id, held_out, other, by)``: rows ``(doc_id, text, split)`` of a split whose id or text also stands in a later one of ``splits``.

    Texts are read once and compared by SHA-256; for each id and each text one pass gathers the splits it stands in as bits,
    so no row meets another. Null texts and ids leak nothing; repeated rows give a row each.
    """
    n = {s: i for i, s in enumerate(splits)}
    place = F.coalesce(*[F.when(F.col("split") == s, i) for s, i in n.items()])
    rows = docs.where(F.col("split").isin(*splits)).select("doc_id", place.alias("n"), F.sha2(text, 256).alias("digest"))
    rows = Workspace(docs.sparkSession).keep(rows, "digests")
    parts = []
    for by, key in (("doc_id", "doc_id"), ("text", "digest")):
        stands = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.bit_or(F.expr("shiftleft(1L, n)")).alias("bits")).where("bit_count(bits) > 1")
        later = F.explode(F.filter(F.array(*map(F.lit, range(len(splits)))), lambda j: (j > F.col("n")) & (F.getbit(F.col("bits"), j) == 1)))
        met = rows.join(stands, F.col(key) == F.col("__k")).select("doc_id", "n", later.alias("m"))
        name = lambda c: F.element_at(F.array(*map(F.lit, splits)), F.col(c) + 1)
        parts.append(met.select("doc_id", name("n").alias("held_out"), name("m").alias("other"), F.lit(by).alias("by")))
    return parts[0].unionByName(parts[1])


def assert_no_leakage(held_out: DataFrame, *others: DataFrame, key: str = "doc_id") -> None:
    """No held-out id may occur in any of the other tables."""
    for other in others:
        none_of(leaked(held_out, other, key), key, "held-out ids occur elsewhere")


def finalize(states: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    """The first n accepted documents by id."""
    return candidates.join(states.where("status = 'accept'"), "doc_id").orderBy("doc_id").limit(n)
