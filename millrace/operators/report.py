"""Report tables, facts, and the check that every quoted number is a fact."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schema
from millrace.errors import ContractError
from millrace.functions import cost

DASH = "—"
NULL_BASELINE = "null baseline"
BEGIN, END = "<!-- generated:begin -->", "<!-- generated:end -->"
# What makes a number a claim, and how each fact is rendered.
CLAIMS = (r"(?<![\w.])(\d+(?:\.\d+)?)\s*%", r"(?<![\w.])(\d+(?:\.\d+)?)\s*ms\b", r"\$\s*(\d+(?:\.\d+)?)", r"(?<![\w.])([+-]?\d+(?:\.\d+)?)\s*(?:macro-)?F1\b")
RATIOS = (r"(?i)\b200\s*[x×]", r"(?i)\b\d+(?:\.\d+)?\s*[x×]\s*(?:larger|bigger|smaller)")
WORDS = {"frontier": r"(?i)\bfrontier\b", "45ms": r"(?i)\b45\s*ms\b"}
FORMATS = {"pct1": "%.1f", "f3": "%.3f", "signed3": "%+.3f", "ms0": "%.0f", "usd5": "%.5f", "usd2": "%.2f", "num1": "%.1f", "num2": "%.2f", "num4": "%.4f", "int0": "%.0f"}
KINDS = {
    "schema_valid_rate": "pct1", "macro_f1": "f3", "macro_f1_null_baseline": "f3", "delta_vs_teacher": "signed3", "noise_f1": "f3", "f1": "f3", "em": "f3", "agreement": "f3",
    "p50_ms": "ms0", "p95_ms": "ms0", "amortized_ms_per_doc": "ms0", "cost_per_1k_docs_usd": "usd5", "cost_per_1k_docs_usd_batch1": "usd5", "gpu_hourly_usd": "usd2", "spend_usd": "usd2",
    "doc_error_rate": "pct1", "gold_audit_doc_error_rate": "pct1", "trainable_pct": "num2", "peak_vram_gb": "num2", "train_runtime_h": "num1", "throughput_docs_per_s": "num4",
}


def show(value: float | None, kind: str) -> str:
    """One number as it is always printed; rounding is Python's."""
    if value is None:
        return DASH
    return FORMATS[kind] % (value * 100 if kind == "pct1" else int(value) if kind == "int0" else value)


def shown(value: Column, kind: str) -> Column:
    """``show`` for a column: exact halves may round differently, so what is published is rendered by ``show``."""
    v = value.cast("double")
    text = v.cast("bigint").cast("string") if kind == "int0" else F.format_string(FORMATS[kind], v * 100 if kind == "pct1" else v)
    return F.when(v.isNull(), DASH).otherwise(text)


def score_facts(scores: DataFrame, names: tuple[str, ...] = ("em", "f1", "precision", "recall")) -> DataFrame:
    """Scores ``(arm, field, ...)`` as facts ``(key, value, text)``, keys being arm, per_field, field and name joined by two underscores."""
    value = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names]))
    long = scores.select("arm", "field", value.alias("x"))
    return long.select(F.concat_ws("__", "arm", F.lit("per_field"), "field", "x.name").alias("key"), F.col("x.value").alias("value"), F.lit(None).cast("string").alias("text"))


def _first(*values: object) -> object:
    """The first value that is neither missing nor zero nor empty, else the last."""
    return next((v for v in values if v), values[-1])


def facts(metrics: dict[str, dict], bench: dict[str, dict], sweep: dict[str, dict], stats: dict[str, dict], teacher_model: str, base_model: str, noise_f1: float, low_support: int, stamp: dict) -> dict:
    """Every scalar that a report may quote, from the artefacts of the arms and the statistics of the stages (gold, train, corpus, teacher, gold_audit). ``stamp``: when and from what the report is made.

    Artefacts are a handful of small JSON objects, so they are plain dictionaries; ``flatten`` makes the keys, ``fact_table`` a table.
    """
    gold, train, corpus, teacher = (stats.get(k) or {} for k in ("gold", "train", "corpus", "teacher"))
    audited = (stats.get("gold_audit") or {}).get("residual_error_sample") or {}
    ordered = {kind: [t[a] for a in schema.ARMS if a in t] for kind, t in (("metrics", metrics), ("bench", bench))}
    any_bench = ordered["bench"][0] if ordered["bench"] else {}
    reported = lambda rows, key: next((r[key] for r in rows if r.get(key) is not None), None)
    hourly = reported(ordered["bench"], "gpu_hourly_usd")
    reference = (metrics.get("teacher") or {}).get("macro_f1")
    out: dict = {}
    for arm in schema.ARMS:
        m, b = metrics.get(arm) or {}, bench.get(arm) or {}
        usable = [r for r in (sweep.get(arm) or {}).get("sweep", []) if not r.get("oom") and r.get("throughput_docs_per_s")]
        best = max(usable, key=lambda r: r["throughput_docs_per_s"], default={})
        served = 1000.0 / best["throughput_docs_per_s"] / 3600.0 * hourly if best and hourly is not None else None
        macro, single = m.get("macro_f1"), b.get("cost_per_1k_docs_usd")
        out[arm] = {
            "schema_valid_rate": m.get("schema_valid_rate"), "macro_f1": macro, "delta_vs_teacher": None if macro is None or reference is None else macro - reference,
            "p50_ms": b.get("p50_ms"), "p95_ms": b.get("p95_ms"), "amortized_ms_per_doc": best.get("amortized_ms_per_doc"), "best_batch_size": best.get("batch_size"),
            "cost_per_1k_docs_usd": single if served is None else served, "cost_per_1k_docs_usd_batch1": single,
        }
    lowest = sorted((gold.get("teacher_field_agreement") or {}).items(), key=lambda kv: (kv[1], kv[0]))[:3]
    seconds = train.get("train_runtime_s")
    return out | {
        "lowest_teacher_agreement": [{"field": f, "agreement": v} for f, v in lowest],
        "lowest_teacher_agreement_str": ", ".join(f"`{f}` {show(v, 'f3')}" for f, v in lowest) or DASH,
        "n_eval_gold": _first(gold.get("n_final"), ordered["metrics"][0].get("n") if ordered["metrics"] else None),
        "n_train": _first(train.get("n_train"), teacher.get("n_ok")), "n_corpus": corpus.get("n_kept"), "corpus_source": corpus.get("source"), "corpus_license": corpus.get("license"),
        "teacher_model": _first(teacher.get("teacher_model"), teacher_model), "base_model": _first(train.get("base_model"), base_model), "adapter_repo": train.get("adapter_repo"),
        "gpu_name": _first(any_bench.get("gpu_name"), train.get("gpu_name")), "gpu_hourly_usd": hourly, "dtype": _first(any_bench.get("dtype"), train.get("dtype")),
        "bench_n_docs": any_bench.get("n_docs"), "bench_repeats": any_bench.get("repeats"), "spend_usd": _first(teacher.get("spend_usd_cached"), teacher.get("spend_usd")),
        "trainable_pct": train.get("trainable_pct"), "peak_vram_gb": train.get("peak_vram_gb"), "train_runtime_s": seconds, "train_runtime_h": None if seconds is None else seconds / 3600,
        "train_epochs": train.get("epochs"), "best_eval_loss": train.get("best_eval_loss"), "macro_f1_null_baseline": reported(ordered["metrics"], "macro_f1_null_baseline"),
        "gold_reviewer": gold.get("reviewer"), "gold_audit_n": audited.get("n"), "gold_audit_doc_error_rate": audited.get("doc_error_rate"), "noise_f1": noise_f1, "low_support": low_support,
    } | stamp


def fact_table(spark: SparkSession, tree: dict) -> DataFrame:
    """``(key, value, text)`` of nested facts, numbers and texts apart; lists and missing values have neither."""
    rows = []
    for k, v in flatten(tree).items():
        number = float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
        rows.append((k, number, v if isinstance(v, str) else None))
    return spark.createDataFrame(rows, "key string, value double, text string")


def shown_facts(tree: dict) -> dict[str, str]:
    """Each fact as it is printed."""
    return {k: v if isinstance(v, str) else DASH if not isinstance(v, (int, float)) else show(v, kind_of(k, v)) for k, v in flatten(tree).items()}


def rendered(template: str, facts: dict[str, str]) -> str:
    """The template with its placeholders filled; one without a fact is an error."""
    gone = sorted(set(placeholders(template)) - set(facts))
    if gone:
        raise ContractError("placeholders without a fact", len(gone), gone[:10])
    return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: facts[m[1]], template)


def kind_of(key: str, value: float) -> str:
    return KINDS.get(key.rsplit("__", 1)[-1], "int0" if isinstance(value, int) else "f3")


def headline(arms: DataFrame, metrics: DataFrame, bench: DataFrame, sweep: DataFrame) -> DataFrame:
    """One row for each arm of the dimension ``arms (ord, arm)``: scores, difference to the teacher, latency, and the cost of the row that the amortised latency comes from."""
    teacher = metrics.where("arm = 'teacher'").select(F.col("macro_f1").alias("__t"))
    best = sweep.where("not oom").groupBy("arm").agg(F.max_by(F.struct("throughput", "batch_size"), F.struct(F.col("throughput"), -F.col("ord"))).alias("b"))
    j = arms.join(metrics, "arm", "left").join(bench, "arm", "left").join(best, "arm", "left").join(teacher, F.lit(True), "left")
    thr = F.col("b.throughput")
    return j.select("ord", "arm", "macro_f1", (F.col("macro_f1") - F.col("__t")).alias("delta_vs_teacher"), "p50_ms", F.col("b.batch_size").alias("batch_size"), (F.lit(1000.0) / thr).alias("amortized_ms"), F.when(thr > 0, F.lit(1000.0) / thr / F.lit(3600.0) * F.col("hourly")).alias("cost_per_1k"))


def headline_rows(arms: DataFrame, metrics: DataFrame, bench: DataFrame, sweep: DataFrame) -> DataFrame:
    """The headline with the share of valid output and, as its last row, the floor: the macro F1 of predicting nothing, as the first arm that reports one has it."""
    rows = headline(arms, metrics, bench, sweep).join(metrics.select("arm", "schema_valid_rate"), "arm", "left")
    known = arms.join(metrics, "arm").where("macro_f1_null_baseline is not null")
    floor = known.agg(F.min_by("macro_f1_null_baseline", "ord").alias("macro_f1"))
    last = arms.agg((F.max("ord") + 1).alias("ord")).crossJoin(floor).withColumn("arm", F.lit(NULL_BASELINE))  # one row each
    return rows.unionByName(last, allowMissingColumns=True)


def per_field(scores: DataFrame) -> DataFrame:
    """Fields by arms: exact match and F1; support once."""
    wide = scores.groupBy("ord", "field").pivot("arm", list(schema.ARMS)).agg(F.first("em").alias("em"), F.first("f1").alias("f1"))
    support = scores.groupBy("field").agg(F.max("support").alias("support"))
    return wide.join(support, "field")


def order_by_first_arm(wide: DataFrame, arms: tuple[str, ...] = ("lora_ft", "base_fewshot")) -> DataFrame:
    """Ascending by F1 of the first arm there is, ties by name."""
    return wide.withColumn("key", F.coalesce(*[F.col(f"{a}_f1") for a in arms])).orderBy("key", "field")


def low_n(support: Column) -> Column:
    return F.when(support < 30, "low-n")


def sweep_rows(files: DataFrame) -> DataFrame:
    """``(arm, sweep array)`` exploded, each row marked fastest, OOM or not at all."""
    rows = files.select("arm", F.posexplode("sweep").alias("ord", "r")).select("arm", "ord", "r.*")
    best = rows.where("not oom").groupBy("arm").agg(F.max_by("ord", F.struct(F.col("throughput"), -F.col("ord"))).alias("best"))
    return rows.join(best, "arm", "left").withColumn("mark", F.when(F.col("oom"), "OOM").when(F.col("ord") == F.col("best"), "fastest")).drop("best")


def claim_numbers(text: Column) -> Column:
    """The numbers of a text that carry a unit, without a leading plus."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in CLAIMS]))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"^\++", ""))))


def allowed_numbers(facts: DataFrame) -> DataFrame:
    """``facts (key, value, text)`` as the numbers that may be quoted: four renderings of each number, every numeral of each text."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.element_at(F.split("key", "__"), -1)], F.lit("f3"))
    own = F.coalesce(*[F.when(kind == k, F.format_string(f, F.col("value") * (100 if k == "pct1" else 1))) for k, f in FORMATS.items()])
    four = F.array(own, F.format_string("%.3f", "value"), F.format_string("%.0f", "value"), F.format_string("%.1f", F.col("value") * 100))
    numbers = F.when(F.col("value").isNotNull(), four).otherwise(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)))
    return facts.select(F.explode(numbers).alias("x")).select(F.regexp_replace("x", r"^\++", "").alias("number")).distinct()


def unknown_claims(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """Quoted numbers that are no facts."""
    return lines.select(F.explode(claim_numbers(F.col("line"))).alias("number")).distinct().join(allowed_numbers(facts), "number", "left_anti")


def word_violations(line: Column) -> Column:
    """Size ratios and the word that must not be used."""
    hit = F.lit(False)
    for p in RATIOS:
        hit |= line.rlike(p)
    return F.array_compact(F.array(F.when(hit, "ratio"), *[F.when(line.rlike(p), name) for name, p in WORDS.items()]))


def conflated(lines: DataFrame, amortized: DataFrame) -> DataFrame:
    """Lines that call an amortised figure ``(arm, shown)`` a p50.

    Each numeral in front of ``ms`` is a token, once from each of its dots on, since a figure may begin behind one; figures
    are joined on the token, and the line is then held against the figure as a whole word. Figures that are no numerals
    are in no line. A line with the same figure twice counts once.
    """
    suspect = lines.where(F.lower("line").contains("p50") & ~F.lower("line").contains("amortized"))
    runs = F.regexp_extract_all("line", F.lit(r"([\w.]+)\s*ms\b"), F.lit(1))
    parts = F.transform(runs, lambda x: F.split(x, r"\."))
    ends = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "."))))
    tokens = suspect.withColumn("__token", F.explode(F.array_distinct(ends)))
    figures = amortized.where(F.col("shown").rlike(r"^\d+(\.\d+)?$")).select(F.col("shown").alias("__shown"), *amortized.columns)
    both = tokens.join(figures, F.col("__token") == F.col("__shown"))
    return both.where(F.expr(r"line rlike concat('\\b', replace(shown, '.', '\\.'), '\\s*ms\\b')")).drop("__token", "__shown")


def flatten(tree: dict, prefix: str = "") -> dict:
    """Nested maps as one, keys joined by two underscores."""
    out = {}
    for k, v in tree.items():
        name = f"{prefix}__{k}" if prefix else str(k)
        out |= flatten(v, name) if isinstance(v, dict) else {name: v}
    return out


def pipe_table(headers: list[str], aligns: list[str], rows: list[list[str]]) -> str:
    rule = {"l": ":---", "r": "---:", "c": ":---:"}
    body = [headers, [rule[a] for a in aligns], *rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in body) + "\n"


def splice(document: str, block: str) -> str:
    """The document with ``block`` between its markers; what stands outside stays. Without markers, or with the end before the begin, the block is appended with markers of its own."""
    marked = f"{BEGIN}\n{block}\n{END}"
    head, begin, rest = document.partition(BEGIN)
    _, end, tail = rest.partition(END)
    if begin and end and END not in head:
        return f"{head}{marked}{tail}"
    return f"{document.rstrip(chr(10))}\n\n{marked}\n"


def placeholders(template: str) -> list[str]:
    return sorted(set(re.findall(r"\{\{\s*([\w]+)\s*\}\}", template)))


def warnings(arms: DataFrame, metrics: DataFrame, bench: DataFrame, sweep: DataFrame) -> DataFrame:
    """Arms without an artefact; the teacher needs no sweep."""
    gone = lambda t, what, a: a.join(t, "arm", "left_anti").select("arm", F.lit(what).alias("missing"))
    return gone(metrics, "metrics", arms).unionByName(gone(bench, "bench", arms)).unionByName(gone(sweep, "sweep", arms.where("arm <> 'teacher'")))


def first_present(value: Column, order: Column) -> Column:
    """The first non-null value in order (an aggregate)."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def truthy_or(a: Column, b: Column) -> Column:
    """``a``, or ``b`` where a is null or zero."""
    return F.coalesce(F.nullif(a, F.lit(0)), b)


def standard_cost(tokens_in: Column, tokens_out: Column, model: Column) -> Column:
    return cost.cost(tokens_in, tokens_out, model)
