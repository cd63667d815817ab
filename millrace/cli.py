"""Commands over a folder of artefacts: ``python -m millrace.cli GROUP COMMAND [options]``.

A command that breaks a contract (too few rows, unknown ids, claims without a fact) ends with 1; one that needs a model or
a provider that was not named ends with 2. Models and providers are named as ``module:attribute``.
"""

from __future__ import annotations

import argparse
import hashlib
import importlib
import json
import os
import subprocess
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schema
from millrace.errors import ContractError, none_of
from millrace.functions import cost, extract
from millrace.operators import benchmarks, curate, gold, label, predict, rendering, report, score, waves
from millrace.sources import files
from millrace.streaming import replay
from millrace.tables import Workspace

DOC = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "source", "source_key", "text")] + [T.StructField("char_len", T.LongType()), T.StructField("split", T.StringType())])
CACHE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("doc_id", "raw_output", "teacher_model", "prompt_sha", "error")] + [T.StructField("ok", T.BooleanType())] + [T.StructField(c, T.LongType()) for c in ("seq", "tokens_in", "tokens_out")]
)
LABELLED = T.StructType([*DOC.fields, T.StructField("gold", schema.POSTING)])
PREDICTION = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "arm", "raw_output")] + [T.StructField("parsed", schema.POSTING), T.StructField("schema_valid", T.BooleanType()), T.StructField("completion_tokens", T.LongType())])
CALL = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("ms", T.DoubleType()), T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()), T.StructField("model", T.StringType())])
# What the stages need.
TARGET, MOST_READ, LEAST_FREE = 7500, 200_000, 2 * 1024**3
LEAST_LABELLED = {"train": 4500, "dev": 280, "eval_pool": 330}
CANDIDATES, GOLD_ROWS, SEED = 330, 300, 1337
NOISE_F1, LOW_SUPPORT = 0.03, 30
PROMPT = "Extract the sixteen fields of the posting as JSON."
PROMPT_SHA = hashlib.sha256(PROMPT.encode()).hexdigest()[:16]


class Unavailable(RuntimeError):
    """A command whose other half lives elsewhere."""


@dataclass(frozen=True)
class Paths:
    """Where the artefacts of all stages lie."""

    docs: str
    labelled: str
    cache: str
    candidates: str
    log: str
    gold: str
    predictions: str
    results: str

    @classmethod
    def in_dir(cls, root: str) -> Paths:
        return cls(*(f"{root}/{x}" for x in ("corpus/docs", "labeled", "labeled/_cache", "gold/_candidates", "gold/_progress", "gold/eval_gold", "predictions", "results")))

    @classmethod
    def default(cls) -> Paths:
        return cls.in_dir(os.environ.get("MILLRACE_ROOT", "artifacts"))


def utc_now() -> str:
    """The clock of all artefacts: UTC, to the second."""
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def eta(seconds: float | None) -> str:
    """Time left as HH:MM, rounded up to the minute."""
    if seconds is None or seconds < 0 or seconds == float("inf"):
        return "--:--"
    minutes = -(-int(-(-seconds // 1)) // 60)
    return f"{minutes // 60:02d}:{minutes % 60:02d}"


def git_sha() -> str:
    got = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=False)
    return got.stdout.strip() or "unknown"


def stamp() -> dict[str, str]:
    return {"generated_at": utc_now(), "git_sha": git_sha()}


def named(spec: str | None, what: str) -> Any:
    """The object that ``module:attribute`` names."""
    if not spec:
        raise Unavailable(f"{what} is not part of this package; name one as module:attribute")
    module, _, attribute = spec.partition(":")
    return getattr(importlib.import_module(module), attribute)


def say(**facts: Any) -> None:
    print(json.dumps(facts, sort_keys=True, ensure_ascii=False, default=str))


def _source(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)


def _stats(path: str) -> dict:
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _put(path: str, obj: dict) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    files.write_json(path, obj)


def corpus_build(spark: SparkSession, p: Paths, a: argparse.Namespace) -> None:
    stats_path = f"{p.results}/corpus_stats.json"
    if not a.force and _stats(stats_path).get("n_kept", 0) >= a.least:
        say(kept=_stats(stats_path)["n_kept"], skipped="the corpus is there; --force builds it anew")
        return
    os.makedirs(p.results, exist_ok=True)
    files.enough_space(p.results, LEAST_FREE)
    rows = files.corpus_rows(_source(spark, a.source), a.max_scan).withColumn("seq", F.monotonically_increasing_id())
    rows = curate.cleaned(rows).withColumn("source", F.lit(a.source_name or os.path.basename(a.source.rstrip("/")))).withColumn("char_len", F.length("text").cast("bigint"))
    named_rows = curate.identified(rows, F.col("source"), F.col("source_key")).withColumn("reason", curate.reason(F.col("char_len")))
    held = Workspace(spark).keep(named_rows, "named")
    flagged = curate.dedupe(held.where("reason is null")).unionByName(held.where("reason is not null").withColumn("drop", F.lit(None).cast("string")))
    seen = curate.take_kept(Workspace(spark).keep(flagged, "flagged"), a.target_n)
    kept = seen.where("reason is null and drop is null").select(F.col("id").alias("doc_id"), "source", "source_key", "text", "char_len", "split")
    n = files.write_jsonl(kept.orderBy("doc_id"), p.docs)
    counts = seen.agg(F.count("*").alias("n_seen"), *[F.count_if(F.col("reason") == r).alias(f"n_dropped_{r}") for r in ("short", "long")], *[F.count_if(F.col("drop") == f"duplicate_{k}").alias(f"n_dropped_dup_{k}") for k in ("id", "prefix")]).first()
    docs = files.read_jsonl(spark, p.docs, DOC)
    splits = curate.split_counts(docs)
    out = counts.asDict() | {"n_kept": n, "source": a.source, "license": a.license, "split_counts": {r["split"]: r["n"] for r in splits.collect()}, "char_len": curate.length_percentiles(docs).first().asDict()} | stamp()
    _put(stats_path, out)
    say(kept=n, splits=out["split_counts"])
    small = [f"{r['what']} has {r['n']} rows, {r['least']} are needed" for r in curate.too_small(splits, a.least, a.least_split).collect()]  # three rows at most
    if small:
        raise ContractError("; ".join(small))


def _cache(spark: SparkSession, p: Paths) -> DataFrame:
    return files.read_jsonl(spark, p.cache, CACHE) if os.path.exists(p.cache) else spark.createDataFrame([], CACHE)


def teacher_label(spark: SparkSession, p: Paths, a: argparse.Namespace) -> None:
    if a.model not in cost.PRICES:
        raise ContractError(f"no price for model {a.model!r}")
    splits = schema.SPLITS if a.split == "all" else (a.split,)
    docs = files.read_jsonl(spark, p.docs, DOC)
    chosen = label.select_docs(docs, splits, a.limit or None)
    prompt_sha = PROMPT_SHA
    cache = _cache(spark, p)
    left = label.todo(chosen, label.cache_hits(cache, a.model, prompt_sha))
    e = label.estimate(left, len(PROMPT)).first()
    priced = cache.where(F.col("tokens_in") > 0).agg(F.count("*").alias("n"), F.avg(cost.batch_cost(F.col("tokens_in"), F.col("tokens_out"), F.lit(a.model))).alias("mean")).first()
    n_left, p_in, p_out = left.count(), *cost.PRICES[a.model]
    estimated = cost.BATCH_DISCOUNT * (e["tokens_in"] / 1e6 * p_in + e["tokens_out"] / 1e6 * p_out)
    projected = max(priced["mean"] * n_left, estimated) if priced["n"] >= cost.LEAST_PRICED else estimated
    say(selected=chosen.count(), todo=n_left, projected_usd=round(projected, 4))
    label.guard_spend(projected)
    if a.dry_run:
        return
    if n_left:
        provider = named(a.provider, "a provider of labels")
        held = label.batches(left.select("doc_id")).groupBy("batch").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids")).orderBy("batch")
        # a provider with a ledger goes on with what an earlier run has left there
        ledger = provider.ledger() if hasattr(provider, "ledger") else []
        waves.consistent([b for b in ledger if not b.get("harvested")], a.model, prompt_sha)
        lost = waves.resume(ledger, getattr(provider, "adopt", lambda row: None), provider.harvest, getattr(provider, "save", lambda row: None))
        if ledger:  # what these have brought is not asked for again
            cache = _cache(spark, p)
            left = label.todo(chosen, label.cache_hits(cache, a.model, prompt_sha))
            held = label.batches(left.select("doc_id")).groupBy("batch").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids")).orderBy("batch")
            say(resumed=len(ledger), lost=len(lost))
        batch = lambda tag, ids: {"tag": tag, "doc_ids": ids, "model": a.model, "prompt_sha": prompt_sha}
        send = lambda rows, name: waves.run_wave((batch(f"{name}-{r['batch']}", r["doc_ids"]) for r in rows.toLocalIterator()), provider.submit, provider.harvest, provider.record)
        send(held, "batch")
        outcomes = label.outcomes(chosen, _cache(spark, p).where((F.col("teacher_model") == a.model) & (F.col("prompt_sha") == prompt_sha)))
        retried = Workspace(spark).keep(label.retry_round(outcomes), "retry")
        if not retried.isEmpty():  # one more round for lost calls and output that did not parse
            send(label.batches(retried).groupBy("batch").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids")).orderBy("batch"), "retry")
        cache = _cache(spark, p)
    done = label.outcomes(chosen, cache.where((F.col("teacher_model") == a.model) & (F.col("prompt_sha") == prompt_sha)))
    done = Workspace(spark).keep(done.withColumn("gold", extract.posting(F.col("v"))).drop("v"), "outcomes")
    ok = done.where("outcome = 'ok'")
    written = files.write_splits(ok.select(*DOC.names, "gold"), p.labelled, splits)
    postings, buckets = ok.select("gold.*"), label.buckets(done)
    label.check_buckets(buckets)
    rates, members = label.null_rates(postings), label.enum_distribution(postings)
    warned = label.quality_warnings(members, rates, postings.agg(F.count("*").alias("n_ok"))).collect()  # a row a field at most
    out = buckets.first().asDict() | {"split_counts": written, "teacher_model": a.model, "prompt_sha": prompt_sha, "field_null_rate": {r["field"]: r["null_rate"] for r in rates.collect()}, "quality_warnings": [r.asDict() for r in warned]}
    _put(f"{p.results}/teacher_stats.json", out | stamp())
    say(split_counts=written, warnings=len(warned), absent=[r["field"] for r in label.most_absent(rates).collect()])
    problems = [f"{r['field']}: {r['what']} in {r['share']:.2f}" for r in warned]
    problems += [f"{s} has {written[s]} rows, {n} are needed" for s, n in LEAST_LABELLED.items() if not a.limit and s in written and written[s] < n]
    if problems:
        raise ContractError("; ".join(problems))


def _labelled(spark: SparkSession, p: Paths, split: str) -> DataFrame:
    return files.read_jsonl(spark, f"{p.labelled}/{split}", LABELLED)


def gold_sample(spark: SparkSession, p: Paths, a: argparse.Namespace) -> None:
    if os.path.exists(p.candidates) and not a.force:
        raise ContractError("candidates are there; --force draws anew")
    n = files.write_jsonl(gold.sample(_labelled(spark, p, "eval_pool"), a.n, a.seed).orderBy("doc_id"), p.candidates)
    say(candidates=n)
    if n < a.n:
        raise ContractError(f"{n} candidates, {a.n} were asked for")


def _states(spark: SparkSession, p: Paths) -> DataFrame:
    log = files.read_jsonl(spark, p.log, replay.LOG) if os.path.exists(p.log) else spark.createDataFrame([], replay.LOG)
    return gold.replay(log)


def _candidates(spark: SparkSession, p: Paths) -> DataFrame:
    return files.read_jsonl(spark, p.candidates, T.StructType([*LABELLED.fields, T.StructField("stratum", T.StringType())]))


def gold_verify(spark: SparkSession, p: Paths, a: argparse.Namespace) -> None:
    """Adds decisions to the log; the terminal that asks a person for them is outside."""
    if a.decisions:
        rows = files.read_jsonl(spark, a.decisions, replay.LOG)
        before = files.read_jsonl(spark, p.log, replay.LOG).agg(F.max("seq")).first()[0] if os.path.exists(p.log) else None
        say(added=files.write_jsonl(rows.withColumn("seq", F.col("seq") + (0 if before is None else before + 1)), p.log, "append"))
    candidates, states = _candidates(spark, p), _states(spark, p)
    counts = gold.review_counts(states, candidates).first().asDict()
    say(next=gold.first_unreviewed(candidates, states).first()["doc_id"], median_s=gold.median_gap(files.read_jsonl(spark, p.log, replay.LOG)).first()[0] if os.path.exists(p.log) else None, **counts)


def gold_finalize(spark: SparkSession, p: Paths, a: argparse.Namespace) -> None:
    candidates, states = _candidates(spark, p), _states(spark, p)
    final = Workspace(spark).keep(gold.finalize(states, candidates, a.n), "final")
    curate.expect_rows(final, a.n, "the gold set")
    for split in ("train", "dev"):
        if os.path.exists(f"{p.labelled}/{split}"):
            gold.assert_no_leakage(final, _labelled(spark, p, split))
    n = files.write_jsonl(final.select(*DOC.names, "gold").orderBy("doc_id"), p.gold)
    agreed = gold.agreement(final.select("doc_id", "gold.*"), candidates.select("doc_id", "gold.*"))
    rates = {r["field"]: r["agreement"] for r in agreed.collect()}  # sixteen rows
    warned = [r["field"] for r in gold.agreement_warnings(agreed).collect()]
    _put(f"{p.results}/gold_stats.json", gold.review_counts(states, candidates).first().asDict() | {"n_final": n, "reviewer": a.reviewer, "teacher_field_agreement": rates, "agreement_warnings": warned} | stamp())
    say(final=n, warnings=warned)


def _gold(spark: SparkSession, path: str) -> DataFrame:
    return files.read_jsonl(spark, path, LABELLED).select("doc_id", "text", "gold.*")


def metrics_score(spark: SparkSession, p: Paths, a: argparse.Namespace) -> None:
    want = _gold(spark, a.gold or p.gold)
    curate.expect_rows(want, a.expect_n, "gold")
    if a.arm == "teacher":
        preds = score.teacher_predictions(_labelled(spark, p, "eval_pool").select("doc_id", "gold.*"), want)
    else:
        preds = files.read_jsonl(spark, a.pred or f"{p.predictions}/{a.arm}", PREDICTION)
        none_of(preds.where(F.coalesce(F.col("arm"), F.lit("")) != a.arm), "doc_id", "predictions of another arm")
    score.check(want, preds)
    for split in ("train", "dev"):
        if os.path.exists(f"{p.labelled}/{split}"):
            gold.assert_no_leakage(want, _labelled(spark, p, split))
    pairs = score.joined(want, preds)
    fields = Workspace(spark).keep(score.per_field(pairs), "fields")
    head = score.header(pairs, want, preds).first()
    keys = {"precision": "precision", "recall": "recall", "f1": "f1", "em": "em_rate"}
    rows = {r["field"]: {k: round(r[c], 6) for k, c in keys.items()} | {"support": r["support"]} for r in fields.collect()}
    null = score.macro_f1(score.per_field(score.null_baseline(want))).first()[0]
    out = {"arm": a.arm, "split": "eval_gold", "n": head["n"], "schema_valid_rate": round(head["schema_valid_rate"], 6), "macro_f1": round(score.macro_f1(fields).first()[0], 6), "macro_f1_null_baseline": round(null, 6), "n_missing_predictions": head["n_missing"], "per_field": rows}
    path = a.out or f"{p.results}/metrics/{a.arm}.json"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    files.write_metrics(path, out | stamp())
    for f, r in sorted(rows.items(), key=lambda x: (x[1]["f1"], x[0])):
        print(f"{f:22s} {r['f1']:7.4f} {r['precision']:7.4f} {r['recall']:7.4f} {r['em']:7.4f} {r['support']:8d}")
    say(arm=a.arm, macro_f1=out["macro_f1"], missing=head["n_missing"])


def _folder(path: str) -> dict[str, dict]:
    """The JSON objects of a results folder by file name; a handful of small ones."""
    return {x[:-5]: _stats(f"{path}/{x}") for x in sorted(os.listdir(path)) if x.endswith(".json")} if os.path.isdir(path) else {}


def metrics_compare(spark: SparkSession, p: Paths, a: argparse.Namespace) -> None:
    found = _folder(a.metrics_dir or f"{p.results}/metrics")
    if not found:
        raise ContractError("no metrics files")
    heads = spark.createDataFrame([(schema.ARMS.index(k) if k in schema.ARMS else len(schema.ARMS), k, m["n"], m["schema_valid_rate"], m["macro_f1"]) for k, m in found.items()], "ord int, arm string, n long, valid double, macro_f1 double")
    for r in score.compared(heads).collect():
        print(f"{r['arm']:26s} {r['n']:5d} {r['valid']:13.4f} {r['macro_f1']:9.4f}")


def gpu_predict(spark: SparkSession, p: Paths, a: argparse.Namespace) -> None:
    call = named(a.generator, "a model")
    want = files.read_jsonl(spark, a.gold or p.gold, LABELLED).select("doc_id", "text")
    want = want.orderBy("doc_id").limit(a.limit) if a.limit else want
    path = a.out or f"{p.predictions}/{a.arm}"
    partial = f"{path}.partial"
    done = files.read_jsonl(spark, partial, PREDICTION) if os.path.exists(partial) else spark.createDataFrame([], PREDICTION)
    prompts = predict.remaining(want, done, a.arm).withColumn("prompt", predict.truncated(F.col("text")))
    made = predict.records(predict.generate(prompts, call, batch=a.batch_size), a.arm)
    made = made.withColumn("completion_tokens", F.ceil(F.length("raw_output") / 4).cast("bigint")).select(*PREDICTION.names)
    files.write_jsonl(made, partial, "append")
    every = files.read_jsonl(spark, partial, PREDICTION)
    order = want.select("doc_id", F.col("doc_id").alias("ord"))
    files.write_jsonl(predict.in_gold_order(every, order).select(*PREDICTION.names), path)
    say(arm=a.arm, **predict.run_summary(files.read_jsonl(spark, path, PREDICTION), done).first().asDict())


def gpu_train(spark: SparkSession, p: Paths, a: argparse.Namespace) -> None:
    train = named(a.trainer, "a trainer")
    rows = _labelled(spark, p, "train").select("doc_id", "text", predict.compact_json(F.col("gold")).alias("gold"))
    examples = predict.training_rows(rows.orderBy("doc_id").limit(a.limit) if a.limit else rows, PROMPT, "<|im_end|>")
    files.write_jsonl(examples.orderBy("doc_id"), f"{p.results}/training_examples")
    files.write_train_stats(f"{p.results}/train_stats.json", train(f"{p.results}/training_examples") | stamp())


def gpu_bench(spark: SparkSession, p: Paths, a: argparse.Namespace) -> None:
    """Summaries of timed samples (arm, ms); timing itself needs the model."""
    if not a.samples:
        raise Unavailable("timing needs a model; give recorded samples with --samples")
    files.parse_batch_sizes(a.batch_sizes)
    rows = spark.read.schema("arm string, ms double").json(a.samples)
    os.makedirs(f"{p.results}/bench", exist_ok=True)
    for r in benchmarks.latency_summary(rows, "arm").collect():  # one row for each arm
        one = {"arm": r["arm"], "n_docs": r["n"], "p50_ms": r["p50"], "p95_ms": r["p95"], "mean_ms": r["mean"], "stdev_ms": r["stdev"], "gpu_hourly_usd": a.hourly_usd, "cost_per_1k_docs_usd": r["p50"] / 3600.0 * a.hourly_usd}
        _put(f"{p.results}/bench/{r['arm']}.json", one | stamp())
    say(arms=sorted(_folder(f"{p.results}/bench")))


def bench_teacher(spark: SparkSession, p: Paths, a: argparse.Namespace) -> None:
    """Summaries of recorded calls; making them needs the provider."""
    if not a.calls:
        raise Unavailable("calls need a provider; give recorded ones with --calls")
    s = benchmarks.teacher_summary(files.read_jsonl(spark, a.calls, CALL)).first().asDict()
    _put(a.out or f"{p.results}/bench/teacher.json", {"arm": "teacher", "measurement": "api_wall_clock"} | s | stamp())
    say(**s)


def report_build(spark: SparkSession, p: Paths, a: argparse.Namespace) -> None:
    base = a.results_dir or p.results
    metrics, benches = _folder(f"{base}/metrics"), _folder(f"{base}/bench")
    sweeps = {k[: -len("_sweep")]: v for k, v in benches.items() if k.endswith("_sweep")}
    bench = {k: v for k, v in benches.items() if not k.endswith("_sweep")}
    stats = {k: _stats(f"{base}/{k}_stats.json") for k in ("gold", "train", "corpus", "teacher")} | {"gold_audit": _stats(f"{base}/gold_review_audit.json")}
    tree = report.facts(metrics, bench, sweeps, stats, "gpt-4o-mini", "base", NOISE_F1, LOW_SUPPORT, stamp())
    out = a.out_dir or f"{base}/tables"
    os.makedirs(out, exist_ok=True)
    files.write_json(f"{base}/README_FACTS.json", tree, sort_keys=False)
    for name, build in rendering.TABLES.items():
        files.write_text(f"{out}/{name}.md", build(tree, metrics, bench, sweeps))
    dim = spark.createDataFrame([(x,) for x in schema.ARMS], "arm string")
    have = lambda t: spark.createDataFrame([(x,) for x in t], "arm string")
    for r in report.warnings(dim, have(metrics), have(bench), have(sweeps)).orderBy("arm", "missing").collect():
        print(f"{r['arm']} has no {r['missing']}", file=sys.stderr)
    if a.template:
        with open(a.template, encoding="utf-8") as f:
            text = report.rendered(f.read(), report.shown_facts(tree))
        files.write_text(a.readme or f"{out}/README.md", text)
        lines = spark.createDataFrame([(x,) for x in text.split("\n")], "line string")
        unknown = [r["number"] for r in report.unknown_claims(lines, report.fact_table(spark, tree)).orderBy("number").limit(10).collect()]
        words = [w for r in lines.select(report.word_violations(F.col("line")).alias("w")).where("size(w) > 0").limit(10).collect() for w in r["w"]]
        if a.strict and (unknown or words):
            raise ContractError("claims without a fact", len(unknown) + len(words), unknown + words)
    say(tables=sorted(os.listdir(out)))


def schema_dump(spark: SparkSession | None, p: Paths, a: argparse.Namespace) -> None:
    text = json.dumps(schema.json_schema(), indent=2) + "\n"
    files.write_text(a.out, text) if a.out else print(text, end="")


Command = Callable[[SparkSession, Paths, argparse.Namespace], None]
_INT, _STR, _FLAG = {"type": int}, {}, {"action": argparse.BooleanOptionalAction}
#: Each command and its options: name, kind, default.
COMMANDS: dict[tuple[str, str], tuple[Command, list[tuple[str, dict, Any]]]] = {
    ("corpus", "build"): (corpus_build, [("--source", {"required": True}, None), ("--source-name", _STR, ""), ("--license", _STR, None), ("--target-n", _INT, TARGET), ("--max-scan", _INT, MOST_READ), ("--least", _INT, curate.LEAST_ROWS), ("--least-split", _INT, curate.LEAST_SPLIT_ROWS), ("--force", _FLAG, False)]),
    ("teacher", "label"): (teacher_label, [("--split", {"choices": [*schema.SPLITS, "all"]}, "train"), ("--limit", _INT, 0), ("--model", _STR, "gpt-4o-mini"), ("--dry-run", _FLAG, False), ("--provider", _STR, None)]),
    ("gold", "sample"): (gold_sample, [("--n", _INT, CANDIDATES), ("--seed", _INT, SEED), ("--force", _FLAG, False)]),
    ("gold", "verify"): (gold_verify, [("--decisions", _STR, None)]),
    ("gold", "finalize"): (gold_finalize, [("--n", _INT, GOLD_ROWS), ("--reviewer", {"choices": ["human", "model_verified"]}, "human")]),
    ("metrics", "score"): (metrics_score, [("--arm", {"choices": list(schema.ARMS), "required": True}, None), ("--pred", _STR, None), ("--gold", _STR, None), ("--out", _STR, None), ("--expect-n", _INT, GOLD_ROWS)]),
    ("metrics", "compare"): (metrics_compare, [("--metrics-dir", _STR, None)]),
    ("gpu", "predict"): (gpu_predict, [("--arm", {"choices": list(schema.ARMS[:-1]), "required": True}, None), ("--generator", _STR, None), ("--gold", _STR, None), ("--out", _STR, None), ("--batch-size", _INT, predict.BATCH), ("--limit", _INT, 0)]),
    ("gpu", "train"): (gpu_train, [("--trainer", _STR, None), ("--limit", _INT, 0)]),
    ("gpu", "bench"): (gpu_bench, [("--samples", _STR, None), ("--batch-sizes", _STR, "1,2,4,8"), ("--hourly-usd", {"type": float}, 0.35)]),
    ("bench", "teacher"): (bench_teacher, [("--calls", _STR, None), ("--out", _STR, None)]),
    ("report", "build"): (report_build, [("--results-dir", _STR, None), ("--out-dir", _STR, None), ("--template", _STR, None), ("--readme", _STR, None), ("--strict", _FLAG, True)]),
    ("schema", "dump"): (schema_dump, [("--out", _STR, None)]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace")
    top.add_argument("--root", help="folder of the artefacts")
    groups: dict[str, Any] = {}
    by_group = top.add_subparsers(dest="group", required=True)
    for (group, name), (run, options) in COMMANDS.items():
        if group not in groups:
            groups[group] = by_group.add_parser(group).add_subparsers(dest="command", required=True)
        sub = groups[group].add_parser(name, help=(run.__doc__ or "").split("\n")[0] or None)
        for flag, kind, default in options:
            sub.add_argument(flag, default=default, **kind)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    run = COMMANDS[a.group, a.command][0]
    paths = Paths.in_dir(a.root) if a.root else Paths.default()
    if spark is None and run is not schema_dump:
        spark = SparkSession.builder.appName("millrace").getOrCreate()
    try:
        run(spark, paths, a)
    except ContractError as error:
        print(error, file=sys.stderr)
        return 1
    except Unavailable as error:
        print(error, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
