"""Operators whose plans avoid windows, replays and collects, against the plain algorithm; gates, sinks and resumption."""

import html
import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace import schema, tables
from millrace.errors import ContractError
from millrace.functions import text
from millrace.operators import benchmarks, curate, gold, label, predict, report, score, waves
from millrace.sources import files
from millrace.streaming import replay


def first_seen(rows):
    """The sequential rule: a dropped row registers neither its id nor its prefix."""
    ids, prefixes, out = set(), set(), {}
    for seq, i, p in sorted(rows):
        out[seq] = "duplicate_id" if i in ids else "duplicate_prefix" if p in prefixes else None
        if out[seq] is None:
            ids.add(i)
            prefixes.add(p)
    return out


@pytest.mark.parametrize("least", [0, 1, 100])
@pytest.mark.parametrize(("n", "ids", "prefixes"), [(120, 20, 25), (80, 79, 3), (60, 2, 50), (1, 1, 1)])
def test_dedupe_is_the_sequential_rule(spark, monkeypatch, least, n, ids, prefixes):
    monkeypatch.setattr(curate, "LEAST_ROUNDS", least)
    rng = random.Random(n * ids + least)
    rows = [(i, rng.choice([None, *(f"i{k}" for k in range(ids))]), rng.choice([None, *(f"p{k}" for k in range(prefixes))])) for i in rng.sample(range(10_000), n)]
    df = spark.createDataFrame(rows, "seq long, id string, prefix string").withColumn("text", F.concat(F.lit("t"), "seq"))
    got = curate.dedupe(df)
    assert got.columns == ["seq", "id", "prefix", "text", "drop"]
    assert {r["seq"]: r["drop"] for r in got.collect()} == first_seen(rows)


def test_dedupe_of_a_long_chain(spark, monkeypatch):
    """Each row waits for the one before. The rounds are few, and so are those in which components are found."""
    n = 100_000
    rows = spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit("i"), F.floor((F.col("id") + 1) / 2)).alias("id"), F.concat(F.lit("p"), F.floor(F.col("id") / 2)).alias("prefix"))
    kept, real = [], tables.Workspace.keep

    def keep(self, df, name):
        kept.append(name)
        return real(self, df, name)

    monkeypatch.setattr(tables.Workspace, "keep", keep)
    got = curate.dedupe(rows).groupBy("drop").agg(F.count("*").alias("n"), F.sum(F.col("seq") % 2).alias("odd")).collect()
    want = first_seen([(k, f"i{(k + 1) // 2}", f"p{k // 2}") for k in range(2000)])
    assert {r["drop"] for r in got} == set(want.values())
    assert {r["drop"]: r["n"] for r in got}[None] == n // 2 == 50 * sum(v is None for v in want.values())
    assert kept.count("left") - 1 <= curate.LEAST_ROUNDS + 1 and kept.count("edges") <= 17
    assert curate.dedupe(rows.limit(0)).collect() == []


def test_components_of_a_path_in_order(spark, monkeypatch):
    n, rounds, real = 20_000, [], tables.Workspace.keep
    monkeypatch.setattr(tables.Workspace, "keep", lambda self, df, name: (rounds.append(name), real(self, df, name))[1])
    edges = spark.range(n).selectExpr("id as a", "id + 1 as b").unionAll(spark.createDataFrame([(-5, -7), (-7, -5), (50_000, 50_000), (None, 3)], "a long, b long"))
    got = tables.components(tables.Workspace(spark), edges).groupBy("root").agg(F.count("*").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(-7, 2), (0, n + 1)] and rounds.count("edges") <= 15


@pytest.mark.parametrize("target", [7, 10_000])
def test_take_until_reads_what_it_needs(spark, target):
    rng = random.Random(target)
    rows = [(s, f"i{rng.randrange(300)}", f"p{rng.randrange(300)}", rng.choice([None, None, None, "short"])) for s in sorted(rng.sample(range(100_000), 900))]
    raw = spark.createDataFrame(rows, "seq long, id string, prefix string, reason string")
    got, read = curate.take_until(raw, target, lambda x: x)
    drops, kept, want = first_seen([r[:3] for r in rows if r[3] is None]), 0, {}
    for s, *_, reason in rows:
        want[s] = (reason, drops.get(s))
        kept += reason is None and drops[s] is None
        if kept == target:
            break
    assert {r["seq"]: (r["reason"], r["drop"]) for r in got.collect()} == want
    assert read <= max(2 * len(want) + 20, 2 * target + 20)
    assert curate.take_until(raw.limit(0), target, lambda x: x)[0].collect() == []


def test_dedupe_unique(spark):
    rows = [(3, "p", "c"), (1, "p", "a"), (2, "q", "b"), (4, None, "d"), (5, None, "e")]
    df = spark.createDataFrame(rows, "seq long, prefix string, text string")
    got = {r["seq"]: r["drop"] for r in curate.dedupe_unique(df).collect()}
    assert got == {1: None, 2: None, 3: "duplicate_prefix", 4: None, 5: "duplicate_prefix"}
    plan = curate.dedupe_unique(df)._jdf.queryExecution().toString()
    assert "Window" not in plan


def plain_clean(raw):
    s = unicodedata.normalize("NFKC", raw)
    for _ in range(3):
        u = html.unescape(s)
        if u == s:
            break
        s = u
    if re.search(text.HAS_TAG, s):
        s = re.sub("<[^>]+>", " ", s)
    s = s.replace("\r\n", "\n").replace("\r", "\n")
    s = "\n".join(line.rstrip() for line in s.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", s).strip()


def test_clean_is_the_plain_rule(spark):
    rng = random.Random(5)
    bits = ["a", "Bé", " ", "  ", "\t", "\n", "\r\n", "\r", "\n\n\n\n", " ", " ", "\x1c", "\x85", "　", "​", "<p>", "</DIV>", "<5 years", "< br / >", "<x>", "&amp;lt;b&gt;", "&nbsp;", "&", "ﬁ", "①", "Σ", ">"]
    cases = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    got = spark.createDataFrame(list(enumerate(cases)), "i long, t string").select("i", text.clean(F.col("t")).alias("t")).collect()
    for r in got:
        assert r["t"] == plain_clean(cases[r["i"]]), repr(cases[r["i"]])


def test_entities_without_a_semicolon_are_decoded(spark):
    cases = ["and&amp</title>", "a &amp b", "&copy 2026", "cut &am", "&amp;amp x", "R&D"]
    got = spark.createDataFrame(list(enumerate(cases)), "i long, t string").select("i", text.clean(F.col("t")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: plain_clean(c) for i, c in enumerate(cases)}
    assert plain_clean("a &amp b") == "a & b"


def test_clean_is_worked_out_once(spark):
    df = spark.createDataFrame([("x",)], "t string").withColumn("t", text.clean(F.col("t"))).withColumn("n", F.length("t")).withColumn("h", F.sha2("t", 256))
    plan = df.where("n > 0 and t <> 'y'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("regexp_replace") == 2


def test_blank_texts_are_left_out(spark):
    rows = [(0, None), (1, ""), (2, " \t\r\n"), (3, "\u3000\u2003"), (4, " x\n"), (5, "&nbsp;")]
    got = curate.cleaned(spark.createDataFrame(rows, "i long, text string")).collect()
    assert {r["i"]: r["text"] for r in got} == {4: "x", 5: ""}


def test_very_long_blank_runs(spark):
    t = ("x" + " " * 200_000 + "y" + "\t" * 100_000 + "\n") * 2
    assert spark.createDataFrame([(t,)], "t string").select(text.clean(F.col("t")).alias("t")).first()["t"] == plain_clean(t)


def test_select_docs(spark):
    rows = [(f"d{i:03d}", ("train", "dev", "other")[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, split string")
    got = [r["doc_id"] for r in label.select_docs(df, ("train", "dev"), caps={"train": 5}).orderBy("doc_id").collect()]
    want = sorted([d for d, s in rows if s == "train"][:5] + [d for d, s in rows if s == "dev"])
    assert got == want
    assert [r["doc_id"] for r in label.select_docs(df, ("train", "dev"), 3, {"train": 5}).collect()] == want[:3]
    assert label.select_docs(df, (), caps={}).count() == 0


def test_batches_whatever_the_ids_look_like(spark):
    for make in (lambda i: f"same-long-prefix-{i:05d}", lambda i: f"{i * 7919 % 1000:03d}-{i}"):
        ids = sorted(make(i) for i in range(500))
        got = {r["doc_id"]: r["batch"] for r in label.batches(spark.createDataFrame([(x,) for x in ids], "doc_id string"), 64).collect()}
        assert got == {x: k // 64 for k, x in enumerate(ids)}


def test_median_gap_over_blocks(spark, monkeypatch):
    rows = [(s, "accept", f"2026-01-01T00:{s // 60:02d}:{s % 60:02d}Z") for s in (0, 1, 2, 5, 9, 30, 31, 100)] + [(50, "edit", "x"), (51, "accept", "bad")]
    log = spark.createDataFrame(rows, "seq long, action string, at string")
    whole = gold.median_gap(log).first()[0]
    monkeypatch.setattr(gold, "BLOCK", 4)
    assert gold.median_gap(log).first()[0] == whole == 3.0  # gaps 1 1 3 4 21 1 69: the middle one
    assert gold.median_gap(log.limit(0)).first()[0] == 0.0


def test_exemplars_match_a_round_by_round_search(spark):
    import hashlib

    rng = random.Random(8)
    rows = [(f"d{i}", "".join(c for c in "abcdef" if rng.random() < 0.3)) for i in range(80)]
    covers = {c: F.contains("text", F.lit(c)) for c in "abcdef"}
    got = predict.pick_exemplars(spark.createDataFrame(rows, "doc_id string, text string"), covers, 6)
    left, seen, want = dict(rows), set(), []
    for _ in range(6):
        top = min(left, key=lambda d: (-len(set(left[d]) - seen), hashlib.sha256(d.encode()).hexdigest()))
        seen |= set(left.pop(top))
        want.append(top)
    assert got == want
    # any number of predicates: of 40 that are alike, one row covers all
    alike = {f"a{i}": F.contains("text", F.lit("a")) for i in range(40)}
    assert predict.pick_exemplars(spark.createDataFrame(rows, "doc_id string, text string"), alike, 1) == [min((d for d, t in rows if "a" in t), key=lambda d: hashlib.sha256(d.encode()).hexdigest())]


def test_stride_sample_numbers_no_more_than_it_needs(spark):
    rows = predict.stride_sample(spark.range(1000).withColumnRenamed("id", "n"), "n", 7, 10)
    assert [r["n"] for r in rows.orderBy("n").collect()] == [7 * i for i in range(10)]


def test_faults_and_messages(spark):
    g = spark.createDataFrame([(1,), (2,), (2,)], "doc_id long")
    p = spark.createDataFrame([(1,), (1,), (9,), (9,)], "doc_id long")
    assert sorted(map(tuple, score.faults(g, p).collect())) == [(1, "duplicate in predictions"), (2, "duplicate in gold"), (9, "duplicate in predictions"), (9, "unknown to gold")]
    with pytest.raises(ContractError, match="ids duplicate in gold: 2"):
        score.check(g, p)
    with pytest.raises(ContractError, match=r"unknown to gold: 10, 11, 12, 13, 14, 15, 16, 17, 18, 19 \(\+20 more\)"):
        score.check(spark.range(10).withColumnRenamed("id", "doc_id"), spark.range(40).withColumnRenamed("id", "doc_id"))


def test_nan_and_signed_zero_in_scores(spark):
    fields = ", ".join(f"{f} {schema.field_type(f).simpleString()}" for f in schema.FIELDS)
    row = lambda **kw: tuple({f: [] if f in schema.SETS else None for f in schema.FIELDS}.get(f) if f not in kw else kw[f] for f in schema.FIELDS)
    nan = float("nan")
    golds = [(1, *row(salary_min=nan, salary_max=0.0)), (2, *row(salary_min=1.0, salary_max=-0.0))]
    preds = [(1, row(salary_min=nan, salary_max=-0.0), True), (2, row(salary_min=1.0, salary_max=0.0), True)]
    g = spark.createDataFrame(golds, f"doc_id long, {fields}")
    p = spark.createDataFrame(preds, f"doc_id long, parsed struct<{', '.join(f'{f}:{schema.field_type(f).simpleString()}' for f in schema.FIELDS)}>, schema_valid boolean")
    got = {r["field"]: (r["tp"], r["fp"], r["fn"], r["em"]) for r in score.per_field(score.joined(g, p)).collect()}
    assert got["salary_min"] == (1, 1, 1, 1) and got["salary_max"] == (2, 0, 0, 2)
    assert [r["n"] for r in score.per_field(score.joined(g.limit(0), p)).collect()] == [0] * 16


def test_gates(spark):
    counts = spark.createDataFrame([("train", 100), ("dev", 3), ("eval_pool", 9)], "split string, n long")
    assert [tuple(r) for r in curate.too_small(counts, 100, 5).collect()] == [("dev", 3, 5)]
    assert {r["what"] for r in curate.too_small(counts, 113, 10).collect()} == {"corpus", "dev", "eval_pool"}
    curate.expect_rows(counts, 3, "it")
    curate.expect_rows(counts, 0, "it")
    for n in (2, 4):
        with pytest.raises(ContractError):
            curate.expect_rows(counts, n, "it")
    with pytest.raises(ContractError):
        files.enough_space("/tmp", 10, free=lambda _: 9)
    files.enough_space("/tmp", 10, free=lambda _: 10)


def test_corpus_rows_reads_two_columns(spark, tmp_path):
    rows = [(f"k{i}", i, "long text " * 60 if i % 5 else " 　\n") for i in range(40)] + [("n", 9, None)]
    spark.createDataFrame(rows, "id string, other long, body string").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = files.corpus_rows(spark.read.parquet(str(tmp_path / "t")))
    assert got.columns == ["source_key", "text"] and got.count() == 32
    assert "ReadSchema: struct<id:string,body:string>" in got._jdf.queryExecution().executedPlan().toString()
    assert files.corpus_rows(spark.read.parquet(str(tmp_path / "t")), 10).count() <= 10
    keyless = spark.read.parquet(str(tmp_path / "t")).drop("id")
    assert len(files.corpus_rows(keyless).first()["source_key"]) == 64


def test_sinks(spark, tmp_path):
    m = {k: 1 for k in files.METRICS_KEYS} | {"per_field": {f: 0 for f in reversed(schema.FIELDS)}, "more": 1}
    files.write_metrics(str(tmp_path / "m.json"), m)
    back = json.loads((tmp_path / "m.json").read_text())
    assert list(back) == list(files.METRICS_KEYS) and list(back["per_field"]) == list(schema.FIELDS)
    t = {k: 1 for k in files.TRAIN_KEYS}
    files.write_train_stats(str(tmp_path / "t.json"), t | {"more": 2})
    assert list(json.loads((tmp_path / "t.json").read_text())) == list(files.TRAIN_KEYS)
    for write, obj in ((files.write_metrics, {k: v for k, v in m.items() if k != "n"}), (files.write_train_stats, {k: 1 for k in files.TRAIN_KEYS[1:]})):
        with pytest.raises(ContractError):
            write(str(tmp_path / "x.json"), obj)
    assert not (tmp_path / "x.json").exists()
    assert files.write_jsonl(spark.range(12), str(tmp_path / "l")) == 12 and files.write_jsonl(spark.range(0), str(tmp_path / "e")) == 0
    split = spark.range(10).withColumn("split", F.when(F.col("id") < 7, "a").otherwise("b"))
    assert files.write_splits(split, str(tmp_path / "s"), ("a", "none")) == {"a": 7, "none": 0}
    assert files.write_splits(split.where("id = 1"), str(tmp_path / "s"), ("a",)) == {"a": 1}
    assert sorted(x.name for x in (tmp_path / "s").iterdir()) == ["a", "none"] and spark.read.json(str(tmp_path / "s" / "a")).count() == 1


def test_resume_harvests_before_anything_is_sent():
    ledger = [
        {"tag": "a", "batch_id": "A", "doc_ids": ["1"], "harvested": True}, {"tag": "b", "batch_id": "B", "doc_ids": ["2", "3"]},
        {"tag": "c", "batch_id": None, "doc_ids": ["4"]}, {"tag": "d", "doc_ids": ["5", "6"]},
    ]
    calls = []
    again = waves.resume(ledger, lambda r: "C" if r["tag"] == "c" else None, lambda b: calls.append(b) or (["3"] if b == "B" else []), lambda r: calls.append(dict(r)))
    assert again == ["3", "5", "6"] and [c for c in calls if isinstance(c, str)] == ["B", "C"]
    assert [r.get("status") for r in ledger] == [None, "harvested", "harvested", "abandoned"] and all(r["harvested"] for r in ledger)
    assert calls[1]["batch_id"] == "B" and calls[2]["batch_id"] == "C" and not calls[2].get("harvested"), "an adopted id is saved before its harvest"


def test_training_rows(spark):
    right = json.dumps({f: None for f in schema.FIELDS} | {f: "unknown" for f in schema.ENUMS} | {"required_skills": []}, separators=(",", ":"))
    rows = [("d1", "text", right)]
    ddl = "doc_id string, text string, gold string"
    example = predict.training_rows(spark.createDataFrame(rows, ddl), "sys", "<|im_end|>").first()["example"]
    assert example == f"<|system|>\nsys\n<|user|>\ntext\n<|assistant|>\n{right}<|im_end|>"
    for bad in ([("d2", "t", right.replace('"title"', '"tittle"'))], [("d2", "t", None)], [("d2", "t<|im_end|>", right)]):
        with pytest.raises(ContractError, match="d2"):
            predict.training_rows(spark.createDataFrame(rows + bad, ddl), "sys", "<|im_end|>")


def test_final_losses(spark):
    log = spark.createDataFrame([(1, 3.0, None), (2, 2.0, 0.5), (3, None, 0.75)], "step long, loss double, eval_loss double")
    none = log.limit(0)
    one = lambda *v: spark.createDataFrame([v], "train_loss double, eval_loss double, best_metric double")
    got = lambda a, b: tuple(benchmarks.final_losses(a, b).first())
    assert got(log, one(1.0, None, None)) == (1.0, 0.5) and got(log, one(None, 9.0, 0.25)) == (2.0, 0.25) and got(none, one(None, 9.0, None))[1] == 9.0
    assert all(x != x for x in got(none, one(None, None, None)))


def test_facts():
    empty = report.facts({}, {}, {}, {}, "t", "b", 0.03, 30, {"generated_at": "now", "git_sha": "x"})
    assert set(schema.ARMS) <= set(empty) and empty["teacher_model"] == "t" and empty["lowest_teacher_agreement_str"] == report.DASH
    assert report.shown_facts(empty)["lora_ft__macro_f1"] == report.DASH
    sweep = {"lora_ft": {"sweep": [{"batch_size": 1, "throughput_docs_per_s": 2.0, "amortized_ms_per_doc": 500.0}, {"batch_size": 2, "throughput_docs_per_s": 4.0, "amortized_ms_per_doc": 250.0}, {"batch_size": 4, "throughput_docs_per_s": 4.0, "amortized_ms_per_doc": 250.0}, {"batch_size": 8, "oom": True}]}}
    f = report.facts({"lora_ft": {"macro_f1": 0.8}, "teacher": {"macro_f1": 0.9, "macro_f1_null_baseline": 0.1}}, {"lora_ft": {"gpu_hourly_usd": 0.36, "cost_per_1k_docs_usd": 9.0}}, sweep, {"train": {"train_runtime_s": 7200}, "teacher": {"spend_usd": 2.0}}, "t", "b", 0.03, 30, {})
    arm = f["lora_ft"]
    assert arm["delta_vs_teacher"] == pytest.approx(-0.1) and arm["best_batch_size"] == 2 and arm["cost_per_1k_docs_usd"] == pytest.approx(0.025) and arm["cost_per_1k_docs_usd_batch1"] == 9.0
    assert f["teacher"]["cost_per_1k_docs_usd"] is None and f["train_runtime_h"] == 2 and f["spend_usd"] == 2.0 and f["macro_f1_null_baseline"] == 0.1


def test_streaming_states_keep_few_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "FOLDED", 2)
    rng = random.Random(4)
    lines = [{"seq": i, "doc_id": f"d{rng.randint(0, 30)}", "field": rng.choice(["title", "company"]), "old": None, "new": str(i), "at": f"t{i}", "action": rng.choice(["edit", "edit", "accept", "reject_doc"])} for i in range(300)]
    src = tmp_path / "src"
    src.mkdir()
    for k in range(5):
        (src / f"{k}.json").write_text("\n".join(map(json.dumps, lines[60 * k : 60 * k + 60])))
        replay.replay_stream(spark, str(src), str(tmp_path / "state"), str(tmp_path / "cp"))
    whole = gold.replay(spark.createDataFrame([tuple(x[c] for c in replay.LOG.names) for x in lines], replay.LOG))
    part = gold.replay(replay.states(spark, str(tmp_path / "state")))
    assert sorted(map(str, part.collect())) == sorted(map(str, whole.collect()))
    assert len(list((tmp_path / "state").glob("changes/v=*"))) <= 3 and len(list((tmp_path / "state").glob("folded/v=*"))) == 1
    assert replay.states(spark, str(tmp_path / "none")).count() == 0
