"""Pinned cases of the operators."""

import json

import pytest
from pyspark.sql import functions as F

from millrace import schema
from millrace.errors import ContractError
from millrace.functions import cost, extract, identity, normalize, text
from millrace.operators import benchmarks, curate, gold, label, predict, report, score, waves
from millrace.sources import files
from millrace.streaming import replay

FULL = dict(
    title="Senior Engineer", company=None, employment_type="full_time", seniority="senior", remote_mode="remote", location_city="Austin", location_region="Texas", location_country="US",
    salary_min=120000.0, salary_max=150000.0, salary_currency="USD", salary_period="yearly", years_experience_min=6, education_level="bachelor", required_skills=["python", "sql"], posting_date=None,
)
ABSENT = {f: None for f in schema.FIELDS} | {f: "unknown" for f in schema.ENUMS} | {"required_skills": []}


def tup(p):
    return tuple(p[f] for f in schema.FIELDS)


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(col.alias("x")).first()["x"]


def test_golden_score(spark):
    gold_rows = [FULL, FULL, FULL, ABSENT | {"required_skills": ["python", "sql", "aws"]}]
    preds = [FULL, FULL | {"title": "Staff Engineer", "seniority": "mid", "salary_min": 120001.0}, None, ABSENT | {"required_skills": ["python", "sql", "java"]}]
    ddl = ", ".join(f"{f} {schema.field_type(f).simpleString()}" for f in schema.FIELDS)
    g = spark.createDataFrame([(i, *tup(p)) for i, p in enumerate(gold_rows)], f"doc_id int, {ddl}")
    p = spark.createDataFrame([(i, p is not None, tup(p) if p else None) for i, p in enumerate(preds)], f"doc_id int, schema_valid boolean, parsed struct<{', '.join(f'{f}:{schema.field_type(f).simpleString()}' for f in schema.FIELDS)}>")
    score.check(g, p)
    got = {r["field"]: (r["tp"], r["fp"], r["fn"], r["em"], r["support"], round(r["f1"], 4)) for r in score.per_field(score.joined(g, p)).collect()}
    for f in schema.FIELDS:
        if f in ("title", "seniority", "salary_min"):
            assert got[f] == (1, 1, 2, 2, 3, 0.4)
        elif f in ("company", "posting_date"):
            assert got[f] == (0, 0, 0, 3, 0, 0.0)
        elif f == "required_skills":
            assert got[f] == (6, 1, 3, 2, 9, 0.75)
        else:
            assert got[f] == (2, 0, 1, 3, 3, 0.8)
    assert score.macro_f1(score.per_field(score.joined(g, p))).first()[0] == pytest.approx(0.621875)
    head = score.header(score.joined(g, p), g, p).first()
    assert (head["n"], head["schema_valid_rate"], head["n_missing"]) == (4, 0.75, 0)
    with pytest.raises(ContractError):
        score.check(g, p.unionAll(p))
    with pytest.raises(ContractError):
        score.check(g.where("doc_id < 3"), p)


def test_splits(spark):
    rows = spark.createDataFrame([("jp_000001",), ("jp_000012",), ("jp_000065",)], "id string")
    got = rows.select(identity.bucket(F.col("id")), identity.split(F.col("id"))).collect()
    assert [tuple(r) for r in got] == [(51, "train"), (1, "eval_pool"), (8, "dev")]


def test_clean(spark):
    cases = {"A\r\nB\r\rC\n\n\n\n\nD": "A\nB\n\nC\n\nD", "<5 years, <100k": "<5 years, <100k", "a <p>b</p>": "a  b", "x &amp;lt; y": "x < y", "ﬁne  ": "fine", "a  \nb\t\n": "a\nb", "&lt;b&gt;x&lt;/b&gt;": "x"}
    for raw, want in cases.items():
        got = one(spark, text.clean(F.col("t")), t=raw)
        assert got == want and one(spark, text.clean(F.col("t")), t=got) == want


def test_normalise(spark):
    assert one(spark, normalize.norm_str(F.col("v")), v="  Senior   DATA\x1cEngineer ") == "senior data engineer"
    assert one(spark, normalize.norm_str(F.col("v")), v="   ") is None
    assert one(spark, normalize.norm_upper(F.col("v")), v=" us ") == "US"
    assert sorted(one(spark, normalize.norm_skills(F.col("v")), v=["Python ", "python", "SQL", " ", None])) == ["python", "sql"]
    assert one(spark, normalize.norm_number(F.col("v")), v="120000") == 120000.0
    assert one(spark, normalize.norm_number(F.col("v")), v="n/a") is None
    with pytest.raises(KeyError):
        normalize.norm_field("nope", F.col("v"))
    assert one(spark, normalize.absent("education_level", F.col("v")), v="none") is False
    assert one(spark, normalize.absent("title", F.col("v")), v="Unknown") is True
    assert one(spark, normalize.null_valued("title", F.col("v")), v="Unknown") is False


@pytest.mark.parametrize("raw", ['{"a": 1}', '  {"a": 1} ', '```json\n{"a": 1}\n```', '```\n{"a": 1}\n```', 'Sure: {"a": 1}', '{"a": 1} done', 'x {"a": 1} y'])
def test_tolerant_parse(spark, raw):
    assert one(spark, F.try_variant_get(extract.extract_json(F.col("r")), "$.a", "int"), r=raw) == 1


@pytest.mark.parametrize("raw", ["I can't", '{"a": 1', '{"a": 1,}', "{", "}", "[1, 2, 3]", "null", "5", '"text"', "true", "", '{"a":1} {"b":2}'])
def test_tolerant_parse_rejects(spark, raw):
    assert one(spark, extract.extract_json(F.col("r")).isNull(), r=raw) is True


@pytest.mark.parametrize("change, ok", [({}, True), ({"salary_min": 5}, True), ({"salary_min": "5"}, False), ({"seniority": "boss"}, False), ({"seniority": None}, False), ({"required_skills": None}, False), ({"extra": 1}, False), ({"title": "drop"}, False), ({"years_experience_min": 2.5}, False), ({"required_skills": []}, True), ({"required_skills": [1]}, False)])
def test_strict_validation(spark, change, ok):
    obj = FULL | change
    if change.get("title") == "drop":
        del obj["title"]
    assert one(spark, extract.valid(extract.extract_json(F.col("r"))), r=json.dumps(obj)) is ok
    assert one(spark, extract.posting(extract.extract_json(F.col("r"))).isNotNull(), r=json.dumps(obj)) is ok


def test_coupled_dedupe(spark):
    rows = [(1, "A", "p1"), (2, "B", "p1"), (3, "B", "p2"), (4, "C", "p3"), (5, "C", "p4"), (6, "D", "p4"), (7, "E", "p9")]
    got = curate.dedupe(spark.createDataFrame(rows, "seq long, id string, prefix string"))
    assert {r["seq"]: r["drop"] for r in got.collect()} == {1: None, 2: "duplicate_prefix", 3: None, 4: None, 5: "duplicate_id", 6: None, 7: None}


def test_quotas_and_strata(spark):
    lengths = spark.createDataFrame([(x,) for x in (1, 400, 1499, 1500, 7999, 8000, 10**9)], "n long")
    assert [r[0] for r in lengths.select(gold.stratum(F.col("n"))).collect()] == ["400-1500"] * 3 + ["1500-3000", "3000-8000", "8000-40000", "8000-40000"]
    pool = spark.range(361).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 9000).otherwise(500 + F.col("id")).alias("char_len"))
    assert gold.sample(pool, 330).count() == 330


def test_results_in_priority(spark):
    msg = "struct<content:string,refusal:string>"
    ddl = f"custom_id string, error struct<code:string,message:string>, response struct<status_code:int,body:struct<choices:array<struct<index:int,finish_reason:string,message:{msg}>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>,error:struct<message:string>>>"
    body = lambda choices: (200, (choices, (7, 3), None))
    rows = [
        ("a", ("c", "m"), None), ("b", None, (500, (None, None, ("oops",)))), ("c", None, body([])), ("d", None, body([(0, "stop", (None, "no"))])),
        ("e", None, body([(0, "stop", ("", None))])), ("f", None, body([(0, "length", ("{", None))])),
    ]
    got = {r["doc_id"]: r for r in label.parse_results(spark.createDataFrame(rows, ddl), "m", "s", "b").collect()}
    assert [got[k]["error"] for k in "abcdef"] == ["request_error: c: m", "http_500: oops", "empty_content", "refusal: no", "empty_content", None]
    assert got["f"]["ok"] and got["f"]["raw_output"] == "{" and got["f"]["usage"]["input_tokens"] == 7 and got["a"]["usage"]["input_tokens"] == 0


def test_benchmarks(spark):
    s = spark.range(1, 201).select(F.lit("a").alias("arm"), F.col("id").cast("double").alias("ms"))
    r = benchmarks.latency_summary(s, "arm").first()
    assert (r["n"], r["p50"], r["p95"]) == (200, 100.0, 190.0)
    sweep = spark.createDataFrame([("a", 0, 1, 1.0, False), ("a", 1, 4, 9.0, False), ("a", 2, 8, 9.0, False), ("a", 3, 16, 99.0, True)], "arm string, ord int, batch_size int, throughput double, oom boolean")
    r = benchmarks.best_rows(sweep).first()
    assert (r["fastest_batch"], r["largest_batch"]) == (4, 8)
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(cost.cost_per_1k(F.lit(0.0), F.lit(1.0))).collect()
    with pytest.raises(Exception, match="no price"):
        spark.range(1).select(cost.batch_cost(F.lit(1), F.lit(1), F.lit("x"))).collect()


def test_generation_seam(spark):
    docs = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "doc_id int, prompt string")
    out = predict.generate(docs, lambda ps: [json.dumps(FULL) for _ in ps])
    assert predict.records(out, "lora_ft").where("schema_valid").count() == 20
    with pytest.raises(Exception, match="outputs for"):
        predict.generate(docs, lambda ps: ps[1:]).collect()
    with pytest.raises(ContractError):
        predict.remaining(docs, docs.withColumn("arm", F.lit("x")), "lora_ft")


def test_exemplars(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "b"), (3, "c"), (4, "x")], "doc_id int, text string")
    got = predict.pick_exemplars(rows, {k: F.contains("text", F.lit(k)) for k in "abc"}, 2)
    assert got == [1, 3]
    assert [r["doc_id"] for r in predict.frozen_exemplars(rows, [3, 1]).collect()] == [3, 1]
    with pytest.raises(ContractError):
        predict.frozen_exemplars(rows, [9])
    with pytest.raises(ContractError, match="4 exemplars of the 5"):
        predict.pick_exemplars(rows, {}, 5)
    many = {f"p{i}": F.col("doc_id") % 13 == i % 13 for i in range(40)}  # any number of predicates
    wide = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    picked = predict.pick_exemplars(wide, many, 20)
    assert len(set(picked)) == 20 and {x % 13 for x in picked[:13]} == set(range(13)) and picked[0] % 13 == 0


def test_splice_without_markers():
    block = f"{report.BEGIN}\nnew\n{report.END}\n"
    for text in ("# Title\n\nprose\n", "", f"a {report.END} b {report.BEGIN} c", f"only {report.BEGIN} begins"):
        assert report.splice(text, "new") == text.rstrip("\n") + "\n\n" + block
    once = report.splice("# Title\n", "old")
    assert report.splice(once, "new") == "# Title\n\n" + block


def test_report_pieces():
    assert report.show(None, "f3") == report.DASH and report.show(0.03125, "f3") == "0.031" and report.show(-0.05, "signed3") == "-0.050" and report.show(0.995, "pct1") == "99.5"
    assert report.flatten({"a": {"b": 1}, "c": 2}) == {"a__b": 1, "c": 2}
    assert report.splice(f"x{report.BEGIN}old{report.END}y", "new") == f"x{report.BEGIN}\nnew\n{report.END}y"
    assert report.placeholders("{{ a }} {{b}} {{a}}") == ["a", "b"]
    assert report.pipe_table(["h"], ["r"], [["1"]]) == "| h |\n| ---: |\n| 1 |\n"
    assert schema.json_schema()["required"] == list(schema.FIELDS)


def test_files(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"doc_id": "a", "n": 1}\n\n   \n{"doc_id": "b", "n": null}\n')
    s = "doc_id string, n long"
    from pyspark.sql.types import _parse_datatype_string

    s = _parse_datatype_string(s)
    rows = files.read_jsonl(spark, str(p), s)
    assert rows.count() == 2
    files.write_jsonl(rows.withColumn("split", F.lit("dev")), str(tmp_path / "o"))
    assert '"n":null' in "".join(f.read_text() for f in (tmp_path / "o").glob("*.json"))
    files.write_splits(rows.withColumn("split", F.lit("dev")), str(tmp_path / "s"), ["dev", "train"])
    assert files.read_jsonl(spark, str(tmp_path / "s" / "dev"), s).count() == 2 and (tmp_path / "s" / "train").exists()
    p.write_text('{"doc_id": "a", "n": 1}\nnot json\n')
    assert files.malformed(spark, str(p), s).first()["_corrupt_record"] == "not json"
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), s).collect()
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text('{"arm": null, "n": 1}')
    (tmp_path / "m" / "b_sweep.json").write_text('{"n": 2}')
    plain, sweeps = files.read_artifacts(spark, str(tmp_path / "m"), _parse_datatype_string("arm string, n long"))
    assert [r["arm"] for r in plain.collect()] == ["a"] and [r["arm"] for r in sweeps.collect()] == ["b"]
    files.write_json(str(tmp_path / "k.json"), {"b": 1, "a": 2})
    assert list(json.loads((tmp_path / "k.json").read_text())) == ["a", "b"]
    assert files.parse_batch_sizes(" 8, 1,,8 ") == [1, 8]
    with pytest.raises(ContractError):
        files.parse_batch_sizes("0")


def test_streaming_replay_equals_batch(spark, tmp_path):
    lines = [dict(seq=i, doc_id=str(i % 5), field=("title" if i % 3 else None), old=None, new=str(i), at=f"2026-01-01T00:00:{i:02d}Z", action=("edit" if i % 3 else ("accept" if i % 2 else "reject_doc"))) for i in range(40)]
    src = tmp_path / "log"
    src.mkdir()
    for k in range(2):
        (src / f"{k}.json").write_text("\n".join(json.dumps(x) for x in lines[k * 20 : k * 20 + 20]))
        replay.replay_stream(spark, str(src), str(tmp_path / "state"), str(tmp_path / "cp"))
    whole = gold.replay(spark.createDataFrame([tuple(x[c] for c in replay.LOG.names) for x in lines], replay.LOG))
    part = gold.replay(replay.states(spark, str(tmp_path / "state"), 2))
    assert sorted(map(str, whole.collect())) == sorted(map(str, part.collect()))


def test_replay_survives_a_crash_before_the_commit(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    lines = [dict(seq=i, doc_id=str(i % 7), field="title", old=None, new=str(i), at="2026-01-01T00:00:00Z", action="edit" if i % 3 else "accept") for i in range(60)]

    def crash(batch_id):
        raise RuntimeError("crash between write and commit")

    for k in range(2):
        (src / f"{k}.json").write_text("\n".join(json.dumps(x) for x in lines[k * 30 : k * 30 + 30]))
        with pytest.raises(Exception, match="crash"):
            replay.replay_stream(spark, str(src), str(tmp_path / "state"), str(tmp_path / "cp"), after_write=crash)
        replay.replay_stream(spark, str(src), str(tmp_path / "state"), str(tmp_path / "cp"))
        whole = gold.replay(spark.createDataFrame([tuple(x[c] for c in replay.LOG.names) for x in lines[: k * 30 + 30]], replay.LOG))
        assert sorted(map(str, gold.replay(replay.states(spark, str(tmp_path / "state"))).collect())) == sorted(map(str, whole.collect()))


def test_line_numbers(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    s = _parse_datatype_string("n long")
    text = "".join(f'{{"n": {i}}}\n' if i % 50 else ("\n" if i % 100 else "broken\n") for i in range(1, 1001))
    (tmp_path / "a.jsonl").write_text(text)
    (tmp_path / "b.jsonl").write_text('{"n": 1}\n[1]')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        got = files.malformed_lines(spark, str(tmp_path), s)
        assert got.rdd.getNumPartitions() > 1
        assert sorted((r["file"].rpartition("/")[2], r["line"], r["value"]) for r in got.collect()) == sorted([*(("a.jsonl", i, "broken") for i in range(100, 1001, 100)), ("b.jsonl", 2, "[1]")])
        with pytest.raises(ContractError, match=r"a\.jsonl:100"):
            files.checked_jsonl(spark, str(tmp_path), s)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_leakage_guard(spark):
    a, b = spark.range(20).withColumnRenamed("id", "doc_id"), spark.range(5, 25).withColumnRenamed("id", "doc_id")
    with pytest.raises(ContractError) as e:
        gold.assert_no_leakage(a, b)
    assert e.value.count == 15 and len(e.value.sample) == 10 and "(+5 more)" in str(e.value)
    gold.assert_no_leakage(a, b.where("doc_id >= 20"))
    with pytest.raises(ContractError):
        label.guard_spend(26.0)


def test_capacity_errors(spark):
    cases = {"Enqueued token limit": True, "token count over its LIMIT": True, "enqueued": True, "rate limit": False, "quota": False, "token": False}
    for text_, want in cases.items():
        assert one(spark, label.capacity_error(F.col("m")), m=text_) is want


def test_batch_sizes_of_columns(spark):
    assert one(spark, files.batch_sizes(F.col("v")), v=" 8, 1,,8 ") == [1, 8]
    assert one(spark, files.batch_sizes(F.col("v")), v="0,1") is None and one(spark, files.batch_sizes(F.col("v")), v=" , ") is None
    with pytest.raises(ContractError):
        files.parse_batch_sizes(" , ")


def test_rendering(spark):
    assert report.rendered("{{ a }}-{{b}}", {"a": "1", "b": "2"}) == "1-2"
    with pytest.raises(ContractError):
        report.rendered("{{ a }}", {})
    assert one(spark, report.shown(F.col("v"), "signed3"), v="-0.05") == "-0.050" and one(spark, report.shown(F.col("v"), "int0"), v="7.9") == "7"
    assert one(spark, gold.rendered("required_skills", F.col("v")), v=[]) == "[]" and one(spark, gold.rendered("required_skills", F.col("v")), v=["a", "b"]) == "a, b"


def test_wave_is_bounded_and_requeues():
    flying, most, log, sent = set(), [], [], {}

    def submit(batch):
        flying.add(batch["tag"])
        most.append(len(flying))
        sent[batch["tag"]] = batch["doc_ids"]
        return batch["tag"]

    def harvest(batch_id):
        flying.remove(batch_id)
        return ["b0"] if batch_id in ("t0", "t0-requeue1") else []

    batches = [{"tag": f"t{i}", "doc_ids": [f"b{i}"]} for i in range(7)]
    done = waves.run_wave(batches, submit, harvest, lambda b, state: log.append((b["tag"], state)))
    assert max(most) == 4 and len(done) == 9 and sent["t0-requeue1"] == ["b0"]
    assert log[0] == ("t0", "intent") and log[1] == ("t0", "t0")
    with pytest.raises(ContractError):
        waves.run_wave(batches, submit, lambda i: flying.discard(i) or ["x"], lambda *_: None)


def test_retry_and_ledger():
    calls, slept = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert waves.with_retry(flaky, lambda e: isinstance(e, TimeoutError), slept.append) == "ok" and slept == [4.0, 16.0]
    with pytest.raises(KeyError):
        waves.with_retry(lambda: {}["x"], lambda e: False, slept.append)
    waves.consistent([{"tag": "a", "model": "m", "prompt_sha": "s"}], "m", "s")
    with pytest.raises(ContractError):
        waves.consistent([{"tag": "a", "model": "m", "prompt_sha": "old"}], "m", "s")
