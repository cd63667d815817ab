"""The commands end to end over a small folder of artefacts, and their exit codes."""

import json
import os

import pytest

from millrace import cli, schema
from millrace.functions import extract  # noqa: F401

POSTING = {f: None for f in schema.FIELDS} | {f: m[0] for f, m in schema.ENUMS.items()} | {"required_skills": ["sql"], "title": "Engineer"}


def copycat(prompts):
    return [json.dumps(POSTING) for _ in prompts]


def put_lines(path, rows):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/part.json", "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("artifacts")
    rows = [(f"k{i}", f"<p>Posting number {i}</p>\r\n" + f"words of text {i} " * 40) for i in range(400)]
    rows += [("k0", "a copy of the first key " * 40), ("x1", rows[5][1]), ("x2", "too short"), ("x3", None), ("x4", " ")]
    spark.createDataFrame(rows, "job_id string, body string").coalesce(1).write.parquet(f"{base}/raw")
    return str(base)


def run(spark, root, *args):
    return cli.main(["--root", root, *args], spark)


def test_all_stages(spark, root, capsys):
    assert run(spark, root, "corpus", "build", "--source", f"{root}/raw", "--least", "300", "--least-split", "1") == 0
    stats = cli._stats(f"{root}/results/corpus_stats.json")
    assert (stats["n_kept"], stats["n_dropped_short"], stats["n_dropped_dup_id"], stats["n_dropped_dup_prefix"]) == (400, 1, 1, 1)
    assert sum(stats["split_counts"].values()) == 400 and stats["char_len"]["max"] > 400
    capsys.readouterr()
    assert run(spark, root, "corpus", "build", "--source", f"{root}/raw", "--least", "300") == 0
    assert "skipped" in capsys.readouterr().out
    assert run(spark, root, "corpus", "build", "--source", f"{root}/raw", "--force") == 1, "too few rows"

    docs = cli.files.read_jsonl(spark, f"{root}/corpus/docs", cli.DOC).orderBy("doc_id").collect()
    assert all("<p>" not in r["text"] and "\r" not in r["text"] for r in docs)
    assert run(spark, root, "teacher", "label", "--split", "all", "--dry-run") == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["todo"] == 400
    assert run(spark, root, "teacher", "label", "--split", "all") == 2, "no provider"
    assert run(spark, root, "teacher", "label", "--model", "unheard-of") == 1

    cache = [{"doc_id": r["doc_id"], "raw_output": json.dumps(POSTING), "teacher_model": "gpt-4o-mini", "prompt_sha": cli.PROMPT_SHA, "error": None, "ok": True, "seq": i, "tokens_in": 100, "tokens_out": 50} for i, r in enumerate(docs)]
    put_lines(f"{root}/labeled/_cache", cache)
    assert run(spark, root, "teacher", "label", "--split", "all") == 1, "one member everywhere, and few rows"
    teacher = cli._stats(f"{root}/results/teacher_stats.json")
    assert teacher["n_ok"] == 400 and teacher["split_counts"] == stats["split_counts"] and {w["field"] for w in teacher["quality_warnings"]} == set(schema.ENUMS)

    n = stats["split_counts"]["eval_pool"]
    assert run(spark, root, "gold", "sample", "--n", str(n)) == 0
    assert run(spark, root, "gold", "sample", "--n", str(n)) == 1, "there already"
    ids = [r["doc_id"] for r in cli._candidates(spark, cli.Paths.in_dir(root)).orderBy("doc_id").collect()]
    log = [{"seq": i, "doc_id": d, "field": None, "old": None, "new": None, "at": f"2026-01-01T00:00:{i:02d}Z", "action": "accept" if i else "reject_doc"} for i, d in enumerate(ids)]
    put_lines(f"{root}/decisions", log)
    assert run(spark, root, "gold", "verify", "--decisions", f"{root}/decisions") == 0
    told = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (told["accepted"], told["rejected"], told["next"], told["median_s"]) == (n - 1, 1, None, 1.0)
    assert run(spark, root, "gold", "finalize", "--n", str(n)) == 1, "one was rejected"
    assert run(spark, root, "gold", "finalize", "--n", str(n - 1)) == 0

    assert run(spark, root, "gpu", "predict", "--arm", "lora_ft") == 2
    assert run(spark, root, "gpu", "predict", "--arm", "lora_ft", "--generator", "test_cli:copycat") == 0
    told = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (told["n"], told["n_valid"], told["n_resumed"]) == (n - 1, n - 1, 0)
    assert run(spark, root, "metrics", "score", "--arm", "lora_ft") == 1, "not as many gold rows as expected"
    for arm in ("lora_ft", "teacher"):
        assert run(spark, root, "metrics", "score", "--arm", arm, "--expect-n", str(n - 1)) == 0
    m = cli._stats(f"{root}/results/metrics/lora_ft.json")
    assert list(m) == list(cli.files.METRICS_KEYS) and list(m["per_field"]) == list(schema.FIELDS) and m["per_field"]["title"]["f1"] == 1.0 and m["macro_f1_null_baseline"] < m["macro_f1"]
    assert run(spark, root, "metrics", "compare") == 0

    assert run(spark, root, "gpu", "bench") == 2 and run(spark, root, "bench", "teacher") == 2 and run(spark, root, "gpu", "train") == 2
    put_lines(f"{root}/samples", [{"arm": "lora_ft", "ms": float(x)} for x in (100, 110, 120)])
    put_lines(f"{root}/calls", [{"ok": i < 4, "ms": 500.0 + i, "input_tokens": 1000, "output_tokens": 300, "model": "gpt-4o-mini"} for i in range(5)])
    assert run(spark, root, "gpu", "bench", "--samples", f"{root}/samples") == 0
    assert run(spark, root, "gpu", "bench", "--samples", f"{root}/samples", "--batch-sizes", "0") == 1
    assert run(spark, root, "bench", "teacher", "--calls", f"{root}/calls") == 0
    cli._put(f"{root}/results/bench/lora_ft_sweep.json", {"sweep": [{"batch_size": b, "throughput_docs_per_s": 8.0 * b, "amortized_ms_per_doc": 125.0 / b, "oom": b == 4} for b in (1, 2, 4)]})
    with open(f"{root}/template.md", "w", encoding="utf-8") as f:
        f.write("p50 of {{ lora_ft__p50_ms }} ms, {{ lora_ft__macro_f1 }} macro-F1\n")
    assert run(spark, root, "report", "build", "--template", f"{root}/template.md") == 0
    with open(f"{root}/results/tables/README.md", encoding="utf-8") as f:
        assert f.read().startswith("p50 of 110 ms, ")
    with open(f"{root}/results/tables/headline.md", encoding="utf-8") as f:
        lines = f.read().strip().split("\n")
    assert len(lines) == 2 + 6 and "null baseline" in lines[-1] and "| API | API |" in lines[-2] and "(bs 2)" in lines[4]
    with open(f"{root}/results/tables/sweep.md", encoding="utf-8") as f:
        text = f.read()
    assert text.count("OOM") == 1 and text.count("fastest") == 1
    with open(f"{root}/template.md", "a", encoding="utf-8") as f:
        f.write("and 99.7% of something\n")
    assert run(spark, root, "report", "build", "--template", f"{root}/template.md") == 1
    assert run(spark, root, "report", "build", "--template", f"{root}/template.md", "--no-strict") == 0


def test_schema_dump(capsys, tmp_path):
    assert cli.main(["schema", "dump"]) == 0
    assert json.loads(capsys.readouterr().out)["required"] == list(schema.FIELDS)
    assert cli.main(["schema", "dump", "--out", str(tmp_path / "s.json")]) == 0


def test_clock_and_eta():
    assert len(cli.utc_now()) == 20 and cli.utc_now().endswith("Z")
    assert [cli.eta(x) for x in (None, 0, 59, 61, 3600, 5401, float("inf"))] == ["--:--", "00:00", "00:01", "00:02", "01:00", "01:31", "--:--"]


def test_commands_are_complete():
    assert len(cli.COMMANDS) == 13
    with pytest.raises(SystemExit) as e:
        cli.main(["gold", "unheard-of"])
    assert e.value.code == 2


class Provider:
    """Answers into the cache; the first time it loses some rows of a batch and spoils others."""

    def __init__(self, root):
        self.root, self.flying, self.most, self.sent, self.states = root, {}, 0, {}, []
        self.open = []

    def ledger(self):
        return self.open

    def record(self, batch, state):
        self.states.append((batch["tag"], state))

    def submit(self, batch):
        self.flying[batch["tag"]] = batch
        self.most = max(self.most, len(self.flying))
        return batch["tag"]

    def harvest(self, at):
        batch = self.flying.pop(at)
        rows, lost = [], []
        for d in batch["doc_ids"]:
            n = self.sent[d] = self.sent.get(d, 0) + 1
            if n == 1 and d.endswith("0"):
                lost.append(d)
            else:
                rows.append({"doc_id": d, "raw_output": "not json" if n == 1 and d.endswith("1") else json.dumps(POSTING), "teacher_model": "gpt-4o-mini", "prompt_sha": cli.PROMPT_SHA, "error": None, "ok": True, "seq": len(self.states), "tokens_in": 1, "tokens_out": 1})
        path = f"{self.root}/labeled/_cache"
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{at}-{len(self.states)}.json", "w", encoding="utf-8") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        return lost


def test_labelling_by_waves(spark, root, tmp_path, monkeypatch):
    real = cli.label.batches
    monkeypatch.setattr(cli.label, "batches", lambda ids: real(ids, 16))
    monkeypatch.setattr(cli.waves, "MOST_INCOMPLETE", 99)
    monkeypatch.setattr(cli.waves.run_wave, "__defaults__", (4, 99))
    mine = str(tmp_path)
    assert run(spark, mine, "corpus", "build", "--source", f"{root}/raw", "--target-n", "100", "--least", "1", "--least-split", "0") == 0
    ids = sorted(r["doc_id"] for r in cli.files.read_jsonl(spark, f"{mine}/corpus/docs", cli.DOC).collect())
    provider = Provider(mine)
    provider.open = [{"tag": "old", "batch_id": "old", "doc_ids": ids[:10], "model": "gpt-4o-mini", "prompt_sha": "another"}]
    monkeypatch.setattr("test_cli.PROVIDER", provider, raising=False)
    assert run(spark, mine, "teacher", "label", "--split", "all", "--provider", "test_cli:PROVIDER") == 1, "an open batch of another prompt"
    provider.open[0]["prompt_sha"] = cli.PROMPT_SHA
    provider.flying["old"] = provider.open[0]
    run(spark, mine, "teacher", "label", "--split", "all", "--provider", "test_cli:PROVIDER")
    stats = cli._stats(f"{mine}/results/teacher_stats.json")
    assert stats["n_ok"] == len(ids) == 100 and provider.open[0]["harvested"]
    assert provider.most == 4 and not provider.flying
    assert {d: 2 if d[-1] in "01" else 1 for d in ids} == provider.sent
    assert [s for t, s in provider.states[:2]] == ["intent", "batch-0"] and any(t.startswith("retry") for t, _ in provider.states)
