"""Report tables as text, from artefacts that are a handful of small JSON objects."""

from __future__ import annotations

from millrace import schema
from millrace.operators import report

API = "API"
LOW_SUPPORT = 30


def headline(tree: dict, metrics: dict, bench: dict, sweeps: dict) -> str:
    """A row for each arm and one for the floor. An API call's wall clock is no latency of a local model, so the teacher has none."""
    rows = []
    for arm in schema.ARMS:
        f = tree[arm]
        amortized = report.DASH if f["amortized_ms_per_doc"] is None else f"{report.show(f['amortized_ms_per_doc'], 'ms0')} (bs {f['best_batch_size']})"
        latency = [API, API] if arm == "teacher" else [report.show(f["p50_ms"], "ms0"), amortized]
        rows.append([f"`{arm}`", report.show(f["schema_valid_rate"], "pct1"), report.show(f["macro_f1"], "f3"), report.show(f["delta_vs_teacher"], "signed3"), *latency, report.show(f["cost_per_1k_docs_usd"], "usd5")])
    rows.append([report.NULL_BASELINE, report.DASH, report.show(tree["macro_f1_null_baseline"], "f3"), *[report.DASH] * 4])
    return report.pipe_table(["arm", "schema-valid %", "macro-F1", "Δ vs teacher", "p50 ms/doc (batch 1)", "amortized ms/doc @ best batch", "$/1k docs"], ["l", *"rrrrrr"], rows)


def per_field(tree: dict, metrics: dict, bench: dict, sweeps: dict) -> str:
    """Fields by arms, weakest first by the F1 of the tuned arm; support once."""
    present = [a for a in schema.ARMS if a in metrics]
    if not present:
        return "No metrics found.\n"
    by = next((a for a in ("lora_ft", "base_fewshot", *present) if a in metrics))
    of = lambda arm, f: metrics[arm]["per_field"].get(f, {})
    rows = []
    for f in sorted(schema.FIELDS, key=lambda f: (of(by, f).get("f1", 0.0), f)):
        support = of(present[0], f).get("support", 0)
        rows.append([f"`{f}`", str(support), "low-n" if support < LOW_SUPPORT else "", *[report.show(of(a, f).get(k), "f3") for a in present for k in ("em", "f1")]])
    return report.pipe_table(["field", "support", "note", *[f"{a} {k}" for a in present for k in ("em", "f1")]], ["l", "r", "l", *["r"] * (2 * len(present))], rows)


def sweep(tree: dict, metrics: dict, bench: dict, sweeps: dict) -> str:
    """Every batch size of each arm; rows out of memory are kept and marked, as is the fastest row."""
    rows = []
    hourly = tree["gpu_hourly_usd"]
    for arm in (a for a in schema.ARMS if a in sweeps):
        found = False
        for r in sweeps[arm].get("sweep", []):
            thr = r.get("throughput_docs_per_s")
            fastest = not found and not r.get("oom") and r.get("batch_size") == tree[arm]["best_batch_size"]
            found |= fastest
            usd = 1000.0 / thr / 3600.0 * hourly if thr and hourly is not None and not r.get("oom") else None
            cells = [report.show(thr, "num4"), report.show(r.get("amortized_ms_per_doc"), "ms0"), report.show(usd, "usd5"), report.show(r.get("peak_vram_gb"), "num2")]
            rows.append([f"`{arm}`", str(r.get("batch_size")), *cells, "OOM" if r.get("oom") else "**fastest**" if fastest else ""])
    if not rows:
        return "No batch sweeps found.\n"
    return report.pipe_table(["arm", "batch size", "throughput docs/s", "amortized ms/doc", "$/1k docs", "peak VRAM GB", ""], ["l", *"rrrrr", "l"], rows)


TABLES = {"headline": headline, "per_field": per_field, "sweep": sweep}
