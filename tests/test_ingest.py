"""Ingest as a stream against the sequential rule: several files, restarts, crashes between write and commit; small files on a store."""

import json
import random
import threading

import pandas as pd
import pytest

from millrace.functions import text as cleaning
from millrace.sources import stores
from millrace.streaming import ingest


def pages(n, seed=1):
    rng = random.Random(seed)
    openings = ["".join(rng.choice("abcdef ") for _ in range(650)) for _ in range(12)]
    rows = []
    for seq in range(n):
        t = rng.choice(["", " \n ", "short", "x" * 50_000] + [None]) if rng.random() < 0.15 else rng.choice(openings) + f" &amp; tail {rng.randrange(5)}" if rng.random() < 0.7 else f"own {seq} " + rng.choice(openings)
        rows.append({"seq": seq, "source_key": rng.choice([None, f"k{rng.randrange(n // 3)}"]), "text": t})
    return rows


def plain(rows):
    import hashlib

    ids, prefixes, kept, n = set(), set(), [], dict.fromkeys(("kept", *ingest.REASONS), 0)
    for r in rows:
        if r["text"] is None or not r["text"].strip(cleaning.BLANK):
            continue
        t = cleaning.decode(r["text"]).strip()
        key = r["source_key"] if r["source_key"] is not None else hashlib.sha256(t.encode()).hexdigest()
        i, p = hashlib.sha256(f"pages\0{key}".encode()).hexdigest()[:10], t[:600]
        what = "short" if len(t) < 400 else "long" if len(t) > 40_000 else "duplicate_id" if i in ids else "duplicate_prefix" if p in prefixes else "kept"
        n[what] += 1
        if what == "kept":
            ids.add(i)
            prefixes.add(p)
            kept.append((r["seq"], f"jp_{i}", t))
    return kept, n


def put(folder, name, rows):
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def agree(spark, out, rows):
    kept, n = plain(rows)
    assert sorted((r["seq"], r["id"], r["text"]) for r in ingest.docs(spark, out).collect()) == kept
    assert {r["what"]: r["n"] for r in ingest.counters(spark, out).collect()} == n


def test_stream_is_the_batch_with_restarts_and_crashes(spark, tmp_path):
    src = tmp_path / "pages"
    src.mkdir()
    out, cp = f"file://{tmp_path}/out", f"{tmp_path}/checkpoint"
    rows = pages(240)
    assert ingest.docs(spark, out).count() == 0 and ingest.counters(spark, out).count() == 5
    put(src, "a.json", rows[:60])
    ingest.ingest_stream(spark, str(src), out, cp)
    agree(spark, out, rows[:60])
    def crash(batch_id):
        raise RuntimeError("crash between write and commit")

    put(src, "c.json", rows[60:190])
    with pytest.raises(Exception, match="crash"):
        ingest.ingest_stream(spark, str(src), out, cp, after_write=crash)
    ingest.ingest_stream(spark, str(src), out, cp)
    agree(spark, out, rows[:190])
    put(src, "d.json", rows[190:])
    with pytest.MonkeyPatch.context() as m:  # before the manifest is there, the batch is written again
        m.setattr(stores, "write_text", lambda *a: crash(0))
        with pytest.raises(Exception, match="crash"):
            ingest.ingest_stream(spark, str(src), out, cp)
    ingest.ingest_stream(spark, str(src), out, cp)
    agree(spark, out, rows)


def test_small_files_on_a_store(spark, tmp_path):
    base = f"file://{tmp_path}/s"
    assert stores.names(spark, base) == [] and not stores.exists(spark, f"{base}/x")
    stores.write_text(f"{base}/a/b.txt", "ä\nold")
    texts = [str(i) * 200_000 for i in range(4)]
    writers = [threading.Thread(target=stores.write_text, args=(f"{base}/a/b.txt", t, spark)) for t in texts]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert stores.read_text(f"{base}/a/b.txt") in texts and stores.names(spark, f"{base}/a") == ["b.txt"]


def test_claims_of_many_keys_share_a_bucket():
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    ends_in_zeros = [bytes([n]) * 12 + b"\0" * 4 for n in range(1, 6)]
    state = State()
    rows = lambda *events: pd.DataFrame([(0, 0, bytearray(d), k) for d, k in events], columns=["bucket", "salt", "digest", "kind"])
    ask = lambda *parts: [c for p in ingest._claimed((0, 0), iter(parts), state) for c in p["claimed"]]
    assert ask(rows((ends_in_zeros[0], "id"), (ends_in_zeros[0], "claim")), rows((ends_in_zeros[0], "prefix"), (ends_in_zeros[1], "claim"))) == [False] * 4, "claims count from the next micro-batch on"
    assert ask(rows(*[(d, "id") for d in ends_in_zeros]), rows((ends_in_zeros[2], "claim"), (ends_in_zeros[0], "claim"))) == [True, True, False, False, False, False, True]
    assert state.get == (b"".join(ends_in_zeros[:3]),)


def test_python_is_called_for_buckets_and_not_for_keys(spark):
    n = 2 * ingest.BUCKETS * ingest.SALTS
    pages = spark.range(n).selectExpr("id AS seq", "CAST(id AS STRING) AS source_key", "repeat(CAST(id AS STRING), 500) AS text")
    claims = spark.range(n).selectExpr("CAST(id AS STRING) AS id", "CAST(-id AS STRING) AS prefix")
    events = ingest._events(pages, claims, "s")
    assert events.count() > 4 * n
    assert events.select("bucket", "salt").distinct().count() <= ingest.BUCKETS * ingest.SALTS
