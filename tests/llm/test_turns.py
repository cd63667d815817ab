"""Repaired conversations against a search through all edits, and the query against plain Python."""

import binascii
import hashlib
import re
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, turns

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def faults_of(rows):
    """``(role, text)`` in order to each row's first fault."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(BLANK)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def searched(rows):
    """``(cost, audit, repaired turns)`` by trying every sequence of edits with at most two inserts between rows."""
    faults = faults_of(rows)

    @cache
    def best(i, state):
        """The least (cost, audit, repaired) of what follows from row i on."""
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for inserts in ("", "u", "a", "ua", "au"):
            at, ok = state, True
            for r in inserts:
                ok = ok and r in {"": "su", "s": "u", "u": "a", "a": "u"}[at]
                at = r
            if not ok:
                continue
            put = tuple(f"{turns.ROLES[r]}:" for r in inserts)
            if i == len(rows):
                if inserts and at == "a":
                    ways.append((3 * len(inserts), "I" * len(inserts), put))
                continue
            role, text = rows[i]
            edits = [(4, "D", at, ())]
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                goes = {"": "su", "s": "u", "u": "a", "a": "u"}[at]
                if role[:1] and role[:1] in goes:
                    edits.append((more, "K", role[:1], (f"{role}:{text}",)))
                edits += [(3 + more, "R", r, (f"{turns.ROLES[r]}:{text}",)) for r in "ua" if r in goes]
            for cost, letter, to, line in edits:
                rest = best(i + 1, to)
                if rest:
                    ways.append((3 * len(inserts) + cost + rest[0], "I" * len(inserts) + letter + rest[1], put + line + rest[2]))
        return min(ways, default=None)

    return best(0, "")


def plain(conv, rows):
    """The query's row of one conversation, from its rows ``(turn, role, text)``."""
    after = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = binascii.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        after += [] if code == 0 else [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    pairs = [(r, t) for _, r, t in after]
    found = faults_of(pairs)
    cost, audit, lines = searched(tuple(pairs))
    known = [t for t, *_ in after if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:], strict=False))
    return (conv, gaps, *[found.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(spark, folder, rows):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in queries.op13_turns(spark, folder).collect()), key=lambda r: (r[0] is not None, str(r[0])))
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(rest)
    assert got == sorted((plain(c, r) for c, r in by.items()), key=lambda r: (r[0] is not None, str(r[0])))
    return got


def test_query_by_search(spark):
    got = check(spark, SF, [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()])
    assert any("I" in r[7] for r in got) and any("D" in r[7] for r in got)


@pytest.mark.parametrize("parts", ["3", "40"])
def test_odd_and_random_rows(spark, tmp_path, parts):
    rng = np.random.default_rng(int(parts))
    said = ["Yes.", "No!", "Well", "", " \t\n", None, "Who? \n", "ünï.", "x" * 300 + ".", "Hm\x1c", ".", "a" * 70_000 + "?"]
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (None, None, "user", "Hi."), (7, None, "tool", "Out."), (8, 5, "", "Odd."), (8, 2**40, "user", "Far.")]
    rows += [(9, 1, "user", "Same."), (9, 1, "user", "Same."), (9, 1, "assistant", "Other."), (10, 0, "system", "Only.")]
    for conv in range(100, 260):
        n = int(rng.integers(1, 11))
        for t in range(n):
            role = str(rng.choice(["user", "assistant", "system", "tool", "u2"], p=[0.4, 0.4, 0.1, 0.05, 0.05]))
            text = said[int(rng.integers(len(said)))] if rng.random() < 0.4 else f"Turn {t} of {conv}{rng.choice(['.', '!', '', '?'])}"
            rows.append((conv, None if rng.random() < 0.05 else int(rng.integers(0, 8)), role, text))
    # a conversation with a third of all rows, most of them equal or of one turn, lies over many ranges
    for k in range(len(rows) // 2):
        rows.append((50, k // 3 if k % 2 else 4, ["user", "assistant", "system"][k % 3], f"Hot {k % 17}{'.' if k % 5 else ''}"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("conv", "at", "part", "fault", "id", "same", "edits", "b", "c", "cost"):
        df = df.withColumn(c, F.lit("x"))
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        check(spark, str(tmp_path), rows)
        fixed = turns.repair(queries._damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet")))
        spread = fixed.rows.where("conv = 50").select("part").distinct().count()
        assert spread > int(parts) / 5, "the ranges of a large conversation are several"
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_turns(spark, str(tmp_path)).collect() == []
    fixed = turns.repair(spark.createDataFrame([("k", 1, "assistant", "Hello.")], "conv_id string, turn int, role string, text string"))
    assert [tuple(r) for r in fixed.turns.orderBy("at", "j").select("edit", "role", "text").collect()] == [("I", "user", ""), ("K", "assistant", "Hello.")]
    assert fixed.summary.first()["audit"] == "IK"


def test_all_rows_of_a_conversation_dropped(spark, tmp_path):
    conv = next(c for c in range(1000) if binascii.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(conv, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r[c] for c in COLUMNS) for r in queries.op13_turns(spark, str(tmp_path)).collect()] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
