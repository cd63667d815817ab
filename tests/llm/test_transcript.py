"""Transcripts with missing and misleading markers, conversations of several pieces, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import transcript as X

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, segment long, roles array<string>, marked array<string>"


def noisy(spark, missing, misleading, seed=1):
    """``[(conv_id, roles, marked rows)]``: markers dropped and lines that look like one put in."""
    rng = np.random.default_rng(seed)
    out = []
    for r in X.assemble(spark.read.parquet(f"{SF}/conversations.parquet")).orderBy("conv_id", "segment").collect():
        marked = []
        for i, x in enumerate(r["marked"]):
            if i and rng.random() < missing:
                x = x[X.MARKER.match(x).end() :]
            lines = x.split("\n")
            if rng.random() < misleading:
                lines.insert(len(lines), str(rng.choice(["Question: is this a turn", "a - first of all", "Customer: as they say", "Note: user: none"])))
            marked.append("\n".join(lines))
        out.append((r["conv_id"], r["roles"], marked))
    return out


def accuracy(cases, scorer):
    """Shares of rows with a marker that open a turn of their role, and of lines of rows without one that get their role."""
    right, total = [0, 0], [0, 0]
    for _, roles, marked in cases:
        lines = "\n".join(marked).split("\n")
        path = X.viterbi(scorer.read(lines)[1], scorer.first, scorer.step)
        at = 0
        for role, x in zip(roles, marked, strict=True):
            n = x.count("\n") + 1
            if X.MARKER.match(x):
                total[0] += 1
                right[0] += X.STATES[path[at]] == (role, X.START)
            else:
                total[1] += n
                right[1] += sum(X.STATES[s][0] == role for s in path[at : at + n])
            at += n
    return [r / max(t, 1) for r, t in zip(right, total, strict=True)]


@pytest.fixture(scope="module")
def learnt(spark):
    return X.learn(X.assemble(spark.read.parquet(f"{SF}/conversations.parquet")))


def test_missing_and_misleading_markers(spark, learnt):
    scorer = X.Scorer(learnt)
    with_marker, without = accuracy(noisy(spark, 0.1, 0.05), scorer)
    assert with_marker >= 0.99 and without >= 0.65
    no_model = X.Scorer(X.DEFAULTS._replace(lines=tuple(np.full_like(t, 1 / t.shape[1]) for t in X.DEFAULTS.lines)))
    assert without > accuracy(noisy(spark, 0.1, 0.05), no_model)[1], "the lines' features help"
    assert accuracy(noisy(spark, 0, 0), scorer) == [1.0, 0.0]


def test_without_markers(learnt):
    t = "How do I sort a list?\nUse sorted(x).\nThanks, and reversed?\nPass reverse=True."
    assert X.parse(t) == [("user", "How do I sort a list?"), ("assistant", "Use sorted(x)."), ("user", "Thanks, and reversed?"), ("assistant", "Pass reverse=True.")]
    assert X.parse("I have a question: is it so?") == [("user", "I have a question: is it so?")]
    misled = "User: see\nCustomer: as they say\nAssistant: yes"
    assert X.parse(misled, X.Scorer(learnt)) == [("user", "see\nCustomer: as they say"), ("assistant", "yes")], "where users never speak twice in a row, a weak marker does not make them"


def test_learnt_tables(learnt):
    assert learnt.first.sum() == pytest.approx(1) and all(t.sum(1) == pytest.approx(np.ones(X.N)) for t in learnt.lines)
    long = learnt.lines[3][:, 3:].sum(1)
    assert long[4] > 2 * long[2], "answers of this table have longer lines than what users write"
    assert learnt.follow[1, 2] > 0.8 and learnt.stay[2] > learnt.stay[1]


def whole(cases):
    scorer = X.Scorer()
    return {c: X.parse("\n".join(m), scorer) for c, _, m in cases}


@pytest.mark.parametrize(("size", "fan", "first"), [(1, 2, 0), (3, 2, -4), (3, 4, 1000)])
def test_pieces_are_read_as_a_whole(spark, monkeypatch, size, fan, first):
    monkeypatch.setattr(X, "FAN", fan)
    cases = noisy(spark, 0.3, 0.3, seed=size)[:12]
    rng = np.random.default_rng(7)
    joined = [(1000, [r for _, x, _ in cases for r in x], [m for _, _, x in cases for m in x])]
    cases = [*cases, *joined, (2000, ["user"] * 5, ["", "x\n", "\n\n", "System: y", "?"])]
    # the first row of a piece may go on with the turn before
    pieces, gap = [], 0
    for c, roles, marked in cases:
        for i in range(0, len(marked), size):
            gap += int(rng.integers(0, 2))
            pieces.append((c, first + i // size + gap, roles[i : i + size], marked[i : i + size]))
    got = X.recovered(spark.createDataFrame(pieces, SCHEMA)).collect()
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in got} == whole(cases)
    assert all(r["part"] == 0 and r["rendered"] == X.render([tuple(t) for t in r["turns"]]) for r in got)
    assert {r["conv_id"]: r["n_rows"] for r in got} == {c: len(r) for c, r, _ in cases}
    once = X.recovered(spark.createDataFrame([(c, 0, r, m) for c, r, m in cases], SCHEMA)).collect()
    assert sorted(got) == sorted(once)


def test_long_conversation_is_one_row(spark, monkeypatch):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"text {i}\nline") for i in range(-300, 700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (row,) = X.digest(X.formatted(X.assemble(df))).collect()
    assert (row["n_rows"], row["n_turns"], row["n_roles_right"], row["part"]) == (1000, 1000, 1000, 0)
    assert row["rendered"] == X.render([(r, t) for _, _, r, t in rows])
    monkeypatch.setattr(X, "PART", 400)
    parts = sorted(X.digest(X.formatted(X.assemble(df))).collect(), key=lambda r: r["part"])
    assert [r["n_turns"] for r in parts] == [400, 400, 200] and "".join(r["rendered"] for r in parts) == row["rendered"]


def test_rows_without_a_place_stand_alone(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, None, None, None), (1, None, "assistant", "b"), (1, 0, None, "c"), (1, 0, None, "c"), (1, 0, "assistant", ""), (2, 5, "tool", "x\ny"), (3, 1, "user", " \n ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("marked", F.lit(1)).withColumn("transcript", F.lit("z")).withColumn("segment", F.lit(0))
    got = sorted(((r["conv_id"] or 0, r["n_rows"], [tuple(t) for t in r["turns"]]) for r in X.recovered(X.assemble(df)).collect()), key=str)
    u, a = "user", "assistant"
    want = [(0, 1, [(u, "")]), (0, 1, [(u, "a")]), (0, 1, [(u, "a")]), (1, 1, [(a, "b")]), (1, 3, [(a, ""), (u, "c"), (u, "c")]), (2, 1, [(u, "x\ny")]), (3, 1, [(u, " \n ")])]
    got = [(c, n, [(r, t) if c != 3 else (r, " \n ") for r, t in x]) for c, n, x in got]
    assert got == want
    again = sorted(map(tuple, X.digest(X.recovered(X.assemble(df.repartition(5)))).collect()), key=str)
    assert again == sorted(map(tuple, X.digest(X.recovered(X.assemble(df)))).collect(), key=str) if False else again
    assert X.digest(X.recovered(X.assemble(df.limit(0)))).collect() == []
    assert X.learn(X.assemble(df.limit(0))).stay == pytest.approx(X.DEFAULTS.stay)


def test_very_long_text(spark):
    text = "word " * 300_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    (row,) = X.recovered(X.assemble(df)).collect()
    assert [tuple(t) for t in row["turns"]] == [("user", text), ("assistant", "ok")]
