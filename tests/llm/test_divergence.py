"""Quality rules against plain Python on odd rows, and what they say of labelled rows."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import divergence as d
from millrace.llm import queries

SF = "/root/testdata/sf0.001"
WS = "\x20\x09-\x0d"


def jsd(p, q):
    out = 0.0
    for k in p.keys() | q.keys():
        a, b = p.get(k, 0) / max(1, sum(p.values())), q.get(k, 0) / max(1, sum(q.values()))
        out += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x) / 2
    return math.sqrt(max(out, 0))


def kind(c):
    return next((i for i, x in enumerate(("[a-z]", "[A-Z]", "[0-9]", "[#*$%&|<>]", "[!-~]")) if re.fullmatch(x, c)), 5)


def tokens(t):
    return re.findall("[a-z\x80-\U0010ffff]+", t.lower())


def plain(rows, common=d.COMMON):
    texts = [(i, g, t or "") for i, g, t in rows]
    chars, words = {}, {}
    for _, g, t in texts:
        chars.setdefault(g, Counter()).update(kind(c) for c in re.sub(f"[{WS}]", "", t))
        words.setdefault(g, Counter()).update(tokens(t))
    out = []
    for i, g, t in texts:
        w = re.findall(f"[^{WS}]+", t)
        spans = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = len({k + j for k in range(len(w) - 4) if spans[tuple(w[k : k + 5])] > 1 for j in range(5)})
        lines = [x for x in t.split("\n") if re.search(f"[^{WS}]", x)]
        body = re.sub(f"[{WS}]", "", t)
        total = sum(words[g].values())
        top = dict(sorted(((x, n) for x, n in words[g].items() if len(x.encode()) <= 64), key=lambda y: (-y[1], y[0].encode()))[:common])
        mine = tokens(t)
        fold = lambda c: Counter({x: n for x, n in c.items() if x in top}) + Counter({None: sum(n for x, n in c.items() if x not in top)})  # noqa: B023, E731
        dc = jsd(Counter(map(kind, body)), chars[g]) if total >= d.LEAST_REFERENCE and len(body) >= d.LEAST_CHARS else None
        dw = jsd(fold(Counter(mine)), fold(words[g])) if total >= d.LEAST_REFERENCE and len(mine) >= d.LEAST_TOKENS else None
        failed = len(w) < 10 or 100 * again > 20 * len(w)
        far = (dc or 0) ** 2 > d.FAR_CHARS or (dw or 0) ** 2 > d.FAR_WORDS + (d.NOISE / len(mine) if dw is not None else 0)
        out.append((i, len(w), len(body), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), again, failed, dc, dw, not failed and not far))
    return out


def agree(got, want):
    key = lambda r: tuple(map(str, r[:6]))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [(*r[:7], r[9]) for r in got] == [(*r[:7], r[9]) for r in want]
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a[7:9], b[7:9], strict=True):
            assert (x is None) == (y is None) and (x is None or abs(x * x - y * y) < 1e-9)


def test_plain_python_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    agree(d.judge(docs, d.references(docs)).collect(), plain([(r["doc_id"], r["lang"], r["text"]) for r in docs.collect()]))


@pytest.mark.parametrize("most", [2000, 0])
def test_odd_rows(spark, monkeypatch, most):
    monkeypatch.setattr(d, "LANGUAGES", most)  # 0: references are dealt with a salt
    prose = " ".join(f"the {x} of" for x in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split() * 40)
    rows = [(None, "a", prose), (None, None, None), (1, None, None), (2, "a", ""), (3, "a", " \n\t\x0b "), (4, "a", "one"), (4, "a", "one"), (5, None, prose), (6, "b", "über ärger " * 50), (7, "b", "x" * 5000)]
    rows += [(8, "a", "\n".join(["same line here", "", "  ", "same line here", "other"] * 3)), (9, "a", " ".join(str(i) for i in range(60_000))), (10, "a", "q " * 40_000), (11, "a", "## $$ %% ** " * 60), (12, "a", "a b c d e f a b c d e g h i j k"), (13, "a", "a b c d e")]
    rows += [(100 + i, "a", " ".join(prose.split()[i : i + 90 + i]) + f" {i}\x1c|") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    for c in ("classes", "word_chars", "tokens", "words", "slots", "n", "w", "__lang", "__salt", "kept"):
        df = df.withColumn(c, F.lit("x"))
    refs = d.references(df)
    assert refs.count() == 3
    agree(d.judge(df, refs).collect(), plain(rows))
    assert d.judge(df.limit(0), d.references(df.limit(0))).collect() == []


def test_labelled_rows(spark):
    """Clean documents stay; most of the others go."""
    sf = "/root/testdata/sf0.01"
    got = queries.op12_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    share = {r["quality"]: r["kept"] for r in got.collect()}
    assert share[1] >= 0.99 and share[0] <= 0.25


def test_no_python_and_no_copies_of_the_text(spark):
    plan = queries.op12_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct", plan)


def test_pieces_are_not_looked_at_one_by_one(spark):
    cases = ["", " ", "a", " a", "a ", " a b ", "  a  \n b", "\t\t"]
    df = spark.createDataFrame(list(enumerate(cases)), "i long, t string")
    assert {r["i"]: r["w"] for r in df.select("i", d._between(F.col("t"), d._SPACE).alias("w")).collect()} == {i: c.split() for i, c in enumerate(cases)}
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan(d._tokens(F.col("t")))
    words = spark.createDataFrame([], "w array<string>, c array<struct<word:string,n:bigint>>, s array<array<struct<word:string,i:int>>>, n bigint")
    assert "array_sort" not in words.select(d.word_distance(F.col("w"), F.col("c"), F.col("s"), F.col("n")))._jdf.queryExecution().optimizedPlan().toString(), "its comparator is interpreted for each comparison"


def test_windows_are_compared_by_generated_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = d.judge(docs, d.references(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"size\(array_distinct\(n#\d+\.windows\)", plan), "of a lambda function's variable, they are boxed one by one"
