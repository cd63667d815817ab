"""Every registered query with SQL gives the SQL's rows at the smallest scale; the others run."""

import re

import compare
import pytest

from millrace.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare.differ(df, sql, con) == ""


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 16


def test_whole_tables(spark):
    events, docs = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("events", "documents"))
    q, sql = catalog.queries(), catalog.oracle_sql()
    assert not [n for n in q if n.endswith("_all") and re.search(r"(event|doc)_id < \d", sql[n])]
    assert q["c4_c5_c7_c8_unit_costs_all"](spark, SF).count() == events
    assert q["a12_review_counts_all"](spark, SF).first()["candidates"] == docs


def test_leakage_uses_the_operator(spark, monkeypatch):
    from millrace.operators import gold

    q, sql = catalog.queries(), catalog.oracle_sql()
    assert "%" not in sql["jn10_agreement_all"].split("FROM gold g JOIN pred p")[1].split(")")[0]
    assert {r["by"] for r in q["jn5_x3_leakage_all"](spark, SF).collect()} == {"text"}, "copies stand in several splits, ids in one"
    real = gold.split_leaks
    monkeypatch.setattr(gold, "split_leaks", lambda *a: real(*a).limit(0))
    assert compare.differ(q["jn5_x3_leakage_all"](spark, SF), sql["jn5_x3_leakage_all"], compare.duck(SF)) != ""
