"""The row store source: two columns, filters where rows are read, and a cap that counts rows read."""

from pyspark.sql import functions as F

from millrace.sources import files, rowstore


def stored(spark, path, n=500):
    rows = spark.range(n).select("id", F.lit("other").alias("wide"), F.when(F.col("id") % 5 == 1, " ").when(F.col("id") % 5 == 2, F.lit(None)).otherwise(F.concat(F.repeat(F.lit("word "), F.lit(120)), "id")).alias("body"))
    rows.repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(path)
    return rows


def test_two_columns_and_a_cap_on_rows_read(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    stored(spark, path)
    got = files.remote_rows(spark, path, 203)
    assert sorted(int(r["source_key"]) for r in got.collect()) == [i for i in range(203) if i % 5 not in (1, 2)]
    scan = rowstore.read(spark, path, ["id", "body"], 203)
    assert scan.columns == ["id", "body"] and scan.count() == 203
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "wide" not in plan and "RelationV2[id" in plan.replace("\n", " ")
    assert files.remote_rows(spark, path).count() == 300 and files.remote_rows(spark, f"{tmp_path}/store", 0).count() == 0


def test_filters_and_fragments(spark, tmp_path):
    path = f"{tmp_path}/store"
    want = stored(spark, path)
    all_rows = rowstore.read(spark, path)
    assert all_rows.rdd.getNumPartitions() == 4
    conditions = {
        "id > 100 and id <= 260": [("id", ">", 100), ("id", "<=", 260)], "id in (3, 77, 499)": [("id", "in", [3, 77, 499])], "body is null": [("body", "null", None)],
        "body is not null and id < 9": [("body", "there", None), ("id", "<", 9)], "body = ' '": [("body", "=", " ")], "id >= 499": [("id", ">=", 499)],
    }
    for cond, where in conditions.items():
        expected = sorted(map(tuple, want.where(cond).collect()), key=str)
        assert sorted(map(tuple, rowstore.read(spark, path, where=where).collect()), key=str) == expected, cond
        assert sorted(map(tuple, all_rows.where(cond).collect()), key=str) == expected, "one table, many filters"
    # a cap counts what is read, not what a condition keeps, which may be on a column that is not asked for
    assert rowstore.read(spark, path, columns=["body"], limit=50, where=[("id", ">=", 40)]).count() == 10
    spark.range(0).write.parquet(f"{tmp_path}/none")
    assert rowstore.read(spark, f"{tmp_path}/none").count() == 0
