"""What is done for each line item when lists are summarised."""

from pyspark.sql import functions as F

from driver import adapters as ad

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_sorted_by_numbers_and_values_only(spark, monkeypatch):
    monkeypatch.setattr(ad, "checkpointed", lambda df: df)
    found = plan(ad.list_summaries(spark, FOLDER))
    sorts = [line for line in found.splitlines() if "Sort [" in line]
    assert sorts and not any("l_orderkey" in line or "l_linenumber" in line for line in sorts)
    lists = {row["list"]: row["n"] for row in ad.list_summaries(spark, FOLDER).groupBy("list").agg(F.sum("rows").alias("n")).collect()}
    flags = {row["l_returnflag"]: row["count"] for row in ad.lines(spark, FOLDER).groupBy("l_returnflag").count().collect()}
    assert lists == {"start": sum(flags.values()), "gc": flags["N"], "stage": flags["A"]}


def test_percentages_are_rounded_without_decimal_text(spark):
    values = [0.07, 0.1, 0.125, 0.005, 0.015, 0.025, 0.035, -0.005, -0.015, -0.025, -0.07, 0.0, -0.0, 0.0049999999999999, 1.115, 0.29, 0.57, None]
    rows = spark.createDataFrame([(v,) for v in values + [i / 1000 for i in range(-400, 400)]], "x double")
    both = rows.select(F.round(F.col("x") * 100).cast("int").alias("old"), ad._percent("x").alias("new")).collect()
    assert [r["new"] for r in both] == [r["old"] for r in both]
    assert "round(" not in plan(ad.lines(spark, FOLDER))
