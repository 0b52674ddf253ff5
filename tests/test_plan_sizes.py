"""Plans that stay small: the driver holds the stages, tasks and metrics of a whole plan at once."""

import re

from pyspark.sql import functions as F

from echelon.operators import matching, spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_values_do_not_multiply_what_is_read(spark):
    placed = spread.arrange(spark.range(40).select((F.col("id") % 3).alias("k"), "id"), ["k"], [F.col("id")])
    for name in "abc":
        placed = placed.running(name, "sum", F.lit(1))
    placed = placed.whole("d", "sum", F.lit(1))
    # the rows, and what each of four steps takes from other slices
    assert plan(placed.df).count("Scan ExistingRDD") == 5
    rows = placed.done().orderBy("k", "id").collect()
    assert [(r["k"], r["a"], r["b"], r["c"], r["d"]) for r in rows] == [(k, i, i, i, size) for k, size in enumerate((14, 13, 13)) for i in range(1, size + 1)]


def test_no_plan_holds_all_matchers(spark, monkeypatch):
    joins, write = [], spread.checkpointed

    def watched(df):
        joins.append(plan(df).count("Join "))
        return write(df)

    monkeypatch.setattr(spread, "checkpointed", watched)
    monkeypatch.setattr(matching, "checkpointed", watched)
    programme = spark.createDataFrame([("a", 2024, "Tour of X", "2024-05-01"), ("a", 2024, "Tour of the Big X", "2024-05-01")], "team_slug string, planning_year int, source_race_name string, observed_date string")
    planning = spark.createDataFrame([(1, 2024, "Tour of X", "tour of x", "2024-05-01")], "race_id long, planning_year int, race_name string, normalized_race_name string, day string")
    planning = planning.select("*", F.col("day").cast("date").alias("start_date"), F.col("day").cast("date").alias("end_date"))
    aliases = matching.prepare_aliases(spark.createDataFrame([("Sponsor", 7)], "source_race_name string, race_id long"))
    found = matching.match_programme(programme, planning, aliases)
    assert sorted((r["source_race_name"], r["matched_race_id"]) for r in found.collect()) == [("Tour of X", 1), ("Tour of the Big X", 1)]
    assert max(joins) <= 8, joins


def test_what_earlier_slices_contribute_is_found_by_the_slice_alone(spark):
    rows = [(None if i % 2 else "a", i) for i in range(60)]
    placed = spread.arrange(spark.createDataFrame(rows, "k string, i int"), ["k"], [F.col("i")]).running("s", "sum", F.col("i"))
    assert re.search(r"BroadcastHashJoin \[_slice#\d+\], \[_r__slice#\d+\]", plan(placed.df))
    found = {r["i"]: r["s"] for r in placed.done().collect()}
    assert found == {i: sum(range(i % 2, i + 1, 2)) for i in range(60)}
