"""What a written step leaves on the disks, and how many rows the matchers get."""

import time

from pyspark.sql import functions as F

from driver import queries
from echelon.operators import backtest, matching, spread, team_calendar


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def left_behind(spark, before):
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return left


def test_a_written_step_leaves_no_shuffle_behind(spark):
    before = shuffle_files(spark)
    left, right = (spark.range(5000).groupBy((F.col("id") % k).alias("k")).count() for k in (100, 70))
    joined = left.join(spread.shuffled(right.withColumnRenamed("count", "other")), "k")
    kept = spread.checkpointed(joined)
    assert not left_behind(spark, before)
    # the frame that was written can still be run itself
    assert kept.count() == joined.count() == 70
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_a_spelling_on_a_date_is_matched_once_for_all_teams(spark, monkeypatch):
    """By shared words only where neither an exact name nor an alias for all teams has decided."""
    given, overlap = [], matching.overlap_matches

    def watched(names, planning):
        given.append(names.count())
        return overlap(names, planning)

    monkeypatch.setattr(matching, "overlap_matches", watched)
    names = [("Tour of X", "2024-05-01"), ("Big Lake X", "2024-05-01"), ("Sponsor", None), ("Nobody", "2024-05-01")]
    rows = [(f"t{team}", 2024, name, day) for team in range(30) for name, day in names] + [(None, 2024, *names[0]), ("t1", None, *names[2])]
    programme = spark.createDataFrame(rows, "team_slug string, planning_year int, source_race_name string, observed_date string")
    planning = spark.createDataFrame([(1, 2024, "Tour of X", "tour of x", "2024-05-01"), (2, 2024, "Lake Y", "lake y", "2024-05-01")], "race_id long, planning_year int, race_name string, normalized_race_name string, day string")
    planning = planning.select("*", F.col("day").cast("date").alias("start_date"), F.col("day").cast("date").alias("end_date"))
    aliases = matching.prepare_aliases(spark.createDataFrame([("", "Sponsor", 7), ("t3", "Sponsor", 5), ("t4", "Tour of X", 2)], "team_slug string, source_race_name string, race_id long"))
    found = matching.match_programme(programme, planning, aliases)
    assert found.columns == [*programme.columns, "matched_race_id", "matched_via", "canonical_race_name", "match_status"]
    got = {(r["team_slug"], r["planning_year"], r["source_race_name"]): (r["matched_race_id"], r["matched_via"], r["canonical_race_name"], r["match_status"]) for r in found.collect()}
    assert given == [2] and len(got) == 122 == found.count()
    for team in (f"t{i}" for i in range(30)):
        assert got[team, 2024, "Tour of X"] == ((2, "alias", "Lake Y", "matched") if team == "t4" else (1, "normalized_name", "Tour of X", "matched"))
        assert got[team, 2024, "Sponsor"] == (5 if team == "t3" else 7, "alias", "", "matched")
        assert got[team, 2024, "Nobody"] == (None, "", "", "unmatched")
    assert got[None, 2024, "Tour of X"] == got["t1", None, "Sponsor"] == (None, None, None, "unmatched")


def test_a_race_of_a_calendar_is_one_row_before_it_gets_the_planned_columns(spark, monkeypatch):
    planning = [(1, 2024, "Tour of X", "1.1", "01.05", 5, "tour of x"), (1, 2024, "Tour of X", "1.1", "01.05", 5, "tour of x x")]
    planning = spark.createDataFrame(planning, "race_id long, planning_year int, race_name string, category string, date_label string, month int, normalized_race_name string")
    planning = planning.withColumns({c: F.lit("2024-05-01").cast("date") for c in ("start_date", "end_date")})
    rows = [(f"t{team}", "T", 2024, "live", name, None) for team in range(5) for name in ("Tour of X", "Tour of X ME", "Sponsor X")]
    programme = spark.createDataFrame(rows, "team_slug string, team_name string, planning_year int, source string, source_race_name string, observed_date string")
    aliases = matching.prepare_aliases(spark.createDataFrame([("Sponsor X", 1)], "source_race_name string, race_id long"))
    kept, write = [], team_calendar.checkpointed

    def watched(df):
        out = write(df)
        kept.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(team_calendar, "checkpointed", watched)
    found = team_calendar.calendar_from_programme(programme, planning, aliases, "2024-06-01").collect()
    assert [count for columns, count in kept if "matched_race_id" in columns and "_name" not in columns] == [5]
    assert sorted((r["team_slug"], r["race_id"], r["observed_race_name"], r["race_name"]) for r in found) == [(f"t{i}", 1, "Sponsor X", "Tour of X") for i in range(5)]


def test_few_rows_are_sent_and_many_are_not(spark, monkeypatch):
    rows, teams = spark.range(40).withColumn("k", F.col("id") % 4), spark.range(4).withColumnRenamed("id", "k")
    plan = lambda: rows.join(spread.few(teams).select("k"), ["k"], "left_semi")
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in text(plan()) and "Exchange hash" not in text(plan())
    monkeypatch.setattr(spread, "MOST_SENT", 3)
    assert "SortMergeJoin" in text(plan()) and plan().count() == 40


def test_spellings_come_once_for_all_teams_to_matchers_that_know_none(spark, monkeypatch):
    rows = [(f"t{team}", 2024, name, None) for team in range(20) for name in ("Tour of X", "Lake Y")]
    programme = spark.createDataFrame(rows, "team_slug string, planning_year int, source_race_name string, observed_date string")
    planned = spark.createDataFrame([(1, "Tour of X", "1.1", "01.05", 5, 2024)], "race_id long, race_name string, category string, date_label string, month int, year int")
    monkeypatch.setattr(queries.ad, "programme", lambda s, d: programme)
    monkeypatch.setattr(queries.ad, "planned_races", lambda s, d: planned)
    names, _ = queries._programme_names(spark, "")
    assert sorted((r["source_race_name"], r["normalized_name"], r["observed_date"]) for r in names.collect()) == [("Lake Y", "lake y", ""), ("Tour of X", "tour of x", "")]
    assert queries._programme_names(spark, "", "team_slug")[0].count() == 40


def test_rows_of_all_candidates_are_on_the_disks_once(spark):
    """They are written in slices; neither the shuffle that dealt them nor those of the ranks of the outcome stay beside them."""
    scores = {name: (F.col("id") * (i + 3) % 17).cast("double") for i, name in enumerate(backtest.COMPONENT_SCORES.values())}
    folds = spark.range(200).select(
        (F.lit(2000) + F.col("id") % 3).cast("int").alias("test_year"), F.col("id").cast("string").alias("target_history_id"), F.lit(5).cast("long").alias("top_k"),
        F.lit(67).cast("long").alias("races_compared"), (F.col("id") * 7 % 31).cast("double").alias("actual_points_efficiency"), *[value.alias(name) for name, value in scores.items()],
    )
    candidates = backtest.distinct_candidates(backtest.weight_candidates(20))
    before = shuffle_files(spark)
    scored = backtest.scored_folds(folds, candidates)
    assert not left_behind(spark, before)
    assert backtest.fold_metrics(scored).count() == 3 * len(candidates)
