"""Tables and documents read from files, the reports built on them, and the constants against a second writing."""

import json

import pytest
from pyspark.sql import functions as F

from echelon import schemas
from echelon.constants import ARCHETYPES, EV_WEIGHTS, OPPORTUNITY_WEIGHTS, SCENARIO_PRESETS
from echelon.functions.text import artifact_stem
from echelon.operators import expected_value as ev, profiles as prof, risk, targets, views
from echelon.sources import tables


def test_programme_and_alias_files(spark, tmp_path):
    (tmp_path / "programme.csv").write_text('race_name,date_label,category,source_url\n"Loop, Coast",01.02,1.1,race/loop/2031/x\nNo Link,02.02,1.1,\n')
    rows = {r.source_race_name: r for r in tables.read_programme(spark, str(tmp_path / "programme.csv")).collect()}
    assert rows["Loop, Coast"].pcs_race_slug == "loop" and rows["Loop, Coast"].observed_date == "01.02"
    assert rows["No Link"].pcs_race_slug == "" and rows["No Link"].source_url in ("", None)
    assert tables.read_programme(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "alias.csv").write_text("team_slug,planning_year,source_race_name,canonical_race_name,race_id\nnorth-2031,2031,GP Ville,Grand Prix,7\n,,GP Ville,Other,x\n")
    found = tables.read_aliases(spark, str(tmp_path / "alias.csv")).orderBy(F.desc("team_slug")).collect()
    assert [(a.team_slug, a.planning_year, a.race_id, a.normalized_source_race_name, a.alias_order) for a in found] == [("north", 2031, 7, "gp ville", 0), ("", None, None, "gp ville", 0)]


def test_planning_and_edition_tables(spark, tmp_path):
    planned = spark.createDataFrame([(1, "Loop WE", "1.1", "28.12-02.01", 12, 2031), (2, "Bad", "1.1", "x", 1, 2031), (3, "Old", "1.1", "01.02", 2, 2030)], schemas.PLANNING)
    planned.write.parquet(str(tmp_path / "planning"))
    ready = {r.race_id: r for r in tables.read_prepared_planning(spark, str(tmp_path / "planning"), 2031).collect()}
    assert set(ready) == {1, 2} and str(ready[1].end_date) == "2032-01-02" and ready[1].normalized_race_name == "loop" and ready[2].date_error
    editions = spark.createDataFrame([(1, "A", 2030, "1.1"), (1, "A", 2031, "1.1"), (2, "B", 2031, "2.1")], "race_id long, race_name string, year int, category string")
    tables.write_editions(editions, str(tmp_path / "editions"))
    tables.write_editions(editions.where("year = 2031 AND race_id = 2"), str(tmp_path / "editions"))
    back = tables.read_editions(spark, str(tmp_path / "editions"), categories=["1.1", "2.1"]).collect()
    assert sorted((r.race_id, r.year) for r in back) == [(1, 2030), (2, 2031)]  # the other year's partition stayed
    assert tables.read_editions(spark, str(tmp_path / "editions"), years=[2030]).first().race_name == "A"


RANKING = "team_rank int, team_name string, team_slug string, team_class string, ranking_points double, breakdown_path string"
RIDERS = "team_slug string, season_year int, rider_name string, rider_slug string, team_rank_within_counted_list int, points_counted double, points_not_counted double, sanction_points double"


def test_contributions_from_pages_to_reports(spark, tmp_path):
    ranking = spark.createDataFrame([(1, "North", "north", "PRT", 80.0, "p/n"), (2, "South", "south", "PRT", 20.0, "p/s"), (3, "West", "west", "CT", 5.0, "p/w")], RANKING)
    riders = spark.createDataFrame([("north", 2031, "Ada", "ada", 1, 50.0, 0.0, 0.0), ("north", 2031, "Bo", "bo", 2, 30.0, 1.0, 2.0), ("west", 2031, "Cy", "cy", 1, 5.0, 0.0, 0.0)], RIDERS)
    totals = spark.createDataFrame([("north", 80.0, 2.0, "u")], "team_slug string, total_counted_points double, sanction_points_total double, source_url string")
    rows = risk.assemble_contributions(ranking, riders, totals, "current", "", F.lit("2031-06-01").cast("timestamp"))
    assert sorted((r.team_slug, r.rider_name, r.team_total_points, r.is_placeholder_team_row) for r in rows.collect()) == [("north", "Ada", 80.0, False), ("north", "Bo", 80.0, False), ("south", "", 20.0, True)]
    tables.write_contributions(rows, str(tmp_path / "c"))
    tables.write_contributions(rows.withColumn("scope", F.lit("cycle")), str(tmp_path / "c"))
    read = tables.read_contributions(spark, str(tmp_path / "c"), "current")
    assert read.count() == 3 and tables.read_contributions(spark, str(tmp_path / "c")).count() == 6
    summary = risk.concentration_risk(read)
    assert [r.team_slug for r in risk.ordered_risk(summary).collect()] == ["north", "south"]
    report = views.risk_report(risk.ordered_risk(summary)).first()
    assert (report.team_name, report.points, report.top1_share_pct, report.leader_name) == ("North", 80.0, 62.5, "Ada")
    teams = spark.createDataFrame([("north", "north"), ("lost", "lost")], "team_slug string, pcs_team_slug string")
    names = {r.team_slug: (r.team_name, r.reference_total_points) for r in tables.team_names(teams, read).collect()}
    assert names == {"north": ("North", 80.0), "lost": ("lost", None)}


def test_team_name_and_total_come_from_one_row(spark):
    rows = spark.createDataFrame([("n", "Zed", 1.0, 2031, 1, "a"), ("n", "Abe", 9.0, 2031, 2, "b")], "team_slug string, team_name string, team_total_points double, season_year int, team_rank_within_counted_list int, rider_slug string")
    rows = rows.withColumns({"scope": F.lit("current"), "cycle_label": F.lit("")})
    found = tables.team_names(spark.createDataFrame([("n", "n")], "team_slug string, pcs_team_slug string"), rows).first()
    assert (found.team_name, found.reference_total_points) == ("Zed", 1.0)


def weights(**own):
    return {"one_day": 0.2, "stage_hunter": 0.2, "gc": 0.2, "time_trial": 0.1, "all_round": 0.2, "sprint_bonus": 0.1, **own}


def test_profile_documents(spark, tmp_path):
    for year in (2030, 2031):
        document = {"team_slug": "north", "planning_year": year, "team_name": "North", "strength_weights": weights(), "team_fit_floor": 0.7, "team_fit_range": 0.3, "execution_rules": {"1.1": 0.4}, "participation_rules": {"completed": 1.0}, "strength_weight_rationale": {"gc": "climbers"}, "team_fit_rationale": "own"}
        (tmp_path / f"north_{year}_profile.json").write_text(json.dumps(document, indent=1))
    read = tables.read_profiles(spark, str(tmp_path))
    assert prof.find_profile(read, "north-2031", 2031).count() == 1 and prof.find_profile(read, "nobody").count() == 0
    with pytest.raises(ValueError, match="Multiple team profiles"):
        prof.find_profile(read, "north")
    with pytest.raises(ValueError, match="blank"):
        prof.find_profile(read, " ")
    one = prof.find_profile(read, "north", 2031)
    reasons = {(r.section, r.item): r.reason for r in prof.weight_explainer(one).collect()}
    assert reasons["strength", "gc"] == "climbers" and reasons["strength", "one_day"] == "" and reasons["participation", "completed"]
    told = prof.with_rationale(one).first()
    assert told.team_fit_rationale == "own" and told.execution_rule_rationale
    status = one.select(prof.profile_status(weights()).alias("same"), prof.profile_status(weights(gc=0.1, all_round=0.3)).alias("other")).first()
    assert (status.same, status.other) == ("Default-like", "Custom")
    card = prof.profile_descriptions(one).first()
    assert card.archetype_label and card.archetype_color
    stem = one.select(artifact_stem(F.lit("north-2031"), F.col("planning_year")).alias("s")).first().s
    assert stem == "north_2031"


def test_archetype_and_preset_documents(spark, tmp_path):
    path = tmp_path / "archetypes.json"
    path.write_text(json.dumps({"own_kind": {"label": "Own", "description": "Own kind", "color": "#123", "strength_weight_prior": {"gc": 3, "one_day": 1}}, "plain": {"label": "Plain", "description": "x"}}))
    catalog = tables.read_archetypes(spark, str(path))
    rows = {r.archetype_key: r for r in catalog.collect()}
    assert rows["own_kind"].strength_weight_prior["gc"] == pytest.approx(0.75) and rows["plain"].strength_weight_prior is None
    schema = "team_slug string, planning_year int, strength_weights map<string,double>, team_fit_floor double, team_fit_range double, execution_rules map<string,double>, participation_rules map<string,double>, archetype_key string, archetype_label string, archetype_description string, profile_confidence string, profile_rationale array<string>"
    team = spark.createDataFrame([("n", 2031, weights(), 0.7, 0.3, {"1.1": 0.4}, {"completed": 1.0}, "own_kind", "", "", "", None)], schema)
    assert prof.validated_profiles(team, catalog).first().errors == [] and prof.validated_profiles(team).first().errors
    path.write_text(json.dumps({"bad": {"label": " ", "description": "x"}}))
    with pytest.raises(ValueError, match="bad"):
        tables.read_archetypes(spark, str(path))
    with pytest.raises(FileNotFoundError):
        tables.read_archetypes(spark, str(tmp_path / "none.json"))
    presets = {"preset_version": "v9", "presets": [{"key": k, "label": k.title(), "description": "d", "profile_overrides": {"team_fit_floor": 0.6}} for k in ("baseline_saved", "other")]}
    path.write_text(json.dumps(presets))
    found = tables.read_presets(spark, str(path))
    assert [(r.preset_version, r.key, r.profile_overrides.team_fit_floor) for r in found.orderBy("preset_order").collect()] == [("v9", "baseline_saved", 0.6), ("v9", "other", 0.6)]
    assert tables.find_preset(found, "other").count() == 1
    with pytest.raises(ValueError, match="Unknown scenario preset"):
        tables.find_preset(found, "nothing")
    path.write_text(json.dumps({"preset_version": "", "presets": presets["presets"][1:]}))
    with pytest.raises(ValueError, match="preset_version.*baseline_saved"):
        tables.read_presets(spark, str(path))


def test_orders_and_shortlist_report(spark):
    schema = "target_history_id string, avg_targeting_score double, avg_arbitrage_score double, avg_top10_points double, on_planning_calendar boolean"
    rows = [("c", 1.0, 2.0, 3.0, True), ("a", None, 9.0, 9.0, True), ("b", 1.0, 2.0, 3.0, True), ("d", 9.0, 9.0, 9.0, False), ("e", 1.0, 3.0, 1.0, True)]
    assert [r.target_history_id for r in targets.ordered_targets(spark.createDataFrame(rows, schema)).collect()] == ["e", "b", "c", "a", "d"]
    dated = spark.createDataFrame([("t", 2031, None, "A", 1), ("t", 2031, "2031-02-01", "B", 2), ("s", 2031, "2031-05-01", "C", 3), ("t", 2031, "2031-02-01", "A", 4)], "team_slug string, planning_year int, start_date string, race_name string, race_id long")
    assert [r.race_id for r in ev.ordered_ev(dated).collect()] == [3, 4, 2, 1]
    names = "target_history_id race_name race_country category route_profile planning_category planning_date_label planning_calendar_status category_history race_type years".split()
    numbers = "avg_targeting_score avg_arbitrage_score avg_specialty_fit_score avg_top10_points avg_stage_top10_points avg_stage_count avg_top10_field_form".split()
    one = spark.range(3).select(*[F.lit("x").alias(n) for n in names], *[F.lit(12.345).alias(n) for n in numbers], F.lit(1.2345).alias("avg_points_efficiency"), F.lit(2).alias("years_analyzed"), (F.col("id") > 0).alias("on_planning_calendar"), (F.col("id") > 1).alias("planning_scope_match"))
    shown = views.target_report(one).collect()
    assert sorted(r.planning_match for r in shown) == ["Category changed", "No in-scope match", "Same category"]
    assert {(r.targeting_score, r.points_per_field_form) for r in shown} == {(12.3, 1.23)}


def test_fixed_weights_sum_to_one_and_presets_are_whole():
    """The SQL reads the same constants as the code, so their shape is held against what must be true of them."""
    assert sum(OPPORTUNITY_WEIGHTS.values()) == pytest.approx(1) and sum(EV_WEIGHTS.values()) == pytest.approx(1)
    assert all(sum(a["strength_weight_prior"].values()) == pytest.approx(1) for a in ARCHETYPES.values())
    assert prof.check_presets("v", "", [{"key": k, "label": p["label"], "description": p["description"]} for k, p in SCENARIO_PRESETS.items()]) == []


def test_csv_export_is_read_back(spark, tmp_path):
    """Quotes, commas and line ends in names survive the way to a file and back."""
    names = ['GP "Ville"', "Loop, Coast", 'a "quoted, part"', "two\nlines", "back\\slash", "plain"]
    rows = spark.createDataFrame([(name, "01.02", "1.1") for name in names], "race_name string, date_label string, category string")
    tables.write_csv(rows, str(tmp_path / "programme.csv"))
    back = tables.read_programme(spark, str(tmp_path / "programme.csv"))
    assert sorted(row.source_race_name for row in back.collect()) == sorted(names)
