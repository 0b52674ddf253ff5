"""The season build: all teams in one plan, failures isolated."""

import pytest
from pyspark.sql import functions as F

from echelon.constants import ARCHETYPES
from echelon.operators import matching, team_calendar as cal
from echelon.plans.season import build_season, refit_season
from tests.test_calendar import NO_ALIAS, PLANNED
from tests.test_value import HISTORY, profile


def test_season_build_isolates_failures(spark):
    editions = spark.createDataFrame(
        [(1, "Alpha Classic", 2025, 2, "1.1", "One-day", 100.0, 40.0, 20.0, 0.0, 0, 5.0), (2, "Beta Tour", 2025, 3, "2.1", "Stage race", 400.0, 90.0, 25.0, 250.0, 5, 9.0)], HISTORY
    )
    planning = cal.prepare_planning(spark.createDataFrame([(1, "Alpha Classic", "1.1", "01.02", 2, 2026), (2, "Beta Tour", "2.1", "01.03-03.03", 3, 2026), (3, "Gamma", "1.1", "soon", 4, 2026)], PLANNED))
    aliases = matching.prepare_aliases(spark.createDataFrame([], NO_ALIAS))
    slugs = ["good", "bad", "lost", "none"]
    teams = spark.createDataFrame([(s, 2026, s.title()) for s in slugs], "team_slug string, planning_year int, team_name string")
    rows = [(s, s, 2026, "team_program_live", n, "2026-02-01", "x") for s in ("good", "bad", "none") for n in ("Alpha Classic ME", "Beta Tour")] + [("lost", "l", 2026, "team_program_live", "Unknown", "", "x")]
    programme = spark.createDataFrame(rows, "team_slug string, team_name string, planning_year int, source string, source_race_name string, observed_date string, pcs_race_slug string")
    weights = ARCHETYPES["gc_development"]["strength_weight_prior"]
    profiles = profile(spark, weights, key="", team="good").unionByName(profile(spark, weights, floor=2.0, key="", team="bad")).unionByName(profile(spark, weights, key="", team="lost"))
    points = spark.createDataFrame([("good", 2026, "x", 30.0, 4, True, None, "u")], "team_slug string, planning_year int, pcs_race_slug string, actual_points double, rider_count int, has_rows boolean, error string, source_url string")
    now = F.lit("2026-02-15").cast("timestamp")
    tables = build_season(teams, programme, planning, aliases, editions, profiles, points, None, 2026, "2026-02-15", now)
    outcome = {r.team_slug: (r.success, r.error) for r in tables["outcomes"].collect()}
    assert outcome["good"] == (True, "")
    assert outcome["bad"][1] == "team_fit_floor must be between 0 and 1."
    assert outcome["lost"][1] == "No team calendar rows were built for lost." and outcome["none"][1] == "No team profile."
    assert [(r.race_id, r.date_error) for r in tables["planning_errors"].collect()] == [(3, "Unsupported planning date label: soon")]
    with pytest.raises(ValueError, match="no tracked team"):
        build_season(teams.where("false"), programme, planning, aliases, editions, profiles, points, None, 2026, "2026-02-15", now)
    values = tables["team_calendar_ev"]
    assert {(r.team_slug, r.race_id, r.status, r.actual_points) for r in values.collect()} == {("good", 1, "completed", 30.0), ("good", 2, "scheduled", 30.0)}
    assert tables["team_ev_metadata"].first().artifact_row_count == 2
    refit = refit_season(values, tables["team_calendar"], editions, profiles.where("team_slug = 'good'").withColumn("archetype_key", F.lit("gc_development")), tables["team_actual_points"], 2026, "2026-02-15")
    assert refit["fits"].first().known_race_count == 2 and refit["team_calendar_ev"].count() == 2
