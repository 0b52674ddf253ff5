"""Expected values, scenarios, weight fit, risk, profiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echelon.constants import ARCHETYPES, EXECUTION_RULES, PARTICIPATION_RULES, PROFILE_AXES
from echelon.operators import expected_value as ev, history as hist, profiles as prof, risk, scenarios, views, weight_fit

PROFILE = (
    "team_slug string, planning_year int, team_name string, strength_weights map<string,double>, team_fit_floor double, team_fit_range double, execution_rules map<string,double>, "
    "participation_rules map<string,double>, archetype_key string, archetype_label string, archetype_description string, profile_confidence string, profile_version string, profile_rationale array<string>"
)


def profile(spark, weights, floor=0.7, reach=0.3, key="balanced_opportunist", label="", confidence="medium", team="t"):
    rows = [(team, 2026, "T", weights, floor, reach, EXECUTION_RULES, PARTICIPATION_RULES, key, label, "", confidence, "v1", ["because", " "])]
    return spark.createDataFrame(rows, PROFILE)


# Saved expected values: base points, six signals, category, status -> fit score, multiplier, participation, execution, points.
SAVED_WEIGHTS = {"one_day": 0.15868, "stage_hunter": 0.177026, "gc": 0.175731, "time_trial": 0.154787, "all_round": 0.16398, "sprint_bonus": 0.169796}
SAVED = [
    (702.4886220629145, (0.15, 0.49390222984562604, 0.5562758978244831, 0.0, 0.7804123711340206, 0.6684643065551449), "2.Pro", "completed", 0.4504650419556401, 0.835139512586692, 1.0, 0.25, 146.66900135682982),
    (310.9190445598454, (0.7707517488954345, 0.0, 0.0, 0.0, 0.3166660530191458, 0.48548278718703985), "1.UWT", "completed", 0.25666282222201764, 0.7769988466666052, 1.0, 0.18, 43.48507302534289),
    (216.40475298259153, (0.15, 0.3209777015437393, 0.31398153502562365, 0.0, 0.6731958762886598, 0.6823672437269014), "2.1", "scheduled", 0.36205357603473726, 0.8086160728104211, 0.95, 0.3, 49.87168302587334),
]


def test_saved_expected_values_are_reproduced(spark):
    signals = ", ".join(f"{a}_signal double" for a in PROFILE_AXES)
    rows = [("t", 2026, i, base, *s, category, status, "team_program_live", None) for i, (base, s, category, status, *_) in enumerate(SAVED)]
    races = spark.createDataFrame(rows, f"team_slug string, planning_year int, race_id long, base_opportunity_points double, {signals}, category string, status string, source string, overlap_group string")
    valued = ev.with_team_fit(ev.with_profiles(races, profile(spark, SAVED_WEIGHTS))).withColumns(
        {"participation_confidence": ev.participation_confidence(), "execution_multiplier": ev.execution_multiplier()}
    ).withColumn("expected_points", ev.expected_points())
    for row, (*_, score, multiplier, sure, execution, points) in zip(valued.orderBy("race_id").collect(), SAVED):
        got = (row.team_fit_score, row.team_fit_multiplier, row.participation_confidence, row.execution_multiplier, row.expected_points)
        assert got == pytest.approx((score, multiplier, sure, execution, points), abs=1e-9)


HISTORY = "race_id long, race_name string, year int, month int, category string, race_type string, top10_points double, winner_points double, points_per_top10_form double, stage_top10_points double, stage_count int, avg_top10_field_form double"
CALENDAR = "team_slug string, team_name string, planning_year int, race_id long, race_name string, category string, date_label string, month int, start_date date, end_date date, status string, team_calendar_status string, source string, pcs_race_slug string, notes string, overlap_group string"


@pytest.fixture(scope="module")
def season(spark):
    from datetime import date

    editions = spark.createDataFrame(
        [
            (11, "Classic", 2023, 2, "1.Pro", "One-day", 100.0, 40.0, 20.0, 0.0, 0, 5.0), (11, "Classic", 2025, 2, None, "One-day", 120.0, 40.0, 20.0, 0.0, 0, 5.0),
            (12, "Tour Chrono", 2025, 3, "2.1", "Stage race", 400.0, 90.0, 25.0, 250.0, 5, 9.0), (12, "Tour Chrono", 2026, 3, "2.1", "Stage race", 999.0, 90.0, 25.0, 250.0, 5, 9.0),
        ],
        HISTORY,
    )
    d = lambda m: date(2026, m, 1)
    calendar = spark.createDataFrame(
        [
            ("t", "T", 2026, 11, None, "1.Pro", "01.02", 2, d(2), d(2), "completed", "active", "team_program_live", "a", "", ""),
            ("t", "T", 2026, 12, "Tour", "2.1", "01.03", 3, d(3), d(3), "scheduled", "active", "calendar_seed", "b", "x |", "overlap_2"),
            ("t", "T", 2026, 50, "New", "1.UWT", "01.04", 4, d(4), d(4), "cancelled", "active", "startlist", "c", "", None),
        ],
        CALENDAR,
    )
    actuals = spark.createDataFrame([("t", 2026, 11, 12.0)], "team_slug string, planning_year int, race_id long, actual_points double")
    history = hist.history_summary(editions, 2026)
    values = ev.team_calendar_ev(calendar, history, profile(spark, ARCHETYPES["balanced_opportunist"]["strength_weight_prior"]), actuals, "2026-02-15").cache()
    return history, calendar, values


def test_season_values(spark, season):
    history, _, values = season
    summary = {r.race_id: r for r in history.collect()}
    assert summary[11].historical_years_analyzed == 2 and summary[11].latest_category == "1.Pro" and summary[11].avg_top10_points == 110.0
    assert summary[12].time_trial_signal == 1.0 and summary[12].avg_top10_points == 400.0 and summary[12].route_profile == "multi-stage race"
    rows = {r.race_id: r for r in values.collect()}
    assert len(rows) == 3 and rows[11].race_name == "Classic"
    assert rows[50].base_opportunity_points == pytest.approx(summary[11].base_opportunity_points)
    assert rows[50].notes == "history_fallback_from=1.Pro | history_missing" and rows[50].historical_years_analyzed is None
    assert (rows[11].participation_confidence, rows[12].participation_confidence, rows[50].participation_confidence) == (1.0, 0.7, 0.95)
    assert rows[11].ev_gap == pytest.approx(12.0 - rows[11].expected_points) and rows[12].ev_gap is None
    total = ev.ev_summary(values).first()
    assert (total.race_count, total.completed_race_count, total.remaining_race_count) == (3, 1, 1)
    assert total.total_expected_points == pytest.approx(sum(r.expected_points for r in rows.values()))
    assert total.actual_points_known == 12.0 and total.remaining_expected_points == pytest.approx(rows[12].expected_points)


def test_scenarios(spark, season):
    _, _, values = season
    own = profile(spark, ARCHETYPES["balanced_opportunist"]["strength_weight_prior"])
    overlay = scenarios.scenario_overlay(values, own).collect()
    assert len(overlay) == 9
    assert all(abs(r.expected_points_delta) < 1e-9 for r in overlay if r.scenario_key == "baseline_saved")
    assert {r.scenario_participation_confidence for r in overlay if r.scenario_key == "depth_constrained"} == {1.0, 0.55, 0.88}
    with pytest.raises(ValueError, match="team_fit_score"):
        scenarios.scenario_overlay(values.drop("team_fit_score"), own)
    box = spark.createDataFrame([(40.0, 1.0, 0.9, 0.95, 0.4, 13.6, 0.6)], "base_opportunity_points double, one_day_signal double, team_fit_multiplier double, participation_confidence double, execution_multiplier double, expected_points double, team_fit_score double")
    row = scenarios.sandbox(box.withColumn("participation_confidence", F.lit(1.0)), {"one_day": 1.0}, 0.7, 0.3).first()
    assert row.sandbox_team_fit_multiplier == pytest.approx(1.0) and row.expected_points_delta == pytest.approx(2.4)


def test_actual_points_rules(spark, season):
    _, calendar, _ = season
    pages = spark.createDataFrame(
        [("t", 2026, "a", 0.0, 0, False, None, "u"), ("t", 2026, "b", None, None, None, "RuntimeError", "u"), ("t", 2026, "c", 7.5, 3, True, None, "u")],
        "team_slug string, planning_year int, pcs_race_slug string, actual_points double, rider_count int, has_rows boolean, error string, source_url string",
    )
    rows = {r.race_id: (r.actual_points, r.rider_count, r.notes) for r in views.actual_points_rows(calendar, pages, F.lit("2026-02-15").cast("timestamp")).collect()}
    assert rows == {11: (0.0, 0, "points_page_empty_after_race"), 12: (None, None, "points_page_error=RuntimeError"), 50: (7.5, 3, "")}


def row_form_fit(exposure, actual, signals, current, prior, floor=0.7, reach=0.3):
    """The fit computed on race rows with plain numpy, step by step."""
    n, m = len(actual), reach * signals
    lam, con = 0.3 * max(1.0, 24 / n), 0.05 * max(1.0, 18 / n)
    target = np.clip(actual / exposure, floor, 1.0)
    r = np.sqrt(np.maximum(actual, 0) + 1)
    floors = np.array([0, 0, 0, 0.01, 0, 0])
    project = lambda w: weight_fit.project_to_simplex(w[None, :], floors)[0]
    start, prior = project(current), project(prior)
    mean = m.T @ r / r.sum()
    hessian = 2 / r.sum() * m.T @ (r[:, None] * m) + 0.7 * np.outer(mean, mean) + (2 * lam / 6 + 2 * con) * np.eye(6)
    step, w = 1 / np.linalg.eigvalsh(hessian).max(), start
    for _ in range(256):
        residual = floor + m @ w - target
        gradient = 2 / r.sum() * m.T @ (r * residual) + 0.7 * (r @ residual / r.sum()) * mean + 2 * lam / 6 * (w - prior) + 2 * con * w
        new = project(w - gradient * step)
        if np.abs(new - w).max() <= 1e-9:
            w = new
            break
        w = new
    return w


def test_weight_fit(spark):
    rng = np.random.default_rng(41)
    n = 30
    target = rng.dirichlet(np.full(6, 4.0))
    signals = np.round(rng.uniform(0, 1, (n, 6)), 3)
    exposure = np.round(rng.uniform(5, 200, n), 2)
    actual = np.round(exposure * np.clip(0.7 + 0.3 * signals @ target + rng.normal(0, 0.01, n), 0.7, 1), 4)
    schema = "team_slug string, planning_year int, race_id long, base_opportunity_points double, participation_confidence double, execution_multiplier double, actual_points double, " + ", ".join(f"{a}_signal double" for a in PROFILE_AXES)
    rows = [("t", 2026, i, float(exposure[i]), 1.0, 1.0, float(actual[i]), *map(float, signals[i])) for i in range(n)] + [("u", 2026, 1, 5.0, 1.0, 1.0, None, *[0.1] * 6)]
    df = spark.createDataFrame(rows, schema)
    current = dict(zip(PROFILE_AXES, map(float, np.round(rng.dirichlet(np.full(6, 9.0)), 4))))
    own = profile(spark, current, key="stage_hunter")
    fit = weight_fit.fit_strength_weights(df, own).collect()
    assert len(fit) == 1
    got = np.array([fit[0].strength_weights[a] for a in PROFILE_AXES])
    prior = np.array([ARCHETYPES["stage_hunter"]["strength_weight_prior"][a] for a in PROFILE_AXES])
    np.testing.assert_allclose(got, row_form_fit(exposure, actual, signals, np.array(list(current.values())), prior), atol=1e-6)
    assert got.sum() == pytest.approx(1.0, abs=1e-5) and got[3] >= 0.01
    assert fit[0].objective <= fit[0].baseline_objective if hasattr(fit[0], "baseline_objective") else fit[0].rmse <= fit[0].baseline_rmse
    assert [r.team_slug for r in weight_fit.unfitted_teams(df).collect()] == ["u"]
    updated = weight_fit.apply_fit(own, weight_fit.fit_strength_weights(df, own)).first()
    assert updated.profile_version == "v2_optimizer" and updated.weight_fit_summary.known_race_count == n


RISK = (
    "scope string, cycle_label string, team_rank int, team_name string, team_slug string, team_class string, ranking_total_points double, team_total_points double, sanction_points_total double, "
    "ranking_url string, source_url string, scraped_at string, season_year int, rider_name string, rider_slug string, points_counted double, points_not_counted double, sanction_points double, is_placeholder_team_row boolean"
)


def test_risk(spark):
    team = lambda slug, total, rider, points, year=2026, empty=False: ("current", "", 1, slug, slug, "PRT", total, total, 0.0, "", "", "", year, rider, rider.lower(), points, 0.0, 0.0, empty)
    rows = [team("a", 512.0, "Ada", 128.0), team("a", 512.0, "Bo", 96.0), team("a", 512.0, "Cy", 64.0), team("a", 512.0, "Di", 32.0)]
    rows += [team("c", 340.0, "Xi", 85.0), team("c", 340.0, "Xi", 51.0, 2027), team("c", 340.0, "Yu", 102.0), team("e", 90.0, "", 0.0, None, True)]
    rows += [("cycle", "2026-2028", *r[2:15], 10 * r[15], *r[16:]) for r in rows[:2]]
    df = spark.createDataFrame(rows, RISK)
    summary = {(r.scope, r.team_slug): r for r in risk.concentration_risk(df).collect()}
    a = summary["current", "a"]
    assert (a.top1_share, a.top3_share, a.top5_share) == pytest.approx((0.25, 0.5625, 0.625)) and a.risk_band == "Medium"
    assert (a.leader_shock_remaining_points, a.leader_coleader_shock_drop_points) == (384.0, 224.0)
    assert a.effective_contributors == pytest.approx(512**2 / (128**2 + 96**2 + 64**2 + 32**2))
    assert summary["current", "e"].counted_riders_found == 0 and summary["current", "e"].risk_band == "Lower" and summary["current", "e"].leader_name == ""
    cycle = summary["cycle", "a"]
    assert (cycle.counted_riders_found, cycle.leader_points) == (2, 1280.0)  # scopes don't mix
    assert {r.rider_name: r.team_rank_within_counted_list for r in risk.team_detail(df.where("scope = 'cycle'"), "a").collect()} == {"Ada": 1, "Bo": 2}
    detail = {r.rider_name: r for r in risk.team_detail(df, "c").collect()}
    assert detail["Xi"].points_counted == 136.0 and detail["Xi"].season_years == "2026, 2027" and detail["Xi"].share_pct == pytest.approx(40.0)
    assert detail["Yu"].cumulative_share_pct == pytest.approx(70.0) and detail["Yu"].team_rank_within_counted_list == 2
    assert risk.team_detail(df, "e").count() == 0
    bands = spark.createDataFrame([(0.35, 0.10, "High"), (0.24, 0.30, "High"), (0.25, 0.10, "Medium"), (0.10, 0.20, "Medium"), (0.10, 0.10, "Lower")], "a double, b double, w string")
    assert bands.where(risk.risk_band(F.col("a"), F.col("b")) != F.col("w")).count() == 0


def test_profiles(spark):
    good = ARCHETYPES["gc_development"]["strength_weight_prior"]
    fine = prof.validated_profiles(profile(spark, good, key="")).first()
    assert fine.errors == [] and fine.archetype_key == "gc_development" and fine.archetype_label == "GC Development Team" and fine.profile_rationale == ["because"]
    errors = lambda df: " ".join(prof.validated_profiles(df).first().errors)
    assert "sum to about 1.0" in errors(profile(spark, {**good, "gc": 0.9}))
    assert "Unknown archetype_key" in errors(profile(spark, good, key="nope"))
    assert "profile_confidence" in errors(profile(spark, good, confidence="certain"))
    assert "does not match" in errors(profile(spark, good, key="sprint_first", label="Wrong"))
    inferred = lambda weights: prof.with_inferred_archetype(profile(spark, weights)).first().inferred_archetype
    for key in ("balanced_opportunist", "gc_development", "sprint_first", "stage_hunter", "time_trial_edge"):
        assert inferred(ARCHETYPES[key]["strength_weight_prior"]) == key
    # One-day and sprint as the two leading axes are the opportunist, however far one-day leads.
    assert inferred(ARCHETYPES["classic_specialist"]["strength_weight_prior"]) == "classic_sprint_opportunist"
    assert inferred({"one_day": 0.5, "all_round": 0.3, "gc": 0.2}) == "classic_specialist"
    assert prof.check_presets("v", "", [{"key": "a", "label": "A", "description": "d"}]) == ["preset catalog must include baseline_saved."]
