"""Scores, route profiles, roll-up, planning overlay and calibration on small frames."""

import pytest
from pyspark.sql import functions as F

from echelon.operators import backtest, editions as ed, targets
from echelon.plans.season import calibrate

EDITION = (
    "race_id long, race_name string, race_country string, year int, month int, category string, race_type string, top10_points double, "
    "winner_points double, total_points double, avg_top10_field_form double, total_field_form double, finish_rate double, "
    "points_per_top10_form double, points_per_total_form double, startlist_size int"
)


def edition(race_id, name, year, points, winner, form, field, rate, efficiency, category="1.1", kind="One-day"):
    return (race_id, name, "X", year, 3, category, kind, points, winner, points * 1.2, form, field, rate, efficiency, efficiency / 10, 120)


def test_soft_field_outranks_hard_field(spark):
    df = spark.createDataFrame([edition(1, "Hard", 2025, 300.0, 125.0, 20.0, 180.0, 0.8, 1.5), edition(2, "Soft", 2025, 300.0, 125.0, 4.0, 40.0, 0.8, 7.5)], EDITION)
    rows = targets.ordered_editions(targets.score_editions(df)).collect()
    assert [r.race_name for r in rows] == ["Soft", "Hard"]
    assert rows[0].top10_points_pct == 50.0 and rows[0].points_efficiency_index == 75.0


def test_roll_up_history_and_overlay(spark):
    rows = [
        edition(1, "Stable", 2023, 100.0, 50.0, 4.0, 40.0, 0.8, 1.0), edition(1, "Stable", 2024, 120.0, 50.0, 4.0, 40.0, 0.8, 1.0),
        edition(2, "Promoted", 2023, 100.0, 50.0, 4.0, 40.0, 0.8, 1.0), edition(2, "Promoted", 2024, 100.0, 50.0, 4.0, 40.0, 0.8, 1.0, "1.Pro"),
        edition(3, "Dropped", 2024, 100.0, 50.0, 4.0, 40.0, 0.8, 1.0), edition(4, "Gone", 2024, 100.0, 50.0, 4.0, 40.0, 0.8, 1.0),
    ]
    df = spark.createDataFrame(rows, EDITION).withColumns({"arbitrage_score": F.when(F.col("year") == 2023, 80.0).otherwise(60.0), "points_efficiency_index": F.lit(1.0)})
    latest = {r.target_history_id: r for r in targets.roll_up_targets(df).collect()}
    assert latest["1::1.1"].avg_arbitrage_score == 70.0 and latest["1::1.1"].years == "2023, 2024"
    assert latest["1::1.1"].avg_stage_top10_points == 0.0
    assert latest["2::1.Pro"].category_history == "1.1 -> 1.Pro" and latest["2::1.Pro"].years_analyzed == 1
    assert "2::1.1" not in latest
    assert targets.roll_up_targets(df, latest_only=False).count() == 5
    planning = spark.createDataFrame(
        [(1, "Stable", "1.1", "01.03", 3, 2026), (2, "Promoted", "1.1", "02.03", 3, 2026), (3, "Dropped", "1.2", "03.03", 3, 2026)],
        "race_id long, race_name string, category string, date_label string, month int, year int",
    )
    status = {r.race_id: (r.planning_calendar_status, r.on_planning_calendar) for r in targets.overlay_planning(targets.roll_up_targets(df), planning, 2026).collect()}
    assert status == {
        1: ("On 2026 .1/.Pro calendar", True), 2: ("On 2026 .1/.Pro calendar (category changed to 1.1)", True),
        3: ("On 2026 calendar but out of scope (1.2)", False), 4: ("Not found on 2026 calendar", False),
    }


def test_route_profiles(spark):
    rows = [
        ("Chrono des Nations", "Individual Time Trial", "One-day", 0.0, "Time trial"), ("Tro-Bro Leon", "One-day race, France", "One-day", 0.0, "One-day classic"),
        ("Tour of Austria", "Stage race, Austria", "Stage race", 0.09, "GC-heavy stage race"), ("Tour of Britain", "Stage race", "Stage race", 0.15, "Balanced stage race"),
        ("Tour de Langkawi", "Stage race", "Stage race", 0.22, "Stage-hunter stage race"), ("Attila", None, "Stage race", None, "GC-heavy stage race"),
    ]
    df = spark.createDataFrame(rows, "race_name string, race_subtitle string, race_type string, stage_points_share double, wanted string")
    out = targets.with_route_profile(df).collect()
    assert all(r.route_profile == r.wanted for r in out)
    assert all(sum(r[c] for c in targets.REQUIREMENTS.values()) == pytest.approx(1.0) for r in out)


def test_balanced_cap_fills_from_other_years(spark):
    rows = [(i, f"r{i:02d}", 2020, 1) for i in range(10)] + [(20, "a", 2021, 1), (21, "b", 2022, 1)]
    df = spark.createDataFrame(rows, "race_id long, race_name string, year int, month int")
    out = ed.balanced_by_year(df, 6).collect()
    assert sorted(r.race_id for r in out) == [0, 1, 2, 3, 20, 21]


def test_calibration_prefers_field_aware_weights(spark):
    rows = []
    for year in (2021, 2022, 2023):
        rows += [edition(1, "Soft", year, 260.0, 125.0, 4.0, 40.0, 0.80, 6.5), edition(2, "Hard", year, 300.0, 125.0, 18.0, 200.0, 0.82, 1.7), edition(3, "Medium", year, 190.0, 80.0, 7.0, 70.0, 0.75, 3.0)]
    df = spark.createDataFrame(rows, EDITION)
    zero = dict.fromkeys(backtest.OPPORTUNITY_WEIGHTS, 0.0)
    points_only, field_aware = {**zero, "top10_points": 1.0}, {**zero, "field_softness": 0.5, "depth_softness": 0.5}
    result = calibrate(df, min_fold_size=3, candidates=[points_only, field_aware])
    assert result["eligible"] and result["fold_years"] == [2023]
    assert result["best"]["field_softness"] == 0.5 and result["best"]["spearman"] == pytest.approx(1.0)
    assert result["best"]["objective"] >= result["default"]["objective"]
    assert calibrate(df.where("year < 2023"), min_fold_size=3, candidates=[points_only])["eligible"] is False
    few = backtest.distinct_candidates([points_only, points_only, field_aware])
    assert len(few) == 2 and len(backtest.distinct_candidates(backtest.weight_candidates(20, 7))) == 27
