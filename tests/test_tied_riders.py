"""Riders with equal points go by name, whatever the order in which their points were added."""

from echelon.operators import risk

ROW = "scope string, cycle_label string, team_rank long, team_name string, team_slug string, team_class string, team_total_points double, ranking_total_points double, sanction_points_total double, ranking_url string, source_url string, scraped_at string, season_year int, rider_name string, rider_slug string, points_counted double, points_not_counted double, sanction_points double"


def test_riders_with_the_same_points_are_ordered_by_name(spark):
    team = ("current", "", 1, "T", "t", "PRT", 1.2, 1.2, 0.0, "", "", "")
    # 0.1 + 0.2 + 0.3 is 0.6000000000000001 or 0.6, by the order of addition
    rows = [(*team, 2001, name, name, points, 0.0, 0.0) for name, points in (("Beta", 0.1 + 0.2 + 0.3), ("Alpha", 0.3 + 0.2 + 0.1))]
    contributions = spark.createDataFrame(rows, ROW)
    detail = {r["rider_name"]: r["team_rank_within_counted_list"] for r in risk.team_detail(contributions).collect()}
    assert detail == {"Alpha": 1, "Beta": 2}
    assert risk.concentration_risk(contributions).first()["leader_name"] == "Alpha"
