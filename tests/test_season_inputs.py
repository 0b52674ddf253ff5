"""What a season's values are made of is computed once."""

import pytest

from driver import adapters as ad, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("build", [queries._ev, queries._refit])
def test_the_lines_of_a_season_are_joined_once(spark, monkeypatch, build):
    joined, season_points = [], ad.season_points
    monkeypatch.setattr(ad, "season_points", lambda s, d: joined.append(d) or season_points(s, d))
    monkeypatch.setattr(queries, "_history", lambda s, d: None)
    # the values stand for their calendar, the fit for its profiles
    monkeypatch.setattr(queries.ev, "team_calendar_ev", lambda calendars, history, profiles, actuals, day: calendars.join(actuals, ["team_slug", "planning_year", "race_id"], "left"))
    monkeypatch.setattr(queries.weight_fit, "fit_strength_weights", lambda values, profiles: profiles)
    monkeypatch.setattr(queries.weight_fit, "apply_fit", lambda profiles, fits: profiles)
    assert build(spark, DATA).where("actual_points IS NOT NULL").count() > 0
    assert joined == [DATA]


def test_calendars_that_are_valued_twice_are_labelled_once(spark, monkeypatch):
    plans = []

    def valued(calendars, history, profiles, actuals, day):
        plans.append(calendars._jdf.queryExecution().executedPlan().toString())
        return calendars

    monkeypatch.setattr(queries, "_history", lambda s, d: None)
    monkeypatch.setattr(queries.ev, "team_calendar_ev", valued)
    monkeypatch.setattr(queries.weight_fit, "fit_strength_weights", lambda values, profiles: profiles)
    monkeypatch.setattr(queries.weight_fit, "apply_fit", lambda profiles, fits: profiles)
    queries._refit(spark, DATA)
    assert len(plans) == 2 and not any("Window" in plan for plan in plans)
