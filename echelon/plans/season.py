"""The batch jobs: season build for all tracked teams, weight refit, target shortlist, calibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from echelon.operators import backtest, targets
from echelon.operators.expected_value import ev_summary, team_calendar_ev
from echelon.operators.history import history_summary
from echelon.operators.profiles import run_metadata, validated_profiles
from echelon.operators.spread import checkpointed, few
from echelon.operators.team_calendar import calendar_from_programme, schedule_changes
from echelon.operators.views import actual_points_rows
from echelon.operators.weight_fit import apply_fit, fit_strength_weights, unfitted_teams

TEAM_KEYS = ["team_slug", "planning_year"]


def shortlist(
    editions: DataFrame,
    planning: DataFrame,
    planning_year: int,
    weights: Mapping[str, float] | None = None,
    specialty_weights: Mapping[str, float] | None = None,
    fit_emphasis: float = 0.0,
    limit: int | None = 15,
) -> DataFrame:
    """Best targets on the planning calendar as one lazy plan."""
    scored = targets.score_editions(editions, weights, specialty_weights, fit_emphasis)
    overlaid = targets.overlay_planning(targets.roll_up_targets(scored), planning, planning_year)
    scoped = targets.in_scope_targets(overlaid, planning_year)
    return targets.ordered_targets(scoped) if limit is None else targets.top_targets(scoped, limit)


def calibrate(
    editions: DataFrame,
    race_type: str = "One-day",
    iterations: int = 600,
    seed: int = 7,
    min_train_years: int = 2,
    min_fold_size: int = 8,
    candidates: Sequence[Mapping[str, float]] | None = None,
) -> dict[str, object]:
    """Calibrated weights: leaderboard, best and default evaluation, folds and the improvement.

    Without folds the result says so instead of failing. The first distinct candidate is the
    default when candidates are generated; a given list gets the default appended for comparison.
    """
    folds = backtest.walk_forward_folds(editions, race_type, min_train_years, min_fold_size)
    if folds.isEmpty():
        return {"eligible": False, "race_type": race_type, "message": "Not enough repeated race history for walk-forward calibration."}
    chosen = backtest.distinct_candidates(backtest.weight_candidates(iterations, seed) if candidates is None else candidates)
    everything = chosen if candidates is None else [*chosen, backtest.OPPORTUNITY_WEIGHTS]
    default_id = 0 if candidates is None else len(chosen)
    scored = backtest.scored_folds(folds, everything)
    # One row per (candidate, test year): small, and read by every result below.
    metrics = checkpointed(backtest.fold_metrics(scored))
    evaluated = backtest.with_candidate_weights(backtest.candidate_metrics(metrics), everything)
    ranked = evaluated.where(F.col("candidate_id") < len(chosen))
    best = backtest.best_candidate(ranked).first()
    default = evaluated.where(F.col("candidate_id") == default_id).first()
    sets = metrics.where(F.col("candidate_id").isin(best["candidate_id"], default_id))
    return {
        "eligible": True,
        "race_type": race_type,
        "fold_years": [r["test_year"] for r in folds.select("test_year").distinct().orderBy("test_year").collect()],
        "leaderboard": backtest.leaderboard(ranked),
        "best": best.asDict(),
        "default": default.asDict(),
        "improvement": best["objective"] - default["objective"],
        "weight_comparison": backtest.weight_comparison(evaluated.where(F.col("candidate_id").isin(best["candidate_id"], default_id)), default_id),
        "fold_comparison": sets.withColumn("weight_set", F.when(F.col("candidate_id") == default_id, "Default").otherwise("Calibrated")),
        "best_fold_details": backtest.fold_detail(scored, folds, best["candidate_id"]),
        "default_fold_details": backtest.fold_detail(scored, folds, default_id),
    }


def build_season(
    teams: DataFrame,
    programme: DataFrame,
    planning: DataFrame,
    aliases: DataFrame,
    editions: DataFrame,
    profiles: DataFrame,
    race_points: DataFrame | None,
    previous: DataFrame | None,
    planning_year: int,
    as_of_date: str | date,
    run_at: Column,
    saved_calendar: DataFrame | None = None,
    saved_actuals: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Calendars, changes, actual points, expected values, summaries, metadata and outcomes of all teams.

    One plan for all teams. Teams with rows in `saved_calendar` keep that calendar, and their names are not matched again;
    teams with rows in `saved_actuals` keep those points, and their points pages are not looked at. A team with an invalid profile or without a matched race appears in
    `outcomes` with its error and in no other table; the others are built all the same. Planning rows whose date
    label can't be read are listed in `planning_errors`. No tracked team at all is an error.
    """
    if teams.isEmpty():
        raise ValueError("there is no tracked team to build")
    checked = checkpointed(validated_profiles(profiles))
    sound = checked.where(F.size("errors") == 0).drop("errors")
    # a few rows per team, met by all rows of the programme in each of its readings
    tracked, sound_teams = few(teams.select(*TEAM_KEYS, F.col("team_name").alias("_name"))), few(sound.select(*TEAM_KEYS))
    listed = programme.join(tracked, TEAM_KEYS).withColumn("team_name", F.col("_name")).drop("_name")
    valid = listed.join(sound_teams, TEAM_KEYS, "left_semi")
    if saved_calendar is None:
        calendar = checkpointed(calendar_from_programme(valid, planning, aliases, as_of_date, run_at))
    else:
        saved = checkpointed(saved_calendar.join(sound_teams, TEAM_KEYS, "left_semi").join(tracked.drop("_name"), TEAM_KEYS, "left_semi"))
        unsaved = valid.join(few(saved.select(*TEAM_KEYS).distinct()), TEAM_KEYS, "left_anti")
        fresh = calendar_from_programme(unsaved, planning, aliases, as_of_date, run_at)
        calendar = checkpointed(fresh.unionByName(saved, allowMissingColumns=True))
    history = history_summary(editions, planning_year)
    actuals = None if race_points is None else actual_points_rows(calendar, race_points, run_at)
    if saved_actuals is not None:
        known_points = checkpointed(saved_actuals.join(few(calendar.select(*TEAM_KEYS).distinct()), TEAM_KEYS, "left_semi"))
        if actuals is None:
            actuals = known_points
        else:
            actuals = actuals.join(known_points.select(*TEAM_KEYS).distinct(), TEAM_KEYS, "left_anti").unionByName(known_points.select(*actuals.columns))
    values = checkpointed(team_calendar_ev(calendar, history, sound, actuals, as_of_date))
    summary = ev_summary(values)
    tables = {"team_calendar": calendar.drop("overlap_group_id"), "team_calendar_ev": values, "team_ev_summary": summary}
    tables["team_ev_metadata"] = run_metadata(sound, summary)
    if previous is not None:
        tables["schedule_changelog"] = schedule_changes(previous, calendar, run_at).drop("change_order")
    if actuals is not None:
        tables["team_actual_points"] = actuals
    tables["outcomes"] = outcomes(teams, checked, values)
    tables["planning_errors"] = planning_errors(planning)
    return tables


def planning_errors(planning: DataFrame) -> DataFrame:
    """Prepared planning rows whose dates are unknown, with the reason."""
    return planning.where(F.col("date_error").isNotNull()).select("race_id", "planning_year", "race_name", "date_label", "date_error")


def outcomes(teams: DataFrame, checked_profiles: DataFrame, values: DataFrame) -> DataFrame:
    """Success or the reason of failure per tracked team."""
    built = values.groupBy(*TEAM_KEYS).agg(F.count(F.lit(1)).alias("races"))
    joined = teams.select(*TEAM_KEYS).join(checked_profiles.select(*TEAM_KEYS, "errors"), TEAM_KEYS, "left").join(built, TEAM_KEYS, "left")
    error = (
        F.when(F.col("errors").isNull(), F.lit("No team profile."))
        .when(F.size("errors") > 0, F.array_join("errors", " "))
        .when(F.col("races").isNull(), F.concat(F.lit("No team calendar rows were built for "), "team_slug", F.lit(".")))
        .otherwise(F.lit(""))
    )
    return joined.select(*TEAM_KEYS, F.coalesce("races", F.lit(0)).alias("races"), error.alias("error")).withColumn("success", F.col("error") == "")


def refit_season(
    values: DataFrame, calendar: DataFrame, editions: DataFrame, profiles: DataFrame, actuals: DataFrame | None, planning_year: int, as_of_date: str | date
) -> dict[str, DataFrame]:
    """Fit weights from saved values, update the profiles and rebuild the values with them."""
    fits = checkpointed(fit_strength_weights(values, profiles))
    fitted = apply_fit(profiles, fits)
    rebuilt = team_calendar_ev(calendar, history_summary(editions, planning_year), fitted, actuals, as_of_date)
    return {"fits": fits, "profiles": fitted, "team_calendar_ev": rebuilt, "team_ev_summary": ev_summary(rebuilt), "failures": unfitted_teams(values)}
