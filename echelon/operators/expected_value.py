"""Expected points of a team at a race: opportunity × fit × participation × execution."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from echelon.constants import (
    EV_COLUMNS, EXECUTION_DEFAULT, EXECUTION_RULES, HISTORY_MEASURES, PARTICIPATION_RULES, PROFILE_AXES,
    TEAM_FIT_FLOOR, TEAM_FIT_RANGE,
)
from echelon.functions.columns import blank, clip, known, map_literal, map_number, number, text, total
from echelon.functions.dates import as_of
from echelon.operators.history import one_history_per_race, with_history_fallback
from echelon.operators.spread import few, skew_join

PROFILE_COLUMNS = ("strength_weights", "team_fit_floor", "team_fit_range", "execution_rules", "participation_rules")
_SPECIALTIES = [axis for axis in PROFILE_AXES if axis != "sprint_bonus"]
TEAM_KEYS = ["team_slug", "planning_year"]


def _signal(df: DataFrame, axis: str) -> Column:
    name = f"{axis}_signal"
    return F.coalesce(number(F.col(name)), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def _or_one(value: Column) -> Column:
    return F.when(value == 0, F.lit(1.0)).otherwise(value)


def with_team_fit(races: DataFrame, prefix: str = "") -> DataFrame:
    """Specialty fit, sprint bonus, fit score and multiplier from the profile columns on each row.

    Result names start with `prefix`; the profile columns must be named as in PROFILE_COLUMNS.
    """
    weights = F.col("strength_weights")
    of = lambda axis: map_number(weights, axis, 0.0)
    every = F.aggregate(F.map_values(weights), F.lit(0.0), lambda acc, w: acc + w)
    sprint_share = of("sprint_bonus") / _or_one(every)
    specialty = total([of(a) * _signal(races, a) for a in _SPECIALTIES]) / _or_one(total([of(a) for a in _SPECIALTIES]))
    scored = races.withColumns(
        {
            f"{prefix}specialty_fit_score": clip(specialty),
            f"{prefix}sprint_fit_bonus": clip(sprint_share * _signal(races, "sprint_bonus")),
            "_sprint_share": sprint_share,
        }
    )
    score = clip((F.lit(1.0) - F.col("_sprint_share")) * F.col(f"{prefix}specialty_fit_score") + F.col(f"{prefix}sprint_fit_bonus"))
    scored = scored.withColumn(f"{prefix}team_fit_score", score).drop("_sprint_share")
    floor = F.coalesce("team_fit_floor", F.lit(TEAM_FIT_FLOOR))
    reach = F.coalesce("team_fit_range", F.lit(TEAM_FIT_RANGE))
    return scored.withColumn(f"{prefix}team_fit_multiplier", clip(floor + reach * F.col(f"{prefix}team_fit_score")))


def participation_confidence() -> Column:
    """How sure the start is; an overlapping race is capped. A null or empty overlap label means none."""
    rule = lambda key: map_number(F.col("participation_rules"), key, PARTICIPATION_RULES[key])
    source = text(F.col("source"))
    sure = (
        F.when(known(F.col("status") == "completed"), rule("completed"))
        .when(F.contains(source, F.lit("startlist")), rule("observed_startlist"))
        .when(F.contains(source, F.lit("program")), rule("program_confirmed"))
        .otherwise(rule("calendar_seed"))
    )
    return F.when(blank(F.col("overlap_group")), sure).otherwise(F.least(sure, rule("overlap_penalty")))


def execution_multiplier() -> Column:
    rules = F.coalesce(F.col("execution_rules"), map_literal(EXECUTION_RULES))
    return F.coalesce(F.element_at(rules, text(F.col("category"))), F.lit(EXECUTION_DEFAULT))


def expected_points(fit: str = "team_fit_multiplier", participation: str = "participation_confidence") -> Column:
    factor = lambda c, default: F.coalesce(number(F.col(c)), F.lit(default))
    return (
        factor("base_opportunity_points", 0.0) * factor(fit, 1.0) * factor(participation, 0.0) * factor("execution_multiplier", 0.0)
    )


def with_history(calendar: DataFrame, history: DataFrame) -> DataFrame:
    """Calendar races with their history; gaps come from category baselines. Row count is kept."""
    single = one_history_per_race(history).select(
        "race_id",
        F.col("race_name").alias("_history_name"),
        "historical_years_analyzed",
        "race_type",
        "route_profile",
        *HISTORY_MEASURES,
    )
    clashing = [c for c in single.columns if c != "race_id"]
    joined = skew_join(calendar.drop(*clashing), single, ["race_id"])
    named = joined.withColumn("race_name", F.coalesce("race_name", "_history_name")).drop("_history_name")
    return with_history_fallback(named, history)


def with_profiles(races: DataFrame, profiles: DataFrame) -> DataFrame:
    """Attach each team's profile columns (one profile row per team-season)."""
    return races.join(few(profiles.select(*TEAM_KEYS, *PROFILE_COLUMNS)), TEAM_KEYS, "left")


def attach_actuals(races: DataFrame, actuals: DataFrame | None) -> DataFrame:
    """Known points and the gap to the expectation; null where nothing is known."""
    base = races.drop("actual_points", "ev_gap")
    if actuals is None:
        joined = base.withColumn("actual_points", F.lit(None).cast("double"))
    else:
        results = actuals.select(*TEAM_KEYS, "race_id", number(F.col("actual_points")).alias("actual_points"))
        joined = base.join(results, [*TEAM_KEYS, "race_id"], "left")
    return joined.withColumn("ev_gap", F.col("actual_points") - F.col("expected_points"))


def team_calendar_ev(
    calendar: DataFrame, history: DataFrame, profiles: DataFrame, actuals: DataFrame | None, as_of_date: str | date
) -> DataFrame:
    """Expected value of every race of every team in one plan."""
    races = with_profiles(with_history(calendar, history), profiles)
    valued = with_team_fit(races).withColumns(
        {"participation_confidence": participation_confidence(), "execution_multiplier": execution_multiplier()}
    )
    valued = valued.withColumn("expected_points", expected_points())
    dated = attach_actuals(valued, actuals).withColumn("as_of_date", as_of(as_of_date))
    return dated.withColumns({c: F.lit(None).cast("string") for c in EV_COLUMNS if c not in dated.columns}).select(*EV_COLUMNS)


def ordered_ev(ev: DataFrame) -> DataFrame:
    return ev.orderBy(*TEAM_KEYS, F.asc_nulls_last("start_date"), "race_name", "race_id")


def ev_summary(ev: DataFrame) -> DataFrame:
    """Season totals of every team: cancelled races count in the total and in the race count only."""
    expected = F.coalesce(F.col("expected_points"), F.lit(0.0))
    done, ahead = known(F.col("status") == "completed"), known(F.col("status") == "scheduled")
    summed = lambda value: F.coalesce(F.sum(value), F.lit(0.0))
    return ev.groupBy(*TEAM_KEYS).agg(
        F.max("as_of_date").alias("as_of_date"),
        summed(expected).alias("total_expected_points"),
        summed(F.when(done, expected)).alias("completed_expected_points"),
        summed(F.when(ahead, expected)).alias("remaining_expected_points"),
        summed(F.col("actual_points")).alias("actual_points_known"),
        summed(F.col("ev_gap")).alias("ev_gap_known"),
        F.count(F.lit(1)).alias("race_count"),
        F.count_if(done).alias("completed_race_count"),
        F.count_if(ahead).alias("remaining_race_count"),
    )
