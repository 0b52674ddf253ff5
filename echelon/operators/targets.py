"""Category history, edition scores, the target roll-up and the planning overlay."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from echelon.constants import (
    ALL_ROUND_SHARE_CENTRE, ALL_ROUND_SHARE_WIDTH, GC_SHARE_LIMIT, OPPORTUNITY_SOURCES, OPPORTUNITY_WEIGHTS,
    ROUTE_LABELS, ROUTE_REASONS, SPECIALTY_WEIGHTS, STAGE_DEFAULTS, STAGE_HUNTER_SHARE_LIMIT, TARGET_CATEGORIES,
    TIME_TRIAL_PATTERN,
)
from echelon.functions.columns import (
    clip, known, last_known, normalised, number, ratio_or_zero, text, total, with_defaults, year_list,
)
from echelon.operators.editions import latest_per_race
from echelon.operators.ranking import percentile_scores
from echelon.operators.spread import skew_join

COMPONENT_SCORES = {name: f"{name}_pct" for name in OPPORTUNITY_WEIGHTS}
REQUIREMENTS = {name: f"{name}_requirement" for name in SPECIALTY_WEIGHTS}


def category_history(editions: DataFrame) -> DataFrame:
    """Per race: categories in first-seen order, number of changes and the latest category."""
    seen = editions.groupBy("race_id", "category").agg(
        F.min(F.struct("year", "month")).alias("first_seen"), F.max(F.struct("year", "month")).alias("last_seen")
    )
    named = F.trim(text(F.col("category")))
    real = (named != "") & (named != "nan")
    per_race = seen.groupBy("race_id").agg(
        F.array_sort(F.collect_list(F.when(real, F.struct("first_seen", named.alias("name"))))).alias("steps"),
        last_known(F.col("category"), F.struct("last_seen", "category")).alias("latest_known_category"),
    )
    # Names may meet after trimming, so they are made distinct once more.
    names = F.array_distinct(F.transform("steps", lambda s: s["name"]))
    return per_race.select(
        "race_id",
        F.array_join(names, " -> ").alias("category_history"),
        F.greatest(F.size(names) - 1, F.lit(0)).alias("category_change_count"),
        "latest_known_category",
    )


def with_category_history(editions: DataFrame) -> DataFrame:
    """Add the history columns and the `race_id::category` key of the roll-up; rows that carry them all stay as they are."""
    derived = ("target_history_id", "category_history", "category_change_count", "latest_known_category")
    if set(derived) <= set(editions.columns):
        return with_defaults(editions, {"month": 0, "category": "Unknown"})
    base = with_defaults(editions.drop(*derived), {"month": 0, "category": "Unknown"})
    keyed = base.withColumn("target_history_id", F.concat(F.col("race_id").cast("string"), F.lit("::"), text(F.col("category"))))
    return skew_join(keyed, category_history(base), ["race_id"])


def with_component_percentiles(editions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    scores = {COMPONENT_SCORES[name]: source for name, source in OPPORTUNITY_SOURCES.items()}
    return percentile_scores(editions, scores, ["race_id", "year"], keys)


def opportunity_score(weights: Mapping[str, float] | None = None) -> Column:
    active = normalised({**OPPORTUNITY_WEIGHTS, **(weights or {})})
    return total([F.col(COMPONENT_SCORES[name]) * F.lit(active[name]) for name in COMPONENT_SCORES])


def with_route_profile(editions: DataFrame) -> DataFrame:
    """Requirement shares per specialty, a route label and the reason for it."""
    have = set(editions.columns)
    words = lambda name: text(F.col(name)) if name in have else F.lit("")
    time_trial = F.lower(F.concat(words("race_name"), F.lit(" "), words("race_subtitle"))).rlike(TIME_TRIAL_PATTERN)
    share = clip(F.coalesce(number(F.col("stage_points_share")), F.lit(0.0))) if "stage_points_share" in have else F.lit(0.0)
    kind = words("race_type")
    one_day, staged = kind == "One-day", kind == "Stage race"
    as_share = lambda condition: condition.cast("double")

    balance = F.lit(1.0) - clip(F.abs(F.col("_share") - ALL_ROUND_SHARE_CENTRE) / F.lit(ALL_ROUND_SHARE_WIDTH))
    raw = {
        "one_day": as_share(F.col("_one_day") & ~F.col("_tt")),
        "gc": as_share(F.col("_staged")) * (F.lit(1.0) - F.col("_share")),
        "stage_hunter": as_share(F.col("_staged")) * F.col("_share"),
        "time_trial": as_share(F.col("_tt")),
        "all_round": as_share(F.col("_staged")) * balance,
    }
    marked = editions.withColumns({"_tt": time_trial, "_share": share, "_one_day": one_day, "_staged": staged})
    marked = marked.withColumns({f"_raw_{name}": value for name, value in raw.items()})
    marked = marked.withColumn("_sum", total([F.col(f"_raw_{name}") for name in raw]))
    # A race of known type always has a requirement, so the sum is 0 only for other types.
    requirements = {REQUIREMENTS[name]: ratio_or_zero(F.col(f"_raw_{name}"), F.col("_sum")) for name in raw}

    # The share rules outrank the keyword, which outranks the race type.
    def pick(values: Mapping[str, str]) -> Column:
        return (
            F.when(F.col("_staged") & (F.col("_share") >= STAGE_HUNTER_SHARE_LIMIT), values["stage_hunter"])
            .when(F.col("_staged") & (F.col("_share") <= GC_SHARE_LIMIT), values["gc"])
            .when(F.col("_tt"), values["time_trial"])
            .when(F.col("_one_day"), values["one_day"])
            .otherwise(values["balanced"])
        )

    labelled = marked.withColumns({**requirements, "route_profile": pick(ROUTE_LABELS), "profile_reason": pick(ROUTE_REASONS)})
    return labelled.drop("_tt", "_share", "_one_day", "_staged", "_sum", *[f"_raw_{name}" for name in raw])


def specialty_fit(weights: Mapping[str, float] | None = None) -> Column:
    active = normalised({**SPECIALTY_WEIGHTS, **(weights or {})})
    return total([F.col(REQUIREMENTS[name]) * F.lit(active[name]) * F.lit(100.0) for name in SPECIALTY_WEIGHTS])


def targeting_score(fit_emphasis: float) -> Column:
    emphasis = min(max(float(fit_emphasis), 0.0), 1.0)
    return F.lit(1.0 - emphasis) * F.col("arbitrage_score") + F.lit(emphasis) * F.col("specialty_fit_score")


def with_points_efficiency(editions: DataFrame) -> DataFrame:
    form = "top10_field_form" if "top10_field_form" in editions.columns else "avg_top10_field_form"
    return editions.withColumn("points_efficiency_index", ratio_or_zero(F.col("top10_points"), F.col(form)))


def score_editions(
    editions: DataFrame,
    weights: Mapping[str, float] | None = None,
    specialty_weights: Mapping[str, float] | None = None,
    fit_emphasis: float = 0.0,
) -> DataFrame:
    """Every edition with history, component percentiles, route profile and scores (unordered)."""
    scored = with_component_percentiles(with_category_history(editions)).withColumn("arbitrage_score", opportunity_score(weights))
    profiled = with_route_profile(scored).withColumn("specialty_fit_score", specialty_fit(specialty_weights))
    return with_points_efficiency(profiled.withColumn("targeting_score", targeting_score(fit_emphasis)))


def ordered_editions(scored: DataFrame) -> DataFrame:
    """Report order of scored editions; order only at the sink."""
    return scored.orderBy(
        *[F.desc_nulls_last(c) for c in ("targeting_score", "arbitrage_score", "top10_points", "winner_points")], "race_id", "year"
    )


_ROLL_UP_MEANS = {
    "avg_targeting_score": "targeting_score",
    "avg_arbitrage_score": "arbitrage_score",
    "avg_specialty_fit_score": "specialty_fit_score",
    "avg_top10_points": "top10_points",
    "avg_winner_points": "winner_points",
    "avg_total_points": "total_points",
    "avg_gc_top10_points": "gc_top10_points",
    "avg_stage_top10_points": "stage_top10_points",
    "avg_stage_total_points": "stage_total_points",
    "avg_stage_count": "stage_count",
    "avg_stage_points_share": "stage_points_share",
    "avg_top10_field_form": "avg_top10_field_form",
    "avg_total_field_form": "total_field_form",
    "avg_finish_rate": "finish_rate",
    "avg_points_efficiency": "points_efficiency_index",
    "avg_startlist_size": "startlist_size",
}


def roll_up_targets(scored: DataFrame, latest_only: bool = True) -> DataFrame:
    """One row per `race × category`: latest attributes, years, means and best edition."""
    prepared = with_defaults(with_category_history(scored), STAGE_DEFAULTS)
    if "targeting_score" not in prepared.columns:
        prepared = prepared.withColumn("targeting_score", F.col("arbitrage_score"))
    prepared = with_defaults(prepared, {"route_profile": "Unknown", "profile_reason": "", "specialty_fit_score": 50.0})
    prepared = with_defaults(prepared, {"race_country": None})
    order = F.struct("year", "month")
    latest = lambda c: last_known(F.col(c), order).alias(c)
    grouped = prepared.groupBy("target_history_id").agg(
        *[latest(c) for c in ("race_id", "race_name", "race_country", "category", "latest_known_category", "category_history")],
        F.max("category_change_count").alias("category_change_count"),
        *[latest(c) for c in ("race_type", "route_profile", "profile_reason")],
        F.count_distinct("year").alias("years_analyzed"),
        year_list(F.col("year")).alias("years"),
        F.max("arbitrage_score").alias("best_edition_score"),
        *[F.avg(source).alias(name) for name, source in _ROLL_UP_MEANS.items()],
    )
    return grouped.where(F.col("category") == F.col("latest_known_category")) if latest_only else grouped


def ordered_targets(targets: DataFrame) -> DataFrame:
    first = [F.desc_nulls_last("on_planning_calendar")] if "on_planning_calendar" in targets.columns else []
    scores = [F.desc_nulls_last(c) for c in ("avg_targeting_score", "avg_arbitrage_score", "avg_top10_points")]
    return targets.orderBy(*first, *scores, "target_history_id")


def overlay_planning(
    targets: DataFrame, planning: DataFrame, planning_year: int, in_scope: Sequence[str] = TARGET_CATEGORIES
) -> DataFrame:
    """Each target with its place on the planning calendar and a status text."""
    calendar = latest_per_race(planning).select(
        "race_id",
        F.col("race_name").alias("planning_race_name"),
        F.col("category").alias("planning_category"),
        F.col("date_label").alias("planning_date_label"),
        F.col("month").alias("planning_month"),
        F.col("year").alias("planning_year"),
    )
    merged = targets.join(calendar, ["race_id"], "left")
    planned = F.col("planning_category")
    scoped = known(planned.isin(*in_scope))
    same = known(F.col("category") == planned)
    here = f"On {planning_year} .1/.Pro calendar"
    status = (
        F.when(planned.isNull(), F.lit(f"Not found on {planning_year} calendar"))
        .when(scoped & same, F.lit(here))
        .when(scoped, F.concat(F.lit(f"{here} (category changed to "), planned, F.lit(")")))
        .otherwise(F.concat(F.lit(f"On {planning_year} calendar but out of scope ("), planned, F.lit(")")))
    )
    return merged.withColumns(
        {"on_planning_calendar": scoped, "planning_scope_match": same, "planning_calendar_status": status}
    )


def in_scope_targets(overlaid: DataFrame, planning_year: int) -> DataFrame:
    return overlaid.where(F.contains(F.col("planning_calendar_status"), F.lit(f"On {planning_year} .1/.Pro calendar")))


def top_targets(overlaid: DataFrame, limit: int = 15) -> DataFrame:
    return ordered_targets(overlaid).limit(limit)
