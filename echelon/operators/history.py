"""Historical summary per race: means, signals, base opportunity, category baselines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from echelon.constants import (
    CATEGORY_HISTORY_FALLBACK, EV_WEIGHTS, HISTORY_MEASURES, HISTORY_TIME_TRIAL_WORDS,
)
from echelon.functions.columns import blank, clip, first_known, last_known, number, text, total
from echelon.operators.ranking import minmax_columns
from echelon.operators.spread import checkpointed, few

_MEANS = {
    "avg_top10_points": "top10_points",
    "avg_winner_points": "winner_points",
    "avg_points_efficiency": "points_per_top10_form",
    "avg_stage_top10_points": "stage_top10_points",
    "avg_stage_count": "stage_count",
    "avg_top10_field_form": "avg_top10_field_form",
}


def average_history(editions: DataFrame, planning_year: int) -> DataFrame:
    """Means over the editions before `planning_year`, per race id and name."""
    prior = editions.where(F.col("year") < planning_year)
    order = F.struct("year", "month") if "month" in editions.columns else F.struct("year")
    return prior.groupBy("race_id", "race_name").agg(
        F.count_distinct("year").alias("historical_years_analyzed"),
        last_known(F.col("category"), order).alias("latest_category"),
        last_known(F.col("race_type"), order).alias("race_type"),
        *[F.avg(number(F.col(source))).alias(name) for name, source in _MEANS.items()],
    )


def with_history_scales(averages: DataFrame) -> DataFrame:
    return minmax_columns(
        averages,
        {
            "field_softness_score": ("avg_top10_field_form", True),
            "stage_points_score": ("avg_stage_top10_points", False),
            "stage_count_score": ("avg_stage_count", False),
            "winner_points_score": ("avg_winner_points", False),
            "top10_points_score": ("avg_top10_points", False),
            "efficiency_score": ("avg_points_efficiency", False),
        },
    )


def with_signals(scaled: DataFrame) -> DataFrame:
    """Suitability signals in [0, 1] per race."""
    soft, stage_points, stage_count, winner = (
        F.col(c) for c in ("field_softness_score", "stage_points_score", "stage_count_score", "winner_points_score")
    )
    one_day = text(F.col("race_type")) == "One-day"
    staged = F.when(one_day, F.lit(0.0)).otherwise(F.lit(1.0))
    balance = clip(F.lit(1.0) - F.abs(soft - 0.5) * 2)
    lowered = F.lower(text(F.col("race_name")))
    timed = F.lit(False)
    for word in HISTORY_TIME_TRIAL_WORDS:
        timed = timed | F.contains(lowered, F.lit(word))
    return scaled.withColumns(
        {
            "one_day_signal": F.when(one_day, F.lit(0.35) + F.lit(0.65) * soft).otherwise(F.lit(0.15)),
            "stage_race_signal": staged,
            "gc_signal": clip(staged * (F.lit(0.5) * winner + F.lit(0.3) * stage_count + F.lit(0.2) * (F.lit(1.0) - soft))),
            "stage_hunter_signal": clip(staged * (F.lit(0.65) * stage_points + F.lit(0.35) * stage_count)),
            "all_round_signal": clip(F.lit(0.5) * staged + F.lit(0.5) * balance),
            "time_trial_signal": timed.cast("double"),
            "sprint_bonus_signal": clip(F.lit(0.75) * soft + F.lit(0.25) * stage_points),
        }
    )


def history_route(race_type: Column, softness: Column, stage_count: Column) -> Column:
    return (
        F.when(
            text(race_type) == "One-day",
            F.when(softness >= 0.5, F.lit("sprint-friendly one-day")).otherwise(F.lit("hard one-day")),
        )
        .when(F.coalesce(stage_count, F.lit(0.0)) >= 5, F.lit("multi-stage race"))
        .otherwise(F.lit("short stage race"))
    )


def with_base_opportunity(signalled: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted opportunity index, the points it stands for, and the route label."""
    scales = {
        "avg_points_efficiency": "efficiency_score",
        "avg_top10_points": "top10_points_score",
        "avg_winner_points": "winner_points_score",
        "avg_stage_top10_points": "stage_points_score",
        "field_softness_score": "field_softness_score",
    }
    active = weights or EV_WEIGHTS
    index = clip(total([F.lit(float(w)) * F.col(scales[name]) for name, w in active.items()]))
    return signalled.withColumn("base_opportunity_index", index).withColumns(
        {
            "base_opportunity_points": F.col("base_opportunity_index") * F.coalesce("avg_top10_points", F.lit(0.0)),
            "route_profile": history_route(F.col("race_type"), F.col("field_softness_score"), F.col("avg_stage_count")),
        }
    )


def history_summary(editions: DataFrame, planning_year: int, weights: Mapping[str, float] | None = None) -> DataFrame:
    """The scored history of every race before the planning year; built once for all teams.

    The averages (one row per race) are needed for the scale bounds and again for the scores, so
    the editions behind them are read once and the lineage is cut there.
    """
    averages = checkpointed(average_history(editions, planning_year))
    scored = with_base_opportunity(with_signals(with_history_scales(averages)), weights)
    return scored.drop("winner_points_score", "top10_points_score", "efficiency_score")


def one_history_per_race(history: DataFrame) -> DataFrame:
    """One row per race id: of renamed races the most analysed, later-named one is kept whole."""
    rows = F.struct(*[F.col(c) for c in history.columns if c != "race_id"])
    order = F.struct("historical_years_analyzed", "race_name")
    return history.groupBy("race_id").agg(F.max_by(rows, order).alias("r")).select("race_id", "r.*")


def category_baselines(history: DataFrame) -> DataFrame:
    """Mean measures per (latest category, race type), null keys kept, with the first route label."""
    route = F.when(~blank(F.col("route_profile")), F.trim("route_profile"))
    return history.groupBy("latest_category", "race_type").agg(
        *[F.avg(c).alias(c) for c in HISTORY_MEASURES],
        F.coalesce(first_known(route, F.struct("race_id", "race_name")), F.lit("")).alias("route_profile"),
    )


def fallback_category(category: Column) -> Column:
    mapped = text(category)
    for missing, substitute in CATEGORY_HISTORY_FALLBACK.items():
        mapped = F.when(text(category) == missing, F.lit(substitute)).otherwise(mapped)
    return mapped


def with_history_fallback(races: DataFrame, history: DataFrame) -> DataFrame:
    """Fill races without history from their category's baseline and note it.

    Only null values are filled. Notes are appended in the order: what was there,
    `history_fallback_from=…`, `history_missing`.
    """
    columns = ["race_type", "route_profile", *HISTORY_MEASURES]
    # A handful of (category, race type) pairs.
    baselines = category_baselines(history).select(
        F.col("latest_category").alias("_category"),
        F.col("race_type").alias("_type"),
        *[F.col(c).alias(f"_b_{c}") for c in columns if c != "race_type"],
        F.lit(True).alias("_found"),
    )
    missing = F.col("historical_years_analyzed").isNull()
    keyed = races.withColumns(
        {
            "_category": F.when(missing, fallback_category(F.col("category"))),
            "_type": F.when(
                missing, F.when(F.startswith(text(F.col("category")), F.lit("1.")), F.lit("One-day")).otherwise(F.lit("Stage race"))
            ),
        }
    )
    joined = keyed.join(few(baselines), ["_category", "_type"], "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"_b_{c}")) for c in columns if c != "race_type"}
    filled["race_type"] = F.coalesce(F.col("race_type"), F.when(F.col("_found"), F.col("_type")))
    trimmed = F.regexp_replace(text(F.col("notes")), r"^[ |]+|[ |]+$", "")
    parts = F.array(
        trimmed,
        F.when(F.col("_found"), F.concat(F.lit("history_fallback_from="), F.col("_category"))).otherwise(F.lit("")),
        F.lit("history_missing"),
    )
    filled["notes"] = F.when(missing, F.array_join(F.filter(parts, lambda p: p != ""), " | ")).otherwise(text(F.col("notes")))
    return joined.withColumns(filled).drop("_category", "_type", "_found", *[f"_b_{c}" for c in columns if c != "race_type"])
