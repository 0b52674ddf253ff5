"""Walk-forward evaluation of opportunity weights: folds, candidates, metrics, leaderboard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from echelon.constants import OBJECTIVE_WEIGHTS, OPPORTUNITY_SOURCES, OPPORTUNITY_WEIGHTS
from echelon.functions.columns import last_known, normalised, total, with_defaults, year_list
from echelon.operators.ranking import expanding_percentile_scores, rank_correlation
from echelon.operators.spread import Arranged, arrange, checkpointed, dealt_out
from echelon.operators.targets import COMPONENT_SCORES, with_category_history

_OUTCOMES = {
    "actual_points_efficiency": "points_per_top10_form",
    "actual_total_efficiency": "points_per_total_form",
    "actual_top10_points": "top10_points",
    "actual_winner_points": "winner_points",
    "actual_top10_field_form": "avg_top10_field_form",
    "actual_total_field_form": "total_field_form",
    "actual_finish_rate": "finish_rate",
}
_FOLD_METRICS = ("objective", "spearman", "top_k_precision", "top_k_value_capture")


def repeated_histories(editions: DataFrame, race_type: str = "One-day") -> DataFrame:
    """Editions of the race type whose `race × category` history covers at least two years."""
    rows = with_category_history(editions)
    if race_type != "All":
        rows = rows.where(F.col("race_type") == race_type)
    repeated = rows.groupBy("target_history_id").agg(F.count_distinct("year").alias("_years")).where("_years >= 2")
    return rows.join(repeated.select("target_history_id"), ["target_history_id"], "left_semi")


def training_rows(editions: DataFrame, years: Sequence[int], min_train_years: int = 2) -> DataFrame:
    """Each edition once per later test year that has enough earlier years, with its percentiles among those before that year.

    Nothing is ranked or shuffled per test year: the percentiles of all windows come as arrays, and the rows are only
    multiplied on their way into an aggregate.
    """
    test_years = [int(y) for y in sorted(years)[min_train_years:]] or [0]
    scores = {COMPONENT_SCORES[name]: source for name, source in OPPORTUNITY_SOURCES.items()}
    windows = expanding_percentile_scores(editions, scores, ["race_id", "year"], "year", test_years)
    joined = editions.join(windows.withColumnsRenamed({name: f"_{name}" for name in scores}), ["race_id", "year"])
    later = F.filter(F.transform(F.lit(test_years), lambda y, k: F.struct(y.alias("y"), k.alias("k"))), lambda one: one["y"] > F.col("year"))
    each = joined.withColumn("_at", F.explode(later)).withColumn("test_year", F.col("_at.y").cast("int"))
    return each.withColumns({name: F.get(f"_{name}", F.col("_at.k")) for name in scores}).drop("_at", *[f"_{name}" for name in scores])


def walk_forward_folds(editions: DataFrame, race_type: str = "One-day", min_train_years: int = 2, min_fold_size: int = 8) -> DataFrame:
    """One row per (test year, history): mean train percentiles next to the outcome of that year.

    Percentiles are those inside the train slice of each test year. The filtered editions feed the
    train slices, the outcomes and the year list, so their lineage is cut; so is that of the folds,
    which every evaluation starts from.
    """
    rows = checkpointed(repeated_histories(editions, race_type))
    years = [r["year"] for r in rows.select("year").distinct().collect()]  # one row per calendar year
    rows = with_defaults(rows, {"race_country": None})
    train = training_rows(rows, years, min_train_years)
    order = F.struct("year", "month", "race_name")
    latest = lambda c: last_known(F.col(c), order).alias(c)
    prediction = train.groupBy("test_year", "target_history_id").agg(
        *[latest(c) for c in ("race_id", "race_name", "category", "category_history")],
        F.max("category_change_count").alias("category_change_count"),
        *[latest(c) for c in ("latest_known_category", "race_type", "race_country")],
        F.count("year").alias("train_editions"),
        year_list(F.col("year")).alias("train_years"),
        *[F.avg(c).alias(c) for c in COMPONENT_SCORES.values()],
    )
    outcome = rows.groupBy(F.col("year").cast("int").alias("test_year"), "target_history_id").agg(
        *[F.avg(source).alias(name) for name, source in _OUTCOMES.items()]
    )
    folds = checkpointed(prediction.join(outcome, ["test_year", "target_history_id"]))
    # One row per test year, so the sizes are small whatever the data.
    sizes = folds.groupBy("test_year").agg(F.count(F.lit(1)).alias("races_compared")).where(F.col("races_compared") >= min_fold_size)
    top_k = F.greatest(F.lit(3), F.ceil(F.col("races_compared") * F.lit(0.20))).cast("long")
    return folds.join(F.broadcast(sizes), ["test_year"]).withColumn("top_k", top_k)


def weight_candidates(iterations: int = 600, seed: int = 7) -> list[dict[str, float]]:
    """Default, uniform, one focus per component and uniform draws from the simplex."""
    names = list(OPPORTUNITY_WEIGHTS)
    focused = [{n: 0.80 if n == focus else 0.05 for n in names} for focus in names]
    draws = np.random.default_rng(seed).dirichlet(np.ones(len(names)), size=iterations) if iterations else []
    return [OPPORTUNITY_WEIGHTS, dict.fromkeys(names, 1.0), *focused, *[dict(zip(names, map(float, d))) for d in draws]]


def distinct_candidates(candidates: Sequence[Mapping[str, float]]) -> list[dict[str, float]]:
    """Normalised candidates without repeats (equal to six decimals); the first of equals stays."""
    kept = {}
    for candidate in candidates:
        weights = normalised({**OPPORTUNITY_WEIGHTS, **candidate})
        kept.setdefault(tuple(round(w, 6) for w in weights.values()), weights)
    return list(kept.values())


def _candidate_literal(candidates: Sequence[Mapping[str, float]]) -> Column:
    return F.lit([[float(c[name]) for name in OPPORTUNITY_WEIGHTS] for c in candidates])


def predicted_score(weights: Column) -> Column:
    return total([F.col(column) * weights[i] for i, column in enumerate(COMPONENT_SCORES.values())])


def with_actual_ranks(folds: DataFrame) -> DataFrame:
    """Average and minimum rank of the outcome within the fold, and whether it is in the top k."""
    placed = arrange(folds, ["test_year"], [-F.col("actual_points_efficiency"), F.col("target_history_id")])
    return _ranked(placed, "actual")


def _ranked(placed: Arranged, name: str, years: DataFrame | None = None, kept: Mapping[str, Column] | None = None) -> DataFrame:
    """Ranks along the order; `years` brings columns of a test year and `kept` says what to keep of the order."""
    position = F.col("_position")
    placed = placed.running("_position", "sum", F.lit(1)).wholes({"_first": ("min", position), "_last": ("max", position)}, within=["_o0"])
    if years is not None:
        placed = Arranged(placed.df.join(years, ["test_year"]), placed.keys, placed.order)
    return placed.with_columns(
        {
            **(kept or {}),
            f"{name}_average_rank": (F.col("_first") + F.col("_last")) / F.lit(2.0),
            f"{name}_rank": F.col("_first"),
            f"{name}_top": F.col("_position") <= F.col("top_k"),
        }
    ).done("_position", "_first", "_last")


def scored_folds(folds: DataFrame, candidates: Sequence[Mapping[str, float]]) -> DataFrame:
    """Every race of every fold under every candidate with predicted and actual ranks.

    The candidates are a short literal list inside the plan. Outcome ranks do not depend on the candidate and are
    computed before the rows are multiplied; only what the metrics need is multiplied, and a row carries its score and history
    once, as its place in the order. What holds for a whole test year is joined from one row per year. `fold_detail` joins the
    rest back. The few bytes of a fold are dealt over all slices before they are multiplied: adaptive execution would leave them,
    and with them all rows of all candidates, to one task.
    """
    slim = folds.select("test_year", "target_history_id", "top_k", "actual_points_efficiency", *COMPONENT_SCORES.values())
    dealt = dealt_out(with_actual_ranks(slim).drop("top_k"), ["test_year", "actual_rank", "target_history_id"])
    each = dealt.select("*", F.posexplode(_candidate_literal(candidates)).alias("candidate_id", "_weights"))
    each = each.withColumn("_score", predicted_score(F.col("_weights"))).drop("_weights", *COMPONENT_SCORES.values())
    placed = arrange(each, ["candidate_id", "test_year"], [-F.col("_score"), F.col("target_history_id")], leave_out=["_score", "target_history_id"])
    years = F.broadcast(folds.groupBy("test_year").agg(F.max("races_compared").alias("races_compared"), F.max("top_k").alias("top_k")))
    return _ranked(placed, "predicted", years, {"predicted_score": -F.col("_o0"), "target_history_id": F.col("_o1")})


def fold_metrics(scored: DataFrame) -> DataFrame:
    """Rank correlation, top-k precision, value capture and objective per (candidate, test year)."""
    both = (F.col("predicted_top") & F.col("actual_top")).cast("int")
    value = F.col("actual_points_efficiency")
    summed = scored.groupBy("candidate_id", "test_year").agg(
        F.max("races_compared").alias("races_compared"),
        F.max("top_k").alias("top_k"),
        rank_correlation(F.col("predicted_average_rank"), F.col("actual_average_rank")).alias("spearman"),
        F.sum(both).alias("_both"),
        F.sum(F.when(F.col("predicted_top"), value)).alias("_captured"),
        F.sum(F.when(F.col("actual_top"), value)).alias("_available"),
    )
    weight = OBJECTIVE_WEIGHTS
    objective = (
        F.lit(weight["spearman"]) * ((F.col("spearman") + 1.0) / 2.0)
        + F.lit(weight["precision"]) * F.col("top_k_precision")
        + F.lit(weight["value_capture"]) * F.col("top_k_value_capture")
    )
    return summed.withColumns(
        {
            "top_k_precision": F.col("_both") / F.col("top_k"),
            "top_k_value_capture": F.coalesce(F.col("_captured") / F.nullif(F.col("_available"), F.lit(0.0)), F.lit(0.0)),
        }
    ).withColumn("objective", objective).drop("_both", "_captured", "_available")


def candidate_metrics(metrics: DataFrame) -> DataFrame:
    """Fold metrics averaged per candidate, weighted by fold size."""
    size = F.col("races_compared")
    return metrics.groupBy("candidate_id").agg(*[(F.sum(F.col(m) * size) / F.sum(size)).alias(m) for m in _FOLD_METRICS])


def with_candidate_weights(evaluated: DataFrame, candidates: Sequence[Mapping[str, float]]) -> DataFrame:
    chosen = F.element_at(_candidate_literal(candidates), F.col("candidate_id") + 1)
    return evaluated.withColumn("_weights", chosen).withColumns(
        {name: F.col("_weights")[i] for i, name in enumerate(OPPORTUNITY_WEIGHTS)}
    ).drop("_weights")


def _leading() -> list[Column]:
    # Rounded so that equal candidates tie exactly and the first one wins.
    return [F.round(c, 9).desc() for c in ("objective", "spearman", "top_k_value_capture")] + [F.col("candidate_id")]


def leaderboard(evaluated: DataFrame, limit: int = 20) -> DataFrame:
    return evaluated.orderBy(*_leading()).limit(limit)


def best_candidate(evaluated: DataFrame) -> DataFrame:
    """The candidate with the highest objective; the first of equals."""
    return evaluated.orderBy(F.round("objective", 9).desc(), "candidate_id").limit(1)


def weight_comparison(evaluated: DataFrame, default_id: int = 0) -> DataFrame:
    """The default and the best candidate side by side: metrics and weights, one row each."""
    default = evaluated.where(F.col("candidate_id") == default_id).withColumn("weight_set", F.lit("Default"))
    best = best_candidate(evaluated).withColumn("weight_set", F.lit("Calibrated"))
    return default.unionByName(best).select("weight_set", *_FOLD_METRICS, *OPPORTUNITY_WEIGHTS)


def fold_detail(scored: DataFrame, folds: DataFrame, candidate_id: int, test_year: int | None = None) -> DataFrame:
    """Races of the folds of one candidate with predicted and actual ranks."""
    rows = scored.where(F.col("candidate_id") == candidate_id)
    rows = rows if test_year is None else rows.where(F.col("test_year") == test_year)
    rows = rows.select("test_year", "target_history_id", "predicted_score", "predicted_rank", "actual_rank")
    return rows.join(folds, ["test_year", "target_history_id"]).select(
        "test_year", "target_history_id", "race_id", "race_name", "category", "category_history", "latest_known_category",
        "category_change_count", "race_country", "train_editions", "train_years", "predicted_score", "actual_points_efficiency",
        "actual_top10_points", "actual_top10_field_form", "predicted_rank", "actual_rank",
    )
