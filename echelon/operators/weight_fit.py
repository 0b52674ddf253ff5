"""Fit six strength weights per team from known results.

Spark reduces every team to a fixed number of sums (its sufficient statistics); the
projected-gradient solve then needs 6×6 numbers per team and runs on batches of teams. A
second aggregate gives the errors in points.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from echelon.constants import (
    ARCHETYPES, FIT_METHOD, FIT_PROFILE_VERSION, FIT_SETTINGS, PROFILE_AXES, TEAM_FIT_FLOOR, TEAM_FIT_RANGE,
)
from echelon.functions.columns import clip, map_number, number, require_columns
from echelon.operators.expected_value import TEAM_KEYS
from echelon.operators.profiles import archetype_table
from echelon.operators.spread import checkpointed, skew_join

_AXES = len(PROFILE_AXES)
_SIGNALS = [f"{axis}_signal" for axis in PROFILE_AXES]
_PAIRS = [(i, j) for i in range(_AXES) for j in range(i, _AXES)]
_NEEDED = ["base_opportunity_points", "participation_confidence", "execution_multiplier", "actual_points", *_SIGNALS]


def _weights_array(mapping: Column) -> Column:
    return F.array(*[map_number(mapping, axis, 0.0) for axis in PROFILE_AXES])


def profile_priors(profiles: DataFrame) -> DataFrame:
    """Current weights, fit bounds and prior of each team: its archetype's prior, else its current weights."""
    # The archetype catalog has a fixed handful of rows.
    catalog = F.broadcast(archetype_table(profiles.sparkSession).select("archetype_key", "strength_weight_prior"))
    keyed = profiles.join(catalog, ["archetype_key"], "left")
    prior = F.coalesce("strength_weight_prior", "strength_weights")
    source = F.when(F.col("strength_weight_prior").isNotNull(), F.concat(F.lit("archetype:"), F.col("archetype_key"))).otherwise(
        F.lit("current_profile")
    )
    return keyed.select(
        *TEAM_KEYS,
        _weights_array(F.col("strength_weights")).alias("current_weights"),
        _weights_array(prior).alias("prior_weights"),
        source.alias("prior_source"),
        F.coalesce("team_fit_floor", F.lit(TEAM_FIT_FLOOR)).alias("fit_floor"),
        F.coalesce("team_fit_range", F.lit(TEAM_FIT_RANGE)).alias("fit_range"),
    )


def training_rows(ev: DataFrame, profiles: DataFrame) -> DataFrame:
    """Races with known points: exposure, target multiplier, race weight and signals, with the team's settings."""
    require_columns(ev, _NEEDED, "Calendar EV data")
    value = lambda c: F.coalesce(number(F.col(c)), F.lit(0.0))
    known = ev.where(number(F.col("actual_points")).isNotNull()).select(
        *TEAM_KEYS,
        number(F.col("actual_points")).alias("actual"),
        (value("base_opportunity_points") * value("participation_confidence") * value("execution_multiplier")).alias("exposure"),
        F.array(*[clip(value(s)) for s in _SIGNALS]).alias("signals"),
    )
    joined = skew_join(known, profile_priors(profiles), TEAM_KEYS, "inner")
    ratio = F.col("actual") / F.nullif(F.col("exposure"), F.lit(0.0))
    target = F.when(F.col("exposure") > 0, clip_between(ratio, F.col("fit_floor"))).otherwise(F.col("fit_floor"))
    return joined.withColumns(
        {
            "target": target,
            "race_weight": F.sqrt(F.greatest("actual", F.lit(0.0)) + 1.0),
            "m": F.transform("signals", lambda s: s * F.col("fit_range")),
        }
    )


def clip_between(value: Column, low: Column) -> Column:
    return F.least(F.greatest(value, low), F.lit(1.0))


def fit_statistics(rows: DataFrame) -> DataFrame:
    """One row per team: the weighted sums that determine its objective."""
    r, e, m = F.col("race_weight"), F.col("fit_floor") - F.col("target"), F.col("m")
    settings = ["current_weights", "prior_weights", "prior_source", "fit_floor", "fit_range"]
    return rows.groupBy(*TEAM_KEYS).agg(
        *[F.first(c).alias(c) for c in settings],
        F.count(F.lit(1)).alias("known_race_count"),
        F.sum(r).alias("s0"),
        F.sum(r * e).alias("c0"),
        F.sum(r * e * e).alias("c1"),
        F.array(*[F.sum(r * m[i]) for i in range(_AXES)]).alias("m1"),
        F.array(*[F.sum(r * e * m[i]) for i in range(_AXES)]).alias("b"),
        F.array(*[F.sum(r * m[i] * m[j]) for i, j in _PAIRS]).alias("m2"),
    )


def project_to_simplex(points: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Nearest weights (row by row) that sum to 1 and respect the floors."""
    free = 1.0 - floors.sum()
    shifted = points - floors
    ordered = -np.sort(-shifted, axis=1)
    excess = np.cumsum(ordered, axis=1) - free
    place = np.arange(1, points.shape[1] + 1)
    support = np.maximum((ordered - excess / place > 0).sum(axis=1), 1)
    threshold = excess[np.arange(len(points)), support - 1] / support
    return floors + np.maximum(shifted - threshold[:, None], 0.0)


def solve_batch(stats: Mapping[str, np.ndarray], settings: Mapping[str, float] = FIT_SETTINGS) -> dict[str, np.ndarray]:
    """Fitted weights for a batch of teams from their statistics (arrays with one row per team)."""
    n, s0 = stats["known_race_count"].astype(float), np.maximum(stats["s0"], 1e-9)
    prior_strength = settings["prior_strength"] * np.maximum(1.0, settings["prior_full_races"] / n)
    concentration = settings["concentration_strength"] * np.maximum(1.0, settings["concentration_full_races"] / n)
    level = settings["level_weight"]
    floors = np.zeros(_AXES)
    floors[PROFILE_AXES.index("time_trial")] = settings["min_time_trial_weight"]
    m2 = np.zeros((len(n), _AXES, _AXES))
    for place, (i, j) in enumerate(_PAIRS):
        m2[:, i, j] = m2[:, j, i] = stats["m2"][:, place]
    mean, b, c0, c1 = stats["m1"] / s0[:, None], stats["b"], stats["c0"], stats["c1"]
    start = project_to_simplex(stats["current_weights"], floors)
    prior = project_to_simplex(stats["prior_weights"], floors)

    ridge = 2.0 * prior_strength / _AXES + 2.0 * concentration
    curvature = 2.0 * m2 / s0[:, None, None] + 2.0 * level * mean[:, :, None] * mean[:, None, :]
    curvature += ridge[:, None, None] * np.eye(_AXES)
    step = 1.0 / np.maximum(np.linalg.eigvalsh(curvature)[:, -1], 1e-9)
    linear = 2.0 * b / s0[:, None] + 2.0 * level * (c0 / s0)[:, None] * mean - (2.0 * prior_strength / _AXES)[:, None] * prior

    def objective(w: np.ndarray) -> np.ndarray:
        squared = (np.einsum("ti,tij,tj->t", w, m2, w) + 2.0 * (b * w).sum(axis=1) + c1) / s0
        gap = (mean * w).sum(axis=1) + c0 / s0
        return squared + level * gap**2 + prior_strength * ((w - prior) ** 2).mean(axis=1) + concentration * (w**2).sum(axis=1)

    weights, active = start.copy(), np.arange(len(n))
    for _ in range(int(settings["max_iterations"])):
        if not len(active):
            break
        w = weights[active]
        gradient = np.einsum("tij,tj->ti", curvature[active], w) + linear[active]
        moved = project_to_simplex(w - gradient * step[active, None], floors)
        weights[active] = moved
        active = active[np.abs(moved - w).max(axis=1) > settings["tolerance"]]

    base, fitted = objective(start), objective(weights)
    keep = fitted > base
    chosen = np.where(keep[:, None], start, weights)
    return {
        "baseline_weights": start, "fitted_weights": chosen, "objective": np.where(keep, base, fitted), "baseline_objective": base,
        "effective_prior_strength": prior_strength, "effective_concentration_strength": concentration,
    }


_SOLVED = (
    "team_slug string, planning_year long, known_race_count long, prior_source string, baseline_weights array<double>, "
    "fitted_weights array<double>, objective double, baseline_objective double, effective_prior_strength double, "
    "effective_concentration_strength double"
)


def solve_weights(statistics: DataFrame) -> DataFrame:
    """Solve all teams; each Arrow batch of team rows is solved together."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            arrays = {c: np.stack(batch[c]) for c in ("current_weights", "prior_weights", "m1", "b", "m2")}
            arrays.update({c: batch[c].to_numpy() for c in ("known_race_count", "s0", "c0", "c1")})
            solved = solve_batch(arrays)
            result = batch[["team_slug", "planning_year", "known_race_count", "prior_source"]].copy()
            for name, values in solved.items():
                result[name] = list(values) if values.ndim == 2 else values
            yield result

    typed = statistics.withColumn("planning_year", F.col("planning_year").cast("long"))
    return typed.mapInPandas(solve, _SOLVED)


def fit_errors(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """Errors in points per team under the fitted and the baseline weights."""
    joined = skew_join(rows, solved.select(*TEAM_KEYS, "fitted_weights", "baseline_weights"), TEAM_KEYS, "inner")

    def predicted(weights: str) -> Column:
        fit = F.aggregate(F.zip_with("m", weights, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
        return F.col("exposure") * (F.col("fit_floor") + fit)

    scored = joined.withColumns({"_p": predicted("fitted_weights"), "_b": predicted("baseline_weights")})
    error, base_error = F.col("_p") - F.col("actual"), F.col("_b") - F.col("actual")
    return scored.groupBy(*TEAM_KEYS).agg(
        F.sum("actual").alias("actual_points_total"),
        F.sum("_p").alias("predicted_points_total"),
        (F.sum("_p") - F.sum("actual")).alias("season_gap"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(base_error)).alias("baseline_mae"),
        F.sqrt(F.avg(base_error * base_error)).alias("baseline_rmse"),
        (F.sum("_b") - F.sum("actual")).alias("baseline_season_gap"),
    )


def fit_strength_weights(ev: DataFrame, profiles: DataFrame) -> DataFrame:
    """Fitted weights and diagnostics of every team with known results, rounded for the saved profile.

    Teams without a known result have no row; `unfitted_teams` lists them.
    """
    # Read twice: for the statistics and for the errors in points.
    rows = checkpointed(training_rows(ev, profiles))
    solved = solve_weights(fit_statistics(rows))
    errors = fit_errors(rows, solved)
    weights = F.map_from_arrays(
        F.lit(list(PROFILE_AXES)), F.transform("fitted_weights", lambda w: F.round(w, 6))
    )
    joined = solved.join(errors, TEAM_KEYS)
    measures = [c for c in errors.columns if c not in TEAM_KEYS]
    return joined.select(
        *TEAM_KEYS,
        F.lit(FIT_METHOD).alias("weight_fit_method"),
        weights.alias("strength_weights"),
        "known_race_count",
        "prior_source",
        *[F.round(c, 3).alias(c) for c in measures],
        *[F.round(c, 6).alias(c) for c in ("objective", "effective_prior_strength", "effective_concentration_strength")],
    )


def unfitted_teams(ev: DataFrame) -> DataFrame:
    """Teams whose rows hold no known actual points."""
    return ev.groupBy(*TEAM_KEYS).agg(F.count(number(F.col("actual_points"))).alias("known")).where("known = 0").select(
        *TEAM_KEYS, F.lit("Calendar EV data has no rows with known actual_points.").alias("error")
    )


def apply_fit(profiles: DataFrame, fits: DataFrame, version: str = FIT_PROFILE_VERSION) -> DataFrame:
    """Profiles with the fitted weights, method, summary and version; others stay as they are."""
    summary = [c for c in fits.columns if c not in (*TEAM_KEYS, "weight_fit_method", "strength_weights")]
    chosen = fits.select(
        *TEAM_KEYS,
        F.col("strength_weights").alias("_weights"),
        F.col("weight_fit_method").alias("_method"),
        F.struct(*summary).alias("_summary"),
    )
    joined = profiles.drop("weight_fit_method", "weight_fit_summary").join(chosen, TEAM_KEYS, "left")
    return joined.withColumns(
        {
            "strength_weights": F.coalesce("_weights", "strength_weights"),
            "profile_version": F.when(F.col("_weights").isNotNull(), F.lit(version)).otherwise(F.col("profile_version")),
        }
    ).withColumnsRenamed({"_method": "weight_fit_method", "_summary": "weight_fit_summary"}).drop("_weights")
