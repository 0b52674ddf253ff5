"""What-if overlays on saved expected values: presets for every team at once, and free sandboxes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from echelon.constants import (
    PROFILE_AXES, PROFILE_AXIS_LABELS, SCENARIO_INPUT_COLUMNS, SCENARIO_PRESETS, TEAM_FIT_FLOOR, TEAM_FIT_RANGE,
)
from echelon.functions.columns import map_literal, map_number, normalised_map, number, require_columns
from echelon.operators.expected_value import (
    PROFILE_COLUMNS, TEAM_KEYS, expected_points, participation_confidence, with_profiles, with_team_fit,
)
from echelon.operators.profiles import merge_maps
from echelon.operators.spread import top_rows

_PARTICIPATION_LABELS = {
    "completed": "Participation: completed",
    "program_confirmed": "Participation: program confirmed",
    "observed_startlist": "Participation: observed startlist",
    "calendar_seed": "Participation: calendar seed",
    "overlap_penalty": "Participation: overlap penalty",
}


def preset_profiles(profiles: DataFrame, presets: Mapping[str, Mapping] = SCENARIO_PRESETS) -> DataFrame:
    """Each profile under each preset: overridden values replaced, overridden weights re-normalised.

    Presets are a short fixed list held in the plan as a literal, so a profile row becomes one row per preset.
    """
    none = lambda kind: F.lit(None).cast(kind)
    numbers = lambda o, name: map_literal(o[name]) if o.get(name) else none("map<string,double>")
    literal = F.array(
        *[
            F.struct(
                F.lit(i).alias("order"),
                F.lit(key).alias("key"),
                F.lit(p["label"]).alias("label"),
                numbers(p["profile_overrides"], "strength_weights").alias("weights"),
                F.lit(p["profile_overrides"].get("team_fit_floor")).cast("double").alias("floor"),
                F.lit(p["profile_overrides"].get("team_fit_range")).cast("double").alias("reach"),
                numbers(p["profile_overrides"], "participation_rules").alias("participation"),
            )
            for i, (key, p) in enumerate(presets.items())
        ]
    )
    each = profiles.withColumn("_p", F.explode(literal))
    weights = F.when(
        F.col("_p.weights").isNotNull(), normalised_map(merge_maps(F.col("strength_weights"), F.col("_p.weights")), PROFILE_AXES)
    ).otherwise(F.col("strength_weights"))
    rules = F.when(
        F.col("_p.participation").isNotNull(), merge_maps(F.col("participation_rules"), F.col("_p.participation"))
    ).otherwise(F.col("participation_rules"))
    return each.withColumns(
        {
            "saved_profile": F.struct(*PROFILE_COLUMNS),
            "scenario_key": F.col("_p.key"),
            "scenario_label": F.col("_p.label"),
            "scenario_order": F.col("_p.order"),
            "strength_weights": weights,
            "team_fit_floor": F.coalesce("_p.floor", "team_fit_floor"),
            "team_fit_range": F.coalesce("_p.reach", "team_fit_range"),
            "participation_rules": rules,
        }
    ).drop("_p")


def scenario_overlay(ev: DataFrame, profiles: DataFrame, presets: Mapping[str, Mapping] = SCENARIO_PRESETS) -> DataFrame:
    """Saved expected values under every preset; base opportunity and execution stay frozen."""
    require_columns(ev, SCENARIO_INPUT_COLUMNS, "Calendar EV data")
    saved = ev.withColumns(
        {
            **{f"saved_{c}": number(F.col(c)) for c in ("specialty_fit_score", "sprint_fit_bonus") if c in ev.columns},
            **{f"saved_{c}": number(F.col(c)) for c in ("team_fit_score", "team_fit_multiplier", "participation_confidence")},
            "saved_expected_points": F.coalesce(number(F.col("expected_points")), F.lit(0.0)),
        }
    )
    # The profile is attached once per race; the presets are unfolded from a literal afterwards.
    scenario = preset_profiles(with_profiles(saved, profiles), presets)
    valued = with_team_fit(scenario, "scenario_").withColumn("scenario_participation_confidence", participation_confidence())
    valued = valued.withColumn(
        "scenario_expected_points", expected_points("scenario_team_fit_multiplier", "scenario_participation_confidence")
    )
    zero = F.lit(0.0)
    result = valued.withColumns(
        {
            "expected_points_delta": F.col("scenario_expected_points") - F.col("saved_expected_points"),
            "team_fit_multiplier_delta": F.col("scenario_team_fit_multiplier") - F.col("saved_team_fit_multiplier"),
            "participation_confidence_delta": F.coalesce("scenario_participation_confidence", zero)
            - F.coalesce("saved_participation_confidence", zero),
        }
    )
    if "actual_points" in ev.columns:
        result = result.withColumn("scenario_ev_gap", number(F.col("actual_points")) - F.col("scenario_expected_points"))
    return result.drop(*PROFILE_COLUMNS, "saved_profile")


def scenario_totals(overlay: DataFrame) -> DataFrame:
    """Saved and scenario totals, their difference and the number of races that moved."""
    return overlay.groupBy(*TEAM_KEYS, "scenario_key").agg(
        F.sum("saved_expected_points").alias("saved_total"),
        F.sum("scenario_expected_points").alias("scenario_total"),
        (F.sum("scenario_expected_points") - F.sum("saved_expected_points")).alias("delta_total"),
        F.count_if(F.abs("expected_points_delta") > 1e-9).alias("races_moved"),
    )


def scenario_movers(overlay: DataFrame, limit: int = 10, value: str = "scenario_expected_points") -> DataFrame:
    """The races each scenario moves most, per team."""
    keys = [*TEAM_KEYS, "scenario_key"] if "scenario_key" in overlay.columns else TEAM_KEYS
    order = [F.abs("expected_points_delta").desc_nulls_last(), F.desc_nulls_last(value), F.col("race_id")]
    return top_rows(overlay, keys, order, limit, "mover_rank")


def sandbox(ev: DataFrame, weights: Mapping[str, float], floor: float, reach: float) -> DataFrame:
    """Expected values under free fit settings; participation and execution stay frozen."""
    saved = ev.withColumns(
        {
            "saved_expected_points": F.coalesce(number(F.col("expected_points")), F.lit(0.0)),
            "saved_team_fit_score": number(F.col("team_fit_score")),
            "saved_team_fit_multiplier": number(F.col("team_fit_multiplier")),
            "strength_weights": map_literal(weights),
            "team_fit_floor": F.lit(float(floor)),
            "team_fit_range": F.lit(float(reach)),
        }
    )
    valued = with_team_fit(saved, "sandbox_").withColumn("sandbox_expected_points", expected_points("sandbox_team_fit_multiplier"))
    return valued.withColumn("expected_points_delta", F.col("sandbox_expected_points") - F.col("saved_expected_points")).drop(
        "strength_weights", "team_fit_floor", "team_fit_range"
    )


def assumption_table(profiles: DataFrame, presets: Mapping[str, Mapping] = SCENARIO_PRESETS) -> DataFrame:
    """Saved versus scenario settings per team and preset; weights only where they differ."""
    each = preset_profiles(profiles, presets)
    saved = lambda c: F.col(f"saved_profile.{c}")
    row = lambda order, setting, a, b: F.struct(
        F.lit(order).alias("setting_order"), F.lit(setting).alias("setting"), a.alias("saved_value"), b.alias("scenario_value")
    )
    settings = [
        row(0, "Team-fit floor", F.coalesce(saved("team_fit_floor"), F.lit(TEAM_FIT_FLOOR)), F.coalesce("team_fit_floor", F.lit(TEAM_FIT_FLOOR))),
        row(1, "Team-fit range", F.coalesce(saved("team_fit_range"), F.lit(TEAM_FIT_RANGE)), F.coalesce("team_fit_range", F.lit(TEAM_FIT_RANGE))),
    ]
    for i, (key, label) in enumerate(_PARTICIPATION_LABELS.items()):
        settings.append(row(2 + i, label, map_number(saved("participation_rules"), key, 0.0), map_number(F.col("participation_rules"), key, 0.0)))
    before, after = normalised_map(saved("strength_weights"), PROFILE_AXES), normalised_map(F.col("strength_weights"), PROFILE_AXES)
    for i, axis in enumerate(PROFILE_AXES):
        a, b = F.element_at(before, F.lit(axis)), F.element_at(after, F.lit(axis))
        settings.append(F.when(F.abs(a - b) >= 1e-9, row(7 + i, f"Weight: {PROFILE_AXIS_LABELS[axis]}", a, b)))
    return each.select(*TEAM_KEYS, "scenario_key", F.explode(F.array_compact(F.array(*settings))).alias("s")).select(*TEAM_KEYS, "scenario_key", "s.*")
