"""Team profiles and archetypes: merging, validation, inference, explanation tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from echelon.constants import (
    ARCHETYPES, EV_WEIGHTS, EXECUTION_REASON, EXPECTED_POINTS_FORMULA, OPPORTUNITY_WEIGHT_REASONS, PARTICIPATION_REASONS,
    PROFILE_AXES, PROFILE_AXIS_LABELS, PROFILE_CONFIDENCE_LEVELS, SCENARIO_FORMULA, SCENARIO_PRESET_VERSION,
    SCENARIO_SCOPE, STRENGTH_WEIGHT_REASONS, TEAM_FIT_FLOOR, TEAM_FIT_RANGE, TEAM_FIT_REASON,
)
from echelon.functions.columns import blank, first_filled, map_number, normalised_map, text, total
from echelon.functions.text import stable_slug

TEAM_KEYS = ["team_slug", "planning_year"]
_MAPS = ("strength_weights", "execution_rules", "participation_rules")
_SCALARS = ("team_fit_floor", "team_fit_range")
_TEXTS = ("archetype_key", "archetype_label", "archetype_description", "profile_confidence", "profile_version")
_REASON_MAPS = {"strength_weight_rationale": STRENGTH_WEIGHT_REASONS, "participation_rule_rationale": PARTICIPATION_REASONS}
_REASON_TEXTS = {"team_fit_rationale": TEAM_FIT_REASON, "execution_rule_rationale": EXECUTION_REASON}


def archetype_table(spark: SparkSession, archetypes: Mapping[str, Mapping] = ARCHETYPES) -> DataFrame:
    """The archetype catalog as rows (a fixed handful)."""
    rows = [(k, a["label"], a["description"], a.get("color", ""), a.get("strength_weight_prior")) for k, a in archetypes.items()]
    return spark.createDataFrame(
        rows, "archetype_key string, label string, description string, color string, strength_weight_prior map<string,double>"
    )


def with_rationale(profiles: DataFrame) -> DataFrame:
    """The reasons for weights and rules: the team's own where it gives any, else the general ones."""
    have = set(profiles.columns)
    general = lambda mapping: F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    maps = {c: F.when(F.size(c) > 0, F.col(c)).otherwise(general(reasons)) if c in have else general(reasons) for c, reasons in _REASON_MAPS.items()}
    texts = {c: first_filled(F.col(c), F.lit(reason)) if c in have else F.lit(reason) for c, reason in _REASON_TEXTS.items()}
    return profiles.withColumns({**maps, **texts})


def merge_maps(base: Column, override: Column, value: str = "double") -> Column:
    """Union of two maps; where both have a key the override wins."""
    empty = F.create_map().cast(f"map<string,{value}>")
    return F.map_zip_with(F.coalesce(base, empty), F.coalesce(override, empty), lambda _, b, o: F.coalesce(o, b))


def merge_profiles(teams: DataFrame, defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Profile of every tracked team: the default profile, the team's own values over it, identity from the manifest.

    `defaults` has one row; `overrides` at most one per team-season; absent values are null.
    """
    columns = [*_MAPS, *_SCALARS, *_TEXTS, "profile_rationale", *_REASON_MAPS, *_REASON_TEXTS]
    kind = lambda c: "map<string,string>" if c in _REASON_MAPS else "string"
    as_struct = lambda df: F.struct(*[F.col(c) if c in df.columns else F.lit(None).cast(kind(c)).alias(c) for c in columns])
    base = teams.withColumn("_d", defaults.select(as_struct(defaults)).scalar())
    own = overrides.select(*TEAM_KEYS, as_struct(overrides).alias("_o"))
    joined = base.join(own, TEAM_KEYS, "left")
    merged = {c: merge_maps(F.col(f"_d.{c}"), F.col(f"_o.{c}")) for c in _MAPS}
    merged.update({c: merge_maps(F.col(f"_d.{c}"), F.col(f"_o.{c}"), "string") for c in _REASON_MAPS})
    merged.update({c: F.coalesce(F.col(f"_o.{c}"), F.col(f"_d.{c}")) for c in [*_SCALARS, *_TEXTS, "profile_rationale", *_REASON_TEXTS]})
    result = joined.withColumns(merged).drop("_d", "_o")
    year = F.col("planning_year")
    source_slug = first_filled(F.col("pcs_team_slug"), F.col("team_slug")) if "pcs_team_slug" in teams.columns else F.col("team_slug")
    return result.withColumns({"team_slug": stable_slug(F.col("team_slug"), year), "pcs_team_slug": source_slug})


def with_inferred_archetype(profiles: DataFrame, name: str = "inferred_archetype", weights: str = "strength_weights") -> DataFrame:
    """Add the archetype found by a decision list on the normalised weights; equal weights rank by axis name."""
    of = lambda axis: F.element_at("_scaled", F.lit(axis))
    ranked = F.array_sort(F.array(*[F.struct((-of(a)).alias("w"), F.lit(a).alias("axis")) for a in PROFILE_AXES]))
    staged = profiles.withColumn("_scaled", normalised_map(F.col(weights), PROFILE_AXES)).withColumn("_ranked", ranked)
    top, second = F.col("_ranked")[0]["axis"], F.col("_ranked")[1]["axis"]
    lead = F.col("_ranked")[1]["w"] - F.col("_ranked")[0]["w"]
    archetype = (
        F.when((top == "sprint_bonus") & (lead >= 0.08), "sprint_first")
        .when((top == "time_trial") & (of("time_trial") >= 0.22), "time_trial_edge")
        .when(top.isin("one_day", "sprint_bonus") & second.isin("one_day", "sprint_bonus"), "classic_sprint_opportunist")
        .when((top == "one_day") & (of("one_day") - F.greatest(of("gc"), of("stage_hunter")) >= 0.08), "classic_specialist")
        .when((top == "stage_hunter") & (of("gc") <= 0.2), "stage_hunter")
        .when((of("gc") + of("all_round") >= 0.45) & top.isin("gc", "all_round"), "gc_development")
        .otherwise("balanced_opportunist")
    )
    return staged.withColumn(name, archetype).drop("_scaled", "_ranked")


def complete_profiles(profiles: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Fill a missing archetype by inference and missing label and description from the catalog.

    `catalog` has the rows of an archetype document; without one the built-in catalog serves.
    """
    catalog = archetype_table(profiles.sparkSession) if catalog is None else catalog.drop("strength_weight_prior")
    keyed = with_inferred_archetype(profiles)
    keyed = keyed.withColumn("archetype_key", first_filled(F.col("archetype_key"), F.col("inferred_archetype"))).drop("inferred_archetype")
    # The catalog is one small document, a handful of rows.
    joined = keyed.join(F.broadcast(catalog), ["archetype_key"], "left")
    return joined.withColumns(
        {
            "archetype_label": first_filled(F.col("archetype_label"), F.col("label")),
            "archetype_description": first_filled(F.col("archetype_description"), F.col("description")),
            "profile_rationale": F.filter(
                F.transform(F.coalesce("profile_rationale", F.array().cast("array<string>")), lambda r: F.trim(r)), lambda r: r != ""
            ),
            "archetype_color": text(F.col("color")),
        }
    ).withColumnRenamed("label", "catalog_label").drop("description", "color")


def _outside(value: Column) -> Column:
    return value.isNull() | (value < 0) | (value > 1)


def profile_errors() -> Column:
    """Array of everything wrong with a completed profile row; empty when it is valid."""
    weights = F.col("strength_weights")
    weight = lambda a: F.element_at(weights, F.lit(a))
    say = lambda condition, message: F.when(F.coalesce(condition, F.lit(False)), F.lit(message))
    rules = [
        F.when(
            F.col(c).isNull() | F.exists(F.map_values(c), lambda v: _outside(v)), F.lit(f"{c} must be numbers between 0 and 1.")
        )
        for c in ("execution_rules", "participation_rules")
    ]
    unknown = F.col("catalog_label").isNull()
    checks = [
        *[say(weight(a).isNull(), f"Team profile missing strength weights for: {a}") for a in PROFILE_AXES],
        *[say((weight(a) < 0) | (weight(a) > 1), f"strength_weights.{a} must be between 0 and 1.") for a in PROFILE_AXES],
        say(F.abs(total([weight(a) for a in PROFILE_AXES]) - 1.0) > 0.02, "Strength weights must sum to about 1.0."),
        *[F.when(_outside(F.col(c)), F.lit(f"{c} must be between 0 and 1.")) for c in _SCALARS],
        F.when(unknown, F.concat(F.lit("Unknown archetype_key `"), text(F.col("archetype_key")), F.lit("`."))),
        F.when(
            ~unknown & (text(F.col("archetype_label")) != F.col("catalog_label")),
            F.concat(F.lit("archetype_label `"), text(F.col("archetype_label")), F.lit("` does not match catalog label `"), F.col("catalog_label"), F.lit("`.")),
        ),
        say(blank(F.col("archetype_description")), "archetype_description must not be blank."),
        say(
            ~blank(F.col("profile_confidence")) & ~F.trim("profile_confidence").isin(*PROFILE_CONFIDENCE_LEVELS),
            "profile_confidence must be one of: " + ", ".join(sorted(PROFILE_CONFIDENCE_LEVELS)) + ".",
        ),
        *rules,
    ]
    return F.array_compact(F.array(*checks))


def validated_profiles(profiles: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Completed profiles with an `errors` column."""
    return complete_profiles(profiles, catalog).withColumn("errors", profile_errors()).drop("catalog_label")


def valid_profiles(profiles: DataFrame) -> DataFrame:
    return validated_profiles(profiles).where(F.size("errors") == 0)


def profile_descriptions(profiles: DataFrame) -> DataFrame:
    """Identity card of each team: archetype, its text and colour, confidence and reasons."""
    return valid_profiles(profiles).select(
        *TEAM_KEYS, "archetype_key", "archetype_label", "archetype_description", "archetype_color",
        text(F.col("profile_confidence")).alias("profile_confidence"), "profile_rationale",
    )


def axis_rows(weights: Column, value_name: str) -> Column:
    """Explodable array of (axis order, key, label, value) in the fixed axis order."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("axis_order"), F.lit(a).alias("axis_key"), F.lit(PROFILE_AXIS_LABELS[a]).alias("axis"),
                map_number(weights, a).alias(value_name),
            )
            for i, a in enumerate(PROFILE_AXES)
        ]
    )


def strength_table(profiles: DataFrame) -> DataFrame:
    return profiles.select(*TEAM_KEYS, F.explode(axis_rows(F.col("strength_weights"), "weight")).alias("a")).select(*TEAM_KEYS, "a.*")


def compare_profiles(profiles: DataFrame, sandbox: Column, default: Mapping[str, float]) -> DataFrame:
    """Default, saved and sandbox weights per axis, all normalised."""
    literal = F.create_map(*[x for a in PROFILE_AXES for x in (F.lit(a), F.lit(float(default.get(a, 0.0))))])
    scaled = {
        "default_profile": normalised_map(literal, PROFILE_AXES),
        "saved_artifact": normalised_map(F.col("strength_weights"), PROFILE_AXES),
        "sandbox": normalised_map(sandbox, PROFILE_AXES),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("axis_order"), F.lit(PROFILE_AXIS_LABELS[a]).alias("axis"),
                *[F.element_at(m, F.lit(a)).alias(name) for name, m in scaled.items()],
            )
            for i, a in enumerate(PROFILE_AXES)
        ]
    )
    return profiles.select(*TEAM_KEYS, F.explode(rows).alias("a")).select(*TEAM_KEYS, "a.*")


def profile_status(default: Mapping[str, float], default_floor: float = TEAM_FIT_FLOOR, default_range: float = TEAM_FIT_RANGE) -> Column:
    """`Default-like` when weights and fit bounds equal the default profile, else `Custom`."""
    literal = F.create_map(*[x for a in PROFILE_AXES for x in (F.lit(a), F.lit(float(default.get(a, 0.0))))])
    saved, base = normalised_map(F.col("strength_weights"), PROFILE_AXES), normalised_map(literal, PROFILE_AXES)
    near = lambda a, b: F.abs(a - b) < 1e-9
    same = near(F.coalesce("team_fit_floor", F.lit(TEAM_FIT_FLOOR)), F.lit(default_floor)) & near(
        F.coalesce("team_fit_range", F.lit(TEAM_FIT_RANGE)), F.lit(default_range)
    )
    for axis in PROFILE_AXES:
        same = same & near(F.element_at(saved, F.lit(axis)), F.element_at(base, F.lit(axis)))
    return F.when(same, F.lit("Default-like")).otherwise(F.lit("Custom"))


def weight_explainer(profiles: DataFrame) -> DataFrame:
    """Long table of all weights behind the expected points of each team, with the team's reasons or the general ones."""
    entry = lambda section, order, name, value, reason: F.struct(
        F.lit(section).alias("section"), order.alias("item_order"), name.alias("item"), value.alias("value"), reason.alias("reason")
    )
    opportunity = F.array(
        *[
            entry("opportunity", F.lit(i), F.lit(k), F.lit(float(w)), F.lit(OPPORTUNITY_WEIGHT_REASONS[k]))
            for i, (k, w) in enumerate(EV_WEIGHTS.items())
        ]
    )

    def section(name: str, mapping: str, why: Column | None) -> Column:
        entries = F.array_sort(F.map_entries(mapping))
        return F.transform(
            entries,
            lambda e, i: entry(name, i, e["key"], e["value"], text(F.element_at(why, e["key"])) if why is not None else F.lit("")),
        )

    rows = F.concat(
        opportunity,
        section("strength", "strength_weights", F.col("strength_weight_rationale")),
        section("execution", "execution_rules", None),
        section("participation", "participation_rules", F.col("participation_rule_rationale")),
    )
    return with_rationale(profiles).select(*TEAM_KEYS, F.explode(rows).alias("r")).select(*TEAM_KEYS, "r.*")


def run_metadata(profiles: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per team-season describing how its expected points were computed."""
    profiles = with_rationale(profiles)
    told = [*_TEXTS, "profile_rationale", *_MAPS, *_SCALARS, *_REASON_MAPS, *_REASON_TEXTS, "weight_fit_method", "weight_fit_summary"]
    described = profiles.select(*TEAM_KEYS, "team_name", F.struct(*[c for c in told if c in profiles.columns]).alias("team_profile"))
    return summary.select(*TEAM_KEYS, "as_of_date", F.col("race_count").alias("artifact_row_count")).join(described, TEAM_KEYS).withColumns(
        {
            "expected_points_formula": F.lit(EXPECTED_POINTS_FORMULA),
            "opportunity_weights": F.create_map(*[F.lit(x) for k, v in EV_WEIGHTS.items() for x in (k, float(v))]),
            "opportunity_rationale": F.create_map(*[F.lit(x) for k, v in OPPORTUNITY_WEIGHT_REASONS.items() for x in (k, v)]),
            "roster_scenario_formula": F.lit(SCENARIO_FORMULA),
            "roster_scenario_preset_version": F.lit(SCENARIO_PRESET_VERSION),
            "roster_scenario_scope": F.lit(SCENARIO_SCOPE),
        }
    )


def find_profile(profiles: DataFrame, team_slug: str, planning_year: int | None = None) -> DataFrame:
    """Profile rows of a team; without a year the slug must be unambiguous."""
    if not team_slug.strip():
        raise ValueError("team_slug must not be blank.")
    if planning_year is not None:
        suffix = f"-{planning_year}"
        return profiles.where((F.col("team_slug") == team_slug.strip().removesuffix(suffix)) & (F.col("planning_year") == planning_year))
    found = profiles.where(F.col("team_slug") == team_slug.strip())
    seasons = found.select("planning_year").distinct().limit(2).count()
    if seasons > 1:
        raise ValueError(f"Multiple team profiles matched `{team_slug}`; provide planning_year explicitly.")
    return found


def check_presets(version: str, scope: str, presets: Sequence[Mapping]) -> list[str]:
    """Everything wrong with a scenario preset catalog (a small parameter document)."""
    problems = []
    if not str(version or "").strip():
        problems.append("preset catalog must include preset_version.")
    if str(scope or "").strip() not in ("", SCENARIO_SCOPE):
        problems.append(f"preset catalog scope `{scope}` does not match expected `{SCENARIO_SCOPE}`.")
    if not presets:
        problems.append("preset catalog must include at least one preset.")
    keys = [str(p.get("key") or "").strip() for p in presets]
    if any(not str(p.get(name) or "").strip() for p in presets for name in ("key", "label", "description")):
        problems.append("each preset must include key, label, and description.")
    problems += [f"duplicate preset key: {k}" for k in sorted({k for k in keys if k and keys.count(k) > 1})]
    if presets and "baseline_saved" not in keys:
        problems.append("preset catalog must include baseline_saved.")
    return problems
