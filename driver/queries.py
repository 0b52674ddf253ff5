"""Every operator family over the given tables, next to the same question in plain SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from driver import adapters as ad, fit_oracle, oracles as sql
from driver.file_queries import file_queries
from driver.page_queries import page_queries
from driver.registry import Query, shape
from echelon.constants import ARCHETYPES, EXECUTION_RULES, OPPORTUNITY_WEIGHTS, PARTICIPATION_RULES, PROFILE_AXES, SCENARIO_PRESETS
from echelon.functions.columns import map_literal
from echelon.functions.dates import label_dates
from echelon.functions.text import name_variants, normalise_name, race_slug, tokens_of
from echelon.operators import (
    backtest, editions as ed, expected_value as ev, history as hist, matching, pages, profiles as prof, ranking, risk, scenarios,
    targets, team_calendar as cal, views, weight_fit,
)
from echelon.operators.spread import checkpointed, shared_folder, shuffled, top_rows
from echelon.plans import incremental

PLANNING_SEASON = 2002
CANDIDATES = backtest.distinct_candidates(backtest.weight_candidates(600, 7))
MIN_FOLD = 8
SANDBOX = {"one_day": 0.4, "stage_hunter": 0.1, "gc": 0.1, "time_trial": 0.05, "all_round": 0.15, "sprint_bonus": 0.2}


def _scored(s: SparkSession, d: str) -> DataFrame:
    return targets.score_editions(ad.editions(s, d), specialty_weights={"one_day": 2.0, "time_trial": 0.5, "all_round": 1.5}, fit_emphasis=sql.EMPHASIS)


def _targets(s: SparkSession, d: str) -> DataFrame:
    return targets.roll_up_targets(_scored(s, d))


def _overlaid(s: SparkSession, d: str) -> DataFrame:
    return targets.overlay_planning(_targets(s, d), ad.planning(s, d, PLANNING_SEASON), PLANNING_SEASON)


def shortlist(s: SparkSession, d: str) -> DataFrame:
    """The fifteen best targets that are on next season's calendar in a target category."""
    return targets.top_targets(targets.in_scope_targets(_overlaid(s, d), PLANNING_SEASON))


def _history(s: SparkSession, d: str) -> DataFrame:
    return hist.history_summary(ad.editions(s, d), ad.PLANNING_YEAR)


def _ev_inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calendars, history and known points; the season's lines are joined and summed once for both sides that need them."""
    season = checkpointed(ad.season_points(s, d))
    return ad.team_calendars(s, d, season), _history(s, d), ad.actual_points(s, d, season)


def _ev(s: SparkSession, d: str) -> DataFrame:
    calendars, history, actuals = _ev_inputs(s, d)
    return ev.team_calendar_ev(calendars, history, ad.team_profiles(s, d), actuals, ad.AS_OF)


def _overlay(s: SparkSession, d: str) -> DataFrame:
    return scenarios.scenario_overlay(_ev(s, d), ad.team_profiles(s, d))


def _folds(s: SparkSession, d: str) -> DataFrame:
    folds = backtest.walk_forward_folds(ad.editions(s, d), min_fold_size=MIN_FOLD)
    return folds.withColumns({c: F.round(c, 9) for c in backtest.COMPONENT_SCORES.values()})


def _programme_names(s: SparkSession, d: str, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The spellings of the programme by `keys` and date; a matcher that knows no team gets them once for all teams."""
    names = ad.programme(s, d).select(
        *keys, "planning_year", "source_race_name", F.coalesce("observed_date", F.lit("")).alias("observed_date")
    ).distinct()
    return matching.spelled(names), cal.prepare_planning(ad.planned_races(s, d))


def _plans(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Planned races and aliases with their comparable names; written, as every matcher reads them."""
    return checkpointed(cal.prepare_planning(ad.planned_races(s, d))), checkpointed(matching.prepare_aliases(ad.race_aliases(s, d)))


def _matched(s: SparkSession, d: str) -> DataFrame:
    return matching.match_programme(ad.programme(s, d), *_plans(s, d))


def _totals_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


TEAM = "team_slug planning_year"
EDITION = "race_id year"


def _editions_queries() -> dict[str, Query]:
    measures = "top10_points winner_points total_points gc_top10_points stage_top10_points stage_total_points"
    return {
        "edition_build": Query(
            ad.editions,
            shape(
                i="race_id year month finishers scoring_places stage_count startlist_size experienced_riders", s="race_name category race_type race_country",
                f4=measures + " total_startlist_starts total_startlist_wins total_field_form top10_field_form avg_top10_field_form",
                f6="stage_points_share gc_points_share",
            ),
            sql.with_ctes(sql.EDITIONS, select="SELECT * FROM editions"),
        ),
        "edition_errors": Query(
            lambda s, d: ad.edition_tables(s, d, F.col("race_id") % 7 == 3, F.col("race_id") % 5 == 2)[1], shape(i=EDITION, s="race_name error"),
            sql.with_ctes(
                sql.EDITIONS,
                select="""SELECT e.race_id, e.year, base_name || CASE WHEN e.year >= 1999 AND e.race_id % 13 = 5 THEN ' Classic' ELSE '' END AS race_name,
                CASE WHEN gc.race_id IS NULL THEN 'Could not find a results table' ELSE 'Could not find an extended startlist table' END AS error
                FROM entries e LEFT JOIN (SELECT * FROM gc WHERE race_id % 7 <> 3) gc ON gc.race_id = e.race_id AND gc.year = e.year WHERE gc.race_id IS NULL OR e.race_id % 5 = 2""",
            ),
        ),
        "edition_ratios": Query(
            lambda s, d: ed.with_ratios(ad.editions(s, d)), shape(i=EDITION, f6="finish_rate points_per_top10_form points_per_total_form"),
            sql.with_ctes(sql.EDITIONS, select="SELECT * FROM editions"),
        ),
        "balanced_year_cap": Query(
            lambda s, d: ed.balanced_by_year(ad.entries(s, d), 80), shape(i="race_id year month", s="race_name"),
            sql.with_ctes(
                sql.EDITIONS,
                select="""SELECT * FROM (
                  SELECT *, row_number() OVER (ORDER BY beyond, year, place) AS taken FROM (
                    SELECT *, CASE WHEN place <= 80 // years + CASE WHEN yr <= 80 % years THEN 1 ELSE 0 END THEN 0 ELSE 1 END AS beyond FROM (
                      SELECT race_id, year, month, base_name || CASE WHEN year >= 1999 AND race_id % 13 = 5 THEN ' Classic' ELSE '' END AS race_name,
                        row_number() OVER (PARTITION BY year ORDER BY month, base_name || CASE WHEN year >= 1999 AND race_id % 13 = 5 THEN ' Classic' ELSE '' END, race_id) AS place,
                        dense_rank() OVER (ORDER BY year) AS yr, (SELECT count(DISTINCT year) FROM entries) AS years FROM entries))) WHERE taken <= 80""",
            ),
        ),
        "dataset_signature": Query(
            lambda s, d: views.dataset_signature(ed.with_stage_columns(ad.editions(s, d))), shape(i="editions stage_races missing_stage_pages category_change_races", s="years categories"),
            sql.with_ctes(
                sql.HISTORY,
                select="""SELECT count(*) AS editions, count(*) FILTER (WHERE race_type = 'Stage race') AS stage_races, 0 AS missing_stage_pages,
                count(DISTINCT race_id) FILTER (WHERE category_change_count > 0) AS category_change_races,
                string_agg(DISTINCT CAST(year AS VARCHAR), ', ' ORDER BY CAST(year AS VARCHAR)) AS years, string_agg(DISTINCT category, ', ' ORDER BY category) AS categories FROM keyed""",
            ),
        ),
    }


def _target_queries() -> dict[str, Query]:
    scores = " ".join(backtest.COMPONENT_SCORES.values())
    requirements = " ".join(f"{name}_requirement" for name in ("one_day", "gc", "stage_hunter", "time_trial", "all_round"))
    means = "avg_targeting_score avg_arbitrage_score avg_specialty_fit_score best_edition_score avg_finish_rate avg_stage_points_share avg_stage_count avg_startlist_size"
    points = "avg_top10_points avg_winner_points avg_total_points avg_stage_top10_points avg_top10_field_form avg_total_field_form avg_points_efficiency"
    overlaid = shape(i="race_id planning_month planning_year", s="target_history_id race_name category planning_race_name planning_category planning_date_label planning_calendar_status", b="on_planning_calendar planning_scope_match")
    scored = sql.with_ctes(sql.SCORED, select="SELECT * FROM scored")
    return {
        "category_history": Query(
            lambda s, d: targets.with_category_history(ad.editions(s, d)), shape(i=EDITION + " category_change_count", s="target_history_id category_history latest_known_category"),
            sql.with_ctes(sql.HISTORY, select="SELECT * FROM keyed"),
        ),
        "percentile_score": Query(lambda s, d: targets.with_component_percentiles(ad.editions(s, d)), shape(i=EDITION, f6=scores), scored),
        "opportunity_score": Query(_scored, shape(i=EDITION, f6="arbitrage_score points_efficiency_index"), scored),
        "route_profile": Query(lambda s, d: targets.with_route_profile(ad.editions(s, d)), shape(i=EDITION, s="route_profile", f6=requirements), scored),
        "specialty_fit": Query(_scored, shape(i=EDITION, f6="specialty_fit_score"), scored),
        "targeting_blend": Query(_scored, shape(i=EDITION, f6="targeting_score"), scored),
        "edition_diagnostics": Query(
            lambda s, d: views.edition_diagnostics(_scored(s, d)), shape(i="year startlist_size stage_count", s="label category race_type route_profile", f4="top10_points targeting_score", f6="finish_rate"),
            sql.with_ctes(sql.SCORED, select="SELECT *, race_name || ' (' || year || ')' AS label FROM scored"),
        ),
        "target_rollup": Query(
            lambda s, d: targets.roll_up_targets(_scored(s, d), latest_only=False),
            shape(i="race_id category_change_count years_analyzed", s="target_history_id race_name race_country category latest_known_category category_history race_type route_profile years", f4=points, f6=means),
            sql.with_ctes(sql.ROLL_UP, select="SELECT * FROM targets_all"),
        ),
        "latest_category_only": Query(
            _targets, shape(i="race_id years_analyzed", s="target_history_id category", f6="avg_targeting_score"), sql.with_ctes(sql.ROLL_UP, select="SELECT * FROM targets"),
        ),
        "calendar_overlay": Query(_overlaid, overlaid, sql.with_ctes(sql.OVERLAY, select="SELECT * FROM overlaid")),
        "target_shortlist": Query(
            shortlist, {**overlaid, **shape(f6="avg_targeting_score avg_arbitrage_score", f4="avg_top10_points")},
            sql.with_ctes(
                sql.OVERLAY,
                select="""SELECT * FROM overlaid WHERE contains(planning_calendar_status, 'On 2002 .1/.Pro calendar')
                ORDER BY avg_targeting_score DESC, avg_arbitrage_score DESC, avg_top10_points DESC, target_history_id LIMIT 15""",
            ),
        ),
        "target_key_figures": Query(
            lambda s, d: views.target_key_figures(ad.editions(s, d), _overlaid(s, d)), shape(i="editions targets targets_on_calendar", f4="average_top10_payout average_startlist_size"),
            sql.with_ctes(
                sql.OVERLAY,
                select="""SELECT (SELECT count(*) FROM editions) AS editions, count(*) AS targets, count(*) FILTER (WHERE on_planning_calendar) AS targets_on_calendar,
                (SELECT avg(top10_points) FROM editions) AS average_top10_payout, (SELECT avg(startlist_size) FROM editions) AS average_startlist_size FROM overlaid""",
            ),
        ),
    }


def _history_queries() -> dict[str, Query]:
    scales = "field_softness_score stage_points_score stage_count_score"
    signals = "one_day_signal stage_race_signal gc_signal stage_hunter_signal all_round_signal time_trial_signal sprint_bonus_signal"
    key = "race_id historical_years_analyzed"
    summary = sql.with_ctes(sql.SUMMARY, select="SELECT * FROM summary")
    averages = "avg_top10_points avg_winner_points avg_stage_top10_points avg_top10_field_form"
    return {
        "history_summary": Query(_history, shape(i=key, s="race_name latest_category race_type route_profile", f4=averages, f6="avg_points_efficiency avg_stage_count"), summary),
        "minmax_scale": Query(lambda s, d: hist.with_history_scales(hist.average_history(ad.editions(s, d), ad.PLANNING_YEAR)), shape(i="race_id", s="race_name", f6=scales + " efficiency_score winner_points_score top10_points_score"), summary),
        "history_signals": Query(_history, shape(i="race_id", s="race_name", f6=signals), summary),
        "base_opportunity": Query(_history, shape(i="race_id", s="race_name route_profile", f6="base_opportunity_index", f4="base_opportunity_points"), summary),
        "category_baseline": Query(
            lambda s, d: hist.category_baselines(_history(s, d)), shape(s="latest_category race_type route_profile", f3="avg_top10_points base_opportunity_points", f6="base_opportunity_index gc_signal sprint_bonus_signal"),
            sql.with_ctes(sql.BASELINES, select="SELECT * FROM baselines"),
        ),
        "history_fallback": Query(
            lambda s, d: ev.with_history(ad.team_calendars(s, d), _history(s, d)),
            shape(i=TEAM.split()[1] + " race_id historical_years_analyzed", s="team_slug race_name category race_type route_profile notes", f4="base_opportunity_points", f6="gc_signal"),
            sql.with_ctes(sql.FALLBACK, select="SELECT * FROM valued"),
        ),
    }


def _ev_queries() -> dict[str, Query]:
    key = shape(i="planning_year race_id", s="team_slug")
    rows = sql.with_ctes(sql.EV, select="SELECT * FROM ev")
    overlay = sql.with_ctes(sql.SCENARIOS, select="SELECT * FROM overlay")
    one, three = "base_opportunity_points expected_points actual_points ev_gap", "team_fit_multiplier participation_confidence execution_multiplier"
    half_even = ", ".join(f"round_even({c}, {k}) AS {c}" for k, names in ((1, one), (3, three)) for c in names.split())
    return {
        "team_fit": Query(_ev, {**key, **shape(f6="specialty_fit_score sprint_fit_bonus team_fit_score team_fit_multiplier")}, rows),
        "participation_confidence": Query(_ev, {**key, **shape(s="status source overlap_group", f6="participation_confidence execution_multiplier")}, rows),
        "expected_points": Query(_ev, {**key, **shape(s="race_name category status notes", f4="base_opportunity_points expected_points")}, rows),
        "attach_actuals": Query(_ev, {**key, **shape(f4="expected_points actual_points ev_gap")}, rows),
        "race_detail": Query(
            lambda s, d: views.race_detail(_ev(s, d)), {**key, **shape(s="race_name category start_date status source overlap_group notes", f1=one, f3=three)},
            f"SELECT * REPLACE ({half_even}) FROM ({rows})",
        ),
        "completed_races": Query(
            lambda s, d: views.season_view(_ev(s, d), "Completed races only"), {**key, **shape(s="status", f4="expected_points")},
            sql.with_ctes(sql.EV, select="SELECT * FROM ev WHERE status = 'completed'"),
        ),
        "season_so_far": Query(
            lambda s, d: views.season_view(_ev(s, d), "Season so far"), {**key, **shape(s="status", f4="expected_points")},
            sql.with_ctes(sql.EV, select="SELECT * FROM ev WHERE status <> 'cancelled'"),
        ),
        "completed_with_gaps": Query(
            lambda s, d: views.completed_with_gaps(_ev(s, d).withColumn("execution_multiplier", F.when(F.col("category") != "1.Pro", F.col("execution_multiplier")))), {**key, **shape(s="category notes")},
            sql.with_ctes(sql.EV, select="SELECT * FROM ev WHERE status = 'completed' AND (base_opportunity_points IS NULL OR category IS NULL OR category = '1.Pro')"),
        ),
        "ev_summary": Query(
            lambda s, d: ev.ev_summary(_ev(s, d)),
            shape(i="planning_year race_count completed_race_count remaining_race_count", s="team_slug as_of_date", f4="total_expected_points completed_expected_points remaining_expected_points actual_points_known ev_gap_known"),
            sql.with_ctes(
                sql.EV,
                select="""SELECT team_slug, planning_year, '2001-06-30' AS as_of_date, sum(expected_points) AS total_expected_points,
                coalesce(sum(expected_points) FILTER (WHERE status = 'completed'), 0) AS completed_expected_points, coalesce(sum(expected_points) FILTER (WHERE status = 'scheduled'), 0) AS remaining_expected_points,
                coalesce(sum(actual_points), 0) AS actual_points_known, coalesce(sum(ev_gap), 0) AS ev_gap_known, count(*) AS race_count,
                count(*) FILTER (WHERE status = 'completed') AS completed_race_count, count(*) FILTER (WHERE status = 'scheduled') AS remaining_race_count FROM ev GROUP BY 1, 2""",
            ),
        ),
        "ev_cumulative": Query(
            lambda s, d: views.cumulative_points(_ev(s, d)), {**key, **shape(f4="expected_cumulative actual_cumulative")},
            sql.with_ctes(
                sql.EV,
                select="""SELECT *, sum(expected_points) OVER w AS expected_cumulative, sum(coalesce(actual_points, 0)) OVER w AS actual_cumulative
                FROM ev WINDOW w AS (PARTITION BY team_slug ORDER BY start_date, race_name, race_id ROWS UNBOUNDED PRECEDING)""",
            ),
        ),
        "ev_by_month": Query(
            lambda s, d: views.by_month(_ev(s, d)), shape(i="planning_year month_order", s="team_slug month_label", f4="expected_points actual_points"),
            sql.with_ctes(
                sql.EV,
                select="""SELECT team_slug, planning_year, month(start_date) AS month_order, strftime(start_date, '%b') AS month_label, sum(expected_points) AS expected_points,
                sum(coalesce(actual_points, 0)) AS actual_points FROM ev GROUP BY ALL""",
            ),
        ),
        "ev_by_category": Query(
            lambda s, d: views.by_category(_ev(s, d)), shape(i="planning_year category_order", s="team_slug category", f4="expected_points actual_points"),
            sql.with_ctes(
                sql.EV,
                select=f"""SELECT team_slug, planning_year, category, {sql.DISPLAY_ORDER} AS category_order, sum(expected_points) AS expected_points,
                sum(coalesce(actual_points, 0)) AS actual_points FROM ev GROUP BY ALL""",
            ),
        ),
        "ev_unpivot": Query(
            lambda s, d: views.as_series(views.by_category(_ev(s, d)), ["team_slug", "planning_year", "category"], {"expected_points": "Projected", "actual_points": "Actual"}),
            shape(i="planning_year", s="team_slug category series", f4="points"),
            sql.with_ctes(
                sql.EV,
                select="""SELECT team_slug, planning_year, category, 'Projected' AS series, sum(expected_points) AS points FROM ev GROUP BY ALL
                UNION ALL SELECT team_slug, planning_year, category, 'Actual', sum(coalesce(actual_points, 0)) FROM ev GROUP BY ALL""",
            ),
        ),
        "ev_gap_extremes": Query(
            lambda s, d: views.gap_extremes(_ev(s, d)), {**key, **shape(s="race_name", f4="ev_gap")},
            sql.with_ctes(
                sql.EV,
                select="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_slug ORDER BY ev_gap DESC, race_id) AS hi,
                row_number() OVER (PARTITION BY team_slug ORDER BY ev_gap, race_id) AS lo FROM ev WHERE ev_gap IS NOT NULL) WHERE hi <= 5 OR lo <= 5""",
            ),
        ),
        "scenario_overlay": Query(
            _overlay, {**key, **shape(s="scenario_key", f6="scenario_team_fit_multiplier scenario_participation_confidence", f4="saved_expected_points scenario_expected_points expected_points_delta scenario_ev_gap")},
            sql.with_ctes(sql.SCENARIOS, select="SELECT *, coalesce(expected_points, 0) AS saved_expected_points, actual_points - scenario_expected_points AS scenario_ev_gap FROM overlay"),
        ),
        "scenario_totals": Query(
            lambda s, d: scenarios.scenario_totals(_overlay(s, d)), shape(i="planning_year races_moved", s="team_slug scenario_key", f4="saved_total scenario_total delta_total"),
            sql.with_ctes(
                sql.SCENARIOS,
                select="""SELECT team_slug, planning_year, scenario_key, sum(expected_points) AS saved_total, sum(scenario_expected_points) AS scenario_total,
                sum(scenario_expected_points) - sum(expected_points) AS delta_total, count(*) FILTER (WHERE abs(expected_points_delta) > 1e-9) AS races_moved FROM overlay GROUP BY ALL""",
            ),
        ),
        "scenario_movers": Query(
            lambda s, d: scenarios.scenario_movers(_overlay(s, d)).where("scenario_key <> 'baseline_saved'"), {**key, **shape(s="scenario_key", f4="expected_points_delta")},
            sql.with_ctes(
                sql.SCENARIOS,
                select="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_slug, scenario_key ORDER BY abs(expected_points_delta) DESC, scenario_expected_points DESC, race_id) AS m
                FROM overlay) WHERE m <= 10 AND scenario_key <> 'baseline_saved'""",
            ),
        ),
        "fit_sandbox": Query(
            lambda s, d: scenarios.sandbox(_ev(s, d), SANDBOX, 0.6, 0.4), {**key, **shape(f6="sandbox_team_fit_multiplier", f4="sandbox_expected_points expected_points_delta")},
            sql.with_ctes(
                sql.EV,
                "boxed AS (SELECT * EXCLUDE (" + ", ".join(PROFILE_AXES) + "), " + ", ".join(f"{w} AS {a}" for a, w in SANDBOX.items()) + " FROM ev)",
                f"parts AS (SELECT *, {sql.fit('sandbox_')} FROM boxed)",
                """multiplied_box AS (SELECT *, least(greatest(0.6 + 0.4 * least(greatest((1.0 - sandbox_sprint_share) * sandbox_specialty_fit_score + sandbox_sprint_fit_bonus, 0.0), 1.0), 0.0), 1.0) AS sandbox_team_fit_multiplier FROM parts)""",
                """boxes AS (SELECT *, coalesce(base_opportunity_points, 0.0) * sandbox_team_fit_multiplier * participation_confidence * execution_multiplier AS sandbox_expected_points FROM multiplied_box)""",
                select="SELECT *, sandbox_expected_points - coalesce(expected_points, 0) AS expected_points_delta FROM boxes",
            ),
        ),
        "freshness_drift": Query(
            _freshness, shape(i="planning_year", s="team_slug ev_as_of calendar_scraped_day", b="has_drift calendar_is_newer"),
            """SELECT CAST(user_id AS VARCHAR) AS team_slug, 2024 AS planning_year, '2024-01-30' AS ev_as_of, strftime(max(ts), '%Y-%m-%d') AS calendar_scraped_day,
            strftime(max(ts), '%Y-%m-%d') <> '2024-01-30' AS has_drift, strftime(max(ts), '%Y-%m-%d') > '2024-01-30' AS calendar_is_newer FROM events GROUP BY 1""",
        ),
        "actual_points_rows": Query(
            _actual_rows, {**key, **shape(i="planning_year race_id rider_count", s="team_slug status pcs_race_slug notes", f4="actual_points")},
            sql.with_ctes(
                sql.RACES, sql.CALENDAR,
                """fetched AS (SELECT c.*, s.points, s.riders, s.supplier FROM calendar c JOIN season s ON c.team_slug = 'nation-' || s.c_nationkey
                AND c.race_id = CASE WHEN s.supplier % 10 = 3 THEN s.supplier + 1000000000 ELSE s.supplier END)""",
                select="""SELECT team_slug, planning_year, race_id, status, CASE WHEN supplier % 6 = 5 THEN '' ELSE 'race-' || supplier END AS pcs_race_slug,
                CASE WHEN supplier % 6 IN (5, 4) THEN NULL WHEN supplier % 6 = 3 THEN CASE WHEN status = 'completed' THEN 0.0 END ELSE round(points, 2) END AS actual_points,
                CASE WHEN supplier % 6 IN (5, 4) THEN NULL WHEN supplier % 6 = 3 THEN CASE WHEN status = 'completed' THEN 0 END ELSE riders END AS rider_count,
                CASE WHEN supplier % 6 = 5 THEN 'missing_race_slug' WHEN supplier % 6 = 4 THEN 'points_page_error=RuntimeError' WHEN supplier % 6 = 3 AND status = 'completed' THEN 'points_page_empty_after_race' ELSE '' END AS notes FROM fetched""",
            ),
        ),
        "weight_fit": Query(
            lambda s, d: weight_fit.fit_strength_weights(_ev(s, d), ad.team_profiles(s, d)).withColumns(
                {axis: F.element_at("strength_weights", F.lit(axis)) for axis in PROFILE_AXES}
            ),
            # steps that end at a tolerance and steps that end by number agree to some seven digits
            shape(i="planning_year known_race_count", s="team_slug weight_fit_method prior_source", f4=" ".join(PROFILE_AXES) + " objective", f0="mae rmse baseline_rmse season_gap"),
            fit_oracle.weight_fit(),
        ),
        "fit_statistics": Query(
            lambda s, d: weight_fit.fit_statistics(weight_fit.training_rows(_ev(s, d), ad.team_profiles(s, d))).withColumns(
                {"gc_mean": F.col("m1")[2], "one_day_square": F.col("m2")[0], "sprint_target": F.col("b")[5]}
            ),
            shape(i="planning_year known_race_count", s="team_slug", f4="s0 c0 c1 gc_mean one_day_square sprint_target"),
            sql.with_ctes(
                sql.EV,
                """exposed AS (SELECT *, coalesce(base_opportunity_points, 0) * coalesce(participation_confidence, 0) * coalesce(execution_multiplier, 0) AS exposure,
                sqrt(greatest(actual_points, 0.0) + 1.0) AS r FROM ev WHERE actual_points IS NOT NULL)""",
                "errs AS (SELECT *, fit_floor - CASE WHEN exposure > 0 THEN least(greatest(actual_points / exposure, fit_floor), 1.0) ELSE fit_floor END AS e FROM exposed)",
                select="""SELECT team_slug, planning_year, count(*) AS known_race_count, sum(r) AS s0, sum(r * e) AS c0, sum(r * e * e) AS c1, sum(r * fit_range * coalesce(gc_signal, 0)) AS gc_mean,
                sum(r * fit_range * coalesce(one_day_signal, 0) * fit_range * coalesce(one_day_signal, 0)) AS one_day_square, sum(r * e * fit_range * coalesce(sprint_bonus_signal, 0)) AS sprint_target FROM errs GROUP BY 1, 2""",
            ),
        ),
        # as above: the last digits of the fit differ
        "weight_refit_ev": Query(_refit, {**key, **shape(f4="team_fit_multiplier", f1="expected_points")}, fit_oracle.weight_refit_ev()),
    }


def _freshness(s: SparkSession, d: str) -> DataFrame:
    calendar = ad.intervals(s, d).select("team_slug", "planning_year", F.col("start_date").alias("scraped_at_utc"))
    summary = calendar.select("team_slug", "planning_year").distinct().withColumn("as_of_date", F.lit("2024-01-30"))
    return views.freshness_drift(summary, calendar)


def _actual_rows(s: SparkSession, d: str) -> DataFrame:
    key = F.col("supplier")
    season = checkpointed(ad.season_points(s, d))
    calendar = ad.team_calendars(s, d, season)
    supplier = F.regexp_extract("pcs_race_slug", "([0-9]+)$", 1).cast("long")
    calendar = calendar.withColumn("pcs_race_slug", F.when(supplier % 6 == 5, "").otherwise(F.col("pcs_race_slug")))
    fetched = season.where(key % 6 != 5).select(
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("team_slug"), F.lit(ad.PLANNING_YEAR).alias("planning_year"),
        F.concat(F.lit("race-"), key.cast("string")).alias("pcs_race_slug"),
        F.round("points", 2).alias("actual_points"), F.col("riders").alias("rider_count"),
        (key % 6 != 3).alias("has_rows"), F.when(key % 6 == 4, "RuntimeError").alias("error"), F.lit("").alias("source_url"),
    )
    return views.actual_points_rows(calendar, fetched, F.lit(ad.AS_OF).cast("timestamp"))


def _refit(s: SparkSession, d: str) -> DataFrame:
    calendars, history, actuals = _ev_inputs(s, d)
    calendars = checkpointed(calendars)  # valued twice
    valued = lambda profiles: ev.team_calendar_ev(calendars, history, profiles, actuals, ad.AS_OF)
    fits = checkpointed(weight_fit.fit_strength_weights(valued(ad.team_profiles(s, d)), ad.team_profiles(s, d)))
    return valued(weight_fit.apply_fit(ad.team_profiles(s, d), fits))


def _risk_queries() -> dict[str, Query]:
    placed = sql.with_ctes(sql.CONTRIBUTIONS, select="SELECT * FROM placed_riders")
    rider = shape(i="team_rank", s="team_slug rider_name rider_slug season_years", f4="points_counted points_not_counted sanction_points")
    rolled = lambda s, d: risk.rider_roll_up(ad.contributions(s, d)).where("NOT is_placeholder_team_row")
    return {
        "rider_rollup": Query(rolled, rider, placed),
        "rider_running_share": Query(
            lambda s, d: risk.team_detail(ad.contributions(s, d)), shape(i="team_rank_within_counted_list", s="team_slug rider_name", f6="share_of_team cumulative_share", f4="share_pct cumulative_share_pct"),
            sql.with_ctes(
                sql.CONTRIBUTIONS,
                "running AS (SELECT *, sum(share_of_team) OVER (PARTITION BY team_slug ORDER BY team_rank_within_counted_list ROWS UNBOUNDED PRECEDING) AS cumulative_share FROM placed_riders)",
                select="SELECT *, share_of_team * 100 AS share_pct, cumulative_share * 100 AS cumulative_share_pct FROM running",
            ),
        ),
        "concentration_risk": Query(
            lambda s, d: risk.concentration_risk(ad.contributions(s, d)),
            shape(
                i="team_rank counted_riders_found", s="team_slug leader_name risk_band data_check",
                f4="team_total_points ranking_total_points leader_points leader_shock_remaining_points leader_coleader_shock_remaining_points reconciliation_gap sanction_points_total effective_contributors",
                f6="top1_share top3_share top5_share leader_coleader_shock_drop_pct",
            ),
            sql.with_ctes(sql.RISK, select="SELECT * FROM risk"),
        ),
        "risk_key_figures": Query(
            lambda s, d: views.risk_key_figures(risk.concentration_risk(ad.contributions(s, d))), shape(i="teams high_risk_teams", f4="median_top1_share_pct max_top1_share_pct median_effective_contributors"),
            sql.with_ctes(
                sql.RISK,
                select="""SELECT count(*) AS teams, count(*) FILTER (WHERE risk_band = 'High') AS high_risk_teams, median(round(top1_share * 100, 1)) AS median_top1_share_pct,
                max(round(top1_share * 100, 1)) AS max_top1_share_pct, median(effective_contributors) AS median_effective_contributors FROM risk""",
            ),
        ),
    }


def _calendar_queries() -> dict[str, Query]:
    built = sql.with_ctes(
        sql.CASCADE,
        """raced AS (SELECT DISTINCT c.team_slug, c.season AS planning_year, matched_race_id AS race_id, p.race_name, p.start_date, p.end_date
        FROM cascade c LEFT JOIN planned p ON p.race_id = matched_race_id AND p.season = c.season WHERE matched_race_id IS NOT NULL)""",
        """described AS (SELECT r.*, CASE WHEN p.race_id % 2 = 0 THEN '1.1' ELSE '2.1' END AS category,
        strftime(r.start_date, '%d.%m') || CASE WHEN r.end_date > r.start_date THEN '-' || strftime(r.end_date, '%d.%m') ELSE '' END AS date_label FROM raced r JOIN planned p ON p.race_id = r.race_id AND p.season = r.planning_year)""",
        """unplanned AS (SELECT c.team_slug, c.season AS planning_year, matched_race_id AS race_id, first(canonical_race_name ORDER BY source_race_name) AS race_name
        FROM cascade c ANTI JOIN planned p ON p.race_id = matched_race_id AND p.season = c.season WHERE matched_race_id IS NOT NULL GROUP BY 1, 2, 3)""",
        """all_races AS (SELECT team_slug, planning_year, race_id, race_name, start_date, end_date, category, date_label FROM described
        UNION ALL SELECT team_slug, planning_year, race_id, race_name, NULL, NULL, NULL, NULL FROM unplanned)""",
        """reach AS (SELECT *, max(end_date) OVER (PARTITION BY team_slug, planning_year ORDER BY start_date NULLS LAST, end_date NULLS LAST, race_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM all_races)""",
        """grp AS (SELECT *, sum(CASE WHEN start_date IS NULL OR reached IS NULL OR start_date > reached THEN 1 ELSE 0 END) OVER (PARTITION BY team_slug, planning_year ORDER BY start_date NULLS LAST, end_date NULLS LAST, race_id ROWS UNBOUNDED PRECEDING) AS gid FROM reach)""",
        select="""SELECT *, month(start_date) AS month, CASE WHEN end_date < DATE '1998-07-01' THEN 'completed' ELSE 'scheduled' END AS status, 'active' AS team_calendar_status,
        CASE WHEN count(*) OVER (PARTITION BY team_slug, planning_year, gid) > 1 THEN 'overlap_' || count(*) OVER (PARTITION BY team_slug, planning_year, gid) ELSE '' END AS overlap_group FROM grp""",
    )
    text_names = lambda s, d: ad.table(s, d, "documents").select("doc_id", normalise_name(F.col("text")).alias("normalized"))
    tokens = lambda s, d: text_names(s, d).select("doc_id", tokens_of(F.col("normalized")).alias("t")).select(
        "doc_id", F.size("t").alias("token_count"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5")
    )
    variants = lambda s, d: ad.planned_races(s, d).select("race_id", F.array_join(name_variants(F.col("race_name")), "|").alias("variants"))
    return {
        "normalize_name": Query(
            lambda s, d: text_names(s, d).select("doc_id", F.length("normalized").alias("length"), F.md5(F.col("normalized").cast("binary")).alias("normalized_md5")),
            shape(i="doc_id length", s="normalized_md5"),
            f"SELECT doc_id, length(n) AS length, md5(n) AS normalized_md5 FROM (SELECT doc_id, {sql.norm('text')} AS n FROM documents)",
        ),
        "name_tokens": Query(
            tokens, shape(i="doc_id token_count", s="tokens_md5"),
            f"SELECT doc_id, len(t) AS token_count, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {sql.tokens(sql.norm('text'))} AS t FROM documents)",
        ),
        "name_variants": Query(
            variants, shape(i="race_id", s="variants"),
            sql.with_ctes(
                sql.NAMES,
                f"spelled AS (SELECT race_id, unnest({sql.variants('race_name')}) AS v, generate_subscripts({sql.variants('race_name')}, 1) AS i FROM planned)",
                select="SELECT race_id, string_agg(v, '|' ORDER BY i) AS variants FROM (SELECT race_id, v, min(i) AS i FROM spelled WHERE v <> '' GROUP BY 1, 2) GROUP BY 1",
            ),
        ),
        "alias_match": Query(
            _alias_hits, shape(i="planning_year race_id", s="team_slug source_race_name observed_date canonical"),
            sql.with_ctes(sql.NAMES, select="SELECT *, season AS planning_year, coalesce(CAST(day AS VARCHAR), '') AS observed_date FROM alias_hits"),
        ),
        "variant_match": Query(
            lambda s, d: matching.variant_matches(*_programme_names(s, d)), shape(i="planning_year variant_race_id", s="source_race_name variant_name"),
            sql.with_ctes(sql.NAMES, select="SELECT season AS planning_year, source_race_name, race_id AS variant_race_id, race_name AS variant_name FROM variant_hits"),
        ),
        "token_overlap_match": Query(
            lambda s, d: matching.overlap_matches(*_programme_names(s, d)), shape(i="planning_year overlap_race_id", s="normalized_name observed_date overlap_name"),
            sql.with_ctes(
                sql.NAMES,
                select="SELECT season AS planning_year, normalized_name, coalesce(CAST(day AS VARCHAR), '') AS observed_date, race_id AS overlap_race_id, race_name AS overlap_name FROM overlap_hits",
            ),
        ),
        "match_cascade": Query(
            lambda s, d: _matched(s, d).select("team_slug", "planning_year", "source_race_name", F.coalesce("observed_date", F.lit("")).alias("observed_date"), "matched_race_id", "canonical_race_name", "matched_via", "match_status").distinct(),
            shape(i="planning_year matched_race_id", s="team_slug source_race_name observed_date canonical_race_name matched_via match_status"),
            sql.with_ctes(sql.CASCADE, select="SELECT *, season AS planning_year, coalesce(CAST(day AS VARCHAR), '') AS observed_date FROM cascade"),
        ),
        "team_calendar_build": Query(
            lambda s, d: cal.calendar_from_programme(ad.programme(s, d), *_plans(s, d), "1998-07-01"),
            shape(i="planning_year race_id month", s="team_slug race_name category date_label start_date end_date status team_calendar_status overlap_group"),
            built,
        ),
        "season_refresh": Query(
            _refreshed_season,
            shape(i="planning_year race_id month", s="team_slug race_name category date_label start_date end_date status team_calendar_status overlap_group"),
            built,
        ),
        "date_label_parse": Query(
            lambda s, d: ad.planned_races(s, d).withColumn("x", label_dates(F.col("date_label"), F.col("year"))).select("race_id", "date_label", "x.*"),
            shape(i="race_id", s="date_label start_date end_date error"),
            sql.with_ctes(
                sql.NAMES,
                select="""SELECT race_id, strftime(start_date, '%d.%m') || CASE WHEN end_date > start_date THEN '-' || strftime(end_date, '%d.%m') ELSE '' END AS date_label, start_date, end_date, NULL AS error FROM planned""",
            ),
        ),
        "status_as_of": Query(
            lambda s, d: cal.prepare_planning(ad.planned_races(s, d)).select("race_id", "end_date", _status("1998-07-01").alias("status")),
            shape(i="race_id", s="end_date status"),
            sql.with_ctes(sql.NAMES, select="SELECT race_id, end_date, CASE WHEN end_date < DATE '1998-07-01' THEN 'completed' ELSE 'scheduled' END AS status FROM planned"),
        ),
        "overlap_groups": Query(
            lambda s, d: cal.with_overlap_groups(ad.intervals(s, d)), shape(i="race_id overlap_group_id", s="team_slug overlap_group"),
            sql.with_ctes(sql.INTERVALS, select="SELECT * FROM labelled"),
        ),
        "schedule_diff": Query(
            lambda s, d: cal.schedule_changes(*ad.snapshots(s, d), F.lit("2002-01-01").cast("timestamp")),
            shape(i="planning_year race_id", s="team_slug race_name change_type old_value new_value notes"),
            sql.with_ctes(sql.SNAPSHOTS, select="SELECT * FROM changes"),
        ),
        "url_slug": Query(
            lambda s, d: ad.table(s, d, "pages").select("page_id", race_slug(F.concat(F.lit("race/"), F.regexp_replace("url", "^https?://", ""))).alias("slug"), race_slug(F.col("url")).alias("absolute_slug")),
            shape(i="page_id", s="slug absolute_slug"),
            """SELECT page_id, CASE WHEN len(string_split(p, '/')) >= 4 THEN string_split(p, '/')[2] ELSE '' END AS slug,
            CASE WHEN len(string_split(q, '/')) >= 4 AND string_split(q, '/')[1] = 'race' THEN string_split(q, '/')[2] ELSE '' END AS absolute_slug
            FROM (SELECT page_id, regexp_replace('race/' || regexp_replace(url, '^https?://', ''), '/+$', '') AS p,
            regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '[?#].*$', ''), '^/+|/+$', '', 'g') AS q FROM pages)""",
        ),
        "page_headings": Query(
            lambda s, d: pages.page_marks(ad.table(s, d, "pages")).select("page_id", "title", F.size("stage_ids").alias("stage_count")), shape(i="page_id stage_count", s="title"),
            """SELECT page_id, 0 AS stage_count, trim(regexp_replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages""",
        ),
    }


def _status(day: str):
    from echelon.functions.dates import status_as_of

    return status_as_of(F.col("end_date"), day)


def _refreshed_season(s: SparkSession, d: str) -> DataFrame:
    """The calendars of all teams after two builds: one before every third programme row was known, and one that repairs it.

    The second build matches only the teams whose rows changed, publishes the next snapshot, and the calendars are read back.
    """
    programme = checkpointed(ad.programme(s, d))
    # read by the fingerprints and by the build, twice each
    (planning, aliases), editions = _plans(s, d), checkpointed(ad.editions(s, d))
    teams = checkpointed(programme.groupBy("team_slug", "planning_year").agg(F.max("team_name").alias("team_name")))
    prior = ARCHETYPES["balanced_opportunist"]["strength_weight_prior"]
    profiles = teams.select(
        "team_slug", "planning_year", "team_name", map_literal(prior).alias("strength_weights"), F.lit(0.7).alias("team_fit_floor"), F.lit(0.3).alias("team_fit_range"),
        map_literal(EXECUTION_RULES).alias("execution_rules"), map_literal(PARTICIPATION_RULES).alias("participation_rules"), F.lit("balanced_opportunist").alias("archetype_key"),
        F.lit("").alias("archetype_label"), F.lit("").alias("archetype_description"), F.lit("medium").alias("profile_confidence"), F.lit("v1").alias("profile_version"),
        F.array(F.lit("The same for all teams.")).alias("profile_rationale"),
    )
    root = f"{shared_folder(s)}/season-{uuid.uuid4().hex}"
    early = programme.where((F.col("l_orderkey") % 3 != 0) | (F.substring("team_slug", 6, 9).cast("int") % 2 == 0))
    for rows in (early, programme):
        incremental.refresh_season(s, root, teams, rows, planning, aliases, editions, profiles, None, 1998, "1998-07-01", F.lit("1998-07-01").cast("timestamp"))
    return incremental.season_table(s, root, "team_calendar")


def _alias_hits(s: SparkSession, d: str) -> DataFrame:
    names, _ = _programme_names(s, d, "team_slug")
    hits = matching.alias_matches(names, matching.prepare_aliases(ad.race_aliases(s, d)))
    return names.join(shuffled(hits), ["team_slug", "planning_year", "normalized_name"]).withColumnsRenamed({"alias_race_id": "race_id", "alias_name": "canonical"})


ARCHETYPE_OF_PROFILE = ",\n".join(
    [
        "long AS (SELECT team_slug, planning_year, unnest([" + sql.quoted(PROFILE_AXES) + "]) AS axis, unnest([" + ", ".join(PROFILE_AXES) + "]) AS w FROM profiles)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY team_slug ORDER BY w DESC, axis) AS rn FROM long)",
        "tops AS (SELECT team_slug, max(axis) FILTER (WHERE rn = 1) AS t, max(w) FILTER (WHERE rn = 1) AS tw, max(axis) FILTER (WHERE rn = 2) AS s, max(w) FILTER (WHERE rn = 2) AS sw FROM ranked GROUP BY 1)",
        """archetypes AS (SELECT p.team_slug, planning_year, CASE WHEN t = 'sprint_bonus' AND tw - sw >= 0.08 THEN 'sprint_first' WHEN t = 'time_trial' AND tw >= 0.22 THEN 'time_trial_edge'
        WHEN least(t, s) = 'one_day' AND greatest(t, s) = 'sprint_bonus' THEN 'classic_sprint_opportunist'
        WHEN t = 'one_day' AND one_day - greatest(gc, stage_hunter) >= 0.08 THEN 'classic_specialist' WHEN t = 'stage_hunter' AND gc <= 0.2 THEN 'stage_hunter'
        WHEN gc + all_round >= 0.45 AND t IN ('gc', 'all_round') THEN 'gc_development' ELSE 'balanced_opportunist' END AS archetype_key FROM profiles p JOIN tops USING (team_slug))""",
    ]
)


def _profile_queries() -> dict[str, Query]:
    axes = " ".join(PROFILE_AXES)
    return {
        "archetype_inference": Query(
            lambda s, d: ad.team_profiles(s, d), shape(i="planning_year", s="team_slug archetype_key"),
            sql.with_ctes(
                sql.PROFILES, ARCHETYPE_OF_PROFILE, select="SELECT * FROM archetypes",
            ),
        ),
        "profile_merge": Query(
            _merged_profiles, shape(i="planning_year", s="team_slug pcs_team_slug team_name", f6=axes + " team_fit_floor team_fit_range uwt_execution"),
            """SELECT 'nation-' || n_nationkey AS team_slug, 'nation-' || n_nationkey || '-2001' AS pcs_team_slug, 'Nation ' || n_nationkey AS team_name, 2001 AS planning_year,
            CASE WHEN n_nationkey % 3 = 0 THEN 0.5 ELSE 0.18 END AS one_day, 0.15 AS stage_hunter, 0.15 AS gc, 0.05 AS time_trial, 0.22 AS all_round, CASE WHEN n_nationkey % 3 = 0 THEN 0.1 ELSE 0.25 END AS sprint_bonus,
            CASE WHEN n_nationkey % 2 = 0 THEN 0.6 ELSE 0.7 END AS team_fit_floor, 0.3 AS team_fit_range, 0.18 AS uwt_execution FROM nation""",
        ),
        "profile_strengths": Query(
            lambda s, d: prof.strength_table(ad.team_profiles(s, d)), shape(i="planning_year axis_order", s="team_slug axis_key axis", f6="weight"),
            sql.with_ctes(
                sql.PROFILES,
                select="SELECT team_slug, planning_year, unnest([" + ", ".join(str(i) for i in range(6)) + "]) AS axis_order, unnest([" + sql.quoted(PROFILE_AXES) + "]) AS axis_key, unnest(["
                + sql.quoted(prof.PROFILE_AXIS_LABELS.values()) + "]) AS axis, unnest([" + ", ".join(PROFILE_AXES) + "]) AS weight FROM profiles",
            ),
        ),
        "profile_validation": Query(
            lambda s, d: prof.validated_profiles(_flawed_profiles(s, d)).select("team_slug", "planning_year", F.size("errors").alias("error_count"), F.array_join("errors", " ").alias("errors")),
            shape(i="planning_year error_count", s="team_slug errors"),
            """SELECT 'nation-' || n_nationkey AS team_slug, 2001 AS planning_year, len(string_split(e, '|')) - CASE WHEN e = '' THEN 1 ELSE 0 END AS error_count, replace(e, '|', ' ') AS errors
            FROM (SELECT n_nationkey, CASE n_nationkey % 13 WHEN 1 THEN 'team_fit_floor must be between 0 and 1.' WHEN 2 THEN 'profile_confidence must be one of: experimental, high, low, medium.'
            WHEN 3 THEN 'team_fit_range must be between 0 and 1.' WHEN 4 THEN 'Team profile missing strength weights for: gc'
            WHEN 5 THEN 'strength_weights.gc must be between 0 and 1.|Strength weights must sum to about 1.0.' WHEN 6 THEN 'Strength weights must sum to about 1.0.'
            WHEN 7 THEN 'Unknown archetype_key `nobody`.' WHEN 8 THEN 'archetype_label `Wrong` does not match catalog label `GC Development Team`.'
            WHEN 9 THEN 'Unknown archetype_key `nobody`.|archetype_description must not be blank.' WHEN 10 THEN 'execution_rules must be numbers between 0 and 1.'
            WHEN 11 THEN 'participation_rules must be numbers between 0 and 1.' WHEN 12 THEN 'strength_weights.gc must be between 0 and 1.|Strength weights must sum to about 1.0.' ELSE '' END AS e FROM nation)""",
        ),
        "profile_description": Query(
            lambda s, d: prof.profile_descriptions(ad.team_profiles(s, d)).withColumn("reasons", F.array_join("profile_rationale", "|")),
            shape(i="planning_year", s="team_slug archetype_key archetype_label archetype_color profile_confidence reasons"),
            sql.with_ctes(
                sql.PROFILES, ARCHETYPE_OF_PROFILE,
                "catalog AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v['label']}', '{v['color']}')" for k, v in ARCHETYPES.items()) + ") AS c(archetype_key, archetype_label, archetype_color))",
                select="SELECT *, 'medium' AS profile_confidence, 'Derived from the nation key.' AS reasons FROM archetypes JOIN catalog USING (archetype_key)",
            ),
        ),
        "profile_comparison": Query(
            lambda s, d: prof.compare_profiles(ad.team_profiles(s, d), map_literal({"one_day": 2.0, "gc": 1.0, "sprint_bonus": 1.0}), SANDBOX),
            shape(i="planning_year axis_order", s="team_slug axis", f6="default_profile saved_artifact sandbox"),
            sql.with_ctes(
                sql.PROFILES,
                select="SELECT team_slug, planning_year, unnest([" + ", ".join(str(i) for i in range(6)) + "]) AS axis_order, unnest([" + sql.quoted(prof.PROFILE_AXIS_LABELS.values()) + "]) AS axis, "
                "unnest([0.4, 0.1, 0.1, 0.05, 0.15, 0.2]) AS default_profile, unnest([" + ", ".join(PROFILE_AXES) + "]) AS saved_artifact, unnest([0.5, 0.0, 0.25, 0.0, 0.0, 0.25]) AS sandbox FROM profiles",
            ),
        ),
        "run_metadata": Query(
            _metadata, shape(i="planning_year artifact_row_count", s="team_slug team_name archetype_key fit_reason own_reason other_reason", f6="efficiency_weight floor"),
            sql.with_ctes(
                sql.PROFILES, ARCHETYPE_OF_PROFILE,
                select="""SELECT a.team_slug, a.planning_year, p.team_name, archetype_key, n AS artifact_row_count, 0.5 AS efficiency_weight, fit_floor AS floor,
                CASE WHEN k % 2 = 0 THEN 'own fit' ELSE 'general' END AS fit_reason, CASE WHEN k % 3 = 0 THEN 'own gc' ELSE 'general' END AS own_reason, CASE WHEN k % 3 = 0 THEN NULL ELSE 'general' END AS other_reason
                FROM archetypes a JOIN profiles p ON a.team_slug = p.team_slug
                JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = k""",
            ),
        ),
        "scenario_assumptions": Query(
            lambda s, d: scenarios.assumption_table(ad.team_profiles(s, d)), shape(i="planning_year setting_order", s="team_slug scenario_key setting", f6="saved_value scenario_value"),
            sql.with_ctes(sql.PROFILES, select=" UNION ALL ".join(_assumption_rows())),
        ),
        "weight_explainer": Query(
            lambda s, d: prof.weight_explainer(ad.team_profiles(s, d)), shape(i="planning_year item_order", s="team_slug section item", f6="value"),
            sql.with_ctes(sql.PROFILES, select=" UNION ALL ".join(_explainer_rows())),
        ),
    }


def _assumption_rows() -> list[str]:
    from echelon.constants import PARTICIPATION_RULES

    rows = []
    for key, preset in SCENARIO_PRESETS.items():
        over = preset["profile_overrides"]
        entries = [
            ("Team-fit floor", "fit_floor", over.get("team_fit_floor", "fit_floor")),
            ("Team-fit range", "fit_range", over.get("team_fit_range", "fit_range")),
        ]
        for rule, label in scenarios._PARTICIPATION_LABELS.items():
            entries.append((label, PARTICIPATION_RULES[rule], over.get("participation_rules", PARTICIPATION_RULES)[rule]))
        for order, (label, saved, scenario) in enumerate(entries):
            rows.append(
                f"SELECT team_slug, planning_year, '{key}' AS scenario_key, {order} AS setting_order, '{label}' AS setting, "
                f"CAST({saved} AS DOUBLE) AS saved_value, CAST({scenario} AS DOUBLE) AS scenario_value FROM profiles"
            )
    return rows


def _explainer_rows() -> list[str]:
    from echelon.constants import EV_WEIGHTS, EXECUTION_RULES, PARTICIPATION_RULES

    sections = {
        "opportunity": list(EV_WEIGHTS.items()),
        "strength": [(a, a) for a in sorted(PROFILE_AXES)],
        "execution": sorted(EXECUTION_RULES.items()),
        "participation": sorted(PARTICIPATION_RULES.items()),
    }
    return [
        f"SELECT team_slug, planning_year, '{section}' AS section, {i} AS item_order, '{name}' AS item, CAST({value} AS DOUBLE) AS value FROM profiles"
        for section, items in sections.items()
        for i, (name, value) in enumerate(items)
    ]


def _merged_profiles(s: SparkSession, d: str) -> DataFrame:
    nation, key = ad.table(s, d, "nation"), F.col("n_nationkey")
    slug = F.concat(F.lit("nation-"), key.cast("string"))
    tracked = nation.select(
        F.concat(slug, F.lit("-2001")).alias("team_slug"), F.concat(slug, F.lit("-2001")).alias("pcs_team_slug"),
        F.concat(F.lit("Nation "), key.cast("string")).alias("team_name"), F.lit(2001).alias("planning_year"),
    )
    region = ad.table(s, d, "region").where("r_regionkey = 0")
    defaults = region.select(
        map_literal({"one_day": 0.18, "stage_hunter": 0.15, "gc": 0.15, "time_trial": 0.05, "all_round": 0.22, "sprint_bonus": 0.25}).alias("strength_weights"),
        map_literal({"1.1": 0.4, "1.UWT": 0.18}).alias("execution_rules"), map_literal({"completed": 1.0}).alias("participation_rules"),
        F.lit(0.7).alias("team_fit_floor"), F.lit(0.3).alias("team_fit_range"),
    )
    own = nation.select(
        F.concat(slug, F.lit("-2001")).alias("team_slug"), F.lit(2001).alias("planning_year"),
        F.when(key % 3 == 0, map_literal({"one_day": 0.5, "sprint_bonus": 0.1})).alias("strength_weights"),
        F.lit(None).cast("map<string,double>").alias("execution_rules"), F.lit(None).cast("map<string,double>").alias("participation_rules"),
        F.when(key % 2 == 0, F.lit(0.6)).alias("team_fit_floor"), F.lit(None).cast("double").alias("team_fit_range"),
    )
    merged = prof.merge_profiles(tracked, defaults, own)
    values = {axis: F.element_at("strength_weights", F.lit(axis)) for axis in PROFILE_AXES}
    return merged.withColumns({**values, "uwt_execution": F.element_at("execution_rules", F.lit("1.UWT"))})


def _flawed_profiles(s: SparkSession, d: str) -> DataFrame:
    """Profiles that break one rule each, by the nation's key."""
    flaw = F.regexp_extract("team_slug", "([0-9]+)$", 1).cast("int") % 13
    weights = F.col("strength_weights")
    shifted = lambda by: F.transform_values(weights, lambda k, v: F.when(k == "gc", v + by).otherwise(v))
    set_gc = lambda to: F.transform_values(weights, lambda k, v: F.when(k == "gc", F.lit(to)).otherwise(v))
    return ad.team_profiles(s, d).withColumns(
        {
            "team_fit_floor": F.when(flaw == 1, F.lit(1.5)).otherwise(F.col("team_fit_floor")),
            "profile_confidence": F.when(flaw == 2, "certain").otherwise(F.col("profile_confidence")),
            "team_fit_range": F.when(flaw != 3, F.col("team_fit_range")),
            "strength_weights": F.when(flaw == 4, F.map_filter(weights, lambda k, _: k != "gc")).when(flaw == 5, set_gc(1.5)).when(flaw == 6, shifted(0.03)).when(flaw == 12, set_gc(-0.1)).otherwise(weights),
            "archetype_key": F.when(flaw.isin(7, 9), "nobody").when(flaw == 8, "gc_development").otherwise(F.col("archetype_key")),
            "archetype_label": F.when(flaw == 8, "Wrong").otherwise(F.col("archetype_label")),
            "archetype_description": F.when(flaw == 7, "text").otherwise(F.col("archetype_description")),
            "execution_rules": F.when(flaw != 10, F.col("execution_rules")),
            "participation_rules": F.when(flaw == 11, map_literal({"completed": 2.0})).otherwise(F.col("participation_rules")),
        }
    )


def _metadata(s: SparkSession, d: str) -> DataFrame:
    """Run metadata with own reasons for some teams; general reasons show as such."""
    key = F.regexp_extract("team_slug", "([0-9]+)$", 1).cast("int")
    profiles = ad.team_profiles(s, d).withColumns(
        {
            "team_fit_rationale": F.when(key % 2 == 0, "own fit"),
            "strength_weight_rationale": F.when(key % 3 == 0, F.create_map(F.lit("gc"), F.lit("own gc"))),
        }
    )
    counted = ad.table(s, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("race_count"))
    summary = counted.select(F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("team_slug"), F.lit(ad.PLANNING_YEAR).alias("planning_year"), F.lit(ad.AS_OF).alias("as_of_date"), "race_count")
    told = F.col("team_profile")
    named = lambda value: F.when(value.startswith("own"), value).when(value.isNotNull(), "general")
    return prof.run_metadata(profiles, summary).select(
        *["team_slug", "planning_year", "team_name", "artifact_row_count"], told["archetype_key"].alias("archetype_key"), told["team_fit_floor"].alias("floor"),
        F.element_at("opportunity_weights", F.lit("avg_points_efficiency")).alias("efficiency_weight"), named(told["team_fit_rationale"]).alias("fit_reason"),
        named(F.element_at(told["strength_weight_rationale"], F.lit("gc"))).alias("own_reason"), named(F.element_at(told["strength_weight_rationale"], F.lit("one_day"))).alias("other_reason"),
    )


def _backtest_queries() -> dict[str, Query]:
    scores = " ".join(backtest.COMPONENT_SCORES.values())
    metrics = "objective spearman top_k_precision top_k_value_capture"
    every = sql.evaluation(MIN_FOLD, CANDIDATES)
    evaluated = lambda s, d, c: backtest.candidate_metrics(backtest.fold_metrics(backtest.scored_folds(_folds(s, d), c)))
    return {
        "walk_forward_folds": Query(
            _folds, shape(i="test_year race_id train_editions races_compared top_k", s="target_history_id race_name train_years", f6=scores + " actual_points_efficiency actual_total_efficiency actual_finish_rate", f4="actual_top10_points"),
            sql.with_ctes(sql.folds(MIN_FOLD), select="SELECT * FROM folds"),
        ),
        "candidate_eval": Query(
            lambda s, d: backtest.fold_metrics(backtest.scored_folds(_folds(s, d), CANDIDATES)), shape(i="candidate_id test_year races_compared top_k", f6=metrics),
            sql.with_ctes(every, select="SELECT * FROM fold_metrics"),
        ),
        "calibration_leaderboard": Query(
            lambda s, d: backtest.with_candidate_weights(backtest.leaderboard(evaluated(s, d, CANDIDATES)), CANDIDATES),
            shape(i="candidate_id", f6=metrics + " " + " ".join(OPPORTUNITY_WEIGHTS)),
            sql.with_ctes(
                every,
                select="SELECT *, " + ", ".join(f"w_{n} AS {n}" for n in OPPORTUNITY_WEIGHTS)
                + " FROM evaluated JOIN candidates USING (candidate_id) ORDER BY round(objective, 9) DESC, round(spearman, 9) DESC, round(top_k_value_capture, 9) DESC, candidate_id LIMIT 20",
            ),
        ),
        "calibration_best": Query(
            lambda s, d: backtest.best_candidate(evaluated(s, d, CANDIDATES)), shape(i="candidate_id", f6=metrics),
            sql.with_ctes(every, select="SELECT * FROM evaluated ORDER BY round(objective, 9) DESC, candidate_id LIMIT 1"),
        ),
        "weight_comparison": Query(
            lambda s, d: backtest.weight_comparison(backtest.with_candidate_weights(evaluated(s, d, CANDIDATES), CANDIDATES)), shape(s="weight_set", f6=metrics + " " + " ".join(OPPORTUNITY_WEIGHTS)),
            sql.with_ctes(
                every,
                "chosen AS (SELECT 'Default' AS weight_set, 0 AS candidate_id UNION ALL SELECT * FROM (SELECT 'Calibrated', candidate_id FROM evaluated ORDER BY round(objective, 9) DESC, candidate_id LIMIT 1))",
                select="SELECT *, " + ", ".join(f"w_{n} AS {n}" for n in OPPORTUNITY_WEIGHTS) + " FROM chosen JOIN evaluated USING (candidate_id) JOIN candidates USING (candidate_id)",
            ),
        ),
        "backtest_detail": Query(
            _backtest_detail, shape(i="candidate_id test_year predicted_rank actual_rank train_editions", s="weight_set target_history_id train_years", f6="predicted_score actual_points_efficiency"),
            sql.with_ctes(
                every,
                "chosen AS (SELECT 'Default' AS weight_set, 0 AS candidate_id UNION ALL SELECT * FROM (SELECT 'Calibrated', candidate_id FROM evaluated ORDER BY round(objective, 9) DESC, candidate_id LIMIT 1))",
                select="SELECT * FROM each_rank JOIN chosen USING (candidate_id)",
            ),
        ),
        "spearman_by_group": Query(
            lambda s, d: ranking.spearman(ad.editions(s, d), "top10_points", "total_field_form", ["race_id", "year"], ["category", "year"]), shape(i="year", s="category", f6="spearman"),
            sql.with_ctes(
                sql.EDITIONS,
                """rk AS (SELECT category, year, rank() OVER (PARTITION BY category, year ORDER BY top10_points) + (count(*) OVER (PARTITION BY category, year, top10_points) - 1) / 2.0 AS a,
                rank() OVER (PARTITION BY category, year ORDER BY total_field_form) + (count(*) OVER (PARTITION BY category, year, total_field_form) - 1) / 2.0 AS b FROM editions)""",
                select="SELECT category, year, CASE WHEN count(*) < 2 OR min(a) = max(a) OR min(b) = max(b) THEN 0.0 ELSE corr(a, b) END AS spearman FROM rk GROUP BY 1, 2",
            ),
        ),
        "topk_precision": Query(
            _topk_precision, shape(i="year hits", f6="precision"),
            sql.with_ctes(
                sql.EDITIONS,
                """pk AS (SELECT year, row_number() OVER (PARTITION BY year ORDER BY top10_points DESC, race_id) AS a, row_number() OVER (PARTITION BY year ORDER BY points_per_top10_form DESC, race_id) AS b FROM editions)""",
                select="SELECT year, count(*) FILTER (WHERE a <= 10 AND b <= 10) AS hits, count(*) FILTER (WHERE a <= 10 AND b <= 10) / 10.0 AS precision FROM pk GROUP BY 1",
            ),
        ),
    }


def _backtest_detail(s: SparkSession, d: str) -> DataFrame:
    """The folds under the default weights (the first candidate) and under the best of all candidates."""
    folds = _folds(s, d)
    scored = backtest.scored_folds(folds, CANDIDATES)
    best = backtest.best_candidate(backtest.candidate_metrics(backtest.fold_metrics(scored))).first()
    detail = lambda id, name: backtest.fold_detail(scored, folds, id).withColumns({"candidate_id": F.lit(id), "weight_set": F.lit(name)})
    # without a fold there is no best candidate, and no row either way
    return detail(0, "Default").unionByName(detail(best["candidate_id"] if best else 0, "Calibrated"))


def _topk_precision(s: SparkSession, d: str) -> DataFrame:
    """How many of the ten richest editions of a year are among its ten most efficient."""
    rows = ad.editions(s, d).select("race_id", "year", "top10_points", "points_per_top10_form")
    rich = top_rows(rows, ["year"], [F.desc("top10_points"), F.col("race_id")], 10).select("year", "race_id")
    efficient = top_rows(rows, ["year"], [F.desc("points_per_top10_form"), F.col("race_id")], 10).select("year", "race_id", F.lit(1).alias("hit"))
    return rich.join(efficient, ["year", "race_id"], "left").groupBy("year").agg(F.count("hit").alias("hits")).withColumn("precision", F.col("hits") / 10.0)


def registered() -> dict[str, Query]:
    return {
        **_editions_queries(), **_target_queries(), **_history_queries(), **_ev_queries(), **_risk_queries(), **_calendar_queries(),
        **_profile_queries(), **_backtest_queries(), **page_queries(), **file_queries(_ev),
    }
