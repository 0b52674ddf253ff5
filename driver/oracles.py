"""The registered queries as plain SQL over the given tables (text fragments and one statement per query)."""

from __future__ import annotations

from echelon.constants import (
    CATEGORY_DISPLAY_ORDER, EV_WEIGHTS, EXECUTION_RULES, HISTORY_MEASURES, NAME_STOP_WORDS, OPPORTUNITY_SOURCES,
    OPPORTUNITY_WEIGHTS, PARTICIPATION_RULES, PROFILE_AXES, ROUTE_LABELS, SCENARIO_PRESETS, TARGET_CATEGORIES,
)
from echelon.functions.columns import normalised

AXES = list(PROFILE_AXES)


def with_ctes(*blocks: str, select: str) -> str:
    return "WITH " + ",\n".join(blocks) + "\n" + select


def pct(column: str, part: str = "", reverse: bool = False) -> str:
    """Average-rank percentile of a column without nulls."""
    by = f"PARTITION BY {part}" if part else ""
    ties = f"PARTITION BY {part + ', ' if part else ''}{column}"
    ranked = f"(rank() OVER ({by} ORDER BY {column}) + (count(*) OVER ({ties}) - 1) / 2.0) / count(*) OVER ({by}) * 100.0"
    flat = f"min({column}) OVER ({by}) = max({column}) OVER ({by})"
    return f"CASE WHEN {flat} THEN 50.0 ELSE {'100.0 - ' if reverse else ''}{ranked} END"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


RACES = """races AS (
  SELECT s_suppkey AS race_id,
    s_name || CASE WHEN s_suppkey % 9 = 4 THEN ' Time Trial' WHEN s_suppkey % 9 = 7 THEN ' Chrono' ELSE '' END AS base_name,
    n_name AS race_country, CASE WHEN s_nationkey % 2 = 0 THEN '1' ELSE '2' END AS type_digit
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

EDITIONS = RACES + """,
lines AS (
  SELECT l_suppkey AS race_id, year(l_shipdate) AS year, month(l_shipdate) AS month, CAST(l_shipdate AS DATE) AS day,
    l_orderkey, l_linenumber, l_returnflag, l_extendedprice AS points, l_quantity AS starts,
    CAST(round(l_discount * 100) AS INT) AS wins, CAST(round(l_tax * 100) AS INT) AS podiums, l_linenumber AS top10s
  FROM lineitem),
formed AS (
  SELECT *, 5.0 * wins + 2.0 * greatest(podiums - wins, 0) + greatest(top10s - podiums, 0) + 0.1 * starts AS form FROM lines),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY race_id, year, l_returnflag ORDER BY points DESC, l_orderkey, l_linenumber) AS rn,
    row_number() OVER (PARTITION BY race_id, year, l_returnflag, l_linenumber ORDER BY points DESC, l_orderkey) AS rs,
    row_number() OVER (PARTITION BY race_id, year ORDER BY form DESC, l_orderkey, l_linenumber) AS rf
  FROM formed),
entries AS (
  SELECT l.race_id, year, min(month) AS month, min(day) AS first_day, count(*) AS n, any_value(base_name) AS base_name,
    any_value(race_country) AS race_country, any_value(type_digit) AS type_digit
  FROM lines l JOIN races r ON l.race_id = r.race_id GROUP BY l.race_id, year),
gc AS (
  SELECT race_id, year, count(*) AS finishers, count(*) FILTER (WHERE points > 0) AS gc_scoring_places,
    max(points) FILTER (WHERE rn = 1) AS gc_winner_points, round(sum(points) FILTER (WHERE rn <= 10), 6) AS gc_top10_points,
    round(sum(points), 6) AS gc_total_points
  FROM placed WHERE l_returnflag = 'N' GROUP BY 1, 2),
stage_pages AS (
  SELECT race_id, year, l_linenumber, count(*) FILTER (WHERE points > 0) AS scoring, max(points) FILTER (WHERE rs = 1) AS winner,
    round(sum(points) FILTER (WHERE rs <= 10), 6) AS top10, round(sum(points), 6) AS total
  FROM placed WHERE l_returnflag = 'A' GROUP BY 1, 2, 3),
stages AS (
  SELECT race_id, year, count(*) AS stage_count, sum(scoring) AS stage_scoring_places, sum(winner) AS stage_winner_points,
    sum(top10) AS stage_top10_points, sum(total) AS stage_total_points
  FROM stage_pages GROUP BY 1, 2),
startlist AS (
  SELECT race_id, year, count(*) AS startlist_size, count(*) FILTER (WHERE form > 0) AS experienced_riders,
    sum(starts) AS total_startlist_starts, sum(wins) AS total_startlist_wins, sum(podiums) AS total_startlist_podiums,
    sum(top10s) AS total_startlist_top10s, round(sum(form), 6) AS total_field_form, round(sum(form) FILTER (WHERE rf <= 10), 6) AS top10_field_form,
    round(avg(form) FILTER (WHERE rf <= 10), 6) AS avg_top10_field_form
  FROM placed GROUP BY 1, 2),
joined AS (
  SELECT e.race_id, e.year, e.month,
    base_name || CASE WHEN e.year >= 1999 AND e.race_id % 13 = 5 THEN ' Classic' ELSE '' END AS race_name,
    CASE WHEN type_digit = '1' THEN 'One-day race, ' ELSE 'Stage race, ' END || race_country AS race_subtitle,
    race_country, type_digit || '.' || CASE WHEN n >= 88 THEN 'Pro' ELSE '1' END AS category,
    CASE WHEN type_digit = '1' THEN 'One-day' ELSE 'Stage race' END AS race_type,
    finishers, gc_scoring_places, gc_winner_points, gc_top10_points, gc_total_points,
    coalesce(stage_count, 0) AS stage_count, coalesce(stage_scoring_places, 0) AS stage_scoring_places,
    coalesce(stage_winner_points, 0.0) AS stage_winner_points, coalesce(stage_top10_points, 0.0) AS stage_top10_points,
    coalesce(stage_total_points, 0.0) AS stage_total_points, s.* EXCLUDE (race_id, year)
  FROM entries e JOIN gc ON gc.race_id = e.race_id AND gc.year = e.year
  JOIN startlist s ON s.race_id = e.race_id AND s.year = e.year
  LEFT JOIN stages t ON t.race_id = e.race_id AND t.year = e.year AND type_digit = '2'),
totals AS (
  SELECT *, gc_scoring_places + stage_scoring_places AS scoring_places, gc_winner_points + stage_winner_points AS winner_points,
    gc_top10_points + stage_top10_points AS top10_points, gc_total_points + stage_total_points AS total_points FROM joined),
editions AS (
  SELECT *, CASE WHEN total_points = 0 THEN 0 ELSE gc_total_points / total_points END AS gc_points_share,
    CASE WHEN total_points = 0 THEN 0 ELSE stage_total_points / total_points END AS stage_points_share,
    CASE WHEN startlist_size = 0 THEN 0 ELSE finishers / startlist_size END AS finish_rate,
    CASE WHEN top10_field_form = 0 THEN 0 ELSE top10_points / top10_field_form END AS points_per_top10_form,
    CASE WHEN total_field_form = 0 THEN 0 ELSE total_points / total_field_form END AS points_per_total_form
  FROM totals)"""

HISTORY = EDITIONS + """,
seen AS (SELECT race_id, category, min(year * 100 + month) AS f, max(year * 100 + month) AS l FROM editions GROUP BY 1, 2),
cathist AS (
  SELECT race_id, string_agg(category, ' -> ' ORDER BY f, category) AS category_history, count(*) - 1 AS category_change_count,
    max_by(category, CAST(l AS VARCHAR) || category) AS latest_known_category FROM seen GROUP BY 1),
keyed AS (
  SELECT e.*, e.race_id || '::' || category AS target_history_id, category_history, category_change_count, latest_known_category
  FROM editions e JOIN cathist c ON e.race_id = c.race_id)"""

_PCT = ",\n    ".join(f"{pct(c, '', rev)} AS {name}_pct" for name, (c, rev) in OPPORTUNITY_SOURCES.items())
_OPPORTUNITY = " + ".join(f"{name}_pct * {w!r}" for name, w in normalised(OPPORTUNITY_WEIGHTS).items())

SPECIALTY = normalised({"one_day": 2.0, "gc": 1.0, "stage_hunter": 1.0, "time_trial": 0.5, "all_round": 1.5})
EMPHASIS = 0.25

ROUTES = """route_raw AS (
  SELECT *, regexp_matches(lower(race_name || ' ' || race_subtitle), '\\b(tt|itt|ttt|prologue|time\\s*trial|chrono|contre[- ]la[- ]montre)\\b') AS tt,
    race_type = 'One-day' AS od, race_type = 'Stage race' AS sr, least(greatest(stage_points_share, 0.0), 1.0) AS share FROM keyed),
route_parts AS (
  SELECT *, CASE WHEN od AND NOT tt THEN 1.0 ELSE 0.0 END AS r_od, CASE WHEN sr THEN 1.0 - share ELSE 0.0 END AS r_gc,
    CASE WHEN sr THEN share ELSE 0.0 END AS r_sh, CASE WHEN tt THEN 1.0 ELSE 0.0 END AS r_tt,
    CASE WHEN sr THEN 1.0 - least(abs(share - 0.15) / 0.10, 1.0) ELSE 0.0 END AS r_ar FROM route_raw),
routes AS (
  SELECT *, r_od / (r_od + r_gc + r_sh + r_tt + r_ar) AS one_day_requirement, r_gc / (r_od + r_gc + r_sh + r_tt + r_ar) AS gc_requirement,
    r_sh / (r_od + r_gc + r_sh + r_tt + r_ar) AS stage_hunter_requirement, r_tt / (r_od + r_gc + r_sh + r_tt + r_ar) AS time_trial_requirement,
    r_ar / (r_od + r_gc + r_sh + r_tt + r_ar) AS all_round_requirement,
    CASE WHEN sr AND share >= 0.18 THEN '{stage_hunter}' WHEN sr AND share <= 0.12 THEN '{gc}' WHEN tt THEN '{time_trial}'
      WHEN od THEN '{one_day}' ELSE '{balanced}' END AS route_profile FROM route_parts)""".replace(
    "{stage_hunter}", ROUTE_LABELS["stage_hunter"]
).replace("{gc}", ROUTE_LABELS["gc"]).replace("{time_trial}", ROUTE_LABELS["time_trial"]).replace(
    "{one_day}", ROUTE_LABELS["one_day"]
).replace("{balanced}", ROUTE_LABELS["balanced"])

_FIT = " + ".join(f"{name}_requirement * {w!r} * 100.0" for name, w in SPECIALTY.items())

SCORED = HISTORY + ",\n" + ROUTES + f""",
percentiles AS (SELECT *, {_PCT} FROM routes),
base_scores AS (SELECT *, {_OPPORTUNITY} AS arbitrage_score, {_FIT} AS specialty_fit_score FROM percentiles),
scored AS (
  SELECT *, {1 - EMPHASIS} * arbitrage_score + {EMPHASIS} * specialty_fit_score AS targeting_score,
    CASE WHEN top10_field_form = 0 THEN 0 ELSE top10_points / top10_field_form END AS points_efficiency_index FROM base_scores)"""

ROLL_UP = SCORED + """,
targets_all AS (
  SELECT target_history_id, max_by(race_id, year * 100 + month) AS race_id, max_by(race_name, year * 100 + month) AS race_name,
    max_by(race_country, year * 100 + month) AS race_country, max_by(category, year * 100 + month) AS category,
    max(latest_known_category) AS latest_known_category, max(category_history) AS category_history,
    max(category_change_count) AS category_change_count, max_by(race_type, year * 100 + month) AS race_type,
    max_by(route_profile, year * 100 + month) AS route_profile, count(DISTINCT year) AS years_analyzed,
    string_agg(DISTINCT CAST(year AS VARCHAR), ', ' ORDER BY CAST(year AS VARCHAR)) AS years,
    avg(targeting_score) AS avg_targeting_score, avg(arbitrage_score) AS avg_arbitrage_score,
    avg(specialty_fit_score) AS avg_specialty_fit_score, max(arbitrage_score) AS best_edition_score,
    avg(top10_points) AS avg_top10_points, avg(winner_points) AS avg_winner_points, avg(total_points) AS avg_total_points,
    avg(stage_top10_points) AS avg_stage_top10_points, avg(stage_count) AS avg_stage_count,
    avg(stage_points_share) AS avg_stage_points_share, avg(avg_top10_field_form) AS avg_top10_field_form,
    avg(total_field_form) AS avg_total_field_form, avg(finish_rate) AS avg_finish_rate,
    avg(points_efficiency_index) AS avg_points_efficiency, avg(startlist_size) AS avg_startlist_size
  FROM scored GROUP BY 1),
targets AS (SELECT * FROM targets_all WHERE category = latest_known_category)"""

PLANNING = """planning AS (
  SELECT race_id, base_name AS planning_race_name, type_digit || '.' || CASE race_id % 5 WHEN 0 THEN 'Pro' WHEN 1 THEN '2' WHEN 2 THEN 'UWT' ELSE '1' END AS planning_category,
    lpad(CAST(race_id % 28 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(race_id % 12 + 1 AS VARCHAR), 2, '0') AS planning_date_label,
    race_id % 12 + 1 AS planning_month, 2002 AS planning_year FROM races WHERE race_id % 6 <> 5)"""

OVERLAY = ROLL_UP + ",\n" + PLANNING + f""",
overlaid AS (
  SELECT t.*, p.* EXCLUDE (race_id), coalesce(planning_category IN ({quoted(TARGET_CATEGORIES)}), false) AS on_planning_calendar,
    coalesce(category = planning_category, false) AS planning_scope_match,
    CASE WHEN planning_category IS NULL THEN 'Not found on 2002 calendar'
      WHEN planning_category NOT IN ({quoted(TARGET_CATEGORIES)}) THEN 'On 2002 calendar but out of scope (' || planning_category || ')'
      WHEN category = planning_category THEN 'On 2002 .1/.Pro calendar'
      ELSE 'On 2002 .1/.Pro calendar (category changed to ' || planning_category || ')' END AS planning_calendar_status
  FROM targets t LEFT JOIN planning p ON t.race_id = p.race_id)"""


def scaled(column: str, source: str = "averages", invert: bool = False) -> str:
    low, high = f"(SELECT min({column}) FROM {source})", f"(SELECT max({column}) FROM {source})"
    flat = f"CASE WHEN {column} IS NULL THEN {'1.0' if invert else '0.0'} ELSE {'0.0' if invert else '1.0'} END"
    value = f"({column} - {low}) / ({high} - {low})"
    return (
        f"CASE WHEN {low} IS NULL THEN 0.0 WHEN {low} = {high} THEN {flat} "
        f"ELSE coalesce({'1.0 - ' + value if invert else value}, 0.0) END"
    )


SUMMARY = EDITIONS + f""",
averages AS (
  SELECT race_id, race_name, count(DISTINCT year) AS historical_years_analyzed, max_by(category, year * 100 + month) AS latest_category,
    max_by(race_type, year * 100 + month) AS race_type, avg(top10_points) AS avg_top10_points, avg(winner_points) AS avg_winner_points,
    avg(points_per_top10_form) AS avg_points_efficiency, avg(stage_top10_points) AS avg_stage_top10_points,
    avg(stage_count) AS avg_stage_count, avg(avg_top10_field_form) AS avg_top10_field_form
  FROM editions WHERE year < 2001 GROUP BY 1, 2),
scales AS (
  SELECT *, {scaled('avg_top10_field_form', invert=True)} AS field_softness_score, {scaled('avg_stage_top10_points')} AS stage_points_score,
    {scaled('avg_stage_count')} AS stage_count_score, {scaled('avg_winner_points')} AS winner_points_score,
    {scaled('avg_top10_points')} AS top10_points_score, {scaled('avg_points_efficiency')} AS efficiency_score FROM averages),
signals AS (
  SELECT *, CASE WHEN race_type = 'One-day' THEN 0.35 + 0.65 * field_softness_score ELSE 0.15 END AS one_day_signal,
    CASE WHEN race_type = 'One-day' THEN 0.0 ELSE 1.0 END AS stage_race_signal,
    CASE WHEN race_type = 'One-day' THEN 0.0 ELSE least(greatest(0.5 * winner_points_score + 0.3 * stage_count_score + 0.2 * (1.0 - field_softness_score), 0.0), 1.0) END AS gc_signal,
    CASE WHEN race_type = 'One-day' THEN 0.0 ELSE least(greatest(0.65 * stage_points_score + 0.35 * stage_count_score, 0.0), 1.0) END AS stage_hunter_signal,
    least(greatest(0.5 * CASE WHEN race_type = 'One-day' THEN 0.0 ELSE 1.0 END + 0.5 * least(greatest(1.0 - abs(field_softness_score - 0.5) * 2, 0.0), 1.0), 0.0), 1.0) AS all_round_signal,
    CASE WHEN contains(lower(race_name), 'itt') OR contains(lower(race_name), ' tt') OR contains(lower(race_name), 'chrono') OR contains(lower(race_name), 'prologue') THEN 1.0 ELSE 0.0 END AS time_trial_signal,
    least(greatest(0.75 * field_softness_score + 0.25 * stage_points_score, 0.0), 1.0) AS sprint_bonus_signal
  FROM scales),
indexed AS (
  SELECT *, least(greatest({EV_WEIGHTS['avg_points_efficiency']} * efficiency_score + {EV_WEIGHTS['avg_top10_points']} * top10_points_score
    + {EV_WEIGHTS['avg_winner_points']} * winner_points_score + {EV_WEIGHTS['avg_stage_top10_points']} * stage_points_score
    + {EV_WEIGHTS['field_softness_score']} * field_softness_score, 0.0), 1.0) AS base_opportunity_index FROM signals),
summary AS (
  SELECT *, base_opportunity_index * coalesce(avg_top10_points, 0.0) AS base_opportunity_points,
    CASE WHEN race_type = 'One-day' THEN CASE WHEN field_softness_score >= 0.5 THEN 'sprint-friendly one-day' ELSE 'hard one-day' END
      WHEN coalesce(avg_stage_count, 0.0) >= 5 THEN 'multi-stage race' ELSE 'short stage race' END AS route_profile FROM indexed)"""

BASELINES = SUMMARY + f""",
baselines AS (
  SELECT latest_category, race_type, {", ".join(f"avg({c}) AS {c}" for c in HISTORY_MEASURES)},
    min_by(route_profile, lpad(CAST(race_id AS VARCHAR), 12, '0') || race_name) AS route_profile
  FROM summary GROUP BY 1, 2)"""

CALENDAR = """season AS (
  SELECT c_nationkey, l_suppkey AS supplier, sum(l_extendedprice) AS points, min(CAST(l_shipdate AS DATE)) AS first_day, count(*) AS riders
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE year(l_shipdate) = 2001 GROUP BY 1, 2),
calendar_rows AS (
  SELECT 'nation-' || c_nationkey AS team_slug, 'Nation ' || c_nationkey AS team_name, 2001 AS planning_year,
    CASE supplier % 3 WHEN 0 THEN 'team_program_live' WHEN 1 THEN 'observed_startlist' ELSE 'calendar_seed' END AS source,
    CASE WHEN supplier % 10 = 3 THEN supplier + 1000000000 ELSE supplier END AS race_id, base_name AS race_name,
    type_digit || '.' || CASE WHEN supplier % 10 = 3 THEN 'UWT' WHEN supplier % 4 = 0 THEN 'Pro' WHEN supplier % 7 = 6 THEN '2' ELSE '1' END AS category,
    strftime(first_day, '%d.%m') AS date_label, month(first_day) AS month, first_day AS start_date,
    first_day + CAST(supplier % 5 AS INT) AS end_date,
    CASE WHEN supplier % 17 = 2 THEN 'cancelled' WHEN first_day + CAST(supplier % 5 AS INT) < DATE '2001-06-30' THEN 'completed' ELSE 'scheduled' END AS status,
    CASE WHEN supplier % 2 = 0 THEN 'matched_via=alias' ELSE '' END AS notes
  FROM season JOIN races ON supplier = race_id),
calendar_reach AS (
  SELECT *, max(end_date) OVER (PARTITION BY team_slug ORDER BY start_date, end_date, race_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM calendar_rows),
calendar_groups AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start_date > reach THEN 1 ELSE 0 END) OVER (PARTITION BY team_slug ORDER BY start_date, end_date, race_id ROWS UNBOUNDED PRECEDING) AS gid FROM calendar_reach),
calendar AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY team_slug, gid) > 1 THEN 'overlap_' || count(*) OVER (PARTITION BY team_slug, gid) ELSE '' END AS overlap_group FROM calendar_groups),
actuals AS (
  SELECT 'nation-' || c_nationkey AS team_slug, CASE WHEN supplier % 10 = 3 THEN supplier + 1000000000 ELSE supplier END AS race_id,
    round(points, 2) AS actual_points FROM season WHERE supplier % 4 <> 1)"""

PROFILES = """raw_profiles AS (
  SELECT 'nation-' || n_nationkey AS team_slug, 'Nation ' || n_nationkey AS team_name, 2001 AS planning_year, n_nationkey AS k,
    1.0 + n_nationkey * 3 % 7 AS w1, 1.0 + n_nationkey * 5 % 7 AS w2, 1.0 + n_nationkey * 2 % 5 AS w3, 1.0 + n_nationkey % 2 AS w4,
    1.0 + n_nationkey * 4 % 6 AS w5, 1.0 + n_nationkey * 6 % 9 AS w6 FROM nation),
profiles AS (
  SELECT team_slug, team_name, planning_year, k, CAST(w1 AS DOUBLE) / (w1+w2+w3+w4+w5+w6) AS one_day, CAST(w2 AS DOUBLE) / (w1+w2+w3+w4+w5+w6) AS stage_hunter,
    CAST(w3 AS DOUBLE) / (w1+w2+w3+w4+w5+w6) AS gc, CAST(w4 AS DOUBLE) / (w1+w2+w3+w4+w5+w6) AS time_trial, CAST(w5 AS DOUBLE) / (w1+w2+w3+w4+w5+w6) AS all_round,
    CAST(w6 AS DOUBLE) / (w1+w2+w3+w4+w5+w6) AS sprint_bonus, CASE WHEN k % 4 = 0 THEN 0.65 ELSE 0.70 END AS fit_floor,
    CASE WHEN k % 4 = 0 THEN 0.35 ELSE 0.30 END AS fit_range FROM raw_profiles)"""

SINGLE_HISTORY = """single AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY historical_years_analyzed DESC, race_name DESC) AS rn FROM summary) WHERE rn = 1)"""

_FILL = ",\n    ".join(f"coalesce(s.{c}, b.{c}) AS {c}" for c in ("route_profile", *HISTORY_MEASURES))

FALLBACK = BASELINES + ",\n" + CALENDAR + ",\n" + SINGLE_HISTORY + f""",
valued AS (
  SELECT c.team_slug, c.team_name, c.planning_year, c.race_id, c.race_name, c.category, c.month, c.start_date, c.end_date, c.status, c.source, c.overlap_group,
    s.historical_years_analyzed, coalesce(s.race_type, b.race_type) AS race_type, {_FILL},
    CASE WHEN s.race_id IS NOT NULL THEN c.notes
      ELSE array_to_string(list_filter([c.notes, CASE WHEN b.race_type IS NOT NULL THEN 'history_fallback_from=' || b.latest_category ELSE '' END, 'history_missing'], lambda x: x <> ''), ' | ') END AS notes
  FROM calendar c LEFT JOIN single s ON c.race_id = s.race_id
  LEFT JOIN baselines b ON s.race_id IS NULL
    AND b.latest_category = CASE c.category WHEN '1.UWT' THEN '1.Pro' WHEN '2.UWT' THEN '2.Pro' ELSE c.category END
    AND b.race_type = CASE WHEN starts_with(c.category, '1.') THEN 'One-day' ELSE 'Stage race' END)"""


def _signal(axis: str) -> str:
    return f"coalesce({axis}_signal, 0.0)"


def fit(prefix: str = "") -> str:
    specialty = " + ".join(f"{a} * {_signal(a)}" for a in AXES[:-1])
    weight = " + ".join(AXES[:-1])
    every = " + ".join(AXES)
    return f"""least(greatest(({specialty}) / ({weight}), 0.0), 1.0) AS {prefix}specialty_fit_score,
    least(greatest(sprint_bonus / ({every}) * {_signal('sprint_bonus')}, 0.0), 1.0) AS {prefix}sprint_fit_bonus,
    sprint_bonus / ({every}) AS {prefix}sprint_share"""


def participation(rules: dict[str, float]) -> str:
    sure = (
        f"CASE WHEN status = 'completed' THEN {rules['completed']} WHEN contains(source, 'startlist') THEN {rules['observed_startlist']} "
        f"WHEN contains(source, 'program') THEN {rules['program_confirmed']} ELSE {rules['calendar_seed']} END"
    )
    return f"CASE WHEN overlap_group <> '' THEN least({sure}, {rules['overlap_penalty']}) ELSE {sure} END"


_EXECUTION = "CASE category " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in EXECUTION_RULES.items()) + " ELSE 0.25 END"

EV = FALLBACK + ",\n" + PROFILES + f""",
fit_parts AS (SELECT v.*, p.* EXCLUDE (team_slug, team_name, planning_year), {fit()} FROM valued v JOIN profiles p ON v.team_slug = p.team_slug),
fit_scores AS (
  SELECT *, least(greatest((1.0 - sprint_share) * specialty_fit_score + sprint_fit_bonus, 0.0), 1.0) AS team_fit_score,
    {participation(PARTICIPATION_RULES)} AS participation_confidence, {_EXECUTION} AS execution_multiplier FROM fit_parts),
multiplied AS (SELECT *, least(greatest(fit_floor + fit_range * team_fit_score, 0.0), 1.0) AS team_fit_multiplier FROM fit_scores),
expected AS (
  SELECT *, coalesce(base_opportunity_points, 0.0) * team_fit_multiplier * participation_confidence * execution_multiplier AS expected_points FROM multiplied),
ev AS (
  SELECT e.*, a.actual_points, a.actual_points - expected_points AS ev_gap
  FROM expected e LEFT JOIN actuals a ON e.team_slug = a.team_slug AND e.race_id = a.race_id)"""


def scenario_block() -> str:
    parts = []
    for key, preset in SCENARIO_PRESETS.items():
        over = preset["profile_overrides"]
        rules = {**PARTICIPATION_RULES, **over.get("participation_rules", {})}
        floor, reach = over.get("team_fit_floor", "fit_floor"), over.get("team_fit_range", "fit_range")
        parts.append(
            f"SELECT *, '{key}' AS scenario_key, least(greatest({floor} + {reach} * team_fit_score, 0.0), 1.0) AS scenario_team_fit_multiplier, "
            f"{participation(rules)} AS scenario_participation_confidence FROM ev"
        )
    return "scenarios AS (" + " UNION ALL ".join(parts) + """),
overlay AS (
  SELECT *, coalesce(base_opportunity_points, 0.0) * scenario_team_fit_multiplier * scenario_participation_confidence * execution_multiplier AS scenario_expected_points,
    coalesce(base_opportunity_points, 0.0) * scenario_team_fit_multiplier * scenario_participation_confidence * execution_multiplier - coalesce(expected_points, 0.0) AS expected_points_delta
  FROM scenarios)"""


SCENARIOS = EV + ",\n" + scenario_block()

CONTRIBUTIONS = """team_totals AS (
  SELECT c_nationkey AS nk, round(sum(CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END), 2) AS team_total_points,
    sum(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 10.0 ELSE 0.0 END) AS sanction_points_total
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
riders AS (
  SELECT lower(n_name) AS team_slug, n_name AS team_name, n_nationkey + 1 AS team_rank, team_total_points,
    team_total_points - n_nationkey % 3 AS ranking_total_points, sanction_points_total, c_name AS rider_name, 'c-' || c_custkey AS rider_slug,
    sum(CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END) AS points_counted,
    sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0.0 END) AS points_not_counted,
    sum(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 10.0 ELSE 0.0 END) AS sanction_points,
    string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ', ' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS season_years
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN team_totals ON nk = c_nationkey JOIN nation ON n_nationkey = c_nationkey
  GROUP BY ALL),
placed_riders AS (
  SELECT *, row_number() OVER (PARTITION BY team_slug ORDER BY points_counted DESC, rider_name, rider_slug) AS team_rank_within_counted_list,
    CASE WHEN team_total_points = 0 THEN 0 ELSE points_counted / team_total_points END AS share_of_team FROM riders)"""

RISK = CONTRIBUTIONS + """,
real_risk AS (
  SELECT team_slug, any_value(team_rank) AS team_rank, any_value(team_total_points) AS t, any_value(ranking_total_points) AS r,
    any_value(sanction_points_total) AS sanction_points_total, count(*) AS n,
    max(rider_name) FILTER (WHERE team_rank_within_counted_list = 1) AS leader_name,
    sum(points_counted) FILTER (WHERE team_rank_within_counted_list <= 1) AS p1, sum(points_counted) FILTER (WHERE team_rank_within_counted_list <= 2) AS p2,
    sum(points_counted) FILTER (WHERE team_rank_within_counted_list <= 3) AS p3, sum(points_counted) FILTER (WHERE team_rank_within_counted_list <= 5) AS p5,
    sum(share_of_team * share_of_team) AS s2
  FROM placed_riders GROUP BY 1),
risk AS (
  SELECT team_slug, team_rank, t AS team_total_points, r AS ranking_total_points, n AS counted_riders_found, leader_name, p1 AS leader_points,
    p1 / t AS top1_share, p3 / t AS top3_share, p5 / t AS top5_share, 1.0 / s2 AS effective_contributors,
    t - p1 AS leader_shock_remaining_points, t - p2 AS leader_coleader_shock_remaining_points, p2 / t AS leader_coleader_shock_drop_pct,
    CASE WHEN p1 / t >= 0.30 THEN 'High' WHEN p1 / t >= 0.20 THEN 'Medium' ELSE 'Lower' END AS risk_band,
    t - r AS reconciliation_gap, CASE WHEN abs(t - r) > 1.0 THEN 'Warning' ELSE 'OK' END AS data_check, sanction_points_total
  FROM real_risk
  UNION ALL
  SELECT lower(r_name), r_regionkey + 100, 0.0, 0.0, 0, '', 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 'Lower', 0.0, 'OK', 0.0 FROM region)"""


def norm(x: str) -> str:
    folded = f"replace(strip_accents(lower(replace({x}, 'ß', 'ss'))), '&', ' and ')"
    unsuffixed = f"regexp_replace({folded}, '\\b(me|we|wwt|mj|wu)\\b', ' ', 'g')"
    return f"trim(regexp_replace({unsuffixed}, '[^a-z0-9]+', ' ', 'g'))"


def tokens(normalised_name: str) -> str:
    return (
        f"list_sort(list_distinct(list_filter(string_split({normalised_name}, ' '), "
        f"lambda w: w <> '' AND NOT list_contains([{quoted(NAME_STOP_WORDS)}], w) AND NOT regexp_full_match(w, '[0-9]+'))))"
    )


def variants(x: str) -> str:
    raw = f"trim({x})"
    spellings = [
        raw,
        f"regexp_replace({raw}, '(?i)\\s+\\b(ME|WE|WWT|MJ|WU)\\b$', '')",
        f"CASE WHEN contains({raw}, ' - ') THEN split_part({raw}, ' - ', 1) ELSE {raw} END",
        f"CASE WHEN contains({raw}, ' / ') THEN split_part({raw}, ' / ', 1) ELSE {raw} END",
        f"regexp_replace({raw}, '[\"“”].*?[\"“”]', '', 'g')",
    ]
    return "[" + ", ".join(norm(s) for s in spellings) + "]"


NAMES = f"""planned AS (
  SELECT p_partkey AS race_id, CASE p_partkey % 5 WHEN 0 THEN p_name || ' Race P' || p_partkey WHEN 1 THEN 'Grand Prix ' || p_name || ' P' || p_partkey
      WHEN 2 THEN 'Tour of ' || p_name || ' P' || p_partkey || ' - ' || p_type WHEN 3 THEN 'Trofeo ' || p_type || ' ' || p_name
      ELSE 'Clásica "' || p_name || '" P' || p_partkey END AS race_name,
    CAST(1995 + p_partkey % 7 AS INT) AS season, p_name, p_type,
    make_date(CAST(1995 + p_partkey % 7 AS INT), 1, 1) + CAST(p_partkey * 7 % 330 AS INT) AS start_date,
    make_date(CAST(1995 + p_partkey % 7 AS INT), 1, 1) + CAST(p_partkey * 7 % 330 AS INT) + p_size % 6 AS end_date FROM part),
named AS (SELECT *, {norm('race_name')} AS normalized FROM planned),
observed AS (
  SELECT DISTINCT 'team-' || l_suppkey % 20 AS team_slug, season,
    CASE l_linenumber % 6 WHEN 0 THEN race_name || ' ME' WHEN 1 THEN race_name || ' / Étape' WHEN 2 THEN upper(p_name) || ' P' || race_id
      WHEN 3 THEN 'Grote ' || p_name WHEN 4 THEN 'Sponsor ' || race_id || ' Open' ELSE 'P' || race_id || ' & ' || p_type END AS source_race_name,
    CASE WHEN l_returnflag <> 'R' THEN start_date + l_linenumber % 4 END AS day
  FROM lineitem JOIN planned ON race_id = l_partkey),
observed_names AS (SELECT *, {norm('source_race_name')} AS normalized_name FROM observed),
aliases AS (
  SELECT '' AS team, NULL AS season, {norm("'Sponsor ' || p_partkey || ' Open'")} AS n, '' AS canonical, p_partkey AS race_id, p_partkey * 2 + 1 AS o FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT 'team-' || p_partkey % 20, 1995 + p_partkey % 7, {norm("'Sponsor ' || p_partkey || ' Open'")}, 'Open of ' || p_name, p_partkey + 1, p_partkey * 2 FROM part WHERE p_partkey % 8 = 0),
alias_hits AS (
  SELECT team_slug, n.season, source_race_name, day, first(race_id ORDER BY o) AS race_id, first(canonical ORDER BY o) AS canonical
  FROM observed_names n JOIN aliases a ON a.n = normalized_name AND (a.team = '' OR a.team = team_slug) AND (a.season IS NULL OR a.season = n.season)
  GROUP BY 1, 2, 3, 4),
single_names AS (SELECT season, normalized, min(race_id) AS race_id, min(race_name) AS race_name FROM named GROUP BY 1, 2 HAVING count(*) = 1),
variant_rows AS (
  SELECT season, source_race_name, unnest({variants('source_race_name')}) AS variant, generate_subscripts({variants('source_race_name')}, 1) AS place
  FROM (SELECT DISTINCT season, source_race_name FROM observed)),
variant_hits AS (
  SELECT v.season, source_race_name, min_by(s.race_id, place) AS race_id, min_by(s.race_name, place) AS race_name
  FROM variant_rows v JOIN single_names s ON s.season = v.season AND s.normalized = variant GROUP BY 1, 2),
observed_words AS (SELECT DISTINCT season, normalized_name, day, unnest({tokens('normalized_name')}) AS word FROM observed_names),
planned_words AS (SELECT race_id, race_name, season, normalized, start_date, end_date, unnest({tokens('normalized')}) AS word FROM named),
pair_words AS (
  SELECT o.season, normalized_name, day, race_id, any_value(race_name) AS race_name, any_value(normalized) AS normalized, any_value(start_date) AS start_date,
    any_value(end_date) AS end_date, count(*) AS shared
  FROM observed_words o JOIN planned_words p ON o.season = p.season AND o.word = p.word GROUP BY 1, 2, 3, 4),
pair_bonus AS (
  SELECT *, CASE WHEN day BETWEEN start_date AND end_date THEN 3 ELSE 0 END AS bonus, CASE WHEN starts_with(normalized_name, normalized) THEN 1 ELSE 0 END AS prefix FROM pair_words),
pair_scores AS (SELECT *, (shared + bonus + prefix) * 1000 + shared * 10 + bonus AS score FROM pair_bonus),
best_scores AS (SELECT season, normalized_name, day, max(score) AS best FROM pair_scores GROUP BY 1, 2, 3 HAVING max(score) >= 3000),
overlap_hits AS (
  SELECT p.season, p.normalized_name, p.day, min(race_id) AS race_id, min(race_name) AS race_name
  FROM pair_scores p JOIN best_scores b ON p.season = b.season AND p.normalized_name = b.normalized_name AND p.day IS NOT DISTINCT FROM b.day AND score = best
  GROUP BY 1, 2, 3 HAVING count(*) = 1)"""

CASCADE = NAMES + """,
resolved AS (
  SELECT o.team_slug, o.season, o.source_race_name, o.day,
    CASE WHEN a.team_slug IS NOT NULL THEN a.race_id ELSE coalesce(v.race_id, t.race_id) END AS matched_race_id,
    CASE WHEN a.team_slug IS NOT NULL THEN a.canonical WHEN v.race_id IS NOT NULL THEN v.race_name ELSE coalesce(t.race_name, '') END AS canonical,
    CASE WHEN a.team_slug IS NOT NULL THEN 'alias' WHEN v.race_id IS NOT NULL THEN 'normalized_name' WHEN t.race_id IS NOT NULL THEN 'token_overlap' ELSE '' END AS matched_via
  FROM observed_names o
  LEFT JOIN alias_hits a ON a.team_slug = o.team_slug AND a.season = o.season AND a.source_race_name = o.source_race_name AND a.day IS NOT DISTINCT FROM o.day
  LEFT JOIN variant_hits v ON v.season = o.season AND v.source_race_name = o.source_race_name
  LEFT JOIN overlap_hits t ON t.season = o.season AND t.normalized_name = o.normalized_name AND t.day IS NOT DISTINCT FROM o.day),
cascade AS (
  SELECT r.*, CASE WHEN canonical <> '' THEN canonical ELSE coalesce(p.race_name, '') END AS canonical_race_name,
    CASE WHEN matched_race_id IS NULL THEN 'unmatched' ELSE 'matched' END AS match_status
  FROM resolved r LEFT JOIN planned p ON p.race_id = matched_race_id AND p.season = r.season)"""

INTERVALS = """intervals AS (
  SELECT CAST(user_id AS VARCHAR) AS team_slug, event_id AS race_id, event_type || ' ' || event_id AS race_name, ts AS start_date,
    CASE WHEN event_type <> 'error' THEN ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) END AS end_date FROM events),
stretched AS (
  SELECT *, coalesce(sum(CASE WHEN end_date IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY team_slug ORDER BY start_date, end_date NULLS LAST, race_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch FROM intervals),
reached AS (
  SELECT *, max(end_date) OVER (PARTITION BY team_slug, stretch ORDER BY start_date, end_date NULLS LAST, race_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM stretched),
grouped AS (
  SELECT *, sum(CASE WHEN end_date IS NULL OR reach IS NULL OR start_date > reach THEN 1 ELSE 0 END) OVER (PARTITION BY team_slug ORDER BY start_date, end_date NULLS LAST, race_id ROWS UNBOUNDED PRECEDING) AS overlap_group_id FROM reached),
labelled AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY team_slug, overlap_group_id) > 1 THEN 'overlap_' || count(*) OVER (PARTITION BY team_slug, overlap_group_id) ELSE '' END AS overlap_group FROM grouped)"""

SNAPSHOTS = """base AS (
  SELECT o_orderpriority AS team_slug, year(o_orderdate) AS planning_year, o_orderkey AS race_id, 'Order ' || o_orderkey AS race_name, CAST(o_orderdate AS DATE) AS day,
    CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'scheduled' END AS status FROM orders),
previous AS (
  SELECT team_slug, planning_year, race_id, race_name, strftime(day, '%d.%m') AS date_label, '1.1' AS category, status,
    CASE WHEN race_id % 23 <> 0 THEN 'active' ELSE '' END AS team_calendar_status FROM base WHERE race_id % 7 <> 0),
latest AS (
  SELECT team_slug, planning_year, race_id, race_name, strftime(CASE WHEN race_id % 13 = 0 THEN day + 1 ELSE day END, '%d.%m') AS date_label,
    CASE WHEN race_id % 17 = 0 THEN '1.Pro' ELSE '1.1' END AS category,
    CASE WHEN race_id % 11 <> 0 THEN status WHEN status = 'completed' THEN 'scheduled' ELSE 'completed' END AS status,
    CASE WHEN race_id % 19 = 0 THEN 'withdrawn' ELSE 'active' END AS team_calendar_status FROM base WHERE race_id % 5 <> 0),
both_sides AS (
  SELECT coalesce(p.team_slug, l.team_slug) AS team_slug, coalesce(p.planning_year, l.planning_year) AS planning_year, coalesce(p.race_id, l.race_id) AS race_id,
    coalesce(l.race_name, p.race_name) AS race_name, p.race_id AS pid, l.race_id AS lid, p.date_label AS pd, l.date_label AS ld, p.category AS pc, l.category AS lc,
    p.status AS ps, l.status AS ls, p.team_calendar_status AS pt, l.team_calendar_status AS lt
  FROM previous p FULL JOIN latest l ON p.team_slug = l.team_slug AND p.planning_year = l.planning_year AND p.race_id = l.race_id),
changes AS (
  SELECT team_slug, planning_year, race_id, race_name, 'race_added' AS change_type, '' AS old_value, ls AS new_value, 'after' AS notes FROM both_sides WHERE pid IS NULL
  UNION ALL SELECT team_slug, planning_year, race_id, race_name, 'race_removed', ps, '', 'before' FROM both_sides WHERE lid IS NULL
  UNION ALL SELECT team_slug, planning_year, race_id, race_name, 'date_changed', pd, ld, 'after' FROM both_sides WHERE pd <> ld
  UNION ALL SELECT team_slug, planning_year, race_id, race_name, 'category_changed', pc, lc, 'after' FROM both_sides WHERE pc <> lc
  UNION ALL SELECT team_slug, planning_year, race_id, race_name, 'status_changed', ps, ls, 'after' FROM both_sides WHERE ps <> ls
  UNION ALL SELECT team_slug, planning_year, race_id, race_name, 'calendar_status_changed', pt, lt, 'after' FROM both_sides WHERE pt <> lt)"""

_TRAIN_PCT = ",\n    ".join(f"{pct(c, 'test_year', rev)} AS {name}_pct" for name, (c, rev) in OPPORTUNITY_SOURCES.items())

FOLDS = HISTORY + f""",
repeated AS (
  SELECT * FROM keyed WHERE race_type = 'One-day' AND target_history_id IN (
    SELECT target_history_id FROM keyed WHERE race_type = 'One-day' GROUP BY 1 HAVING count(DISTINCT year) >= 2)),
years AS (SELECT year AS test_year FROM (SELECT year, row_number() OVER (ORDER BY year) AS rn FROM (SELECT DISTINCT year FROM repeated)) WHERE rn > 2),
train AS (SELECT r.*, test_year FROM repeated r JOIN years ON r.year < test_year),
train_pct AS (SELECT *, {_TRAIN_PCT} FROM train),
prediction AS (
  SELECT test_year, target_history_id, max_by(race_id, year) AS race_id, max_by(race_name, year) AS race_name, count(*) AS train_editions,
    string_agg(DISTINCT CAST(year AS VARCHAR), ', ' ORDER BY CAST(year AS VARCHAR)) AS train_years,
    {", ".join(f"round(avg({n}_pct), 9) AS {n}_pct" for n in OPPORTUNITY_WEIGHTS)} FROM train_pct GROUP BY 1, 2),
outcome AS (
  SELECT year AS test_year, target_history_id, avg(points_per_top10_form) AS actual_points_efficiency, avg(points_per_total_form) AS actual_total_efficiency,
    avg(top10_points) AS actual_top10_points, avg(finish_rate) AS actual_finish_rate FROM repeated GROUP BY 1, 2),
merged AS (SELECT p.*, o.* EXCLUDE (test_year, target_history_id), count(*) OVER (PARTITION BY p.test_year) AS races_compared
  FROM prediction p JOIN outcome o ON p.test_year = o.test_year AND p.target_history_id = o.target_history_id),
folds AS (SELECT *, greatest(3, CAST(ceil(races_compared * 0.20) AS BIGINT)) AS top_k FROM merged WHERE races_compared >= {{min_fold}})"""


def folds(min_fold: int) -> str:
    return FOLDS.replace("{min_fold}", str(min_fold))


def evaluation(min_fold: int, candidates: list[dict[str, float]]) -> str:
    values = ", ".join("(" + ", ".join([str(i), *[repr(c[n]) for n in OPPORTUNITY_WEIGHTS]]) + ")" for i, c in enumerate(candidates))
    names = ", ".join(f"w_{n}" for n in OPPORTUNITY_WEIGHTS)
    score = " + ".join(f"{n}_pct * w_{n}" for n in OPPORTUNITY_WEIGHTS)
    return folds(min_fold) + f""",
candidates AS (SELECT * FROM (VALUES {values}) AS c(candidate_id, {names})),
each_score AS (SELECT f.*, c.*, CAST({score} AS DOUBLE) AS predicted_score FROM folds f CROSS JOIN candidates c),
each_rank AS (
  SELECT *, rank() OVER p AS predicted_rank, rank() OVER a AS actual_rank, row_number() OVER (PARTITION BY candidate_id, test_year ORDER BY predicted_score DESC, target_history_id) AS pp,
    row_number() OVER (PARTITION BY candidate_id, test_year ORDER BY actual_points_efficiency DESC, target_history_id) AS ap,
    rank() OVER p + (count(*) OVER (PARTITION BY candidate_id, test_year, predicted_score) - 1) / 2.0 AS pr,
    rank() OVER a + (count(*) OVER (PARTITION BY candidate_id, test_year, actual_points_efficiency) - 1) / 2.0 AS ar
  FROM each_score WINDOW p AS (PARTITION BY candidate_id, test_year ORDER BY predicted_score DESC), a AS (PARTITION BY candidate_id, test_year ORDER BY actual_points_efficiency DESC)),
fold_parts AS (
  SELECT candidate_id, test_year, max(races_compared) AS races_compared, max(top_k) AS top_k, coalesce(corr(pr, ar), 0.0) AS spearman,
    count(*) FILTER (WHERE pp <= top_k AND ap <= top_k) / max(top_k) AS top_k_precision,
    coalesce(sum(actual_points_efficiency) FILTER (WHERE pp <= top_k) / nullif(sum(actual_points_efficiency) FILTER (WHERE ap <= top_k), 0), 0.0) AS top_k_value_capture
  FROM each_rank GROUP BY 1, 2),
fold_metrics AS (SELECT *, 0.6 * ((spearman + 1.0) / 2.0) + 0.2 * top_k_precision + 0.2 * top_k_value_capture AS objective FROM fold_parts),
evaluated AS (
  SELECT candidate_id, {", ".join(f"sum({m} * races_compared) / sum(races_compared) AS {m}" for m in ("objective", "spearman", "top_k_precision", "top_k_value_capture"))}
  FROM fold_metrics GROUP BY 1)"""


DISPLAY_ORDER = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATEGORY_DISPLAY_ORDER, 1)) + f" ELSE {len(CATEGORY_DISPLAY_ORDER) + 1} END"
