"""The weight fit as plain SQL: sums per team, then projected gradient steps in a recursive query.

The objective is strictly convex, so any step below 1 over the largest curvature leads to the same optimum; one over the trace is safe.
"""

from __future__ import annotations

import re

from driver import oracles as sql
from echelon.constants import ARCHETYPES, FIT_METHOD, FIT_SETTINGS as S, PROFILE_AXES

AXES = list(PROFILE_AXES)
N = len(AXES)
STEPS = 900
FLOORS = [S["min_time_trial_weight"] if axis == "time_trial" else 0.0 for axis in AXES]
FREE = 1.0 - sum(FLOORS)


def _list(values) -> str:
    return "[" + ", ".join(str(v) for v in values) + "]"


def _each(expression: str) -> str:
    """A list over the axes; the expression names the place as `i`."""
    return f"list_transform(range(1, {N + 1}), lambda i: {expression})"


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def _projected(source: str, column: str, name: str) -> str:
    """Rows of `source` with `name`: the nearest weights to `column` that sum to 1 and keep the floors."""
    shifted = _each(f"{column}[i] - {_list(FLOORS)}[i]")
    over = f"(list_sum(ordered[1:i]) - {FREE}) / i"
    return f"""SELECT * EXCLUDE (shifted, ordered, support), list_transform(range(1, {N + 1}), lambda k: {_list(FLOORS)}[k] + greatest(shifted[k] - (list_sum(ordered[1:support]) - {FREE}) / support, 0.0)) AS {name}
    FROM (SELECT *, greatest(coalesce(list_max(list_filter(range(1, {N + 1}), lambda i: ordered[i] - {over} > 0)), 1), 1) AS support
    FROM (SELECT *, list_reverse_sort(shifted) AS ordered FROM (SELECT *, {shifted} AS shifted FROM ({source}))))"""


def _objective(w: str) -> str:
    quadratic = _dot(_each(_dot("m2[i]", w)), w)
    gap = f"({_dot('mean', w)} + c0 / s0)"
    distance = f"list_sum({_each(f'({w}[i] - prior[i]) * ({w}[i] - prior[i])')}) / {N}"
    return f"(({quadratic} + 2.0 * {_dot('b', w)} + c1) / s0 + {S['level_weight']} * {gap} * {gap} + strength * {distance} + spread * {_dot(w, w)})"


def _fit(select: str, *further: str) -> str:
    signal = lambda axis: f"fit_range * least(greatest(coalesce({axis}_signal, 0.0), 0.0), 1.0)"
    priors = ", ".join(f"('{key}', {_list(float(a['strength_weight_prior'][axis]) for axis in AXES)})" for key, a in ARCHETYPES.items())
    total = lambda value: f"sum({value})"
    curvature = f"list_transform(range(1, {N + 1}), lambda i: list_transform(range(1, {N + 1}), lambda j: 2.0 * m2[i][j] / s0 + {2 * S['level_weight']} * mean[i] * mean[j] + CASE WHEN i = j THEN 2.0 * strength / {N} + 2.0 * spread ELSE 0.0 END))"
    linear = _each(f"2.0 * b[i] / s0 + {2 * S['level_weight']} * (c0 / s0) * mean[i] - 2.0 * strength / {N} * prior[i]")
    step = f"SELECT team_slug, step + 1 AS step, h, l, t, {_each('w[i] - (' + _dot('h[i]', 'w') + ' + l[i]) / t')} AS moved FROM steps WHERE step < {STEPS}"
    predicted = lambda w: f"exposure * (fit_floor + {_dot('m', w)})"
    return sql.with_ctes(
        sql.EV.replace("WITH ", ""),
        sql_archetypes(),
        f"priors AS (SELECT * FROM (VALUES {priors}) AS p(archetype_key, prior_raw))",
        f"""known AS (SELECT team_slug, planning_year, CAST(actual_points AS DOUBLE) AS actual, fit_floor, sqrt(greatest(actual_points, 0.0) + 1.0) AS r,
          CAST(coalesce(base_opportunity_points, 0) * coalesce(participation_confidence, 0) * coalesce(execution_multiplier, 0) AS DOUBLE) AS exposure, {_list(signal(a) for a in AXES)} AS m FROM ev WHERE actual_points IS NOT NULL)""",
        "aimed AS (SELECT *, fit_floor - CASE WHEN exposure > 0 THEN least(greatest(actual / exposure, fit_floor), 1.0) ELSE fit_floor END AS e FROM known)",
        f"""sums AS (SELECT team_slug, planning_year, count(*) AS n, greatest(sum(r), 1e-9) AS s0, sum(r * e) AS c0, sum(r * e * e) AS c1, {_list(total(f'r * m[{i}]') for i in range(1, N + 1))} AS m1,
          {_list(total(f'r * e * m[{i}]') for i in range(1, N + 1))} AS b, {_list(_list(total(f'r * m[{i}] * m[{j}]') for j in range(1, N + 1)) for i in range(1, N + 1))} AS m2 FROM aimed GROUP BY 1, 2)""",
        f"""posed AS (SELECT s.*, list_transform(m1, lambda x: x / s0) AS mean, {S['prior_strength']} * greatest(1.0, {S['prior_full_races']} / n) AS strength, {S['concentration_strength']} * greatest(1.0, {S['concentration_full_races']} / n) AS spread,
          {_list('p.' + a for a in AXES)} AS current, archetype_key, prior_raw FROM sums s JOIN profiles p USING (team_slug) JOIN archetypes a USING (team_slug) JOIN priors USING (archetype_key))""",
        "started AS (" + _projected(_projected("SELECT * FROM posed", "current", "base"), "prior_raw", "prior") + ")",
        f"problem AS (SELECT *, {curvature} AS h, {linear} AS l FROM started)",
        f"steps AS (SELECT team_slug, 0 AS step, h, l, list_sum({_each('h[i][i]')}) AS t, base AS w FROM problem UNION ALL SELECT team_slug, step, h, l, t, w FROM ({_projected(step, 'moved', 'w')}))",
        f"ended AS (SELECT p.*, w FROM problem p JOIN (SELECT team_slug, w FROM steps WHERE step = {STEPS}) USING (team_slug))",
        f"valued_fit AS (SELECT *, {_objective('w')} AS reached, {_objective('base')} AS at_base FROM ended)",
        "chosen AS (SELECT *, CASE WHEN reached > at_base THEN base ELSE w END AS fitted, least(reached, at_base) AS objective FROM valued_fit)",
        f"""errors AS (SELECT team_slug, avg(abs({predicted('fitted')} - actual)) AS mae, sqrt(avg(pow({predicted('fitted')} - actual, 2))) AS rmse, sqrt(avg(pow({predicted('base')} - actual, 2))) AS baseline_rmse,
          sum({predicted('fitted')}) - sum(actual) AS season_gap FROM known JOIN chosen USING (team_slug) GROUP BY 1)""",
        *further,
        select=select,
    ).replace("WITH ", "WITH RECURSIVE ", 1)


def weight_fit() -> str:
    weights = ", ".join(f"round(fitted[{i}], 6) AS {axis}" for i, axis in enumerate(AXES, 1))
    return _fit(
        f"""SELECT team_slug, c.planning_year, n AS known_race_count, '{FIT_METHOD}' AS weight_fit_method, 'archetype:' || archetype_key AS prior_source,
        {weights}, objective, mae, rmse, baseline_rmse, season_gap FROM chosen c JOIN errors USING (team_slug)"""
    )


def weight_refit_ev() -> str:
    """The statement of the expected values once more, over profiles with the fitted weights where a team has any."""
    fitted = ", ".join(f"coalesce(round(fitted[{i}], 6), p.{axis}) AS {axis}" for i, axis in enumerate(AXES, 1))
    again = sql.EV[sql.EV.index("fit_parts AS") :].replace("profiles p", "refitted p")
    again = re.sub(r"\b(fit_parts|fit_scores|multiplied|expected|ev)\b", r"re_\1", again)
    refitted = f"refitted AS (SELECT p.* EXCLUDE ({', '.join(AXES)}), {fitted} FROM profiles p LEFT JOIN chosen USING (team_slug))"
    return _fit("SELECT * FROM re_ev", refitted, again)


def sql_archetypes() -> str:
    from driver.queries import ARCHETYPE_OF_PROFILE

    return ARCHETYPE_OF_PROFILE
