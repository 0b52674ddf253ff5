"""Report tables over the results: filters, roll-ups, series, extremes and key figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from echelon.constants import CATEGORY_DISPLAY_ORDER
from echelon.functions.columns import known, nulls_last, text
from echelon.functions.dates import as_date, iso_day
from echelon.operators.expected_value import TEAM_KEYS
from echelon.operators.ranking import medians
from echelon.operators.spread import arrange, top_rows

_EV_FACTORS = ("expected_points", "base_opportunity_points", "team_fit_multiplier", "participation_confidence", "execution_multiplier")


def season_view(ev: DataFrame, view: str) -> DataFrame:
    """`Completed races only`, `Season so far` (not cancelled) or everything."""
    if view == "Completed races only":
        return ev.where(F.col("status") == "completed")
    if view == "Season so far":
        return ev.where(text(F.col("status")) != "cancelled")
    return ev


def completed_with_gaps(ev: DataFrame) -> DataFrame:
    """Completed races that lack one of the factors of their expected points."""
    lacking = F.lit(False)
    for factor in _EV_FACTORS:
        lacking = lacking | F.col(factor).isNull()
    return ev.where((F.col("status") == "completed") & lacking)


def _points(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def by_category(ev: DataFrame) -> DataFrame:
    """Expected and actual points per team and category; `category_order` is the display order."""
    summed = ev.groupBy(*TEAM_KEYS, F.coalesce("category", F.lit("Unknown")).alias("category")).agg(
        F.sum(_points("expected_points")).alias("expected_points"), F.sum(_points("actual_points")).alias("actual_points")
    )
    place = F.array_position(F.lit(list(CATEGORY_DISPLAY_ORDER)), F.col("category"))
    return summed.withColumn("category_order", F.when(place > 0, place).otherwise(F.lit(len(CATEGORY_DISPLAY_ORDER) + 1)))


def by_month(ev: DataFrame) -> DataFrame:
    """Expected and actual points per team and month of the start date; `month_order` sorts the labels."""
    start = as_date(F.col("start_date"))
    return ev.groupBy(*TEAM_KEYS, F.date_format(start, "MMM").alias("month_label"), F.month(start).alias("month_order")).agg(
        F.sum(_points("expected_points")).alias("expected_points"), F.sum(_points("actual_points")).alias("actual_points")
    )


def cumulative_points(ev: DataFrame) -> DataFrame:
    """Running expected and actual points of each team by date."""
    order = [nulls_last(F.col("start_date")), F.col("race_name"), F.col("race_id")]
    placed = arrange(ev, TEAM_KEYS, order)
    placed = placed.running("expected_cumulative", "sum", _points("expected_points"))
    return placed.running("actual_cumulative", "sum", _points("actual_points")).done()


def as_series(df: DataFrame, ids: Sequence[str], labels: dict[str, str]) -> DataFrame:
    """Wide to long: one row per id and series; `labels` maps columns to series names."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    long = df.unpivot(list(ids), list(labels), "series", "points")
    return long.withColumn("series", F.element_at(names, F.col("series")))


def gap_extremes(ev: DataFrame, limit: int = 5) -> DataFrame:
    """The races furthest above and below expectation per team, each race once.

    Both ends are top-k selections; a race within both (a team with few races) is kept once.
    """
    rows = ev.where(F.col("ev_gap").isNotNull())
    best = top_rows(rows, TEAM_KEYS, [F.desc("ev_gap"), F.col("race_id")], limit)
    worst = top_rows(rows, TEAM_KEYS, [F.asc("ev_gap"), F.col("race_id")], limit)
    return best.unionByName(worst).drop("_rank").dropDuplicates([*TEAM_KEYS, "race_id"])


def target_key_figures(scored: DataFrame, targets: DataFrame) -> DataFrame:
    """Editions, targets, targets on the calendar, mean payout and startlist in one row."""
    editions = scored.agg(
        F.struct(
            F.count(F.lit(1)).alias("editions"), F.avg("top10_points").alias("payout"), F.avg("startlist_size").alias("startlist")
        ).alias("e")
    )
    counted = targets.agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("on_planning_calendar")).alias("targets_on_calendar"))
    return counted.withColumn("_e", editions.scalar()).select(
        F.col("_e.editions").alias("editions"), "targets", "targets_on_calendar",
        F.col("_e.payout").alias("average_top10_payout"), F.col("_e.startlist").alias("average_startlist_size"),
    )


def risk_key_figures(risk: DataFrame) -> DataFrame:
    share = F.round(F.col("top1_share") * 100, 1)
    names = ("median_top1_share_pct", "median_effective_contributors")
    middle = medians(risk, dict(zip(names, (share, F.col("effective_contributors")), strict=True)))
    counted = risk.agg(
        F.count(F.lit(1)).alias("teams"),
        F.count_if(F.col("risk_band") == "High").alias("high_risk_teams"),
        F.max(share).alias("max_top1_share_pct"),
    )
    # one row each
    return counted.withColumn("_m", middle.select(F.struct(*names).alias("m")).scalar()).select(
        "teams", "high_risk_teams", F.col(f"_m.{names[0]}").alias(names[0]), "max_top1_share_pct", F.col(f"_m.{names[1]}").alias(names[1])
    )


def dataset_signature(editions: DataFrame) -> DataFrame:
    """Row count, years and categories of an edition table, and how many races changed category."""
    changed = editions.groupBy("race_id").agg(F.count_distinct("category").alias("n")).agg(F.count_if(F.col("n") > 1).alias("c"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda v: v.cast("string")), ", ")
    return editions.agg(
        F.count(F.lit(1)).alias("editions"), joined("year").alias("years"), joined("category").alias("categories"),
        F.count_if(F.col("race_type") == "Stage race").alias("stage_races"),
        F.coalesce(F.sum("stage_pages_missing"), F.lit(0)).alias("missing_stage_pages"),
    ).withColumn("category_change_races", changed.scalar())


def freshness_drift(summary: DataFrame, calendar: DataFrame) -> DataFrame:
    """Whether a team's saved values and its calendar snapshot carry different dates."""
    scraped = calendar.groupBy(*TEAM_KEYS).agg(F.max(F.col("scraped_at_utc").try_cast("timestamp")).alias("calendar_scraped_at"))
    joined = summary.select(*TEAM_KEYS, iso_day(F.col("as_of_date")).alias("ev_as_of")).join(scraped, TEAM_KEYS, "left")
    day = F.coalesce(F.date_format("calendar_scraped_at", "yyyy-MM-dd"), F.lit(""))
    return joined.withColumns(
        {
            "calendar_scraped_day": day,
            "has_drift": (F.col("ev_as_of") != "") & (day != "") & (F.col("ev_as_of") != day),
            "calendar_is_newer": (F.col("ev_as_of") != "") & (day > F.col("ev_as_of")),
        }
    )


def rounded(df: DataFrame, columns: dict[str, tuple[str, int | None]], keep: Sequence[str] = ()) -> DataFrame:
    """Report projection: result name -> (column, decimals or None); halves round to even."""
    shown = [
        (F.bround(F.col(c).cast("double"), d) if d is not None else F.col(c)).alias(name) for name, (c, d) in columns.items()
    ]
    return df.select(*keep, *shown)


def target_report(targets: DataFrame) -> DataFrame:
    """The shortlist as shown: rounded scores and a plain match text."""
    match = (
        F.when(~F.col("on_planning_calendar"), "No in-scope match")
        .when(F.col("planning_scope_match"), "Same category")
        .otherwise("Category changed")
    )
    one = lambda c: (c, 1)
    return rounded(
        targets.withColumn("planning_match", match),
        {
            "targeting_score": one("avg_targeting_score"), "opportunity_score": one("avg_arbitrage_score"),
            "specialty_fit": one("avg_specialty_fit_score"), "average_top10_points": one("avg_top10_points"),
            "average_stage_top10_points": one("avg_stage_top10_points"), "average_stage_days": one("avg_stage_count"),
            "average_top10_field_form": one("avg_top10_field_form"), "points_per_field_form": ("avg_points_efficiency", 2),
        },
        [
            "target_history_id", "race_name", "race_country", "category", "route_profile", "planning_category", "planning_date_label",
            "planning_match", "planning_calendar_status", "category_history", "race_type", "years_analyzed", "years",
        ],
    )


def edition_diagnostics(scored: DataFrame) -> DataFrame:
    """Edition rows for the opportunity map with a `name (year)` label."""
    return scored.withColumn("label", F.concat("race_name", F.lit(" ("), F.col("year").cast("string"), F.lit(")"))).select(
        "label", "race_name", "year", "category", "race_type", "race_country", "route_profile", "profile_reason", "targeting_score",
        "specialty_fit_score", "arbitrage_score", "top10_points", "winner_points", "total_points", "gc_top10_points",
        "stage_top10_points", "stage_count", "stage_points_share", "avg_top10_field_form", "total_field_form", "finish_rate",
        "startlist_size",
    )


def race_detail(ev: DataFrame) -> DataFrame:
    """Race rows of a team season as shown in the detail table."""
    return rounded(
        ev,
        {
            "base_opportunity_points": ("base_opportunity_points", 1), "team_fit_multiplier": ("team_fit_multiplier", 3),
            "participation_confidence": ("participation_confidence", 3), "execution_multiplier": ("execution_multiplier", 3),
            "expected_points": ("expected_points", 1), "actual_points": ("actual_points", 1), "ev_gap": ("ev_gap", 1),
        },
        [*TEAM_KEYS, "race_id", "race_name", "category", "start_date", "status", "source", "overlap_group", "notes"],
    )


def risk_report(risk: DataFrame) -> DataFrame:
    """Team risk table with shares in percent."""
    percent = {
        "top1_share_pct": "top1_share", "top3_share_pct": "top3_share", "top5_share_pct": "top5_share",
        "leader_shock_pct": "leader_shock_drop_pct", "leader_coleader_shock_pct": "leader_coleader_shock_drop_pct",
    }
    shares = risk.withColumns({name: F.bround(F.col(c) * 100, 1) for name, c in percent.items()})
    return shares.select(
        "team_rank", "team_name", "team_class", F.bround(F.col("team_total_points").cast("double"), 1).alias("points"), "leader_name",
        *percent, F.bround("effective_contributors", 2).alias("effective_n"), "counted_riders_found", "risk_band", "data_check",
    )


def actual_points_rows(calendar: DataFrame, race_points: DataFrame, checked_at: Column) -> DataFrame:
    """Known points for each calendar race from its parsed points page.

    `race_points` has one row per fetched page (team, season, race slug, points, riders, has_rows, error). A
    completed race with an empty page scored 0; a scheduled one, a failed page or a race without slug is unknown.
    """
    pages = race_points.select(
        *TEAM_KEYS, "pcs_race_slug", F.col("actual_points").alias("_points"), F.col("rider_count").alias("_riders"),
        known(F.col("has_rows")).alias("_has_rows"), F.col("error").alias("_error"), F.col("source_url").alias("_url"),
    )
    joined = calendar.withColumn("pcs_race_slug", F.trim(text(F.col("pcs_race_slug")))).join(pages, [*TEAM_KEYS, "pcs_race_slug"], "left")
    slug = F.col("pcs_race_slug") != ""
    failed = slug & (F.col("_error").isNotNull() | F.col("_has_rows").isNull())
    empty_after = slug & ~failed & ~F.col("_has_rows") & (F.col("status") == "completed")
    filled = slug & ~failed & F.col("_has_rows")
    return joined.select(
        "team_slug", "team_name", "planning_year", "race_id", "race_name", "category", "date_label", "status",
        F.when(filled, F.col("_points")).when(empty_after, F.lit(0.0)).alias("actual_points"),
        F.when(filled, F.col("_riders")).when(empty_after, F.lit(0)).cast("long").alias("rider_count"),
        text(F.col("_url")).alias("source_url"), "pcs_race_slug", checked_at.alias("checked_at_utc"),
        F.when(~slug, F.lit("missing_race_slug"))
        .when(failed, F.concat(F.lit("points_page_error="), F.coalesce("_error", F.lit("PageMissing"))))
        .when(empty_after, F.lit("points_page_empty_after_race"))
        .otherwise(F.lit(""))
        .alias("notes"),
    )
