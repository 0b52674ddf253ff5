"""How concentrated a team's points are on few riders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from echelon.constants import CONTRIBUTION_TEAM_COLUMNS
from echelon.functions.columns import ratio_or_zero, with_defaults, year_list
from echelon.operators.spread import arrange, top_rows

_PLACEHOLDER = "is_placeholder_team_row"
_TEAM = ("scope", "cycle_label", "team_slug")


def rider_roll_up(contributions: DataFrame) -> DataFrame:
    """Points per team and rider over all seasons."""
    rows = with_defaults(contributions, {_PLACEHOLDER: False}).withColumn(_PLACEHOLDER, F.coalesce(_PLACEHOLDER, F.lit(False)))
    summed = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
    return rows.groupBy(*CONTRIBUTION_TEAM_COLUMNS, "rider_name", "rider_slug", _PLACEHOLDER).agg(
        summed("points_counted"), summed("points_not_counted"), summed("sanction_points"), year_list(F.col("season_year")).alias("season_years")
    )


def _leading_first() -> list[Column]:
    # Sums of the same points differ in their last digits by the order of addition: equal ones must tie, and go by name.
    return [-F.round("points_counted", 6), F.col("rider_name"), F.col("rider_slug")]


def running_shares(riders: DataFrame) -> DataFrame:
    """Rank within the team (of one scope and cycle), share of the team's points and running share, largest scorers first."""
    share = ratio_or_zero(F.col("points_counted"), F.col("team_total_points"))
    placed = arrange(riders.withColumn("share_of_team", share), _TEAM, _leading_first())
    real = (~F.col(_PLACEHOLDER)).cast("int")
    placed = placed.running("_position", "sum", real).running("cumulative_share", "sum", F.col("share_of_team"))
    return placed.with_columns(
        {"team_rank_within_counted_list": F.when(F.col(_PLACEHOLDER), F.lit(0)).otherwise(F.col("_position")).cast("long")}
    ).done("_position")


def risk_band(top_share: Column, shock: Column) -> Column:
    return (
        F.when((top_share >= 0.35) | (shock >= 0.30), "High").when((top_share >= 0.25) | (shock >= 0.20), "Medium").otherwise("Lower")
    )


def concentration_risk(contributions: DataFrame) -> DataFrame:
    """Shares of the leading riders, loss without them, effective contributors and a risk band per team.

    A team without riders keeps its row with zeros. Scopes and cycles of one team are teams of their own.
    """
    riders = rider_roll_up(contributions)
    real = ~F.col(_PLACEHOLDER)
    attributes = [c for c in CONTRIBUTION_TEAM_COLUMNS if c not in _TEAM]
    leading_row = F.struct((-F.col("points_counted")).alias("p"), F.col("rider_name"))
    teams = riders.groupBy(*_TEAM).agg(
        F.min_by(F.struct(*attributes), leading_row).alias("t"),
        F.count_if(real).alias("counted_riders_found"),
        F.sum(F.when(real, F.col("points_counted") * F.col("points_counted"))).alias("_squares"),
    )
    leaders = top_rows(riders.where(real), _TEAM, _leading_first(), 5)
    upto = lambda k: F.sum(F.when(F.col("_rank") <= k, F.col("points_counted")))
    tops = leaders.groupBy(*_TEAM).agg(
        F.max(F.when(F.col("_rank") == 1, F.col("rider_name"))).alias("_leader"),
        upto(1).alias("_top1"), upto(2).alias("_top2"), upto(3).alias("_top3"), upto(5).alias("_top5"),
    )
    joined = teams.select(*_TEAM, "t.*", "counted_riders_found", "_squares").join(tops, list(_TEAM), "left")
    joined = joined.fillna(0.0, ["_top1", "_top2", "_top3", "_top5", "_squares"])
    points = F.col("team_total_points").cast("double")
    share = lambda c: ratio_or_zero(F.col(c), points)
    gap = points - F.col("ranking_total_points")
    return joined.select(
        "scope", "cycle_label", "team_rank", "team_name", "team_slug", "team_class", "team_total_points", "ranking_total_points",
        "counted_riders_found",
        F.coalesce("_leader", F.lit("")).alias("leader_name"),
        F.col("_top1").alias("leader_points"),
        share("_top1").alias("top1_share"),
        share("_top3").alias("top3_share"),
        share("_top5").alias("top5_share"),
        F.when(points != 0, ratio_or_zero(points * points, F.col("_squares"))).otherwise(F.lit(0.0)).alias("effective_contributors"),
        (points - F.col("_top1")).alias("leader_shock_remaining_points"),
        F.col("_top1").alias("leader_shock_drop_points"),
        share("_top1").alias("leader_shock_drop_pct"),
        (points - F.col("_top2")).alias("leader_coleader_shock_remaining_points"),
        F.col("_top2").alias("leader_coleader_shock_drop_points"),
        share("_top2").alias("leader_coleader_shock_drop_pct"),
        risk_band(share("_top1"), share("_top1")).alias("risk_band"),
        gap.alias("reconciliation_gap"),
        F.when(F.abs(gap) > 1.0, "Warning").otherwise("OK").alias("data_check"),
        "sanction_points_total", "ranking_url", "source_url", "scraped_at",
    )


def ordered_risk(risk: DataFrame) -> DataFrame:
    return risk.orderBy(*[F.desc_nulls_last(c) for c in ("top1_share", "leader_shock_drop_pct", "team_total_points")], "team_slug")


def team_detail(contributions: DataFrame, team_slug: str | None = None) -> DataFrame:
    """Riders of one team (or of all) with shares in percent."""
    rows = contributions if team_slug is None else contributions.where(F.col("team_slug") == team_slug)
    shares = running_shares(rider_roll_up(rows)).where(~F.col(_PLACEHOLDER))
    return shares.withColumns({"share_pct": F.col("share_of_team") * 100, "cumulative_share_pct": F.col("cumulative_share") * 100})


def assemble_contributions(
    ranking: DataFrame, breakdown: DataFrame, totals: DataFrame, scope: str, cycle_label: str, scraped_at: Column, team_classes: tuple[str, ...] = ("PRT",)
) -> DataFrame:
    """Contribution rows of the selected team classes; a team without riders gets one placeholder row."""
    teams = ranking.where(F.col("team_class").isin(*team_classes)).join(totals, ["team_slug"], "left")
    counted = F.when(F.coalesce("total_counted_points", F.lit(0.0)) != 0, F.col("total_counted_points")).otherwise(F.col("ranking_points"))
    described = teams.select(
        F.lit(scope).alias("scope"), F.lit(cycle_label).alias("cycle_label"), "team_rank", "team_name", "team_slug", "team_class",
        F.col("ranking_points").alias("ranking_total_points"), counted.alias("team_total_points"),
        F.coalesce("sanction_points_total", F.lit(0.0)).alias("sanction_points_total"),
        F.col("breakdown_path").alias("ranking_url"), F.coalesce("source_url", F.lit("")).alias("source_url"), scraped_at.alias("scraped_at"),
    )
    riders = breakdown.select(
        "team_slug", F.col("season_year").cast("long").alias("season_year"), "rider_name", "rider_slug", "team_rank_within_counted_list",
        "points_counted", "points_not_counted", "sanction_points", F.lit(False).alias(_PLACEHOLDER),
    )
    joined = described.join(riders, ["team_slug"], "left")
    return joined.withColumn(_PLACEHOLDER, F.coalesce(_PLACEHOLDER, F.lit(True))).fillna(
        {"rider_name": "", "rider_slug": "", "team_rank_within_counted_list": 0, "points_counted": 0.0, "points_not_counted": 0.0, "sanction_points": 0.0}
    )
