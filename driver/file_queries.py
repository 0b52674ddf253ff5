"""The tables written to files and read back by the library's own readers, next to the same questions in plain SQL.

Every query writes what Spark derives from the given tables into a new folder of the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from driver import adapters as ad, oracles as sql
from driver.registry import Query, shape
from echelon.constants import STAGE_DEFAULTS
from echelon.operators import risk
from echelon.operators.expected_value import ev_summary
from echelon.operators.spread import checkpointed, shared_folder
from echelon.plans import incremental
from echelon.sources import snapshots, tables

_LABEL = "strftime(start_date, '%d.%m') || CASE WHEN end_date > start_date THEN '-' || strftime(end_date, '%d.%m') ELSE '' END"


def _folder(s: SparkSession) -> str:
    return f"{shared_folder(s)}/files-{uuid.uuid4().hex}"


def _editions(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    tables.write_editions(ad.editions(s, d), path)
    return tables.read_editions(s, path, years=[1994, 1995, 1997], categories=["1.1", "1.Pro", "2.1", "2.Pro"])


def _old_editions(s: SparkSession, d: str) -> DataFrame:
    """As CSV, of a time when stage results were not collected."""
    path = f"{_folder(s)}.csv"
    tables.write_csv(ad.editions(s, d).drop(*STAGE_DEFAULTS), path)
    return tables.read_editions(s, path)


def _planning(s: SparkSession, d: str) -> DataFrame:
    """The landed calendar holds nothing of the categories and months asked for, so the snapshot is read."""
    planned, path = ad.planned_races(s, d), _folder(s)
    tables.write_csv(planned.where("month = 1 OR category = '2.1'"), f"{path}/landed.csv")
    planned.write.parquet(f"{path}/snapshot")
    return tables.read_planning(s, f"{path}/landed.csv", f"{path}/snapshot", categories=["1.1"], months=range(3, 10))


def _contributions(s: SparkSession, d: str) -> DataFrame:
    path, rows = _folder(s), ad.contributions(s, d)
    cycle = rows.withColumn("scope", F.lit("cycle_2026_2028")).withColumn("points_counted", -F.col("points_counted"))
    tables.write_contributions(rows.unionByName(cycle), path)
    return risk.rider_roll_up(tables.read_contributions(s, path, "current").select(*rows.columns)).where("NOT is_placeholder_team_row")


def _programme(s: SparkSession, d: str) -> DataFrame:
    path, key = f"{_folder(s)}.csv", F.col("race_id")
    link = F.when(key % 3 == 0, F.concat(F.lit("race/r-"), key, F.lit("/2001/result"))).when(key % 3 == 1, F.concat(F.lit("https://example.org/team-in-race/t/r-"), key, F.lit("/2001")))
    tables.write_csv(ad.planned_races(s, d).select("race_name", "date_label", "category", link.alias("source_url")), path)
    return tables.read_programme(s, path)


def _manifest(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as tracked teams, in the spellings that a manifest may have."""
    path, key = f"{_folder(s)}.csv", F.col("s_suppkey")
    flag = F.element_at(F.array(*map(F.lit, ("", "yes", "FALSE", "1", "off", " True "))), (key % 6 + 1).cast("int"))
    rows = ad.table(s, d, "supplier").select(
        F.concat(F.lit(" Team-"), key, F.when(key % 2 == 0, F.lit("-2026")).otherwise(F.lit(""))).alias("team_slug"), F.concat(F.lit("t-"), key).alias("pcs_team_slug"),
        F.concat(F.col("s_name"), F.lit(" ")).alias("team_name"), F.lit("2026").alias("planning_year"), flag.alias("enabled"),
    )
    tables.write_csv(rows, path)
    return tables.read_manifest(s, path, enabled_only=True)


def _season(build: Callable[[SparkSession, str], DataFrame], s: SparkSession, d: str) -> str:
    """All expected values published, then those of one team again with doubled points: the root of two snapshots."""
    # written, since both snapshots and both of their tables are made of them
    root, values = _folder(s), checkpointed(tables.typed(build(s, d), incremental.TABLES["team_calendar_ev"]))
    again = values.where("team_slug = 'nation-7'").withColumns({"expected_points": F.col("expected_points") * 2, "team_name": F.lit(" ")})
    for rows, replaced in ((values, None), (again, again.select("team_slug", "planning_year").distinct())):
        held = {"team_calendar_ev": rows, "team_ev_summary": tables.typed(ev_summary(rows), incremental.TABLES["team_ev_summary"])}
        snapshots.publish(s, root, held, replaced=replaced)
    return root


def _export(build: Callable[[SparkSession, str], DataFrame], s: SparkSession, d: str) -> DataFrame:
    """Race rows without what names their source, as CSV and back: the columns that are left tell what went."""
    path = _folder(s)
    rows = build(s, d).select("team_slug", "planning_year", "race_id", "category", "expected_points", "pcs_race_slug", F.lit("https://example.org/x").alias("notes"), F.lit(None).cast("string").alias("remark"))
    tables.write_csv(tables.without_sources(rows), path)
    back = s.read.option("header", True).csv(path)
    return back.withColumn("columns", F.lit(",".join(sorted(back.columns))))


def _assembled(s: SparkSession, d: str) -> DataFrame:
    """A ranking of nations, of which every fifth has no rider list and every seventh is of another class."""
    key = F.col("n_nationkey")
    ranking = ad.table(s, d, "nation").select(
        key.alias("team_rank"), F.col("n_name").alias("team_name"), F.lower("n_name").alias("team_slug"), F.when(key % 7 == 6, "WT").otherwise("PRT").alias("team_class"),
        (1000.0 - key).alias("ranking_points"), F.concat(F.lit("teams/"), key).alias("breakdown_path"),
    )
    riders = ad.table(s, d, "customer").join(F.broadcast(ad.table(s, d, "nation")), F.col("c_nationkey") == key).where(key % 5 != 0).select(
        F.lower("n_name").alias("team_slug"), F.lit(2001).alias("season_year"), F.col("c_name").alias("rider_name"), F.concat(F.lit("c-"), "c_custkey").alias("rider_slug"),
        F.col("c_custkey").cast("int").alias("team_rank_within_counted_list"), F.col("c_acctbal").alias("points_counted"), F.lit(0.0).alias("points_not_counted"), F.lit(0.0).alias("sanction_points"),
    )
    totals = riders.groupBy("team_slug").agg(F.round(F.sum("points_counted"), 2).alias("total_counted_points"), F.lit(5.0).alias("sanction_points_total"), F.lit("u").alias("source_url"))
    return risk.assemble_contributions(ranking, riders, totals, "current", "", F.lit("2001-12-31"))


def _names(s: SparkSession, d: str) -> DataFrame:
    """Teams by slug, one in three unknown to the contributions, with the total of their first row."""
    teams = ad.table(s, d, "nation").select(F.concat(F.lower("n_name"), F.when(F.col("n_nationkey") % 3 == 0, "-x").otherwise("")).alias("team_slug")).withColumn("pcs_team_slug", F.col("team_slug"))
    return tables.team_names(teams, ad.contributions(s, d).withColumn("team_rank_within_counted_list", F.lit(1)))


def file_queries(expected: Callable[[SparkSession, str], DataFrame]) -> dict[str, Query]:
    measures = "winner_points top10_points total_points finish_rate points_per_top10_form"
    edition = shape(i="race_id year month finishers stage_count startlist_size", s="race_name category race_type", f4=measures, f6="stage_points_share")
    stages = {name: value for name, value in STAGE_DEFAULTS.items()}
    replaced = ", ".join(f"{value!r} AS {name}" for name, value in stages.items() if name in ("stage_count", "stage_points_share"))
    key = shape(i="planning_year race_id", s="team_slug")
    flag = "(CASE s_suppkey % 6 WHEN 2 THEN FALSE WHEN 4 THEN FALSE ELSE TRUE END)"
    first = lambda c: f"coalesce({c}, '')"
    doubled = "SELECT * REPLACE (CASE WHEN team_slug = 'nation-7' THEN 2 ELSE 1 END * expected_points AS expected_points) FROM ev"

    def team(build: Callable[[SparkSession, str], str], slug: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda s, d: incremental.season_table(s, build(s, d), "team_calendar_ev", team_slug=slug, planning_year=ad.PLANNING_YEAR)

    season: Callable[[SparkSession, str], str] = lambda s, d: _season(expected, s, d)
    return {
        "files_editions": Query(_editions, edition, sql.with_ctes(sql.EDITIONS, select="SELECT * FROM editions WHERE year IN (1994, 1995, 1997) AND category IN ('1.1', '1.Pro', '2.1', '2.Pro')")),
        "files_old_editions": Query(_old_editions, edition, sql.with_ctes(sql.EDITIONS, select=f"SELECT * REPLACE ({replaced}) FROM editions")),
        "files_planning": Query(
            _planning, shape(i="race_id month year", s="race_name category date_label calendar_source"),
            sql.with_ctes(sql.NAMES, select=f"SELECT race_id, month(start_date) AS month, season AS year, race_name, '1.1' AS category, {_LABEL} AS date_label, 'snapshot' AS calendar_source FROM planned WHERE race_id % 2 = 0 AND month(start_date) BETWEEN 3 AND 9"),
        ),
        "files_contributions": Query(
            _contributions, shape(i="team_rank", s="team_slug rider_name rider_slug season_years", f4="points_counted points_not_counted sanction_points"),
            sql.with_ctes(sql.CONTRIBUTIONS, select="SELECT * FROM placed_riders"),
        ),
        "files_programme": Query(
            _programme, shape(s="source_race_name observed_date category source_url pcs_race_slug"),
            sql.with_ctes(
                sql.NAMES,
                select=f"""SELECT race_name AS source_race_name, {_LABEL} AS observed_date, CASE WHEN race_id % 2 = 0 THEN '1.1' ELSE '2.1' END AS category,
                CASE race_id % 3 WHEN 0 THEN 'race/r-' || race_id || '/2001/result' WHEN 1 THEN 'https://example.org/team-in-race/t/r-' || race_id || '/2001' END AS source_url,
                CASE race_id % 3 WHEN 2 THEN '' ELSE 'r-' || race_id END AS pcs_race_slug FROM planned""",
            ),
        ),
        "files_manifest": Query(
            _manifest, shape(i="planning_year", s="team_slug pcs_team_slug team_name profile_path", b="enabled"),
            f"SELECT 2026 AS planning_year, 'Team-' || s_suppkey AS team_slug, 't-' || s_suppkey AS pcs_team_slug, s_name AS team_name, '' AS profile_path, TRUE AS enabled FROM supplier WHERE {flag}",
        ),
        "published_season": Query(
            lambda s, d: incremental.season_table(s, season(s, d), "team_calendar_ev"), {**key, **shape(s="status category", f4="expected_points actual_points")}, sql.with_ctes(sql.EV, select=doubled),
        ),
        "published_team": Query(team(season, "nation-7"), {**key, **shape(f4="expected_points")}, sql.with_ctes(sql.EV, select=f"SELECT * FROM ({doubled}) WHERE team_slug = 'nation-7'")),
        "published_catalog": Query(
            lambda s, d: snapshots.published_catalog(s, season(s, d)), shape(i="planning_year", s="team_slug team_name label"),
            sql.with_ctes(sql.EV, select="""SELECT DISTINCT planning_year, team_slug, CASE WHEN team_slug = 'nation-7' THEN 'Nation 7' ELSE 'Nation ' || substr(team_slug, 8) END AS team_name,
            'Nation ' || substr(team_slug, 8) || ' (' || planning_year || ')' AS label FROM ev"""),
        ),
        "files_export": Query(
            lambda s, d: _export(expected, s, d), {**key, **shape(s="category columns", f4="expected_points")},
            sql.with_ctes(sql.EV, select="SELECT *, 'category,expected_points,planning_year,race_id,remark,team_slug' AS columns FROM ev"),
        ),
        "contribution_rows": Query(
            _assembled, shape(i="team_rank team_rank_within_counted_list season_year", s="team_slug team_class rider_name rider_slug source_url", f4="ranking_total_points team_total_points sanction_points_total points_counted", b="is_placeholder_team_row"),
            f"""WITH riders AS (SELECT * FROM customer WHERE c_nationkey % 5 <> 0), totals AS (SELECT c_nationkey, round(sum(c_acctbal), 2) AS total FROM riders GROUP BY 1)
            SELECT n_nationkey AS team_rank, coalesce(r.c_custkey, 0) AS team_rank_within_counted_list, CASE WHEN r.c_custkey IS NOT NULL THEN 2001 END AS season_year, lower(n_name) AS team_slug, 'PRT' AS team_class,
            {first("c_name")} AS rider_name, {first("'c-' || r.c_custkey")} AS rider_slug, CASE WHEN t.total IS NULL THEN '' ELSE 'u' END AS source_url, 1000.0 - n_nationkey AS ranking_total_points,
            CASE WHEN coalesce(t.total, 0) <> 0 THEN t.total ELSE 1000.0 - n_nationkey END AS team_total_points, CASE WHEN t.total IS NULL THEN 0.0 ELSE 5.0 END AS sanction_points_total,
            coalesce(c_acctbal, 0) AS points_counted, r.c_custkey IS NULL AS is_placeholder_team_row
            FROM nation LEFT JOIN totals t ON t.c_nationkey = n_nationkey LEFT JOIN riders r ON r.c_nationkey = n_nationkey WHERE n_nationkey % 7 <> 6""",
        ),
        "reference_totals": Query(
            _names, shape(s="team_slug team_name", f4="reference_total_points"),
            sql.with_ctes(
                sql.CONTRIBUTIONS,
                select="""SELECT lower(n_name) || CASE WHEN n_nationkey % 3 = 0 THEN '-x' ELSE '' END AS team_slug, CASE WHEN n_nationkey % 3 = 0 OR nk IS NULL THEN lower(n_name) || CASE WHEN n_nationkey % 3 = 0 THEN '-x' ELSE '' END ELSE n_name END AS team_name,
                CASE WHEN n_nationkey % 3 <> 0 THEN team_total_points END AS reference_total_points FROM nation LEFT JOIN team_totals ON nk = n_nationkey""",
            ),
        ),
    }
