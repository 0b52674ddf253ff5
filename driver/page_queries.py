"""The page readers over pages composed from the given tables, all rows; the SQL reads the same values from the tables.

No page holds more than the rows of one order, or of a block of fifty keys, whatever the size of the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driver import adapters as ad
from driver.registry import Query, shape
from echelon.operators import pages

BLOCK = 50
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
RESULTS = ("Pos", "Rider", "Team", "UCI")
STARTS = ("BiB", "Rider", "Starts", "Wins", "Podium", "Top 10")
RANKINGS = ("#", "Prev.", "Diff.", "Team", "Class", "Points")
CURRENT = ("#", "Rider", "Points counted", "Points not counted", "Sanctions")
CYCLE = ("Season", "Rider", "Nth best rider for team", "Points counted", "Not counted", "Sanction points")
PROGRAMME = ("", "Date", "Race", "Class")
POINTS = ("#", "Rider", "Points")


def _text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value.cast("string")


def _tags(tag: str, values: Sequence[Column | str]) -> Column:
    return F.concat(*[F.concat(F.lit(f"<{tag}>"), F.coalesce(_text(v), F.lit("")), F.lit(f"</{tag}>")) for v in values])


def _row(*cells: Column | str) -> Column:
    return F.concat(F.lit("<tr>"), _tags("td", cells), F.lit("</tr>"))


def _link(path: Column, label: Column | str) -> Column:
    return F.concat(F.lit('<a href="'), path, F.lit('">'), _text(label), F.lit("</a>"))


def _number(value: Column) -> Column:
    return value.cast("decimal(20,2)").cast("string")


def _block(key: str) -> Column:
    return F.floor(F.col(key) / BLOCK).cast("long")


def _composed(
    rows: DataFrame, page: Column, order: Sequence[str], headers: Sequence[str], row: Column | Callable[[Column], Column], before: Column | str = "", footer: Column | str = "", url: Column | str = "page.php"
) -> DataFrame:
    """One page per value of `page`: `before`, a decoy table without the needed headers, and the table.

    A row that is a function of the values in `order` is spelled after they came together, so that only values are shuffled.
    """
    spelled, marks = callable(row), {"before": before, "footer": footer, "url": url}
    varying = {name: _text(value) for name, value in marks.items() if isinstance(value, Column)}
    listed = rows.select(page.alias("page_id"), F.struct(*order, *([] if spelled else [row.alias("html")])).alias("r"), *[value.alias(name) for name, value in varying.items()])
    grouped = listed.groupBy("page_id").agg(F.array_sort(F.collect_list("r")).alias("rows"), *[F.max(c).alias(c) for c in varying])
    grouped = grouped.withColumns({name: _text(value) for name, value in marks.items() if name not in varying})
    body = F.array_join(F.transform("rows", row if spelled else lambda r: r["html"]), "")
    head = F.concat(F.lit("<table><tr><th>menu</th></tr><tr><td>x</td></tr></table><table><tr>"), _tags("th", headers), F.lit("</tr>"))
    return grouped.select("page_id", "url", F.concat("before", head, body, "footer", F.lit("</table>")).alias("html"))


def _lines(s: SparkSession, d: str) -> DataFrame:
    return ad.table(s, d, "lineitem")


def result_pages(s: SparkSession, d: str) -> DataFrame:
    points = lambda r: F.replace(_number(r["l_extendedprice"]), F.lit("."), F.lit(","))
    row = lambda r: _row(r["l_linenumber"], F.concat(F.lit("rider "), r["l_partkey"]), "T", F.when(r["l_returnflag"] == "R", "-").otherwise(points(r)))
    return _composed(_lines(s, d), F.col("l_orderkey"), [*_LINE_ORDER, "l_returnflag"], RESULTS, row)


def start_pages(s: SparkSession, d: str) -> DataFrame:
    row = lambda r: _row(
        r["l_linenumber"], _link(F.concat(F.lit("rider/"), r["l_partkey"]), F.concat(F.lit("Rider "), r["l_partkey"])), r["l_quantity"].cast("int"),
        F.round(r["l_discount"] * 100).cast("int"), F.round(r["l_tax"] * 100).cast("int"), r["l_linenumber"],
    )
    return _composed(_lines(s, d), F.col("l_orderkey"), [*_LINE_ORDER, "l_quantity", "l_discount", "l_tax"], STARTS, row)


def header_pages(s: SparkSession, d: str) -> DataFrame:
    key = F.col("race_id")
    stages = F.transform(F.sequence(F.lit(0), (key % 4).cast("int")), lambda i: F.concat(F.lit('<option value="'), F.when(i > 0, i.cast("string")).otherwise(""), F.lit('">s</option>')))
    heading = F.concat(F.lit("<h2>Round <b>"), key, F.lit("</b>, "), F.when(key % 7 != 0, F.col("race_country")).otherwise(""), F.lit("</h2><h2>second</h2>"))
    select = F.concat(F.lit('<select name="e">'), F.array_join(stages, ""), F.lit("</select>"))
    return ad.race_names(s, d).select(F.col("race_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<title>t</title>"), heading, select).alias("html"))


def month_pages(s: SparkSession, d: str) -> DataFrame:
    """Month pages of blocks of races; each race is on two of them, and the later month counts."""
    key = F.col("race_id")
    months = ad.race_names(s, d).select("*", F.explode(F.array(F.lit(1), F.lit(7))).alias("shift")).withColumn("month", key % 6 + F.col("shift"))
    kind = F.when(key % 5 == 0, "1.4").otherwise(F.concat("type_digit", F.lit(".1")))
    row = _row("Mo", F.concat(F.lit("0"), key % 9 + 1, F.lit(".0"), F.col("shift")), kind, F.concat(F.lit("XX "), _link(F.concat(F.lit("race.php?y=2001&amp;r="), key), F.col("base_name")), F.lit(" (old)")))
    page = (_block("race_id") * 100 + F.col("month")).cast("long")
    return _composed(months, page, ["race_id"], ("a",), row, url=F.concat(F.lit("races.php?m="), F.col("month"), F.lit("&y=2001")))


def ranking_pages(s: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    points = F.format_number(F.abs("s_acctbal"), 2)
    path = F.concat(F.lit("/team/t-"), key, F.when(key % 6 == 0, "/results/x").otherwise("/"))
    row = _row(F.when(key % 11 == 0, "-").otherwise(key.cast("string")), "1", "", _link(path, F.col("s_name")), F.when(key % 3 == 0, "PRT").otherwise("WT"), points)
    return _composed(ad.table(s, d, "supplier"), _block("s_suppkey"), ["s_suppkey"], RANKINGS, row)


def current_pages(s: SparkSession, d: str) -> DataFrame:
    key, block = F.col("c_custkey"), _block("c_custkey")
    row = _row(key % 30 + 1, _link(F.concat(F.lit("rider/c-"), key), F.col("c_name")), _number(F.col("c_acctbal")), "-", key % 4)
    footer = F.when(block % 3 == 0, _row("", "", F.concat(F.lit("1"), block), "", "")).otherwise("")
    heading = F.concat(F.lit("<h2>"), F.when(block % 5 != 4, F.concat(2000 + block % 2, F.lit(" season"))).otherwise("Season"), F.lit("</h2>"))
    return _composed(ad.table(s, d, "customer"), block, ["c_custkey"], CURRENT, row, heading, footer)


def cycle_pages(s: SparkSession, d: str) -> DataFrame:
    key, block = F.col("c_custkey"), _block("c_custkey")
    row = _row(1998 + key % 3, _link(F.concat(F.lit("rider/c-"), key), F.col("c_name")), key % 30 + 1, _number(F.col("c_acctbal")), "1,000", key % 4)
    footer = F.when(block % 2 == 0, _row("", "", "", F.concat(F.lit("5"), block), "", block % 3)).otherwise("")
    return _composed(ad.table(s, d, "customer"), block, ["c_custkey"], CYCLE, row, "", footer)


def programme_pages(s: SparkSession, d: str) -> DataFrame:
    key, block = F.col("p_partkey"), _block("p_partkey")
    slug = F.concat(F.lit("race-"), key)
    path = F.when(key % 3 == 0, F.concat(F.lit("race/"), slug, F.lit("/2001/start"))).otherwise(F.concat(F.lit("team-in-race/t/"), slug, F.lit("/2001")))
    row = _row("1", F.concat(F.lit("2001-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0")), F.when(key % 10 == 9, F.lit("")).otherwise(_link(path, F.col("p_name"))), F.concat(F.lit("1."), key % 3))
    title = F.concat(F.lit("<title>"), F.when(block % 2 == 0, "Program for ").otherwise("Races for "), F.lit("Team "), block, F.lit("</title>"))
    return _composed(ad.table(s, d, "part"), block, ["p_partkey"], PROGRAMME, row, title)


def race_point_pages(s: SparkSession, d: str) -> DataFrame:
    key = F.col("l_orderkey")
    points = F.when((key % 50 == 0) & (F.col("l_linenumber") == 1), "n/a").when(F.col("l_returnflag") == "A", "-").otherwise(F.format_number("l_extendedprice", 2))
    row = _row(F.col("l_linenumber"), F.when(key % 20 != 1, F.concat(F.lit("r"), F.col("l_partkey"))).otherwise(""), points)
    return _composed(_lines(s, d), key, _LINE_ORDER, POINTS, row, url=F.concat(F.lit("u"), key))


_PLACED = f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)})"
_RACES = "SELECT s_suppkey AS k, s_name || CASE WHEN s_suppkey % 9 = 4 THEN ' Time Trial' WHEN s_suppkey % 9 = 7 THEN ' Chrono' ELSE '' END AS name, n_name, CASE WHEN s_nationkey % 2 = 0 THEN '1' ELSE '2' END AS digit FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def page_queries() -> dict[str, Query]:
    riders = shape(i="page_id season_year team_rank_within_counted_list", s="rider_name rider_slug", f4="points_counted points_not_counted sanction_points")
    totals = shape(i="page_id", f4="total_counted_points sanction_points_total")
    return {
        "page_results": Query(
            lambda s, d: pages.result_rows(result_pages(s, d)), shape(i="page_id row_no", f4="points"),
            f"SELECT l_orderkey AS page_id, {_PLACED} AS row_no, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice END AS points FROM lineitem",
        ),
        "page_startlists": Query(
            lambda s, d: pages.startlist_rows(start_pages(s, d)), shape(i="page_id row_no starts wins podiums top10s", s="rider"),
            f"""SELECT l_orderkey AS page_id, {_PLACED} AS row_no, 'Rider ' || l_partkey AS rider, l_quantity AS starts, round(l_discount * 100) AS wins, round(l_tax * 100) AS podiums,
            l_linenumber AS top10s FROM lineitem""",
        ),
        "page_header": Query(
            lambda s, d: pages.header_metadata(header_pages(s, d)).withColumn("stages", F.array_join("stage_ids", ",")), shape(i="page_id", s="race_subtitle race_country stages"),
            f"""SELECT k AS page_id, 'Round ' || k || ' ,' || CASE WHEN k % 7 <> 0 THEN ' ' || n_name ELSE '' END AS race_subtitle, CASE WHEN k % 7 <> 0 THEN n_name ELSE 'Round ' || k END AS race_country,
            CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '1,2' ELSE '1,2,3' END AS stages FROM ({_RACES})""",
        ),
        "page_calendar": Query(
            lambda s, d: pages.calendar_entries(month_pages(s, d)), shape(i="race_id month year", s="race_name category date_label"),
            f"""SELECT k AS race_id, name AS race_name, digit || '.1' AS category, '0' || (k % 9 + 1) || '.07' AS date_label, k % 6 + 7 AS month, 2001 AS year FROM ({_RACES}) WHERE k % 5 <> 0""",
        ),
        "page_rankings": Query(
            lambda s, d: pages.team_rankings(ranking_pages(s, d), "results/uci"), shape(i="page_id team_rank", s="team_name team_class team_slug breakdown_path", f4="ranking_points"),
            f"""SELECT s_suppkey // {BLOCK} AS page_id, s_suppkey AS team_rank, s_name AS team_name, CASE WHEN s_suppkey % 3 = 0 THEN 'PRT' ELSE 'WT' END AS team_class,
            't-' || s_suppkey AS team_slug, 'team/t-' || s_suppkey || '/results/uci' AS breakdown_path, round(abs(s_acctbal), 2) AS ranking_points FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 6 <> 0""",
        ),
        "page_current_riders": Query(
            lambda s, d: pages.current_breakdown(current_pages(s, d))[0], riders,
            f"""SELECT c_custkey // {BLOCK} AS page_id, CASE WHEN c_custkey // {BLOCK} % 5 <> 4 THEN 2000 + c_custkey // {BLOCK} % 2 END AS season_year, c_custkey % 30 + 1 AS team_rank_within_counted_list,
            c_name AS rider_name, 'c-' || c_custkey AS rider_slug, round(c_acctbal, 2) AS points_counted, 0 AS points_not_counted, c_custkey % 4 AS sanction_points FROM customer""",
        ),
        "page_current_totals": Query(
            lambda s, d: pages.current_breakdown(current_pages(s, d))[1], totals,
            f"""SELECT c_custkey // {BLOCK} AS page_id, CASE WHEN c_custkey // {BLOCK} % 3 = 0 THEN CAST('1' || (c_custkey // {BLOCK}) AS DOUBLE) ELSE sum(round(c_acctbal, 2)) END AS total_counted_points,
            sum(c_custkey % 4) AS sanction_points_total FROM customer GROUP BY c_custkey // {BLOCK}""",
        ),
        "page_cycle_riders": Query(
            lambda s, d: pages.cycle_breakdown(cycle_pages(s, d))[0], riders,
            f"""SELECT c_custkey // {BLOCK} AS page_id, 1998 + c_custkey % 3 AS season_year, c_custkey % 30 + 1 AS team_rank_within_counted_list,
            c_name AS rider_name, 'c-' || c_custkey AS rider_slug, round(c_acctbal, 2) AS points_counted, 1000 AS points_not_counted, c_custkey % 4 AS sanction_points FROM customer""",
        ),
        "page_cycle_totals": Query(
            lambda s, d: pages.cycle_breakdown(cycle_pages(s, d))[1], totals,
            f"""SELECT b AS page_id, CASE WHEN b % 2 = 0 THEN CAST('5' || b AS DOUBLE) ELSE counted END AS total_counted_points, CASE WHEN b % 2 = 0 AND b % 3 > 0 THEN b % 3 ELSE sanctions END AS sanction_points_total
            FROM (SELECT c_custkey // {BLOCK} AS b, sum(round(c_acctbal, 2)) AS counted, sum(c_custkey % 4) AS sanctions FROM customer GROUP BY 1)""",
        ),
        "page_programme": Query(
            lambda s, d: pages.programme_entries(programme_pages(s, d)), shape(i="page_id row_no", s="team_name source_race_name observed_date category pcs_race_slug"),
            f"""SELECT * FROM (SELECT p_partkey // {BLOCK} AS page_id, row_number() OVER (PARTITION BY p_partkey // {BLOCK} ORDER BY p_partkey) AS row_no, 'Team ' || (p_partkey // {BLOCK}) AS team_name, p_name AS source_race_name,
            '2001-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS observed_date, '1.' || (p_partkey % 3) AS category, 'race-' || p_partkey AS pcs_race_slug, p_partkey AS k FROM part) WHERE k % 10 <> 9""",
        ),
        "page_race_points": Query(
            lambda s, d: pages.race_points(race_point_pages(s, d)), shape(i="page_id rider_count", s="source_url error", b="has_rows", f4="actual_points"),
            """SELECT l_orderkey AS page_id, 'u' || l_orderkey AS source_url, CASE WHEN k % 20 = 1 THEN 0 ELSE n END AS rider_count, k % 20 <> 1 AS has_rows, CASE WHEN bad THEN 'ValueError' END AS error,
            CASE WHEN bad THEN NULL WHEN k % 20 = 1 THEN 0 ELSE points END AS actual_points
            FROM (SELECT l_orderkey, l_orderkey AS k, count(*) AS n, l_orderkey % 50 = 0 AND bool_or(l_linenumber = 1) AS bad, sum(CASE WHEN l_returnflag = 'A' THEN 0 ELSE round(l_extendedprice, 2) END) AS points FROM lineitem GROUP BY 1)""",
        ),
    }
