"""Landed pages, table files and the registered entry points."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from echelon import schemas
from echelon.operators import editions as ed, pages
from echelon.sources import tables



def html_table(headers, *rows):
    cells = lambda tag, values: "".join(f"<{tag}>{value}</{tag}>" for value in values)
    return "<table><tr>" + cells("th", headers) + "</tr>" + "".join(f"<tr>{cells('td', row)}</tr>" for row in rows) + "</table>"


def link(path, label):
    return f'<a href="{path}">{label}</a>'


RESULT_HEADERS = ("Pos", "Rider", "Team", "UCI")
LAYOUT = "<table><tr><td>menu</td><td>" + html_table(("Pos", "Rider"), ("1", "only half a list")) + "</td></tr></table>"
RESULTS = (
    "<h2>Road, Stages, Nordland</h2><h2>ignored</h2>"
    '<select name="other"><option value="9">x</option></select><select name="e"><option value=" ">all</option><option value="7">I</option><option value="8">II</option><option value="7">I</option></select>'
    + LAYOUT + html_table(RESULT_HEADERS, ("1", "Ada", "North", "33,5"), ("2", "Bo", "South", "12"), ("3", "Cy", "West", "-"), ("4", "Di", "West"))
)
STAGE = html_table(RESULT_HEADERS, ("1", "Bo", "South", "8"), ("2", "Ada", "North", "3")) + html_table(RESULT_HEADERS, ("1", "second table", "", "999"))
NO_POINTS = html_table(("Pos", "Rider", "Team", "Time"), ("1", "Bo", "South", "4:01"))
START = html_table(("BiB", "Rider", "Starts", "Wins", "Podium", "Top 10"), ("5", "Ada", "31", "3", "4", "9"), ("6", "Bo", "0", "0", "0", "0"), ("7", "Cy", "12", "", "1", "1"))
RANKING = html_table(
    ("#", "Prev.", "Diff.", "Team", "Class", "Points"),
    ("3", "4", "+1", link("/team/north-2031/", "North") + " &amp; Co", "PRT", "1,204.25"), ("4", "3", "", link("team/south-2031/results/x", "only results"), "PRT", "10"),
    ("5", "5", "", link("team/west-2031", "West"), "", "7"), ("6", "-"),
)
CURRENT = "<h2>2031 (second tier)</h2>" + html_table(
    ("#", "RIDER", "Points counted", "Points not counted", "Sanctions"),
    ("1", link("rider/ada-n", "N Ada"), "61.75", "-", "-"), ("2", link("rider/bo-s", "S Bo"), "20", "4.5", "3"), ("", "no rank", "1", "", ""), ("", "", "90", "", ""),
)
CYCLE = html_table(("Season", "Points"), ("2031", "70")) + html_table(
    ("Season", "Rider", "Nth best rider for team", "Points counted", "Not counted", "Sanction points"),
    ("2030", link("rider/cy-w", "W Cy"), "4", "17", "1", "2"), ("2031", link("rider/cy-w", "W Cy"), "2", "53", "-", "-"), ("", "", "", "", "", ""),
)
PROGRAMME = "<html><head><title>Program for The North Wind</title></head>" + html_table(
    ("", "Date", "Race", "Class"), ("1", "2031-02-09", link("race/coast-loop/2031/startlist", "Coast <i>Loop</i>"), "1.Pro"), ("2", "2031-02-11", "", "1.1"), ("3", "2031-03-01", "Unlinked Race", "2.1")
)
POINTS = html_table(("#", "Rider", "Points"), ("1", "Ada", "7.5"), ("2", "Bo", "0"), ("3", "Cy", "4"), ("4", "", "100"))
MONTH = "<table><tr><td>x</td></tr>" + "".join(
    "<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>"
    for row in (
        ("Sat", "07.06", "2.1", "NO " + link("race.php?y=2031&amp;r=318", "Fjord &lt;Tour&gt;") + " (new)"), ("Sun", "08.06", "1.4", link("race.php?r=319", "Out of scope")),
        ("Mon", "09.06", "1.1", link("team.php?r=320", "Not a race")), ("Tue", "10.06", "1.1", "No link"),
    )
) + "</table>"


@pytest.fixture(scope="module")
def landed(spark):
    html = [RESULTS, START, STAGE, NO_POINTS, RANKING, CURRENT, CYCLE, PROGRAMME, POINTS, "<p>nothing</p>", MONTH, POINTS.replace("7.5", "many"), None]
    return spark.createDataFrame([(i, f"race.php?t=2&y=2031&m=0{i % 9 + 1}", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def only(df, *ids):
    return df.where(F.col("page_id").isin(*ids))


def test_edition_from_pages(spark, landed):
    rows = pages.result_rows(landed)
    keys = lambda df: df.withColumns({"race_id": F.lit(318).cast("long"), "year": F.lit(2031)})
    order = [F.col("row_no")]
    gc = ed.summarise_results(keys(only(rows, 0)), ["race_id", "year"], order, F.col("points"))
    wanted = keys(only(landed, 2, 3).select(F.col("page_id").alias("stage")))
    parsed = ed.summarise_results(keys(only(rows, 2, 3)).withColumn("stage", F.col("page_id")), ["race_id", "year", "stage"], order, F.col("points"))
    stages = ed.summarise_stages(wanted.join(parsed, ["race_id", "year", "stage"], "left"), ["race_id", "year"])
    start = ed.summarise_startlist(keys(only(pages.startlist_rows(landed), 1)), ["race_id", "year"], *[F.col(c) for c in ("starts", "wins", "podiums", "top10s")], ["row_no"])
    entries = spark.createDataFrame([(318, 2031, "Fjord", "2.1"), (319, 2031, "Gone", "1.1")], "race_id long, year int, race_name string, category string")
    editions, errors = ed.assemble_editions(entries, gc, start, stages)
    row = editions.first()
    assert (row.finishers, row.gc_scoring_places, row.gc_top10_points, row.stage_top10_points, row.top10_points, row.winner_points) == (4, 2, 45.5, 11.0, 56.5, 41.5)
    assert (row.stage_count, row.stage_pages_parsed, row.stage_pages_missing, row.startlist_size, row.experienced_riders) == (2, 1, 1, 3, 2)
    assert row.stage_points_share == pytest.approx(11 / 56.5) and row.finish_rate == pytest.approx(4 / 3)
    assert row.total_field_form == pytest.approx((15 + 2 + 5 + 3.1) + (2 + 1.2)) and row.race_type == "Stage race"
    assert [(e.race_name, e.error) for e in errors.collect()] == [("Gone", "Could not find a results table")]
    meta = only(pages.header_metadata(landed), 0).first()
    assert (meta.race_subtitle, meta.race_country, meta.stage_ids) == ("Road, Stages, Nordland", "Nordland", ["7", "8"])


def test_rankings_and_breakdowns(landed):
    team = pages.team_rankings(landed, "results/all").collect()
    assert [(t.team_rank, t.team_name, t.team_slug, t.ranking_points, t.breakdown_path) for t in team] == [(3, "North & Co", "north-2031", 1204.25, "team/north-2031/results/all")]
    riders, totals = pages.current_breakdown(landed)
    assert {(r.season_year, r.rider_slug, r.points_counted, r.points_not_counted, r.sanction_points) for r in riders.collect()} == {(2031, "ada-n", 61.75, 0.0, 0.0), (2031, "bo-s", 20.0, 4.5, 3.0)}
    both = lambda t: (t.total_counted_points, t.sanction_points_total)
    assert both(only(totals, 5).first()) == (90.0, 3.0) and both(only(totals, 9).first()) == (0.0, 0.0)
    riders, totals = pages.cycle_breakdown(landed)
    assert {(r.season_year, r.team_rank_within_counted_list, r.points_counted) for r in riders.collect()} == {(2030, 4, 17.0), (2031, 2, 53.0)}
    assert both(only(totals, 6).first()) == (70.0, 2.0)


def test_programme_points_and_calendar_pages(landed):
    entry = pages.programme_entries(landed).collect()
    assert [(e.team_name, e.source_race_name, e.observed_date, e.pcs_race_slug, e.category) for e in entry] == [
        ("The North Wind", "Coast Loop", "2031-02-09", "coast-loop", "1.Pro"), ("The North Wind", "Unlinked Race", "2031-03-01", "", "2.1"),
    ]
    points = {r.page_id: (r.actual_points, r.rider_count, r.has_rows, r.error) for r in only(pages.race_points(landed), 8, 9, 11, 12).collect()}
    assert points == {8: (11.5, 3, True, None), 9: (0.0, 0, False, None), 11: (None, 3, True, "ValueError"), 12: (0.0, 0, False, None)}
    listed = pages.calendar_entries(only(landed, 10)).collect()
    assert [(e.race_id, e.race_name, e.category, e.date_label, e.month, e.year) for e in listed] == [(318, "Fjord <Tour>", "2.1", "07.06", 2, 2031)]


def test_each_page_is_parsed_once(landed):
    for frame in (*pages.current_breakdown(landed), *pages.cycle_breakdown(landed), pages.programme_entries(landed), pages.race_points(landed), pages.calendar_entries(landed)):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_tables_round_trip(spark, tmp_path):
    planning = spark.createDataFrame([(1, "A", "1.1", "23.10", 10, 2026)], schemas.PLANNING)
    tables.write_csv(planning, str(tmp_path / "planning.csv"))
    back = tables.read_planning(spark, str(tmp_path / "none"), str(tmp_path / "planning.csv")).first()
    assert (back.category, back.date_label, back.calendar_source) == ("1.1", "23.10", "snapshot")
    assert tables.read_planning(spark, None, str(tmp_path / "none.csv")).isEmpty()
    assert tables.read_editions(spark, str(tmp_path / "none"), years=[2024]).count() == 0
    summary = spark.createDataFrame([("a-b", 2026, 1.0), ("c", 2026, 2.0)], "team_slug string, planning_year int, total_expected_points double")
    tables.write_season({"team_ev_summary": summary}, str(tmp_path / "season"))
    tables.write_season({"team_ev_summary": summary.where("team_slug = 'c'").withColumn("total_expected_points", F.lit(9.0))}, str(tmp_path / "season"))
    read = tables.read_season(spark, str(tmp_path / "season"), "team_ev_summary", schemas.EV_SUMMARY)
    assert {r.team_slug: r.total_expected_points for r in read.collect()} == {"a-b": 1.0, "c": 9.0}
    names = spark.createDataFrame([("a-b", 2026, " ")], "team_slug string, planning_year int, team_name string")
    assert [r.label for r in tables.season_catalog(summary, names).collect()] == ["A B (2026)"]
    rows = spark.createDataFrame([("x", "http://a", "see pcs here", "ok", 1)], "name string, link string, note string, fine string, source_url int")
    assert tables.without_sources(rows).columns == ["name", "fine"]
    nested = spark.createDataFrame(
        [({"note": "http://a", "good": "b", "page_url": "c"}, ["PCS", "d"], ("e", "f", [("https://g", 1)]))], "m map<string,string>, a array<string>, s struct<pcs_id: string, kept: string, deep: array<struct<text: string, n: int>>>"
    )
    row = tables.without_sources(nested).first()
    assert (row.m, row.a, row.s.asDict(True)) == ({"good": "b"}, ["d"], {"kept": "f", "deep": [{"text": None, "n": 1}]})


def test_manifest(spark, tmp_path):
    path = tmp_path / "manifest.csv"
    path.write_text("team_slug,pcs_team_slug,team_name,planning_year,profile_path,enabled,notes\na-2026,a-2026,A,2026,,,\nb,b-2026,B,2026,,no,\n")
    teams = tables.read_manifest(spark, str(path)).orderBy("team_slug").collect()
    assert [(t.team_slug, t.enabled) for t in teams] == [("a", True), ("b", False)]
    assert tables.read_manifest(spark, str(path), enabled_only=True, team_slug="a-2026").count() == 1
    path.write_text("team_slug,pcs_team_slug,team_name,planning_year,profile_path,enabled,notes\na,a,,x,,maybe,\n")
    with pytest.raises(ValueError, match="missing team_name"):
        tables.read_manifest(spark, str(path))
    with pytest.raises(FileNotFoundError):
        tables.read_manifest(spark, str(tmp_path / "none.csv"))


def test_entry_points():
    import __spark_entry__ as entry_points

    queries, statements = entry_points.queries(), entry_points.oracle_sql()
    assert set(statements) <= set(queries) and len(queries) >= 70
    database = duckdb.connect()
    for name in "nation supplier customer part orders lineitem events documents pages region".split():
        database.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    for name, statement in statements.items():
        database.execute(f"EXPLAIN {statement}")
    assert json.dumps(sorted(queries))
