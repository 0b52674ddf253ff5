"""Tables and marks of landed web pages, and the records read from them.

A small HTML reader (the only Python here) turns each page into table rows; everything after
that is DataFrame work on those rows. Fetching is not part of this: pages are landed first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from echelon.constants import TARGET_CATEGORIES
from echelon.functions.columns import text
from echelon.functions.text import digits_only, heading_year, lenient_number, race_slug, slug_after, strict_number
from echelon.operators.spread import first_rows

_ROWS = (
    "page_id long, heading string, title string, table_no int, row_no int, headers array<string>, cells array<string>, "
    "links array<array<string>>, link_texts array<array<string>>"
)
_ROWS_PER_BATCH = 10_000
_MARKS = "page_id long, heading string, title string, stage_ids array<string>"


def _words(parts: list[str]) -> str:
    return " ".join(p.strip() for p in parts if p.strip())


class _Page(HTMLParser):
    """Collects table rows (with header texts, cell texts and each cell's links and their texts), the first h2, the title and stage options."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.headers: dict[int, list[str]] = {}
        self.heading: str | None = None
        self.title: str | None = None
        self.stage_ids: list[str] = []
        self._tables: list[int] = []
        self._seen_tables = 0
        self._row: dict | None = None
        self._open: dict[str, list[str]] = {}
        self._in_stage_select = self._stage_select_done = False

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        values = dict(attributes)
        if tag == "table":
            self._close_row()
            self._tables.append(self._seen_tables)
            self.headers[self._seen_tables] = []
            self._seen_tables += 1
        elif tag == "tr":
            self._close_row()
            number = self._tables[-1] if self._tables else -1
            self._row = {"table_no": number, "cells": [], "links": [], "link_texts": []}
        elif tag in ("td", "th"):
            self._close_cell()
            self._open[tag] = []
            if tag == "td" and self._row is not None:
                self._row["links"].append([])
                self._row["link_texts"].append([])
        elif tag == "a":
            self._close_link()
            if "td" in self._open and self._row is not None and values.get("href") is not None:
                self._row["links"][-1].append(values["href"])
                self._row["link_texts"][-1].append("")
                self._open[tag] = []
        elif (tag == "h2" and self.heading is None) or (tag == "title" and self.title is None):
            self._open[tag] = []
        elif tag == "select" and values.get("name") == "e" and not self._stage_select_done:
            self._in_stage_select = True
        elif tag == "option" and self._in_stage_select:
            value = (values.get("value") or "").strip()
            if value and value not in self.stage_ids:
                self.stage_ids.append(value)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self._close_cell()
        elif tag == "a":
            self._close_link()
        elif tag == "tr":
            self._close_row()
        elif tag == "table":
            self._close_row()
            if self._tables:
                self._tables.pop()
        elif tag in ("h2", "title") and tag in self._open:
            setattr(self, "heading" if tag == "h2" else "title", _words(self._open.pop(tag)))
        elif tag == "select" and self._in_stage_select:
            self._in_stage_select, self._stage_select_done = False, True

    def handle_data(self, data: str) -> None:
        for parts in self._open.values():
            parts.append(data)

    def _close_link(self) -> None:
        if "a" in self._open:
            text = _words(self._open.pop("a"))
            if self._row is not None:
                self._row["link_texts"][-1][-1] = text

    def _close_cell(self) -> None:
        self._close_link()
        if "td" in self._open:
            cell = _words(self._open.pop("td"))
            if self._row is not None:
                self._row["cells"].append(cell)
        if "th" in self._open:
            head = _words(self._open.pop("th"))
            if self._tables:
                self.headers[self._tables[-1]].append(head)

    def _close_row(self) -> None:
        self._close_cell()
        if self._row is not None:
            self.rows.append(self._row)
            self._row = None

    def finish(self) -> "_Page":
        self.close()
        self._close_row()
        return self


# Tags without attributes or with such as most pages have, and elements whose content is not read as tags.
_TAG = re.compile(r"(/?)([a-z][a-z0-9]*)")
_OPENED = re.compile(r'([a-z][a-z0-9]*)((?:\s+[a-z]+="[^"&]*")+)')
_ATTRIBUTE = re.compile(r'\s([a-z]+)="([^"]*)"')
_RAW = frozenset("script style textarea xmp iframe noembed noframes noscript plaintext svg math".split())


@lru_cache(maxsize=10_000)
def _plain_tag(written: str) -> tuple[str, str, list[tuple[str, str]]] | None:
    """(slash, name, attributes) of what stands between < and >; null if it's no plain tag."""
    found, attributes = _TAG.fullmatch(written), []
    if found is None:
        found = _OPENED.fullmatch(written)
        if found is None:
            return None
        name, rest = found.groups()
        slash, attributes = "", _ATTRIBUTE.findall(rest)
    else:
        slash, name = found.groups()
    return None if name in _RAW else (slash, name, attributes)


def _plain_page(html: str) -> _Page | None:
    """A page of nothing but plain tags and text, as the parser of the library reads it in several times the time; null for any other."""
    page, pieces = _Page(), html.split("<")
    opened, last, i = page._open, len(pieces) - 1, 1
    while i <= last:
        written, end, text = pieces[i].partition(">")
        if not end:
            return None
        if "&" in text:
            text = unescape(text)
        i += 1
        if not opened and i <= last:  # most cells and headers are text only
            if written == "td" and page._row is not None and pieces[i].startswith("/td>"):
                row = page._row
                row["cells"].append(text.strip())
                row["links"].append([])
                row["link_texts"].append([])
                i += 1
                continue
            if written == "th" and pieces[i].startswith("/th>"):
                if page._tables:
                    page.headers[page._tables[-1]].append(text.strip())
                i += 1
                continue
        tag = _plain_tag(written)
        if tag is None or (tag[1] == "title" and not tag[0] and (i > last or not pieces[i].startswith("/title>"))):
            return None
        if tag[0]:
            page.handle_endtag(tag[1])
        else:
            page.handle_starttag(tag[1], tag[2])
        if text and opened:
            page.handle_data(text)
    page._close_row()
    return page


def _read(html: str | None) -> _Page:
    page = _plain_page(html or "")
    if page is None:
        page = _Page()
        page.feed(html or "")
        page.finish()
    return page


def page_rows(pages: DataFrame) -> DataFrame:
    """Every table row of every page: marks of the page, header texts of its table, cell texts, links and their texts."""

    columns = ["page_id", "heading", "title", "table_no", "row_no", "headers", "cells", "links", "link_texts"]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for page_id, html in zip(batch["page_id"], batch["html"]):
                page = _read(html)
                places: dict[int, int] = {}
                for row in page.rows:
                    number = row["table_no"]
                    places[number] = places.get(number, -1) + 1
                    found.append((page_id, page.heading, page.title, number, places[number], page.headers.get(number, []), row["cells"], row["links"], row["link_texts"]))
                if len(found) >= _ROWS_PER_BATCH:
                    yield pd.DataFrame(found, columns=columns)
                    found = []
            yield pd.DataFrame(found, columns=columns)

    return pages.select("page_id", "html").mapInPandas(extract, _ROWS)


def page_marks(pages: DataFrame) -> DataFrame:
    """First second-level heading, title and distinct stage ids of every page."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, p.heading, p.title, p.stage_ids) for i, p in ((i, _read(h)) for i, h in zip(batch["page_id"], batch["html"]))]
            yield pd.DataFrame(found, columns=["page_id", "heading", "title", "stage_ids"])

    return pages.select("page_id", "html").mapInPandas(extract, _MARKS)


def table_rows(pages: DataFrame, required: Sequence[str], exact_case: bool = False, links: bool = True) -> DataFrame:
    """Body rows of the first table on each page that has all required headers.

    The table is chosen where its page is read, so no row goes through a shuffle; `links` off leaves out the links and their texts.
    """
    wanted = {h if exact_case else h.lower() for h in required}
    columns = ["page_id", "heading", "title", "row_no", "headers", "cells", *(["links", "link_texts"] if links else [])]
    kinds = ", ".join(kind for kind in _ROWS.split(", ") if kind.split()[0] in columns)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for page_id, html in zip(batch["page_id"], batch["html"]):
                page = _read(html)
                fitting = (n for n, heads in page.headers.items() if wanted.issubset(heads if exact_case else map(str.lower, heads)))
                first = min(fitting, default=None)
                body = [row for row in page.rows if row["table_no"] == first][1:] if first is not None else []
                heads = page.headers.get(first)
                for number, row in enumerate(body, 1):
                    found.append((page_id, page.heading, page.title, number, heads, row["cells"], *((row["links"], row["link_texts"]) if links else ())))
                if len(found) >= _ROWS_PER_BATCH:
                    yield pd.DataFrame(found, columns=columns)
                    found = []
            yield pd.DataFrame(found, columns=columns)

    return pages.select("page_id", "html").mapInPandas(extract, kinds)


def _cell(index: int) -> Column:
    return text(F.get(F.col("cells"), F.lit(index)))


def _named(header: str) -> Column:
    place = F.array_position("headers", header).cast("int")
    return F.when(place > 0, F.get(F.col("cells"), place - 1))


def _first_link(cells: Column) -> Column:
    return F.get(F.flatten(cells), F.lit(0))


def header_metadata(pages: DataFrame) -> DataFrame:
    """Subtitle and country (the last comma part of the subtitle) of every page."""
    subtitle = text(F.col("heading"))
    parts = F.filter(F.transform(F.split(subtitle, ","), lambda p: F.trim(p)), lambda p: p != "")
    return page_marks(pages).select(
        "page_id", subtitle.alias("race_subtitle"), F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("")).alias("race_country"), "stage_ids"
    )


def calendar_entries(pages: DataFrame, categories: Sequence[str] = TARGET_CATEGORIES) -> DataFrame:
    """Races listed on month pages; year and month come from the page address. A race listed twice keeps its last month."""
    query = lambda key: F.regexp_extract("url", rf"[?&]{key}=([0-9]+)", 1).try_cast("int")
    dated = pages.select("page_id", query("y").alias("year"), query("m").alias("month"))
    link = _first_link(F.col("links"))
    race_id = F.when(F.startswith(link, F.lit("race.php")), F.regexp_extract(link, r"[?&]r=([0-9]+)(?:&|#|$)", 1).try_cast("long"))
    found = page_rows(pages).where((F.size("cells") >= 3) & link.isNotNull()).select(
        "page_id", "row_no", race_id.alias("race_id"), _first_link(F.col("link_texts")).alias("race_name"),
        _cell(2).alias("category"), _cell(1).alias("date_label"),
    )
    scoped = found.where(F.col("race_id").isNotNull() & F.col("category").isin(*categories)).join(dated, ["page_id"])
    latest = first_rows(scoped, ["year", "race_id"], [F.desc("month"), F.desc("row_no"), F.col("page_id")])
    return latest.select("race_id", "race_name", "category", "date_label", "month", "year")


def result_rows(pages: DataFrame) -> DataFrame:
    """Rows of result tables: page order and points (a decimal comma is read)."""
    points = F.coalesce(F.translate(text(_named("UCI")), ",", ".").try_cast("double"), F.lit(0.0))
    return table_rows(pages, ["Pos", "Rider", "Team", "UCI"], exact_case=True, links=False).select("page_id", "row_no", points.alias("points"))


def startlist_rows(pages: DataFrame) -> DataFrame:
    """Rows of extended startlists: career starts, wins, podiums and top tens."""
    return table_rows(pages, ["BiB", "Rider", "Starts", "Wins", "Podium", "Top 10"], exact_case=True, links=False).select(
        "page_id", "row_no", *[_named(h).alias(n) for h, n in (("Rider", "rider"), ("Starts", "starts"), ("Wins", "wins"), ("Podium", "podiums"), ("Top 10", "top10s"))]
    )


def team_rankings(pages: DataFrame, breakdown_suffix: str) -> DataFrame:
    """Teams of ranking pages with rank, class, points and the path of their breakdown."""
    rows = table_rows(pages, ["#", "Team", "Class", "Points"]).where(F.size("cells") >= 6)
    paths = F.transform(F.flatten("links"), lambda l: F.regexp_replace(l, "^/+|/+$", ""))
    team_path = F.get(F.filter(paths, lambda l: F.startswith(l, F.lit("team/")) & ~F.contains(l, F.lit("/results/"))), F.lit(0))
    parsed = rows.select(
        "page_id", digits_only(_cell(0)).alias("team_rank"), _cell(3).alias("team_name"), _cell(4).alias("team_class"),
        lenient_number(_cell(5)).alias("ranking_points"), team_path.alias("team_path"),
    )
    complete = F.col("team_rank").isNotNull() & (F.col("team_name") != "") & (F.col("team_class") != "") & (text(F.col("team_path")) != "")
    return parsed.where(complete).withColumns(
        {
            "team_slug": F.regexp_replace("team_path", "^team/", ""),
            "breakdown_path": F.concat("team_path", F.lit(f"/{breakdown_suffix}")),
        }
    )


def _breakdown(pages: DataFrame, rows: DataFrame, key: int, rank: int, counted: int, season: Column, footer_sanctions: bool) -> tuple[DataFrame, DataFrame]:
    """(riders, totals per page). A footer row has neither key nor rider.

    Counted points and sanctions of a page come from its last footer, or from the sum of its riders where the footer
    shows nothing. Each of the two reads every page once.
    """
    footer = (_cell(key) == "") & (_cell(1) == "")
    read = rows.select(
        "page_id", "row_no", footer.alias("_footer"), season.cast("int").alias("season_year"), _cell(1).alias("rider_name"),
        slug_after(_first_link(F.col("links")), "rider").alias("rider_slug"), digits_only(_cell(rank)).alias("team_rank_within_counted_list"),
        *[lenient_number(_cell(counted + i)).alias(n) for i, n in enumerate(("points_counted", "points_not_counted", "sanction_points"))],
    )
    complete = ~F.col("_footer") & F.col("team_rank_within_counted_list").isNotNull() & (F.col("rider_name") != "") & F.col("season_year").isNotNull()
    of_riders = lambda c: F.sum(F.when(complete, F.col(c)))
    of_footer = lambda c: F.max_by(c, F.when(F.col("_footer"), F.col("row_no")))
    summed = read.groupBy("page_id").agg(
        of_riders("points_counted").alias("_counted"), of_riders("sanction_points").alias("_sanctions"),
        of_footer("points_counted").alias("_footer_counted"), of_footer("sanction_points").alias("_footer_sanctions"),
    )
    joined = pages.select("page_id", F.col("url").alias("source_url")).join(summed, ["page_id"], "left")
    either = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit(0.0)), F.col(b), F.lit(0.0))
    sanctions = either("_footer_sanctions", "_sanctions") if footer_sanctions else F.coalesce("_sanctions", F.lit(0.0))
    totals = joined.select("page_id", "source_url", either("_footer_counted", "_counted").alias("total_counted_points"), sanctions.alias("sanction_points_total"))
    return read.where(complete).drop("_footer"), totals


def current_breakdown(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(riders, totals) of the current-season pages; the season is the year in the page heading."""
    rows = table_rows(pages, ["#", "rider", "Points counted", "Points not counted", "Sanctions"]).where(F.size("cells") >= 5)
    # A heading without a year leaves the season unknown but keeps the riders.
    riders, totals = _breakdown(pages, rows, 0, 0, 2, F.coalesce(heading_year(F.col("heading")), F.lit(-1)), False)
    return riders.withColumn("season_year", F.nullif("season_year", F.lit(-1))), totals


def cycle_breakdown(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(riders, totals) of the licence-cycle pages; the season is the first cell."""
    needed = ["Season", "Rider", "Nth best rider for team", "Points counted", "Not counted", "Sanction points"]
    rows = table_rows(pages, needed).where(F.size("cells") >= 6)
    return _breakdown(pages, rows, 0, 2, 3, digits_only(_cell(0)), True)


def programme_entries(pages: DataFrame) -> DataFrame:
    """Races of team programme pages with the team name from the page title."""
    title = text(F.col("title"))
    team = (
        F.when(F.startswith(title, F.lit("Program for ")), F.trim(F.substring(title, F.lit(13), F.length(title))))
        .when(F.contains(title, F.lit(" for ")), F.trim(F.substring_index(title, " for ", -1)))
        .otherwise(F.lit(""))
    )
    rows = table_rows(pages, ["date", "race", "class"]).where((F.size("cells") >= 4) & (_cell(2) != ""))
    link = F.trim(text(F.get(F.get(F.col("links"), F.lit(2)), F.lit(0))))
    return rows.select(
        "page_id", "row_no", team.alias("team_name"), _cell(2).alias("source_race_name"), _cell(1).alias("observed_date"), _cell(1).alias("date_label"),
        _cell(3).alias("category"), link.alias("source_url"), race_slug(link).alias("pcs_race_slug"),
    )


def race_points(pages: DataFrame) -> DataFrame:
    """Points and riders per team-in-race page; a page without riders has has_rows false, unreadable points an error."""
    rows = table_rows(pages, ["#", "rider", "points"], links=False).where((F.size("cells") >= 3) & (_cell(1) != ""))
    scored = rows.withColumn("_points", strict_number(_cell(2)))
    summed = scored.groupBy("page_id").agg(
        F.sum("_points").alias("_sum"), F.count(F.lit(1)).alias("_riders"), F.count_if(F.col("_points").isNull()).alias("_bad")
    )
    joined = pages.select("page_id", F.col("url").alias("source_url")).join(summed, ["page_id"], "left")
    riders = F.coalesce("_riders", F.lit(0))
    return joined.select(
        "page_id", "source_url", F.when(F.col("_bad") > 0, F.lit(None)).otherwise(F.coalesce("_sum", F.lit(0.0))).alias("actual_points"),
        riders.alias("rider_count"), (riders > 0).alias("has_rows"), F.when(F.col("_bad") > 0, F.lit("ValueError")).alias("error"),
    )
