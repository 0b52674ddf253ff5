"""Pages of plain tags are read without the parser of the library; both must see the same."""

import random

from echelon.operators import pages

PIECES = [
    "<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", "<td/>", "<TD>", "</td >", "<a href=\"race/x\">", "<a href='y'>", "<a href=z>", "<a>", "</a>", "<h2>", "</h2>", "<title>", "</title>",
    '<select name="e">', "</select>", '<option value="1">', '<option value=" 2 " class="a&amp;b">', "</option>", "<script>", "</script>", "<!-- c -->", "<!doctype html>", "<br>", "<textarea>", "</textarea>", "&amp;", "&", "&#x27;", "a < b", " > ",
    "text ", "\n", "1,5", "<p\nclass=\"u\">", '<td class="c" href="d">', '<a href="one" href="two">', '<a  href="s">', "<", "é ", "Pos", "Rider",
]
PLAIN = [p for p in PIECES if p not in ("<td/>", "<TD>", "</td >", "<a href='y'>", "<a href=z>", "<script>", "</script>", "<!-- c -->", "<!doctype html>", "<textarea>", "</textarea>", "a < b", "<")]


def seen(page):
    return page.rows, page.headers, page.heading, page.title, page.stage_ids


def parsed(html):
    page = pages._Page()
    page.feed(html)
    return seen(page.finish())


def test_plain_pages_are_read_as_the_parser_reads_them():
    draw, plain = random.Random(3), 0
    for size in (4, 12, 40):
        for pieces in (PIECES, PLAIN):
            for _ in range(1500):
                html = "".join(draw.choices(pieces, k=size))
                plain += pages._plain_page(html) is not None
                assert seen(pages._read(html)) == parsed(html), html
    assert plain > 1000


def test_rows_of_a_page_are_not_shuffled(spark):
    html = "<table><tr><th>x</th></tr><tr><td>0</td></tr></table><table><tr><th>Pos</th><th>Rider</th><th>Team</th><th>UCI</th></tr><tr><td>1</td><td>r</td><td>t</td><td>2,5</td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, None), (3, html + html)], "page_id long, html string")
    rows = pages.result_rows(df)
    assert sorted(map(tuple, rows.collect())) == [(1, 1, 2.5), (3, 1, 2.5)]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
