import datetime as dt

from pyspark.sql import functions as F

from boutlab import fixtures
from boutlab.operators import page_records as records
from boutlab.operators.snapshots import append_with_child_keys
from boutlab.sources.tables import stage

LISTING = """<table><tr class="b-statistics__table-row"><td>Name</td></tr>
<tr class="b-statistics__table-row"><td><a class="b-link b-link_style_black" href="http://s.example{}">E</a>
<span class="b-statistics__date"> {} </span></td><td class="x b-statistics__table-col_style_big-top-padding"> {} </td></tr></table>"""


def _event(*rows):
    made = "".join(
        f'<tr class="b-fight-details__table-row x" data-link="{link}">'
        + "".join(f'<td class="b-fight-details__table-col">{c}</td>' for c in ("win", names, 2, 3, 4, 5, weight))
        + "</tr>"
        for link, names, weight in rows
    )
    return f'<table><tr><td>0</td></tr><tbody class="b-fight-details__table-body">{made}</tbody></table>'


def _pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


NAMES = "<a>Ann</a> <a>Bea</a>"


def test_values_go_along_links(spark, no_broadcast):
    listings = _pages(
        spark,
        (1, "/l/1", LISTING.format("/e/1", "March 02, 2024", "Hall")),
        (2, "/l/2", LISTING.format("/e/2", "March 01, 2024", "Dome &amp; Co")),
        (3, "/l/3", LISTING.format("/e/2", "no day", "Nowhere")),
    )
    many = [(f"/b/{i}", NAMES, "Flyweight") for i in range(10, 40)]
    events = _pages(
        spark,
        (4, "https://s.example/e/1", _event(("//s.example/b/1", NAMES, "Women's Bantamweight"), ("", NAMES, "x"), *many)),
        (5, "/e/2", _event(("/b/1", NAMES, "Heavyweight"), ("/b/2", NAMES, "Odd Weight"))),
        (6, "/e/9", _event(("/b/3", NAMES, "Heavyweight"))),
        (7, "/e/7", None),
    )
    bouts = _pages(spark, *[(100 + i, f"http://s.example/b/{i}", "x") for i in (1, 2, 3)], (99, "/b/1", "y"), (98, None, "z"))
    found = {r.page_id: tuple(r)[1:] for r in records.bout_context(listings, events, bouts).collect()}
    event = (dt.date(2024, 3, 1), "Dome & Co")
    assert found == {99: (*event, "heavyweight", 265), 102: (*event, "odd weight", None)}


def test_bouts_carry_day_and_place_of_their_event(spark):
    person = '<div class="b-fight-details__person"><a class="b-fight-details__person-link">{}</a></div>'
    html = person.format("Ann") + person.format("Bea")
    listings = _pages(spark, (1, "/l/1", LISTING.format("/e/1", "March 02, 2024", "Hall")))
    events = _pages(spark, (4, "/e/1", _event(("/b/1", NAMES, "Flyweight"), ("/b/3", NAMES, "Flyweight"))))
    bouts = _pages(spark, (101, "/b/1", html), (102, "/b/2", html), (103, "/b/3", "x"), (None, "/b/3", html), (101, "/b/1", html))
    found = records.dated_bouts(listings, events, bouts).select("page_id", "bout_date", "location", "r_name", "b_name")
    day = (dt.date(2024, 3, 2), "Hall")
    assert sorted(map(tuple, found.collect()), key=str) == [
        (101, *day, "Ann", "Bea"), (101, *day, "Ann", "Bea"), (102, None, None, "Ann", "Bea"), (None, None, None, "Ann", "Bea"),
    ]


def test_quotes(spark):
    def page(label="Betting Odds", left="<a>Ann</a>"):
        return (
            f'<div class="fighterNames"><span class="left">{left}</span><span class="right"><a>Bea</a></span></div>'
            '<table class="fighterStats2"><tr></tr><tr></tr><tr><td>+150 (up)</td><td></td>'
            f"<td>{label}</td><td></td><td>-175</td></tr></table>"
            '<div class="details_with_poster_x"><li></li><li></li><li><span>Sat 03.02.2024 at</span></li>'
            + "<li></li>" * 6 + "<li><span>Light Heavyweight (205 lbs)</span></li></div>"
        )

    pages = _pages(spark, (0, "", page()), (1, "", page("Age")), (2, "", page(left="")), (3, "", None), (4, "", "<p>"))
    found = sorted((tuple(r) for r in records.quotes_from_page(pages).collect()), key=lambda r: r[0])
    rest = ("+150", "-175", dt.date(2024, 3, 2), "Light Heavyweight")
    assert found == [(0, "Ann", "Bea", *rest), (2, None, "Bea", *rest)]
    assert sorted(r.page_id for r in records.pages_without_quote(pages).collect()) == [1, 3, 4]


def test_competitors(spark):
    def page(name, link, *facts):
        items = "".join(f'<li class="b-list__box-list-item"><i>{k}</i> {v} </li>' for k, v in facts)
        row = f'<tr class="b-fight-details__table-row__hover x" data-link="{link}"></tr>' if link else ""
        return (
            f'<span class="b-content__title-highlight">{name}</span><ul class="b-list__box-list">{items}</ul>'
            f'<tbody class="b-fight-details__table-body"><tr></tr>{row}</tbody>'
        )

    facts = [("STANCE:", "Switch"), ("Height:", "5' 4&quot;"), ("Weight:", "125 lbs."), ("DOB:", "Mar 02, 1990")]
    bouts = _pages(spark, (1, "/b/1", "<i class='b-fight-details__fight-title'>Women&#39;s Flyweight Bout</i>"), (2, "/b/2", "<p>"))
    pages = _pages(
        spark, (0, "", page("Ann &amp; Co", "http://x.y/b/1", *facts)), (1, "", page("Bea", "", *facts)),
        (2, "", page("Cea", "/b/2")), (3, "", page("", "/b/1")), (4, "", None),
    )
    found = records.competitors_from_page(pages, bouts).collect()
    assert [r.asDict() for r in found] == [
        {"page_id": 0, "name": "Ann & Co", "height": "5' 4\"", "weight": "125 lbs.", "reach": "", "stance": "Switch",
         "date_of_birth": "Mar 02, 1990", "bout_class": "Women's Flyweight Bout"}
    ]
    assert sorted(r.page_id for r in records.competitors_without_bout(pages, bouts).collect()) == [1, 2, 3, 4]


def test_card(spark):
    cell = '<td class="b-fight-details__table-col l-page_align_left">{}</td>'
    cells = [NAMES, " Flyweight ", "x", "<a>Cea</a><p><a> Dea</a>", "Women's Strawweight", "y", NAMES, "short"]
    page = "<table><tr><td>n</td>" + "".join(cell.format(c) for c in cells) + "</tr></table>"
    found = [tuple(r) for r in records.card_from_page(_pages(spark, (7, "", page), (8, "", None))).collect()]
    assert found == [(7, 0, "Ann", "Bea", "Flyweight"), (7, 1, "Cea", "Dea", "Women's Strawweight")]


def test_children_are_numbered_with_their_parents(spark):
    rows = spark.createDataFrame([(d, i) for i, d in enumerate([3, 1, 2, 1])], "day int, at long")
    old, kids = spark.createDataFrame([(10,)], "id long"), spark.createDataFrame([(70,), (71,)], "kid long")
    for size in (1_000, 2):
        made = append_with_child_keys(old, kids, rows, "id", "kid", ["day", "at"], ["r", "b"], size).orderBy("id")
        assert [tuple(r) for r in made.select("day", "at", "id", "r", "b").collect()] == [
            (1, 1, 11, 72, 73), (1, 3, 12, 74, 75), (2, 2, 13, 76, 77), (3, 0, 14, 78, 79)
        ]
    first = append_with_child_keys(old.limit(0), kids.limit(0), rows, "id", "kid", ["day", "at"], ["r", "b"])
    assert [tuple(r) for r in first.orderBy("id").select("id", "r", "b").collect()][0] == (1, 1, 2)


def test_days_go_to_tasks_of_their_own(spark):
    """Rows that shrink in a shuffle must not bring the pages of all days into one task."""
    bouts = spark.range(400).selectExpr(
        "id AS bout_id", "date_add(DATE'2024-01-01', CAST(id % 40 AS INT)) AS bout_date", "id AS r_id",
        "concat('user ', id) AS r_name", "concat('user ', id + 1) AS b_name", "'Flyweight' AS weight_class",
    )
    made = fixtures.event_pages(bouts).select("page_id", "html", F.spark_partition_id().alias("task")).collect()
    assert len(made) == 40 and len({r.task for r in made}) > 8
    assert all(r.html.count("data-link") == 10 for r in made)


def test_titles_are_read_from_wanted_pages_alone(spark):
    pages = _pages(
        spark,
        (1, "/b/1", '<i class="b-fight-details__fight-title">Flyweight Bout</i>'),
        (2, "http://s.example/b/2", '<i class="b-fight-details__fight-title">Heavyweight Bout</i>'),
        (3, "/b/3", '<i class="b-fight-details__fight-title">Odd Bout</i>'),
    )
    wanted = spark.createDataFrame([("/b/2",), ("/b/2",), (None,), ("/b/3",), ("/b/9",)], "bout_path string")
    paths = stage(wanted, "paths")
    found = {tuple(r) for r in records._titles(pages, paths).collect()}
    assert found == {("/b/2", "Heavyweight Bout"), ("/b/3", "Odd Bout")}
    assert "LeftSemi" in records._titles(pages, paths)._jdf.queryExecution().optimizedPlan().toString()
