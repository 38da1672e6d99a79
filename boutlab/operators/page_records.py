"""Records of linked pages: cards, events, quotes, competitors, and the card to come.

What a page says about the pages it links to travels along the links: a listing gives day and place to its
event pages, an event page gives them and the weight class to its bout pages. Links are resolved to stored
pages once, by site path; pages with many links are spread by ``lookup``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlab.functions import text, tree
from boutlab.operators.pages import BoutPage, bout_from_page
from boutlab.operators.skew import broadcast_limit, estimated_bytes, lookup
from boutlab.sources.tables import stage


@dataclass(frozen=True)
class EventPages:
    """Markup classes and cell places of listings, event pages and competitor pages."""

    listing_row: str = "b-statistics__table-row"
    listing_link: str = "b-link_style_black"
    listing_day: str = "b-statistics__date"
    listing_place: str = "b-statistics__table-col_style_big-top-padding"
    body: str = "b-fight-details__table-body"
    row: str = "b-fight-details__table-row"
    row_link: str = "data-link"
    cell: str = "b-fight-details__table-col"
    names_cell: int = 1
    class_cell: int = 6
    # Cells of a card to come, in threes: names, class, something else.
    card_cell: str = "l-page_align_left"
    card_width: int = 3
    name: str = "b-content__title-highlight"
    facts: str = "b-list__box-list"
    facts_item: str = "b-list__box-list-item"
    first_bout: str = "b-fight-details__table-row__hover"


# Labels of a competitor page.
FACTS = {"height": "Height:", "weight": "Weight:", "reach": "Reach:", "stance": "STANCE:", "date_of_birth": "DOB:"}


@dataclass(frozen=True)
class QuotePage:
    """Markup classes, places and the label of a page of betting quotes."""

    names: str = "fighterNames"
    left: str = "left"
    right: str = "right"
    stats: str = "fighterStats"
    odds_row: int = 2
    label: str = "Betting Odds"
    label_cell: int = 2
    left_cell: int = 0
    right_cell: int = 4
    details: str = "details_with_poster"
    day_item: int = 2
    class_item: int = 9


def site_path(url: Column | str) -> Column:
    """A link without scheme and host, so that absolute and relative ones name the same page."""
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_replace(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]+", "")


def _rows(
    pages: DataFrame,
    kinds: Sequence[str],
    unit: tree.Kind,
    record: Callable[[Column], Column],
    kept=("page_id",),
    within: tree.Kind | None = None,
):
    """One row per item of a page, with its position; only one item's elements are held at a time."""
    found = tree.with_parts(pages, kinds, unit, kept, within).select(*kept, "pos", record(tree.unit()).alias("record"))
    return found.select(*kept, "pos", "record.*")


def cards_from_page(pages: DataFrame, layout: EventPages = EventPages()) -> DataFrame:
    """Events of listing pages: path of the event page, day and place. Rows without a link are headings."""

    def record(row: Column) -> Column:
        link = tree.nth(tree.inside(row, "a", layout.listing_link), 0)
        day = tree.text_of(tree.nth(tree.inside(row, "span", layout.listing_day), 0))
        return F.struct(
            site_path(tree.attribute(link, "href")).alias("event_path"),
            text.to_day(day, "card").alias("bout_date"),
            tree.text_of(tree.nth(tree.inside(row, "td", layout.listing_place), 0)).alias("location"),
        )

    rows = tree.Kind("tr", (layout.listing_row,))
    return _rows(pages, ["tr", "td", "a", "span"], rows, record).filter("event_path <> ''")


def event_rows_from_page(pages: DataFrame, layout: EventPages = EventPages()) -> DataFrame:
    """Bouts of event pages: path of the bout page, both names and the weight class.

    ``event_path`` is the event page's own; rows without a link lead to no bout and are left out.
    """

    def record(row: Column) -> Column:
        cells = tree.inside(row, "td", layout.cell)
        names = tree.inside(tree.nth(cells, layout.names_cell), "a")
        return F.struct(
            site_path(tree.attribute(row, layout.row_link)).alias("bout_path"),
            tree.text_of(tree.nth(names, 0)).alias("r_name"),
            tree.text_of(tree.nth(names, 1)).alias("b_name"),
            text.class_name(tree.text_of(tree.nth(cells, layout.class_cell))).alias("weight_class"),
        )

    rows, body = tree.Kind("tr", (layout.row,), starts=True), tree.Kind("tbody", (layout.body,))
    found = _rows(pages, ["tbody", "tr", "td", "a"], rows, record, ("page_id", "url"), body)
    return found.filter("bout_path <> ''").withColumn("event_path", site_path("url")).drop("url")


def page_paths(pages: DataFrame) -> DataFrame:
    """(path, page_id) of stored pages, the least id of a path stored twice."""
    return pages.select(site_path("url").alias("path"), "page_id").groupBy("path").agg(F.min("page_id").alias("page_id"))


def bout_context(listings: DataFrame, events: DataFrame, pages: DataFrame, layout: EventPages = EventPages()) -> DataFrame:
    """Day, place, weight class and pounds of stored bout pages, from the pages that lead to them.

    A listing's values go along its links to event pages, and on with the weight class along theirs. Of
    several listings or events that lead to one page the earliest day counts, then the first page and place.
    """
    cards = cards_from_page(listings, layout)
    # A day that cannot be read comes last.
    order = [F.col("bout_date").isNull().alias("undated"), "bout_date", "page_id", "pos"]
    first = cards.groupBy(F.col("event_path")).agg(F.min(F.struct(*order, "location")).alias("card"))
    known = first.select("event_path", "card.bout_date", "card.location")
    # Written, as a lookup reads its facts twice.
    rows = stage(event_rows_from_page(events, layout), "event_rows")
    dated = lookup(rows, known, ["event_path"], ["bout_path", "pos"], "inner")
    single = dated.groupBy(F.col("bout_path").alias("path")).agg(
        F.min(F.struct(*order, "location", "weight_class")).alias("bout")
    )
    found = lookup(page_paths(pages), single, ["path"], ["page_id"], "inner")
    return found.select(
        "page_id", "bout.bout_date", "bout.location", "bout.weight_class",
        text.pounds(F.col("bout.weight_class")).alias("weight"),
    )


def dated_bouts(listings: DataFrame, events: DataFrame, pages: DataFrame, layout: EventPages = EventPages()) -> DataFrame:
    """The rows of ``bout_from_page`` with day and place, which only the pages that lead to a bout know.

    Bouts that no event page leads to stay, without them; of pages that share an id the earliest day counts.
    """
    known = bout_context(listings, events, pages, layout).filter("page_id IS NOT NULL")
    order = F.struct(F.col("bout_date").isNull().alias("undated"), "bout_date", "location")
    first = known.groupBy("page_id").agg(F.min(order).alias("card"))
    read = bout_from_page(pages)
    found = read.join(first, "page_id", "left")
    return found.select("page_id", "card.bout_date", "card.location", *[c for c in read.columns if c != "page_id"])


def _quotes(pages: DataFrame, layout: QuotePage) -> DataFrame:
    names = tree.nth(tree.inside(tree.page(), "div", layout.names), 0)

    def name(side):
        found = tree.text_of(tree.nth(tree.inside(tree.nth(tree.inside(names, "span", side), 0), "a"), 0))
        return F.nullif(found, F.lit(""))

    table = tree.nth(tree.inside(tree.page(), "table", layout.stats, starts=True), 0)
    cells = tree.inside(tree.nth(tree.inside(table, "tr", level=0), layout.odds_row), "td")

    def first_word(n):
        return F.get(F.split(tree.text_of(tree.nth(cells, n)), " "), F.lit(0))

    items = tree.inside(tree.nth(tree.inside(tree.page(), "div", layout.details, starts=True), 0), "li")

    def fact(n):
        return tree.text_of(tree.nth(tree.inside(tree.nth(items, n), "span"), 0))

    scanned = tree.with_tree(pages, ["div", "span", "a", "table", "tr", "td", "li"])
    return scanned.select(
        "page_id",
        tree.text_of(tree.nth(cells, layout.label_cell)).alias("_label"),
        name(layout.left).alias("left_name"),
        name(layout.right).alias("right_name"),
        first_word(layout.left_cell).alias("left_odds"),
        first_word(layout.right_cell).alias("right_odds"),
        # A weekday comes before the day; pounds may follow the class.
        text.to_day(F.get(F.split(fact(layout.day_item), " "), F.lit(1)), "quote").alias("quote_date"),
        F.trim(F.regexp_substr(fact(layout.class_item), F.lit(r"^[^(0-9]*"))).alias("weight_class"),
    )


def quotes_from_page(pages: DataFrame, layout: QuotePage = QuotePage()) -> DataFrame:
    """One quote per page: names, odds, day and class. Pages whose line has another label hold no quote."""
    found = _quotes(pages, layout)
    return found.filter(F.col("_label") == layout.label).drop("_label")


def pages_without_quote(pages: DataFrame, layout: QuotePage = QuotePage()) -> DataFrame:
    """The pages ``quotes_from_page`` skips."""
    return _quotes(pages, layout).filter(~F.col("_label").eqNullSafe(F.lit(layout.label))).select("page_id")


def competitor_facts(pages: DataFrame, layout: EventPages = EventPages()) -> DataFrame:
    """Name, five facts by their labels, and the path of the first bout, as texts."""
    facts = tree.nth(tree.inside(tree.page(), "ul", layout.facts), 0)
    body = tree.nth(tree.inside(tree.page(), "tbody", layout.body), 0)
    bout = tree.nth(tree.inside(body, "tr", layout.first_bout, starts=True), 0)
    scanned = tree.with_tree(pages, ["span", "ul", "li", "i", "tbody", "tr"])
    return scanned.select(
        "page_id",
        tree.text_of(tree.nth(tree.inside(tree.page(), "span", layout.name), 0)).alias("name"),
        tree.labelled_texts(facts, FACTS).alias("_facts"),
        site_path(tree.attribute(bout, layout.row_link)).alias("bout_path"),
    ).select(
        "page_id", "name", *[F.coalesce(F.col("_facts")[fact], F.lit("")).alias(fact) for fact in FACTS], "bout_path"
    )


def competitors_from_page(pages: DataFrame, bout_pages: DataFrame, layout: EventPages = EventPages()) -> DataFrame:
    """Competitors as the directory has them, out of their pages: texts, and the class of the first bout.

    The class, from which the gender follows, is the title of the bout page two links away. Who has no
    name or no stored first bout is left to ``competitors_without_bout``.
    """
    facts = stage(competitor_facts(pages, layout).filter("name <> ''"), "competitor_facts")
    return lookup(facts, _titles(bout_pages, facts), ["bout_path"], ["page_id"], "inner").drop("bout_path")


def competitors_without_bout(pages: DataFrame, bout_pages: DataFrame, layout: EventPages = EventPages()) -> DataFrame:
    facts = competitor_facts(pages, layout)
    named = F.when(F.col("name") != "", F.col("bout_path"))
    wanted = stage(facts.select("page_id", named.alias("bout_path")), "competitor_paths")
    return lookup(wanted, _titles(bout_pages, wanted), ["bout_path"], ["page_id"], "left_anti").select("page_id")


def _titles(bout_pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The title of the stored bout pages by path, of the least page_id where one is stored twice.

    Only pages whose path is in ``wanted`` are read, if its paths can be broadcast; pages are too wide to be
    shuffled for it, so beyond that all are.
    """
    paths = wanted.select("bout_path").distinct()
    if estimated_bytes(paths) <= broadcast_limit(bout_pages.sparkSession):
        bout_pages = bout_pages.join(F.broadcast(paths), site_path("url") == F.col("bout_path"), "left_semi")
    first = tree.with_first(bout_pages, (), tree.Kind("i", (BoutPage().title,)), ("page_id", "url"))
    read = first.select("page_id", site_path("url").alias("bout_path"), tree.text_of(tree.unit()).alias("bout_class"))
    return read.groupBy("bout_path").agg(F.min_by("bout_class", "page_id").alias("bout_class")).filter("bout_class IS NOT NULL")


def card_from_page(pages: DataFrame, layout: EventPages = EventPages()) -> DataFrame:
    """Bouts to come: the page's cells in threes, two names in the first and the class in the second.

    A group's cells stay elements, so that one cell can give two names; a short last group is none.
    """
    cells = tree.Kind("td", (layout.cell, layout.card_cell))
    names = tree.inside(tree.unit(0), "a")
    return tree.with_parts(pages, ["td", "a"], cells, width=layout.card_width).select(
        "page_id",
        "pos",
        tree.text_of(tree.nth(names, 0)).alias("r_name"),
        tree.text_of(tree.nth(names, 1)).alias("b_name"),
        tree.text_of(tree.unit(1)).alias("weight_class"),
    )
