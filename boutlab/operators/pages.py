"""Records out of stored pages.

Every job works on one page row at a time and needs no shuffle; only following links joins pages. Fields
that cannot hold others of their kind are found by pattern, nested ones in the page's tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlab.functions import markup, text, tree
from boutlab.operators.skew import lookup
from boutlab.schema import AREAS, MAX_ROUNDS, ROUND_SECONDS


def extract_links(pages: DataFrame) -> DataFrame:
    """Every anchor's position, target and text."""
    anchors = markup.elements(F.col("html"), "a")
    return pages.select("page_id", F.posexplode(anchors).alias("pos", "element")).select(
        "page_id",
        "pos",
        markup.attribute(F.col("element"), "href").alias("href"),
        markup.inner_text(F.col("element")).alias("text"),
    )


def text_field(
    html: Column, tag: str, css_class: str | None = None, partial: bool = False
) -> Column:
    """Text of the first element of a kind, as far as its first closing tag; NULL where the page has none."""
    return markup.inner_text(markup.first_element(html, tag, css_class, partial))


def nested_field(pages: DataFrame, tag: str, css_class: str | None = None) -> DataFrame:
    """Text of the first element of a kind with all that is nested in it, others of its kind included."""
    first = tree.with_first(pages, (), tree.Kind(tag, (css_class,) if css_class else ()))
    return first.select("page_id", tree.text_of(tree.unit()).alias("text"))


def nested_cells(pages: DataFrame, tag: str, css_class: str | None = None) -> DataFrame:
    """Every element of a kind: position, how many of its kind enclose it, which one does, and its text.

    ``around`` is the position of the enclosing element of the kind, NULL for an outermost one.
    """
    found = tree.with_parts(pages, (), tree.Kind(tag, (css_class,) if css_class else ()))
    around = F.when(F.col("level") > 0, F.col("around")).alias("around")
    return found.select("page_id", "pos", "level", around, tree.text_of(tree.unit()).alias("text"))


def extract_text_field(
    pages: DataFrame, tag: str, css_class: str | None = None, partial: bool = False
) -> DataFrame:
    """The text field of every page."""
    return pages.select("page_id", text_field(F.col("html"), tag, css_class, partial).alias("text"))


def extract_cells(
    pages: DataFrame, tag: str, css_class: str | None = None, partial: bool = False
) -> DataFrame:
    """Text and position of every element of a kind."""
    found = markup.elements(F.col("html"), tag, css_class, partial)
    return pages.select("page_id", F.posexplode(found).alias("pos", "element")).select(
        "page_id", "pos", markup.inner_text(F.col("element")).alias("text")
    )


def nth_cell(pages: DataFrame, tag: str, n: int) -> DataFrame:
    found = F.get(markup.elements(F.col("html"), tag), F.lit(n))
    return pages.select("page_id", markup.inner_text(found).alias("text"))


def chunk_cells(pages: DataFrame, tag: str, width: int) -> DataFrame:
    """The flat cell list of a page as rows of ``width`` cells; the last row may be short.

    Slicing the page's own list keeps each page in its task; nothing is grouped.
    """
    cells = F.transform(markup.elements(F.col("html"), tag), markup.inner_text)
    count = F.ceil(F.size("cells") / F.lit(width)).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return (
        pages.select("page_id", cells.alias("cells"))
        .select("page_id", "cells", F.explode(starts).alias("row"))
        .select(
            "page_id",
            "row",
            *[
                F.get("cells", F.col("row") * width + i).alias(f"cell_{i}")
                for i in range(width)
            ],
        )
    )


def slice_items(pages: DataFrame, tag: str, start: int, stop: int | None) -> DataFrame:
    """Items ``start`` to ``stop`` of a page's list; a negative ``stop`` drops that many at the end."""
    found = markup.elements(F.col("html"), tag)
    size = F.size("items")
    end = size if stop is None else (F.least(F.lit(stop), size) if stop >= 0 else size + stop)
    kept = F.slice("items", start + 1, F.greatest(end - start, F.lit(0)))
    return (
        pages.select("page_id", found.alias("items"))
        .select("page_id", F.posexplode(kept).alias("pos", "element"))
        .select(
            "page_id",
            (F.col("pos") + start).alias("pos"),
            markup.inner_text(F.col("element")).alias("text"),
        )
    )


def flag_marker(pages: DataFrame, marker: str, tag: str = "img", name: str = "src") -> DataFrame:
    """True where any image of the page shows exactly the marker."""
    sources = markup.attributes(F.col("html"), tag, name)
    return pages.select("page_id", F.array_contains(sources, marker).alias("flag"))


def extract_tail_text(pages: DataFrame, label: str, tag: str = "i") -> DataFrame:
    """The text behind ``label</tag>``."""
    return pages.select("page_id", markup.text_after(F.col("html"), label, tag).alias("text"))


def follow_links(start: DataFrame, links: DataFrame, depth: int = 2) -> DataFrame:
    """The links walked from the start pages: ``step``, ``page_id``, ``target_page_id``.

    ``links`` has ``page_id`` and ``target_page_id``. A page is left once per step however many pages
    lead to it, so the result never exceeds ``depth`` times the links. Only ids travel.
    """
    edges = links.select("page_id", "target_page_id").distinct()
    frontier = start.select("page_id").distinct()
    walked = None
    for step in range(1, depth + 1):
        taken = lookup(edges, frontier, ["page_id"], ["target_page_id"], "left_semi")
        numbered = taken.select(F.lit(step).alias("step"), "page_id", "target_page_id")
        walked = numbered if walked is None else walked.unionByName(numbered)
        frontier = taken.select(F.col("target_page_id").alias("page_id")).distinct()
    return walked


def linked_pages(start: DataFrame, links: DataFrame, pages: DataFrame, depth: int = 2) -> DataFrame:
    """The pages reached in exactly ``depth`` steps."""
    last = follow_links(start, links, depth).filter(F.col("step") == depth)
    reached = last.select(F.col("target_page_id").alias("page_id")).distinct()
    return pages.join(reached, "page_id", "left_semi")


@dataclass(frozen=True)
class BoutPage:
    """Markup classes, labels and cell places of a bout page."""

    person: str = "b-fight-details__person"
    status: str = "b-fight-details__person-status"
    person_link: str = "b-fight-details__person-link"
    title: str = "b-fight-details__fight-title"
    cell: str = "b-fight-details__table-col"
    charts: str = "b-fight-details__charts-col_pos_right"
    round_row: str = "b-fight-details__bar-charts-row"
    round_text: str = "b-fight-details__bar-chart-text"
    red: str = "js-red"
    blue: str = "js-blue"
    method_style: str = "font-style: normal"
    round_label: str = "Round:"
    time_label: str = "Time:"
    format_label: str = "Time format:"
    referee_label: str = "Referee:"
    details_label: str = "Details:"
    belt: str = "belt.png"


# The tables of a bout page with the totals and with the strikes by area, and the place
# of each statistic among the cells of these two.
TOTALS_TABLE, STRIKES_TABLE = 0, 2
TOTAL_CELLS = {"kd_landed": 0, "sig_str": 1, "total_str": 3, "td": 4, "subs_attempted": 6,
               "reversals": 7, "ctrl_time": 8}
STRIKE_CELLS = {"head": 2, "body": 3, "legs": 4, "distance": 5, "clinch": 6, "ground": 7}


READABLE = "coalesce(r_name, '') <> '' AND coalesce(b_name, '') <> ''"


def bout_from_page(pages: DataFrame, layout: BoutPage = BoutPage()) -> DataFrame:
    """One bout row per page: names, winner, method, round, time, referee, title bout.

    Day, place and weight class are those of the event page that links here (``bout_context``). Pages
    without the names of two corners are left to ``unreadable_bouts``.
    """
    return _read_bouts(pages, layout).filter(READABLE)


def unreadable_bouts(pages: DataFrame, layout: BoutPage = BoutPage()) -> DataFrame:
    """The pages that ``bout_from_page`` leaves out, for lack of a corner's name."""
    return _read_bouts(pages, layout).filter(f"NOT ({READABLE})").select("page_id")


def _read_bouts(pages: DataFrame, layout: BoutPage) -> DataFrame:
    scanned = tree.with_tree(pages, ["div", "i", "a", "img", "p"])
    page = tree.page()
    people = tree.inside(page, "div", layout.person)
    title = tree.nth(tree.inside(page, "i", layout.title), 0)

    def name(side):
        return tree.text_of(tree.nth(tree.inside(side, "a", layout.person_link), 0))

    def won(side):
        status = tree.text_of(tree.nth(tree.inside(side, "i", layout.status), 0))
        return F.coalesce(status == "W", F.lit(False))

    labels = {
        "details": layout.details_label, "format": layout.format_label, "round": layout.round_label,
        "time": layout.time_label, "referee": layout.referee_label,
    }

    def after(label):
        return F.col("_after")[label]

    belt = F.exists(
        tree.inside(title, "img"), lambda x: F.coalesce(x["attrs"]["src"].endswith(layout.belt), F.lit(False))
    )
    styled = F.filter(tree.inside(page, "i"), lambda x: x["attrs"]["style"] == layout.method_style)
    red, blue = F.col("_red"), F.col("_blue")
    read = scanned.select(
        "page_id",
        "tree",
        tree.nth(people, 0).alias("_red"),
        tree.nth(people, 1).alias("_blue"),
        tree.labelled_texts(page, labels).alias("_after"),
    ).select(
        "page_id",
        name(red).alias("r_name"),
        name(blue).alias("b_name"),
        won(red).alias("_r_won"),
        won(blue).alias("_b_won"),
        F.coalesce(belt, F.lit(False)).alias("championship_fight"),
        F.coalesce(tree.text_of(tree.nth(styled, 0)), F.lit("")).alias("win_method"),
        after("details").alias("win_method_details"),
        F.get(F.split(after("format"), " "), F.lit(0)).try_cast("int").alias("number_of_rounds"),
        after("round").try_cast("int").alias("finish_round"),
        after("time").alias("finish_time"),
        after("referee").alias("referee"),
    )
    winner = F.when(F.col("_b_won"), F.col("b_name")).when(F.col("_r_won"), F.col("r_name")).otherwise("")
    seconds = (F.col("finish_round") - 1) * ROUND_SECONDS + text.clock_seconds("finish_time")
    return read.select(
        "page_id", "r_name", "b_name", winner.alias("winner"), "championship_fight", "win_method",
        "win_method_details", "number_of_rounds", "finish_round", "finish_time", "referee",
        seconds.alias("total_fight_time"),
    )


def corner_stats_from_page(pages: DataFrame, layout: BoutPage = BoutPage()) -> DataFrame:
    """Two rows per page with what each corner did; rounds not fought are NULL."""
    scanned = tree.with_tree(pages, ["table", "td", "p", "div", "i"])
    # Tables inside tables are no tables of the page.
    tables = F.col("_tables")
    # The rounds stand to the right of other charts that are built alike.
    right = F.col("_right")

    def lines(cell):
        return F.transform(tree.inside(cell, "p"), tree.text_of)

    def texts(table: int) -> Column:
        """Per cell the lines of the two corners, found once for all columns of both corners."""
        return F.transform(tree.inside(tree.nth(tables, table), "td", layout.cell, level=0), lines)

    def both(row):
        """The text element of either corner: other elements come first inside the corner's mark."""
        sides = [tree.nth(tree.inside(row, "i", side), 0) for side in (layout.red, layout.blue)]
        return F.array(*[tree.text_of(tree.nth(tree.inside(side, "i", layout.round_text), 0)) for side in sides])

    parsed = scanned.select(
        "page_id",
        "tree",
        tree.inside(tree.page(), "table", level=0).alias("_tables"),
        tree.nth(tree.inside(tree.page(), "div", layout.charts), 0).alias("_right"),
    ).select(
        "page_id",
        texts(TOTALS_TABLE).alias("_totals"),
        texts(STRIKES_TABLE).alias("_strikes"),
        F.transform(tree.inside(right, "div", layout.round_row), both).alias("_rounds"),
        F.array(F.lit("r"), F.lit("b")).alias("_corners"),
    )
    staged = parsed.select(
        "page_id", "_totals", "_strikes", "_rounds", F.posexplode("_corners").alias("_place", "corner")
    )

    def value(cells: str, n: int) -> Column:
        """The corner's own line of the n-th cell."""
        return F.get(F.get(cells, F.lit(n)), F.col("_place"))

    def in_round(n: int) -> Column:
        return value("_rounds", n)

    sources = {
        area: value("_totals", TOTAL_CELLS[area]) if area in TOTAL_CELLS
        else value("_strikes", STRIKE_CELLS[area])
        for area in AREAS
    }
    sources |= {f"round_{n}_sig_str": in_round(n - 1) for n in range(1, MAX_ROUNDS + 1)}
    pairs = []
    for area, cell in sources.items():
        pairs += [
            text.landed(cell).alias(f"{area}_landed"),
            text.attempted(cell).alias(f"{area}_attempted"),
        ]

    def number(stat):
        return value("_totals", TOTAL_CELLS[stat]).try_cast("int").alias(stat)

    return staged.select(
        "page_id",
        "corner",
        *pairs,
        number("kd_landed"),
        number("subs_attempted"),
        number("reversals"),
        text.clock_seconds(value("_totals", TOTAL_CELLS["ctrl_time"])).alias("ctrl_time"),
    )
