"""Bout tables derived from the star-schema test tables, see FIXTURES.md.

Everything is computed from the given tables by Spark, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutlab.operators.totals import pair_up
from boutlab.schema import AREAS, MAX_ROUNDS, STAT_COLUMNS, WEIGHT_CLASSES

PROTECTED_PART = "red plate"
CLASS_NAMES = [n.title() for n in WEIGHT_CLASSES]
METHODS = ["Decision - Split", "Decision - Unanimous", "KO/TKO", "Submission", "Overturned"]
STANCE_CYCLE = ["Orthodox", "Southpaw", "Switch", "Open Stance", None]
CUTOFF = "2024-01-20"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _clock(seconds: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int"))


def bouts(spark: SparkSession, folder: str) -> DataFrame:
    """Two successive events make a bout; one pass over the events, one shuffle."""
    events = _table(spark, folder, "events").select(
        F.expr("event_id div 2").alias("bout_id"),
        F.when(F.col("event_id") % 2 == 0, "r").otherwise("b").alias("side"),
        "ts",
        "user_id",
        "value",
        (F.col("event_type") == "signup").alias("signup"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )

    def of(side, name):
        return F.max(F.when(F.col("side") == side, F.col(name)))

    paired = events.groupBy("bout_id").agg(
        of("r", "ts").alias("bout_ts"),
        of("r", "user_id").alias("r_id"),
        of("b", "user_id").alias("b_id"),
        of("r", "value").alias("r_value"),
        of("b", "value").alias("b_value"),
        of("r", "signup").alias("championship_fight"),
        of("r", "k").alias("rk"),
        of("b", "k").alias("bk"),
    )
    r_name = F.concat(F.lit("user "), F.col("r_id").cast("string"))
    b_name = F.concat(F.lit("user "), F.col("b_id").cast("string"))
    rounds = F.when(F.col("championship_fight"), 5).otherwise(3)
    k = F.col("rk") + F.col("bk")
    return paired.filter(F.col("r_id") != F.col("b_id")).select(
        "bout_id",
        "bout_ts",
        F.col("bout_ts").cast("date").alias("bout_date"),
        "r_id",
        "b_id",
        r_name.alias("r_name"),
        b_name.alias("b_name"),
        F.when(F.floor("r_value") == F.floor("b_value"), "")
        .when(F.col("r_value") > F.col("b_value"), r_name)
        .otherwise(b_name)
        .alias("winner"),
        _pick(METHODS, k % 5).alias("win_method"),
        "championship_fight",
        "rk",
        "bk",
        rounds.alias("number_of_rounds"),
        (k % rounds + 1).alias("finish_round"),
        _clock(F.col("rk") * 7 % 300).alias("finish_time"),
        _pick(CLASS_NAMES, F.col("bout_id") % 10).alias("weight_class"),
        (F.col("bout_id") * 2).alias("r_stats_id"),
        (F.col("bout_id") * 2 + 1).alias("b_stats_id"),
    )


def bout_stats(bouts: DataFrame) -> DataFrame:
    """One row per corner and bout."""

    def side(name, number):
        return F.struct(
            F.col(f"{name}_stats_id").alias("stats_id"),
            F.lit(name).alias("corner"),
            F.col(f"{name}_id").alias("competitor_id"),
            F.col(f"{name}k").alias("k"),
        )

    def pair(name, factor, when=None):
        attempted = F.col("k") * factor % 60
        landed = F.expr(f"(k * {factor} % 60) * (k % 10) div 10").cast("int")
        if when is not None:
            attempted, landed = F.when(when, attempted), F.when(when, landed)
        return [landed.alias(f"{name}_landed"), attempted.alias(f"{name}_attempted")]

    columns = []
    for i, area in enumerate(AREAS):
        columns += pair(area, i + 3)
    for j in range(1, MAX_ROUNDS + 1):
        columns += pair(f"round_{j}_sig_str", j + 11, F.col("finish_round") >= j)
    return bouts.select(
        "bout_id", "finish_round", F.inline(F.array(side("r", 0), side("b", 1)))
    ).select(
        "stats_id",
        "bout_id",
        "corner",
        "competitor_id",
        *columns,
        (F.col("k") % 3).alias("kd_landed"),
        (F.col("k") % 4).alias("subs_attempted"),
        (F.col("k") * 3).alias("ctrl_time"),
        (F.col("k") % 2).alias("reversals"),
    )


def competitors(spark: SparkSession, folder: str) -> DataFrame:
    ids = _table(spark, folder, "events").select(F.col("user_id").alias("id")).distinct()
    height = (F.col("id") % 20 + 60).cast("int")
    return ids.select(
        "id",
        F.concat(F.lit("user "), F.col("id").cast("string")).alias("name"),
        (F.col("id") % 90 + 115).cast("int").alias("weight"),
        height.alias("height"),
        F.when(F.col("id") % 6 != 0, height + (F.col("id") % 5).cast("int")).alias("reach"),
        _pick(STANCE_CYCLE, F.col("id") % 5).alias("stance"),
        F.date_add(F.lit("1980-01-01").cast("date"), (F.col("id") * 37 % 7000).cast("int")).alias(
            "date_of_birth"
        ),
        F.when(F.col("id") % 4 == 0, "female").otherwise("male").alias("gender"),
    )


def raw_competitors(spark: SparkSession, folder: str) -> DataFrame:
    """Competitors in the texts a page shows, with the usual gaps."""
    c = competitors(spark, folder)
    mark = F.when(F.col("id") % 2 == 0, '"').otherwise("&quot;")
    gap = F.lit("--")
    return c.select(
        "id",
        "name",
        F.when(F.col("id") % 17 == 3, gap)
        .otherwise(F.concat(F.expr("height div 12"), F.lit("' "), F.col("height") % 12, mark))
        .alias("height"),
        F.when(F.col("id") % 19 == 4, gap)
        .otherwise(F.concat(F.col("weight"), F.lit(" lbs.")))
        .alias("weight"),
        F.when(F.col("reach").isNull(), gap).otherwise(F.concat(F.col("reach"), mark)).alias("reach"),
        F.coalesce("stance", F.lit("")).alias("stance"),
        F.date_format("date_of_birth", "MMM dd, yyyy").alias("date_of_birth"),
        F.concat(
            F.when(F.col("id") % 4 == 0, "Women's ").otherwise(""),
            _pick(CLASS_NAMES, F.col("id") % 10),
        ).alias("bout_class"),
    )


def quotes(bouts: DataFrame) -> DataFrame:
    """Betting quotes for most bouts, some sides swapped and some names spelt differently."""
    favourite = F.col("rk") >= F.col("bk")
    size = F.when(favourite, F.col("rk")).otherwise(F.col("bk")) * 3 + 100
    minus, plus = F.concat(F.lit("-"), size), F.concat(F.lit("+"), size)
    r_odds = F.when(favourite, minus).otherwise(plus)
    b_odds = F.when(favourite, plus).otherwise(minus)
    r_name = F.when(
        F.col("bout_id") % 7 == 0, F.concat(F.lit("usr "), F.col("r_id").cast("string"))
    ).otherwise(F.col("r_name"))
    swapped = F.col("bout_id") % 3 == 0
    quoted = bouts.filter(F.col("bout_id") % 11 != 0)
    # Every thirteenth quote is for a card a year later and finds no bout.
    day = F.when(F.col("bout_id") % 13 == 0, F.date_add("bout_date", 365)).otherwise(F.col("bout_date"))
    left = F.when(swapped, F.col("b_name")).otherwise(r_name)
    return quoted.select(
        F.col("bout_id").alias("quote_id"),
        # Some quotes name one side only.
        F.when(F.col("bout_id") % 89 != 0, left).alias("left_name"),
        F.when(swapped, r_name).otherwise(F.col("b_name")).alias("right_name"),
        F.when(swapped, b_odds).otherwise(r_odds).alias("left_odds"),
        F.when(swapped, r_odds).otherwise(b_odds).alias("right_odds"),
        F.col("weight_class"),
        day.alias("quote_date"),
        F.when(F.col("bout_id") % 5 == 0, F.col("bout_id")).alias("bout_id"),
    )


def aliases(competitors: DataFrame) -> DataFrame:
    return competitors.select(
        F.concat(F.lit("usr "), F.col("id").cast("string")).alias("raw_name"), "name"
    )


def linked_bouts(bouts: DataFrame) -> DataFrame:
    """Bouts with the ids of their totals; most bouts after the cutoff have none yet."""
    done = (F.col("bout_date") <= F.lit(CUTOFF).cast("date")) | (F.col("bout_id") % 13 == 0)
    return bouts.withColumns(
        {
            "r_totals_id": F.when(done, F.col("bout_id") * 2),
            "b_totals_id": F.when(done, F.col("bout_id") * 2 + 1),
        }
    )


def unresolved_bouts(bouts: DataFrame) -> DataFrame:
    """Bouts as first stored: names only, some of competitors nobody knows."""
    stranger = F.concat(F.lit("guest "), F.col("bout_id").cast("string"))
    return bouts.select(
        "bout_id",
        "bout_date",
        F.when(F.col("bout_id") % 17 == 0, stranger).otherwise(F.col("r_name")).alias("r_name"),
        F.col("b_name"),
        F.when(F.col("bout_id") % 2 == 0, F.col("r_id")).alias("r_id"),
        F.when(F.col("bout_id") % 2 == 0, F.col("b_id")).alias("b_id"),
        F.when(F.col("bout_id") % 3 == 0, F.col("bout_id")).alias("quote_id"),
    )


def odd_winners(bouts: DataFrame) -> DataFrame:
    """Bouts where now and then the winner is neither corner."""
    return bouts.withColumn(
        "winner", F.when(F.col("bout_id") % 97 == 0, "nobody").otherwise(F.col("winner"))
    )


def last_day(bouts: DataFrame) -> Column:
    return bouts.agg(F.max("bout_date")).scalar()


def upcoming(bouts: DataFrame) -> DataFrame:
    """The card of the last day: names and weight class only."""
    return bouts.filter(F.col("bout_date") == last_day(bouts)).select(
        F.col("bout_id").alias("card_id"),
        "r_name",
        "b_name",
        F.when(F.col("r_id") % 4 == 0, F.concat(F.lit("Women's "), F.col("weight_class")))
        .otherwise(F.col("weight_class"))
        .alias("weight_class"),
    )


def history(bouts: DataFrame) -> DataFrame:
    return bouts.filter(F.col("bout_date") < last_day(bouts))


def bout_odds(bouts: DataFrame) -> DataFrame:
    """Odds of each quoted bout by corner."""
    mine = quotes(bouts)
    swapped = F.col("quote_id") % 3 == 0
    return mine.select(
        F.col("quote_id").alias("bout_id"),
        F.when(swapped, F.col("right_odds")).otherwise(F.col("left_odds")).alias("r_odds"),
        F.when(swapped, F.col("left_odds")).otherwise(F.col("right_odds")).alias("b_odds"),
    )


def raw_stat_cells(stats: DataFrame) -> DataFrame:
    """Landed and attempted as one text per area: ``109 of 156``."""
    return stats.select(
        "stats_id", *[F.expr(f"concat({a}_landed, ' of ', {a}_attempted) AS {a}") for a in AREAS]
    )


def _round_text(name: str, side: str = "") -> str:
    landed, attempted = f"{side}{name}_landed", f"{side}{name}_attempted"
    return (
        f"concat({landed}, ' of ', {attempted}, ' - ', "
        f"{landed} * 100 div greatest({attempted}, 1), '%')"
    )


def raw_round_cells(stats: DataFrame) -> DataFrame:
    """One text per round fought: ``51 of 69 - 74%``."""
    cells = ", ".join(f"{n}, {_round_text(f'round_{n}_sig_str')}" for n in range(1, MAX_ROUNDS + 1))
    return stats.selectExpr(
        "stats_id", f"stack({MAX_ROUNDS}, {cells}) AS (round, text)"
    ).filter("text IS NOT NULL")


def raw_dates(bouts: DataFrame) -> DataFrame:
    return bouts.select(
        "bout_id",
        F.date_format("bout_date", "MMMM dd, yyyy").alias("card_text"),
        F.date_format("bout_date", "MMM dd, yyyy").alias("birth_text"),
        F.date_format("bout_date", "MM.dd.yyyy").alias("quote_text"),
    )


def links(pages: DataFrame) -> DataFrame:
    """A target for every page; the stored pages do not link to each other."""
    count = pages.agg(F.count(F.lit(1))).scalar()
    return pages.select("page_id", ((F.col("page_id") * 7 + 1) % count).alias("target_page_id"))


def _cell(expression: str) -> str:
    red, blue = expression.format("r_"), expression.format("b_")
    return f"'<td class=\"b-fight-details__table-col l-page_align_left\"><p>', {red}, '</p><p>', {blue}, '</p></td>'"


def _of(area: str) -> str:
    return f"concat({{0}}{area}_landed, ' of ', {{0}}{area}_attempted)"


def bout_pages(bouts: DataFrame, stats: DataFrame) -> DataFrame:
    """A page per bout, in the markup the extraction jobs expect."""
    wide = bouts.join(pair_up(stats, STAT_COLUMNS), "bout_id")

    def person(side):
        status = f"CASE WHEN winner = {side}_name THEN 'W' WHEN winner = '' THEN 'D' ELSE 'L' END"
        return (
            f"'<div class=\"b-fight-details__person\"><i class=\"b-fight-details__person-status b-status_{side}\">', "
            f"{status}, '</i><h3><a class=\"b-link b-fight-details__person-link\" href=\"/competitor/', "
            f"{side}_id, '\">', {side}_name, '</a></h3></div>'"
        )

    def item(label, value):
        return (
            "'<i class=\"b-fight-details__text-item\"><i class=\"b-fight-details__label\">"
            f"{label}</i> ', {value}, ' </i>'"
        )

    clock = "concat({0}ctrl_time div 60, ':', lpad({0}ctrl_time % 60, 2, '0'))"
    empty = "''"
    total_cells = ["{0}kd_landed", _of("sig_str"), empty, _of("total_str"), _of("td"), empty,
                   "{0}subs_attempted", "{0}reversals", clock]
    strike_cells = [empty, empty] + [_of(a) for a in ("head", "body", "legs", "distance", "clinch", "ground")]
    rounds = []
    text = '<i class=\"b-fight-details__bar-chart-text b-style_light\">'
    for n in range(1, MAX_ROUNDS + 1):
        red, blue = (_round_text(f"round_{n}_sig_str", s) for s in ("r_", "b_"))
        rounds.append(
            f"coalesce(concat('<div class=\"b-fight-details__bar-charts-row clearfix\"><i class=\"b-bar js-red\">"
            f"<i class=\"b-fight-details__bar-chart\"></i>{text}', {red}, '</i></i><i class=\"b-bar js-blue\">"
            f"<i class=\"b-fight-details__bar-chart\"></i>{text}', {blue}, '</i></i></div>'), '')"
        )
    # The tables by round, which no one reads.
    per_round = "<table><tbody><td class=\"b-fight-details__table-col\"><p>7</p><p>7</p></td></tbody></table>"
    parts = [
        "'<html><head><script>var x = \"<div class=\\\"b-fight-details__person\\\">\";</script></head><body>'",
        # A comment that would read as a corner, and the block around both corners.
        "'<!-- <div class=\"b-fight-details__person\"><a class=\"b-fight-details__person-link\">Nobody</a></div> -->'",
        "'<div class=\"b-fight-details__persons clearfix\">'",
        person("r"), person("b"), "'</div>'",
        "'<div class=\"b-fight-details__fight\"><i class=\"b-fight-details__fight-title\">'",
        "CASE WHEN championship_fight THEN '<img src=\"/img/belt.png\">' ELSE '<img src=\"/img/perf.png\">' END",
        "CASE WHEN r_id % 4 = 0 THEN 'Women&#39;s ' ELSE '' END", "weight_class", "' Bout</i>'",
        "'<i><i>Method:</i><i style=\"font-style: normal\">'", "win_method", "'</i></i>'",
        item("Round:", "finish_round"), item("Time:", "finish_time"),
        item("Time format:", "concat(number_of_rounds, ' Rnd')"),
        item("Referee:", "concat('<span>Referee ', bout_id % 13, '</span>')"),
        item("Details:", "concat('after ', finish_time)"),
        "'</div><table><tbody class=\"b-fight-details__table-body\">'", *[_cell(c) for c in total_cells],
        f"'</tbody></table>{per_round}'",
        "'<table><tbody class=\"b-fight-details__table-body\">'", *[_cell(c) for c in strike_cells],
        f"'</tbody></table>{per_round}<div class=\"b-fight-details__charts-col_pos_left\">"
        f"<div class=\"b-fight-details__bar-charts-row\"><i class=\"js-red\">{text}1 of 1 - 100%</i></i></div></div>'",
        "'<div class=\"b-fight-details__charts-col b-fight-details__charts-col_pos_right\">'",
        *rounds, "'</div></body></html>'",
    ]
    return wide.selectExpr(
        "bout_id AS page_id", "concat('/bout/', bout_id) AS url", f"concat({', '.join(parts)}) AS html"
    )


def _joined(frame: DataFrame, day: str, order: str, row: str) -> DataFrame:
    """One text per day of its rows' texts, in order.

    Days are dealt to a fixed number of tasks: equal rows shrink so much in a shuffle that one task would take all days.
    """
    # More tasks than days, so that few tasks hold two.
    parts = 8 * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = frame.selectExpr(day, f"struct({order} AS at, {row} AS row) AS item").repartition(parts, day)
    return rows.groupBy(day).agg(F.expr("array_join(transform(array_sort(collect_list(item)), x -> x.row), '')").alias("rows"))


def event_pages(bouts: DataFrame) -> DataFrame:
    """A page per day, with a row per bout that links to its page; one cell holds a table of its own."""
    cell = "<td class=\"b-fight-details__table-col l-page_align_left\">"
    row = (
        "concat('<tr class=\"b-fight-details__table-row b-fight-details__table-row__hover js-click\" "
        f"data-link=\"http://stats.example/bout/', bout_id, '\">{cell}<a href=\"#\">win</a></td>{cell}"
        "<p><a href=\"/c/1\"> ', r_name, ' </a></p><p><a href=\"/c/2\">', b_name, '</a></p></td>"
        f"{cell}<table><tr><td>1</td><td>2</td></tr></table></td>{cell}3</td>{cell}4</td>{cell}5</td>{cell}<p>', "
        "CASE WHEN r_id % 4 = 0 THEN concat('Women&#39;s ', weight_class) ELSE weight_class END, '</p></td></tr>')"
    )
    joined = _joined(bouts, "bout_date", "bout_id", row)
    return joined.selectExpr(
        "1000000 + unix_date(bout_date) AS page_id",
        "concat('http://stats.example/event/', bout_date) AS url",
        "concat('<html><body><table><thead><tr><th>x</th></tr></thead><tbody class=\"b-fight-details__table-body\">"
        "<tr class=\"b-fight-details__table-row\"><td>heading</td></tr>', rows, '</tbody></table></body></html>') AS html",
    )


def listing_pages(bouts: DataFrame) -> DataFrame:
    """Two pages that list the events, the days of odd and of even numbers."""
    days = bouts.select("bout_date").distinct().selectExpr("bout_date", "unix_date(bout_date) % 2 AS half")
    row = (
        "concat('<tr class=\"b-statistics__table-row\"><td><i><a class=\"b-link b-link_style_black\" "
        "href=\"http://stats.example/event/', bout_date, '\">Night</a><span class=\"b-statistics__date\"> ', "
        "date_format(bout_date, 'MMMM dd, yyyy'), ' </span></i></td>"
        "<td class=\"b-statistics__table-col b-statistics__table-col_style_big-top-padding\"> Hall &amp; Dome ', "
        "unix_date(bout_date) % 9, '</td></tr>')"
    )
    return _joined(days, "half", "bout_date", row).selectExpr(
        "2000000 + half AS page_id",
        "concat('http://stats.example/events/', half) AS url",
        "concat('<table><tr class=\"b-statistics__table-row\"><td>Name</td></tr>', rows, '</table>') AS html",
    )


def competitor_pages(raw: DataFrame, bouts: DataFrame) -> DataFrame:
    """A page per competitor: facts in any order, links to the bouts, the first one first."""
    item = "concat('<li class=\"b-list__box-list-item b-list__box-list-item_type_block\"><i class=\"b-list__title\"> {0} </i> ', {1}, ' </li>')"
    facts = [
        ("Height:", "height"), ("Weight:", "weight"), ("Reach:", "reach"), ("STANCE:", "stance"),
        ("DOB:", "date_of_birth"), ("Other:", "'x'"),
    ]
    turned = ", ".join(item.format(*f) for f in facts[::-1])
    plain = ", ".join(item.format(*f) for f in facts)
    first = bouts.select(F.explode(F.array("r_id", "b_id")).alias("id"), "bout_id").groupBy("id").agg(F.min("bout_id").alias("bout_id"))
    row = (
        "CASE WHEN id % 23 = 1 THEN '' ELSE concat('<tr class=\"b-fight-details__table-row "
        "b-fight-details__table-row__hover\" data-link=\"http://stats.example/bout/', bout_id, '\"><td>x</td></tr>') END"
    )
    return raw.join(first, "id").selectExpr(
        "3000000 + id AS page_id",
        "concat('/competitor/', id) AS url",
        "concat('<span class=\"b-content__title-highlight\"> ', name, ' </span><ul class=\"b-list__box-list\">', "
        f"CASE WHEN id % 2 = 0 THEN concat({plain}) ELSE concat({turned}) END, '</ul><table><tbody class="
        f"\"b-fight-details__table-body\"><tr class=\"b-fight-details__table-row\"><td></td></tr>', {row}, '</tbody></table>') AS html",
    )


def card_page(card: DataFrame) -> DataFrame:
    """The page of a card to come: three cells per bout, both names in the first."""
    cell = "<td class=\"b-fight-details__table-col l-page_align_left\">"
    row = (
        f"concat('<tr><td class=\"b-fight-details__table-col\">no</td>{cell}<p><a>', r_name, '</a></p><p><a> ', b_name, "
        f"' </a></p></td>{cell}<p>', replace(weight_class, chr(39), '&#39;'), '</p></td>{cell}time</td></tr>')"
    )
    return _joined(card.withColumn("one", F.lit(1)), "one", "card_id", row).selectExpr(
        "CAST(one AS BIGINT) AS page_id", "'/event/next' AS url", "concat('<table>', rows, '</table>') AS html"
    )


def quote_pages(quotes: DataFrame) -> DataFrame:
    """A page per quote; some have another line where the odds should be."""
    label = "CASE WHEN quote_id % 6 = 0 THEN 'Nickname' ELSE 'Betting Odds' END"
    blank = "'<li><span>x</span></li>'"
    side = "concat('<span class=\"{0}\"><a href=\"/f\">', coalesce({0}_name, ''), '</a></span>')"
    return quotes.selectExpr(
        "quote_id AS page_id",
        "concat('/quotes/', quote_id) AS url",
        f"concat('<div class=\"fighterNames\">', {side.format('left')}, {side.format('right')}, '</div>"
        "<table class=\"fighterStats spaced\"><tr><td>a</td></tr><tr><td><table><tr><td>b</td></tr></table></td></tr><tr><td>', "
        f"left_odds, ' (text)</td><td>x</td><td>', {label}, '</td><td>x</td><td>', right_odds, ' (text)</td></tr></table>"
        f"<div class=\"details details_with_poster\"><ul>', {blank}, {blank}, '<li><span>Saturday ', "
        f"date_format(quote_date, 'MM.dd.yyyy'), ' at 10:00 PM</span></li>', repeat({blank}, 6), '<li><span> ', "
        "weight_class, ' (155 lbs)</span></li></ul></div>') AS html",
    )
