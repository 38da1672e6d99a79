"""Every operator as a query over the given tables.

Each query derives its bout tables from the star-schema tables (see FIXTURES.md) and runs over all
of them.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutlab import fixtures as fx
from boutlab.functions import text
from boutlab.functions.odds import units
from boutlab.operators import (
    evaluate,
    features,
    late,
    page_records,
    pages,
    quotes,
    resolve,
    snapshots,
    standardize,
    totals,
)
from boutlab.plans import models, refresh
from boutlab.operators.skew import ROWS_PER_SLOT, lookup
from boutlab.schema import (
    CATEGORIES,
    CONTROL,
    KNOCKDOWNS,
    RECORD,
    STAT_COLUMNS,
    STRIKES,
    SUBMISSIONS,
    TOTAL_COLUMNS,
)
from boutlab.session import scratch_path, tune
from boutlab.sources import tables

CUTOFF = fx.CUTOFF
# Rounds of two-class boosting in the queries that share one model, of the 1,000 that are the library's default;
# all else trains at the defaults, but for the grid of networks.
GBT_ROUNDS = {"maxIter": 100}

QUERIES = {}


def query(function):
    @functools.wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(Given(tune(spark), folder))

    QUERIES[function.__name__] = run
    return run


class Given:
    """The input tables of one scale, each built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder)

    def table(self, name):
        return tables.read_table(self.spark, self.folder, name)

    @functools.cached_property
    def bouts(self):
        return fx.bouts(self.spark, self.folder)

    @functools.cached_property
    def stats(self):
        return fx.bout_stats(self.bouts)

    @functools.cached_property
    def competitors(self):
        return fx.competitors(self.spark, self.folder)

    @functools.cached_property
    def full_competitors(self):
        return standardize.reach_from_height(self.competitors)

    @functools.cached_property
    def raw_competitors(self):
        return fx.raw_competitors(self.spark, self.folder)

    @functools.cached_property
    def bout_pages(self):
        """Stored pages, one per bout."""
        return tables.stage(fx.bout_pages(self.bouts, self.stats), "bout_pages", "page_id")

    @functools.cached_property
    def event_pages(self):
        return tables.stage(fx.event_pages(self.bouts), "event_pages", "page_id")

    @functools.cached_property
    def listing_pages(self):
        return fx.listing_pages(self.bouts)

    @functools.cached_property
    def competitor_pages(self):
        return tables.stage(fx.competitor_pages(self.raw_competitors, self.bouts), "competitor_pages", "page_id")

    @functools.cached_property
    def quote_pages(self):
        return tables.stage(fx.quote_pages(self.quotes), "quote_pages", "page_id")

    @functools.cached_property
    def quotes(self):
        return fx.quotes(self.bouts)

    @functools.cached_property
    def resolved_quotes(self):
        return resolve.resolve_aliases(
            self.quotes, ["left_name", "right_name"], fx.aliases(self.competitors), "quote_id"
        )

    @functools.cached_property
    def linked(self):
        return fx.linked_bouts(self.bouts)

    @functools.cached_property
    def history(self):
        return fx.history(self.bouts)

    @functools.cached_property
    def card(self):
        return fx.upcoming(self.bouts)

    @functools.cached_property
    def stored_totals(self):
        """Totals of the bouts up to the cutoff, with ids."""
        done = self.bouts.filter(F.col("bout_date") <= F.lit(CUTOFF).cast("date"))
        return tables.stage(
            with_totals_ids(totals.running_totals(done, self.stats)), "stored_totals"
        )

    @functools.cached_property
    def newest_before_card(self):
        """Stored totals of the bouts before the card, the newest per competitor."""
        past = with_totals_ids(totals.running_totals(self.history, self.stats))
        return totals.latest_totals(tables.stage(past, "past_totals"))

    @functools.cached_property
    def priced(self):
        """Bouts with weight, and with odds where a quote names the bout."""
        prices = fx.bout_odds(self.bouts)
        return self.bouts.withColumn("weight", text.pounds(text.class_name("weight_class"))).join(
            prices, "bout_id", "left"
        )

    @functools.cached_property
    def dataset(self):
        return features.training_dataset(self.priced, self.stats, self.full_competitors)

    @functools.cached_property
    def predicted(self):
        """Fixed predictions next to the label, with odds where there is a quote."""
        return self.priced.select(
            "bout_id",
            text.label_number(text.label_of("winner", "r_name", "b_name")).alias("label"),
            ((F.col("rk") + F.col("bk")) % 2).alias("prediction"),
            F.when(F.col("bout_id") % 4 == 0, "test").otherwise("train").alias("split"),
            text.american_odds("r_odds").alias("r_odds"),
            text.american_odds("b_odds").alias("b_odds"),
        )


def with_totals_ids(frame):
    return frame.withColumn(
        "totals_id", F.col("bout_id") * 2 + F.when(F.col("corner") == "r", 0).otherwise(1)
    )


CORNER_KEYS = ["bout_id", "corner", "competitor_id"]


# --- scans, sources, sinks -------------------------------------------------------------------


@query
def scan_pending_bouts(g):
    return snapshots.pending_bouts(g.linked, CUTOFF).select("bout_id", "bout_date", "r_id", "b_id")


@query
def scan_pending_quotes(g):
    return snapshots.pending_quotes(g.quotes, CUTOFF).select(
        "quote_id", "left_name", "right_name", "quote_date"
    )


@query
def lookup_by_id(g):
    pending = snapshots.pending_bouts(g.linked, CUTOFF)
    keys = pending.select(F.explode(F.array("r_stats_id", "b_stats_id")).alias("stats_id"))
    return snapshots.lookup_by_id(keys, g.stats, "stats_id")


@query
def read_feature_csv(g):
    path = scratch_path(g.spark, "dataset_csv")
    tables.export_dataset(g.dataset, path)
    columns = ["bout_id", "weight", "gender", "r_wins", "r_stance", "b_sig_str_evaded", "winner"]
    return tables.read_feature_csv(g.spark, path, columns=columns)


@query
def append_with_keys(g):
    new = g.bouts.select("bout_ts", F.col("bout_id").alias("source_id"), "r_id", "b_id")
    old = g.quotes.select("quote_id")
    return snapshots.append_with_keys(old, new, "quote_id", ["bout_ts", "source_id"])


@query
def append_competitors(g):
    new = g.competitors.select("name", "weight", "gender").withColumn(
        "_order", snapshots.natural_order("name")
    )
    return snapshots.append_with_keys(
        g.competitors.select("id"), new, "id", ["_order", "name"]
    ).drop("_order")


@query
def append_competitors_cut(g):
    """Numbered along two text columns, in slots of ten rows."""
    new = g.competitors.select("gender", "name")
    return snapshots.append_with_keys(g.competitors.select("id"), new, "id", ["gender", "name"], 10)


@query
def overlay_update(g):
    base = g.linked.select("bout_id", "bout_date", "r_totals_id", "b_totals_id")
    changes = snapshots.pending_bouts(g.linked, CUTOFF).select(
        "bout_id",
        (F.col("bout_id") * 10).alias("r_totals_id"),
        F.when(F.col("bout_id") % 2 == 0, F.col("bout_id") * 10 + 1).alias("b_totals_id"),
    )
    return snapshots.overlay_update(base, changes, "bout_id")


def _linked_pair(g):
    oriented = quotes.orient_quotes(quotes.match_quotes(g.resolved_quotes, g.bouts), g.bouts)
    return quotes.link_quotes_and_bouts(g.quotes, g.bouts.drop("weight_class"), oriented)


@query
def link_quotes_and_bouts(g):
    bouts, _ = _linked_pair(g)
    return bouts.select("bout_id", "quote_id", "r_odds", "b_odds", "weight")


@query
def link_bouts_onto_quotes(g):
    _, linked = _linked_pair(g)
    return linked.select("quote_id", "left_name", "bout_id")


@query
def update_weight_by_pair(g):
    weights = g.quotes.select(
        F.col("left_name").alias("one_name"),
        F.col("right_name").alias("other_name"),
        F.col("quote_date").alias("day"),
        text.class_name("weight_class").alias("weight_class"),
    )
    bouts = g.bouts.select(
        "bout_id", "r_name", "b_name", "bout_date", F.lit(None).cast("int").alias("weight")
    )
    return quotes.update_weight_by_pair(bouts, weights)


@query
def export_dataset(g):
    path = scratch_path(g.spark, "export")
    tables.export_dataset(g.dataset, path)
    return tables.read_feature_csv(g.spark, path)


@query
def write_prediction_report(g):
    picks = g.bouts.select(
        "r_name",
        "b_name",
        F.when(F.col("rk") >= F.col("bk"), F.col("r_name")).otherwise(F.col("b_name")).alias("winner"),
        ((F.greatest("rk", "bk") + 100) / F.lit(200.0)).alias("confidence"),
    )
    path = scratch_path(g.spark, "report")
    tables.write_prediction_report(picks, path)
    return g.spark.read.text(path)


# --- pages -----------------------------------------------------------------------------------


@query
def extract_links(g):
    return pages.extract_links(g.table("pages"))


@query
def extract_text_field(g):
    # Two fields of a page in one pass over it.
    p = g.table("pages")
    fields = {"title": ("title", None), "ad": ("div", "ad")}
    found = {n: pages.text_field(F.col("html"), *where) for n, where in fields.items()}
    return p.select("page_id", *[c.alias(n) for n, c in found.items()])


@query
def extract_cells(g):
    return pages.extract_cells(g.table("pages"), "li")


@query
def nth_cell(g):
    return pages.nth_cell(g.table("pages"), "li", 2)


@query
def chunk_cells(g):
    return pages.chunk_cells(g.table("pages"), "li", 4)


@query
def follow_links(g):
    p = g.table("pages")
    return pages.follow_links(p.filter(F.col("url").startswith("https")), fx.links(p), 2)


@query
def linked_page_titles(g):
    p = g.table("pages")
    titles = pages.extract_text_field(p, "title")
    return pages.linked_pages(p.filter(F.col("url").startswith("https")), fx.links(p), titles, 2)


@query
def flag_marker(g):
    return pages.flag_marker(g.table("pages"), "/to", "a", "href")


@query
def flag_title_belt(g):
    return pages.flag_marker(g.bout_pages, "/img/belt.png")


@query
def slice_items(g):
    return pages.slice_items(g.table("pages"), "li", 1, -2)


@query
def extract_tail_text(g):
    return pages.extract_tail_text(g.bout_pages, "Referee:")


@query
def bout_record_from_page(g):
    """Bouts of stored pages, with day and place from the pages that lead to them."""
    return page_records.dated_bouts(g.listing_pages, g.event_pages, g.bout_pages)


@query
def corner_records_from_page(g):
    return pages.corner_stats_from_page(g.bout_pages)


@query
def skip_incomplete_quotes(g):
    return page_records.quotes_from_page(fx.quote_pages(g.quotes)).select("page_id", "left_odds", "right_odds")


@query
def quotes_from_page(g):
    return page_records.quotes_from_page(g.quote_pages)


@query
def pages_without_quote(g):
    return page_records.pages_without_quote(g.quote_pages)


@query
def cards_from_page(g):
    return page_records.cards_from_page(g.listing_pages).drop("pos")


@query
def event_rows_from_page(g):
    return page_records.event_rows_from_page(g.event_pages)


@query
def bout_context(g):
    return page_records.bout_context(g.listing_pages, g.event_pages, g.bout_pages)


@query
def competitors_from_page(g):
    return page_records.competitors_from_page(g.competitor_pages, g.bout_pages)


@query
def competitors_without_bout(g):
    return page_records.competitors_without_bout(g.competitor_pages, g.bout_pages)


@query
def card_from_page(g):
    return page_records.card_from_page(fx.card_page(g.card))


@query
def card_page_features(g):
    """The columns a model sees for a card read from its page."""
    card = page_records.card_from_page(fx.card_page(g.card)).withColumn("card_id", F.col("pos").cast("long"))
    return features.upcoming_features(
        card, fx.last_day(g.bouts), g.full_competitors, g.newest_before_card
    ).select("r_name", "b_name", "weight", "gender", "r_age", "b_stance", "r_wins", "b_opponent_wins", "b_fight_time")


@query
def nested_cells(g):
    """Cells of event pages, those of tables inside cells among them."""
    return pages.nested_cells(g.event_pages, "td").select("page_id", "pos", "level", "around", F.regexp_replace("text", r"\s+", " ").alias("text"))


# --- standardisation -------------------------------------------------------------------------


@query
def parse_landed_attempted(g):
    raw = fx.raw_stat_cells(g.stats)
    parsed = []
    for c in CATEGORIES[:9]:
        parsed += [text.landed(c).alias(f"{c}_landed"), text.attempted(c).alias(f"{c}_attempted")]
    return raw.select("stats_id", *parsed)


@query
def parse_round_cells(g):
    return fx.raw_round_cells(g.stats).select(
        "stats_id", "round", text.landed("text").alias("landed"), text.attempted("text").alias("attempted")
    )


@query
def pad_rounds(g):
    return standardize.rounds_to_columns(fx.raw_round_cells(g.stats), ["stats_id"])


@query
def zero_fill_stats(g):
    return totals.zero_fill(g.stats).select("stats_id", *STAT_COLUMNS)


@query
def parse_clock(g):
    return g.bouts.select("bout_id", text.clock_seconds("finish_time").alias("seconds"))


@query
def bout_duration(g):
    return g.bouts.select("bout_id", totals.bout_seconds().alias("total_fight_time"))


@query
def parse_height(g):
    return g.raw_competitors.select("id", text.height_inches("height").alias("height"))


@query
def strip_unit(g):
    return g.raw_competitors.select(
        "id",
        text.leading_number("weight").alias("weight"),
        text.leading_number("reach").alias("reach"),
    )


@query
def sentinel_to_null(g):
    return standardize.sentinels_to_null(g.raw_competitors).select(
        "id", "height", "weight", "reach", "stance"
    )


@query
def reach_from_height(g):
    return standardize.reach_from_height(g.competitors).select("id", "height", "reach")


@query
def require_attributes(g):
    return standardize.require_attributes(
        standardize.sentinels_to_null(g.raw_competitors)
    ).select("id", "name")


@query
def parse_dates(g):
    return fx.raw_dates(g.bouts).select(
        "bout_id",
        text.to_day("card_text", "card").alias("card_day"),
        text.to_day("birth_text", "birth").alias("birth_day"),
        text.to_day("quote_text", "quote").alias("quote_day"),
    )


@query
def weight_class_to_pounds(g):
    return g.bouts.select(
        "bout_id",
        text.pounds(F.lower("weight_class")).alias("weight"),
        text.pounds("win_method").alias("unknown"),
    )


@query
def gender_and_class(g):
    return g.raw_competitors.select(
        "id", text.gender("bout_class").alias("gender"), text.class_name("bout_class").alias("class")
    )


@query
def parse_american_odds(g):
    moved = F.concat("left_odds", F.lit(" (moved)"))
    return g.quotes.select(
        "quote_id",
        text.american_odds(moved).alias("left_odds"),
        text.american_odds("right_odds").alias("right_odds"),
        text.american_odds("weight_class").alias("no_odds"),
    )


@query
def fold_accents_and_hyphens(g):
    return g.table("documents").select("doc_id", text.plain_letters("text").alias("text"))


@query
def last_name_key(g):
    return g.bouts.select("bout_id", text.last_name("r_name").alias("last_name"))


@query
def result_to_label(g):
    label = text.label_of("winner", "r_name", "b_name")
    return fx.odd_winners(g.bouts).select(
        "bout_id", label.alias("winner_side"), text.label_number(label).alias("label")
    )


@query
def rejected_results(g):
    return totals.rejected(fx.odd_winners(g.bouts)).select("bout_id", "winner")


@query
def clean_competitors(g):
    return standardize.clean_competitors(g.raw_competitors)


# --- projections and filters -----------------------------------------------------------------


@query
def bouts_without_ids(g):
    return resolve.without_ids(fx.unresolved_bouts(g.bouts))


@query
def bouts_without_odds(g):
    return resolve.without_odds(fx.unresolved_bouts(g.bouts))


@query
def bouts_of_competitor(g):
    fighters = g.card.select(F.explode(F.array("r_name", "b_name")).alias("name")).distinct()
    wanted = g.competitors.join(fighters, "name").select(
        F.col("id").alias("competitor_id"), F.lit(CUTOFF).cast("date").alias("before")
    )
    return resolve.bouts_of_competitor(g.linked, wanted)


@query
def project_features(g):
    entering = totals.running_totals(g.bouts, g.stats, before=True)
    with_body = totals.with_age(entering, g.full_competitors).join(
        g.full_competitors.select(
            F.col("id").alias("competitor_id"), "stance", "height", "reach"
        ),
        "competitor_id",
        "left",
    )
    return features.project_features(with_body.filter(F.col("corner") == "r"), "r", ["bout_id"])


@query
def project_features_blue(g):
    """The other corner's columns, its attributes joined like those of hot competitors."""
    entering = totals.running_totals(g.bouts, g.stats, before=True)
    body = g.full_competitors.select(F.col("id").alias("competitor_id"), "stance", "height", "reach")
    with_body = lookup(totals.with_age(entering, g.full_competitors), body, ["competitor_id"], ["bout_id"])
    return features.project_features(with_body.filter(F.col("corner") == "b"), "b", ["bout_id"])


def _variant(name):
    def run(g):
        return features.VARIANTS[name](g.dataset).select(
            "bout_id", "win_method", "winner", "r_odds", "b_odds", "r_wins", "b_losses"
        )

    run.__name__ = name
    return run


for _name in features.VARIANTS:
    query(_variant(_name))


# --- joins -----------------------------------------------------------------------------------


@query
def resolve_names(g):
    return resolve.resolve_names(fx.unresolved_bouts(g.bouts), g.competitors).select(
        "bout_id", "r_name", "b_name", "r_id", "b_id"
    )


@query
def resolve_aliases(g):
    return g.resolved_quotes.select("quote_id", "left_name", "right_name")


@query
def match_quotes(g):
    return quotes.match_quotes(g.resolved_quotes, g.bouts).select("quote_id", "bout_id")


@query
def orient_quotes(g):
    return quotes.orient_quotes(quotes.match_quotes(g.resolved_quotes, g.bouts), g.bouts)


@query
def unmatched_quotes(g):
    return quotes.unmatched_quotes(g.resolved_quotes, g.bouts).select(
        "quote_id", "left_name", "right_name", "quote_date"
    )


@query
def previous_bout(g):
    purchases = g.table("events").filter(F.col("event_type") == "purchase")
    probes = purchases.selectExpr(
        "event_id AS probe_id", "user_id AS competitor_id", "ts AS probe_ts"
    )
    return totals.previous_bout(g.linked, probes)


@query
def previous_totals(g):
    wanted = ["wins", "losses", "opponent_wins", "sig_str_landed", "fight_time"]
    return totals.previous_totals(g.bouts, g.stats, wanted).select(*CORNER_KEYS, *wanted)


@query
def matchup_join(g):
    pairs = features.upcoming_pairs(g.card, g.full_competitors, g.newest_before_card).withColumn(
        "bout_date", fx.last_day(g.bouts)
    )
    return features.matchup_join(pairs, g.newest_before_card, g.full_competitors, "card_id").drop(
        "weight_class"
    )


@query
def predictable_only(g):
    early = g.bouts.filter(F.col("bout_date") <= F.lit("2024-01-01").cast("date"))
    newest = with_totals_ids(totals.running_totals(early, None, ["wins"]))
    pairs = features.upcoming_pairs(g.card, g.competitors, totals.latest_totals(newest))
    return features.predictable_only(pairs).select("card_id", "r_totals_id", "b_totals_id")


@query
def not_predictable(g):
    early = g.bouts.filter(F.col("bout_date") <= F.lit("2024-01-01").cast("date"))
    newest = with_totals_ids(totals.running_totals(early, None, ["wins"]))
    pairs = features.upcoming_pairs(g.card, g.competitors, totals.latest_totals(newest))
    return features.not_predictable(pairs).select("card_id", "r_name", "b_name")


@query
def same_name_semi(g):
    return resolve.rows_with_duplicate_names(g.table("part"), "p_partkey", "p_name").select(
        "p_partkey", "p_name"
    )


@query
def dedupe_anti(g):
    return resolve.drop_duplicate_names(
        g.table("part"), "p_partkey", "p_name", [fx.PROTECTED_PART]
    ).select("p_partkey", "p_name")


@query
def name_search_ci(g):
    directory = g.competitors.select(
        F.col("id").alias("entry_id"),
        F.lit("User").alias("first_name"),
        F.col("id").cast("string").alias("last_name"),
    )
    wanted = resolve.missing_names(fx.unresolved_bouts(g.bouts)).select(F.upper("name").alias("name"))
    return resolve.search_names(directory, wanted)


@query
def opponent_mirror(g):
    return totals.opponent_mirror(g.stats, ["sig_str_landed", "kd_landed", "ctrl_time"])


# --- aggregations ----------------------------------------------------------------------------


@query
def duplicate_names(g):
    return resolve.duplicate_names(g.table("part"), "p_name")


@query
def min_id_per_name(g):
    return resolve.min_id_per_name(g.table("part"), "p_partkey", "p_name")


@query
def last_bout_date(g):
    return resolve.last_bout_date(g.linked, F.lit(CUTOFF).cast("date"))


@query
def missing_names(g):
    return resolve.missing_names(fx.unresolved_bouts(g.bouts))


@query
def value_counts(g):
    return resolve.value_counts(
        g.bouts.select(text.label_of("winner", "r_name", "b_name").alias("winner")), "winner"
    )


def _rounded(frame, keys):
    return frame.select(*keys, *[F.round(c, 6).alias(c) for c in frame.columns if c not in keys])


@query
def column_mean_std(g):
    train, _ = features.split_random(g.dataset)
    return _rounded(features.mean_std_rows(train, features.NUMERIC_FEATURES), ["feature"])


@query
def latest_totals(g):
    return totals.latest_totals(
        with_totals_ids(totals.running_totals(g.bouts, None, RECORD))
    ).select("totals_id", *CORNER_KEYS, *RECORD)


# --- running totals --------------------------------------------------------------------------


def _running(name, measures, needs_stats=True):
    def run(g):
        stats = g.stats if needs_stats else None
        return totals.running_totals(g.bouts, stats, measures).select(*CORNER_KEYS, *measures)

    run.__name__ = name
    return query(run)


_running("running_strikes", STRIKES)
_running("running_record", RECORD, False)
_running("running_opponent_record", ["opponent_wins", "opponent_loses"], False)
_running("running_control", CONTROL)
_running("running_knockdowns", KNOCKDOWNS)
_running("running_submissions", SUBMISSIONS)
_running("running_fight_time", ["fight_time", "opponent_fight_time"], False)
_running("running_reversals", ["reversals"])
_running("championship_count", ["championship_fights"], False)


@query
def age_at_bout(g):
    legs = totals.record_legs(g.bouts, [])
    return totals.with_age(legs, g.competitors).select(*CORNER_KEYS, "age")


@query
def cumulative_totals(g):
    return totals.cumulative_totals(g.bouts, g.stats, g.competitors).select(
        *CORNER_KEYS, "name", "age", *TOTAL_COLUMNS
    )


@query
def pre_bout_totals(g):
    return totals.previous_totals(g.bouts, g.stats).select(*CORNER_KEYS, *TOTAL_COLUMNS)


@query
def incremental_totals(g):
    new = g.bouts.filter(F.col("bout_date") > F.lit(CUTOFF).cast("date"))
    seed = totals.latest_totals(g.stored_totals)
    return totals.running_totals(new, g.stats, seed=seed).select(*CORNER_KEYS, *TOTAL_COLUMNS)


def _late(g, rows_per_slot=ROWS_PER_SLOT):
    """Every tenth bout comes when the totals of all others are stored."""
    on_time = g.bouts.filter("bout_id % 10 <> 0")
    stored = tables.stage(with_totals_ids(totals.running_totals(on_time, g.stats)), "early_totals")
    found = late.late_totals(g.bouts.filter("bout_id % 10 = 0"), g.stats, stored, rows_per_slot=rows_per_slot)
    return stored, found


@query
def late_bouts_totals(g):
    return late.with_late_totals(*_late(g)).select(*CORNER_KEYS, *TOTAL_COLUMNS)


@query
def late_bouts_totals_cut(g):
    """The same with the time lines of busy competitors cut into slots."""
    return late.with_late_totals(*_late(g, 50)).select(*CORNER_KEYS, *TOTAL_COLUMNS)


@query
def late_bouts_corrections(g):
    """The stored rows that late bouts change, with their new values."""
    return _late(g)[1].corrected


@query
def split_hot_totals(g):
    """The same totals with every busy competitor cut into slots."""
    wanted = ["wins", "losses", "draws", "opponent_wins", "opponent_fight_time", "sig_str_evaded"]
    return totals.running_totals(g.bouts, g.stats, wanted, rows_per_slot=20).select(
        *CORNER_KEYS, *wanted
    )


# --- sorts and top-k -------------------------------------------------------------------------


@query
def bouts_by_date(g):
    return snapshots.bouts_by_date(g.bouts.select("bout_id", "bout_date", "r_id", "b_id"))


@query
def latest_one(g):
    all_totals = with_totals_ids(totals.running_totals(g.bouts, None, RECORD))
    return snapshots.latest_one(all_totals, "competitor_id", 7, "totals_id").select(
        "totals_id", *CORNER_KEYS, *RECORD
    )


@query
def top_importances(g):
    return models.top_importances(_fitted(g, "gbt"))


# --- features --------------------------------------------------------------------------------


@query
def one_hot(g):
    return features.one_hot(g.dataset.select("bout_id", "gender", "r_stance", "b_stance"))


@query
def align_dummies(g):
    partial = features.one_hot(g.competitors.select("id", "gender"), ["gender"]).drop("gender_male")
    return features.align_dummies(partial, ["id", "gender_female", "gender_male"])


@query
def encode_label(g):
    return features.encode_label(g.dataset.select("bout_id", "winner")).select("bout_id", "label")


def _split(train, test):
    return train.select("bout_id", F.lit("train").alias("split")).unionByName(
        test.select("bout_id", F.lit("test").alias("split"))
    )


@query
def split_ordered(g):
    return _split(*features.split_ordered(g.bouts))


@query
def split_random(g):
    return _split(*features.split_random(g.bouts))


def _standardized(g):
    columns = ["r_wins", "b_losses", "r_age", "weight", "b_sig_str_landed"]
    rows = g.dataset.select("bout_id", *columns)
    train, _ = features.split_random(rows)
    return _rounded(features.standardize(train, rows, columns), ["bout_id"])


_standardized.__name__ = "standardize"
query(_standardized)


@query
def training_dataset(g):
    return g.dataset


@query
def training_dataset_after(g):
    return features.training_dataset(
        g.priced, g.stats, g.full_competitors, as_of="after"
    ).select("bout_id", "r_wins", "b_wins", "r_td_evaded", "b_opponent_fight_time")


def _card_features(g):
    return features.upcoming_features(
        g.card, fx.last_day(g.bouts), g.full_competitors, g.newest_before_card
    )


@query
def upcoming_features(g):
    return _card_features(g)


# --- models ----------------------------------------------------------------------------------

_STORED: dict[tuple, str] = {}


def _stored_dataset(g):
    """The training rows, written once per session to the shared folder."""
    key = (g.spark.sparkContext.applicationId, g.folder)
    if key not in _STORED:
        path = scratch_path(g.spark, "dataset")
        tables.save_snapshot(g.dataset, path)
        _STORED[key] = path
    return g.spark.read.parquet(_STORED[key])


#: Models fitted in this session, by what they are fitted on.
_FITTED = {}


def _fitted(g, name):
    """Each model is fitted once per session and scale."""
    key = (g.spark.sparkContext.applicationId, g.folder, name)
    if key not in _FITTED:
        rows, _ = features.split_random(models.labelled(_stored_dataset(g)))
        two = tables.stage(rows.filter("winner <> 'DRAW'"), "train_rows")
        fits = {
            "gbt": lambda: models.train_gbt(two, **GBT_ROUNDS),
            "softmax": lambda: models.train_gbt_multiclass(tables.stage(rows, "train_rows")),
            "forest": lambda: models.train_random_forest(tables.stage(rows, "train_rows")),
            "mlp": lambda: models.train_mlp(two),
            "network": lambda: models.train_network(two),
        }
        _FITTED[key] = fits[name]()
    return _FITTED[key]


def _train(g):
    rows = models.labelled(features.no_draws(_stored_dataset(g)))
    train, _ = features.split_random(rows)
    return train


def _test(g):
    _, test = features.split_random(models.labelled(features.no_draws(_stored_dataset(g))))
    return test


def _scores(model, rows):
    return models.score(model, rows).select(
        "bout_id", "label", "prediction", "probabilities", "confidence"
    )


@query
def train_gbt(g):
    return _scores(_fitted(g, "gbt"), _test(g))


@query
def train_gbt_multiclass(g):
    _, test = features.split_random(models.labelled(_stored_dataset(g)))
    return _scores(_fitted(g, "softmax"), test)


@query
def train_random_forest(g):
    _, test = features.split_random(models.labelled(_stored_dataset(g)))
    return _scores(_fitted(g, "forest"), test)


@query
def train_mlp(g):
    return _scores(_fitted(g, "mlp"), _test(g))


@query
def train_network(g):
    return _scores(_fitted(g, "network"), _test(g))


@query
def scored_rows(g):
    """What holds for the scores of every model: all rows, shares that add up to one, the largest picked."""
    rows = tables.stage(features.split_random(models.labelled(_stored_dataset(g)))[1], "test_rows")
    checked = []
    for name in ("gbt", "softmax", "forest", "mlp", "network"):
        one = rows if name in ("softmax", "forest") else rows.filter("winner <> 'DRAW'")
        total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
        picked = F.get("probabilities", F.col("prediction").cast("int"))
        checked.append(
            models.score(_fitted(g, name), one).select(
                F.lit(name).alias("model"), "bout_id", F.col("label").cast("int").alias("label"),
                (F.abs(total - 1) < 1e-9).alias("adds_up"), (picked == F.col("confidence")).alias("largest"),
            )
        )
    return functools.reduce(lambda a, b: a.unionByName(b), checked)


@query
def saved_scores(g):
    """Rows that a saved and loaded model scores as the one in memory does: all of them."""
    path = scratch_path(g.spark, "model")
    models.save_model(_fitted(g, "softmax"), path)
    rows = tables.stage(features.split_random(models.labelled(_stored_dataset(g)))[1], "test_rows")
    first, again = (_scores(m, rows) for m in (_fitted(g, "softmax"), models.load_model(path)))
    return first.join(again.withColumnRenamed("probabilities", "again"), "bout_id").select(
        "bout_id", (F.col("probabilities") == F.col("again")).alias("same")
    )


@query
def grid_search_network(g):
    grid = {"hidden": ((10, 10), (100,)), "alpha": (0.001, 0.1)}
    return models.grid_search_network(_train(g), grid, folds=3, maxIter=10).table


@query
def grid_search(g):
    _, table = models.grid_search(_train(g))
    return table


@query
def cross_val_score(g):
    return models.cross_val_score(_train(g))


@query
def score(g):
    return _scores(_fitted(g, "forest"), _test(g))


@query
def save_model(g):
    path = scratch_path(g.spark, "model")
    models.save_model(_fitted(g, "gbt"), path)
    return _scores(models.load_model(path), _test(g))


@query
def predict_upcoming(g):
    return models.predict_upcoming(_fitted(g, "gbt"), _card_features(g))


@query
def labelled_rejects(g):
    return models.unlabelled(_stored_dataset(g)).select("bout_id", "winner")


@query
def unlabelled_rows(g):
    """Rows that no model learns from, as every ninth bout has no known weight."""
    rows = _stored_dataset(g).withColumn("weight", F.when(F.col("bout_id") % 9 != 0, F.col("weight")))
    return models.unlabelled(rows).select("bout_id", "winner")


@query
def predict_upcoming_rejects(g):
    return models.not_placed(_card_features(g)).select("card_id", "r_name", "b_name")


@query
def model_comparison(g):
    card = tables.save_snapshot(_card_features(g), scratch_path(g.spark, "card"))
    return evaluate.model_comparison(
        {name: models.predict_upcoming(_fitted(g, name), card) for name in ("gbt", "mlp", "network")}
    )


# --- evaluation ------------------------------------------------------------------------------


@query
def accuracy(g):
    return _rounded(evaluate.accuracy(g.predicted), ["split"])


@query
def confusion_matrix(g):
    return evaluate.confusion_matrix(g.predicted)


@query
def classification_report(g):
    return _rounded(evaluate.classification_report(g.predicted), ["class", "support"])


@query
def betting_units(g):
    return _rounded(evaluate.betting_units(g.predicted), ["correct", "incorrect"])


@query
def bet_per_bout(g):
    won = units(F.col("label"), F.col("prediction"), F.col("r_odds"), F.col("b_odds"))
    return g.predicted.select("bout_id", F.round(won, 6).alias("units"))


@query
def correct_incorrect(g):
    return evaluate.correct_incorrect(g.predicted)


# --- refreshes -------------------------------------------------------------------------------


def _refresh(g):
    done = g.linked.filter("r_totals_id IS NOT NULL")
    stored = tables.stage(with_totals_ids(totals.running_totals(done, g.stats)), "done_totals")
    return refresh.refresh_totals(g.linked, g.stats, g.competitors, stored, CUTOFF)


@query
def refresh_totals(g):
    return _refresh(g).new_totals.select("totals_id", *CORNER_KEYS, "age", *TOTAL_COLUMNS)


@query
def refresh_totals_links(g):
    return _refresh(g).bouts.select("bout_id", "r_totals_id", "b_totals_id")


def _late_refresh(g):
    late = F.col("bout_id") % 10 == 0
    on_time = tables.stage(
        totals.with_age(with_totals_ids(totals.running_totals(g.bouts.filter(~late), g.stats)), g.competitors),
        "early_totals",
    )
    ids = {f"{c}_totals_id": F.when(~late, F.col("bout_id") * 2 + i) for i, c in enumerate("rb")}
    return refresh.refresh_late_totals(g.bouts.withColumns(ids), g.stats, g.competitors, on_time)


@query
def refresh_late_totals(g):
    return _late_refresh(g).totals.select("totals_id", *CORNER_KEYS, "name", "age", *TOTAL_COLUMNS)


@query
def refresh_late_totals_links(g):
    return _late_refresh(g).bouts.select("bout_id", "r_totals_id", "b_totals_id")


@query
def refresh_odds(g):
    done = refresh.refresh_odds(
        g.quotes, g.bouts.drop("weight_class"), fx.aliases(g.competitors), CUTOFF
    )
    return done.bouts.select("bout_id", "quote_id", "r_odds", "b_odds", "weight")


@query
def refresh_odds_unmatched(g):
    done = refresh.refresh_odds(
        g.quotes, g.bouts.drop("weight_class"), fx.aliases(g.competitors), CUTOFF
    )
    return done.unmatched.select("quote_id", "left_name", "right_name", "quote_date")


def _page_refresh(g):
    late = g.bouts.filter(F.col("bout_date") > F.lit(CUTOFF).cast("date"))
    stored = g.bouts.filter(F.col("bout_date") <= F.lit(CUTOFF).cast("date"))
    known = g.competitors.filter(F.col("id") % 7 != 0)
    found = tables.stage(fx.bout_pages(late, g.stats), "late_pages", "page_id")
    # Event pages miss every tenth bout, so that no day is known for it.
    events = fx.event_pages(late.filter("bout_id % 10 <> 3"))
    done = g.stats.join(stored.select("bout_id"), "bout_id", "left_semi")
    # The directory is read from pages too.
    directory = page_records.competitors_from_page(g.competitor_pages, g.bout_pages).withColumnRenamed("page_id", "id")
    return refresh.refresh_bouts(found, events, fx.listing_pages(late), stored, done, known, directory)


@query
def refresh_bouts(g):
    return _page_refresh(g).bouts.select(
        "bout_id", "bout_date", "location", "weight", "r_name", "b_name", "winner", "r_id", "b_id", "total_fight_time",
        "r_stats_id", "b_stats_id",
    )


@query
def refresh_bouts_stats(g):
    return _page_refresh(g).stats


@query
def refresh_bouts_unplaced(g):
    return _page_refresh(g).unplaced


@query
def refresh_bouts_lookup(g):
    """The corner rows of new bouts, found by the ids that the bouts carry."""
    done = _page_refresh(g)
    keys = done.bouts.select("bout_id", F.explode(F.array("r_stats_id", "b_stats_id")).alias("stats_id"))
    found = snapshots.lookup_by_id(keys, done.stats.drop("bout_id"), "stats_id")
    return found.select("bout_id", "stats_id", "corner", "competitor_id", "kd_landed")


@query
def refresh_quotes(g):
    cutoff = F.lit(CUTOFF).cast("date")
    new = tables.stage(fx.quote_pages(g.quotes.filter(F.col("quote_date") > cutoff)), "new_quote_pages", "page_id")
    return refresh.refresh_quotes(new, g.quotes.filter(F.col("quote_date") <= cutoff)).quotes


@query
def refresh_bouts_competitors(g):
    return _page_refresh(g).competitors.select("id", "name", "weight", "reach", "stance", "gender")


@query
def full_refresh(g):
    day = F.lit(CUTOFF).cast("date")
    # Stored bouts keep their weight and odds; those of new bouts come from their quotes.
    stored = g.priced.filter(F.col("bout_date") <= day)
    late = g.bouts.filter((F.col("bout_date") > day) & (F.col("bout_date") < fx.last_day(g.bouts)))
    pages_in = tables.stage(fx.bout_pages(late, g.stats), "late_pages", "page_id")
    linked = fx.linked_bouts(stored).withColumns(
        {c: F.col(c).cast("string") for c in ("r_odds", "b_odds")}
    )
    done = refresh.full_refresh(
        scratch_path(g.spark, "refresh"),
        pages_in,
        fx.event_pages(late),
        fx.listing_pages(late),
        g.full_competitors,
        linked,
        g.stats.join(stored.select("bout_id"), "bout_id", "left_semi"),
        g.stored_totals,
        g.quotes,
        fx.aliases(g.competitors),
        g.raw_competitors,
        g.card,
        fx.last_day(g.bouts),
        CUTOFF,
    )
    return evaluate.model_comparison(done.predictions)
