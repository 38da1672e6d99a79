"""Refreshes: fold new bouts, quotes and pages into the stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlab.operators.features import no_draws, training_dataset, upcoming_features
from boutlab.operators.late import late_totals
from boutlab.operators.page_records import bout_context, pages_without_quote, quotes_from_page
from boutlab.operators.pages import bout_from_page, corner_stats_from_page, unreadable_bouts
from boutlab.operators.quotes import (
    link_quotes_and_bouts,
    match_quotes,
    orient_quotes,
    unmatched_quotes,
)
from boutlab.operators.resolve import resolve_aliases, resolve_names
from boutlab.operators.skew import ROWS_PER_SLOT, lookup
from boutlab.operators.snapshots import (
    append_with_child_keys,
    append_with_keys,
    natural_order,
    overlay_update,
    pending_bouts,
    pending_quotes,
)
from boutlab.operators.standardize import clean_competitors
from boutlab.operators.totals import (
    ORDER,
    latest_totals,
    pair_up,
    totals_since_stored,
    with_age,
    zero_fill,
)
from boutlab.plans.models import (
    labelled,
    not_placed,
    predict_upcoming,
    train_gbt,
    train_mlp,
    unlabelled,
)
from boutlab.schema import CORNERS
from boutlab.sources.tables import export_dataset, read_feature_csv, save_snapshot, stage


@dataclass(frozen=True)
class TotalsRefresh:
    new_totals: DataFrame
    bouts: DataFrame


def refresh_totals(
    bouts: DataFrame,
    stats: DataFrame,
    competitors: DataFrame,
    totals: DataFrame,
    cutoff,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> TotalsRefresh:
    """Totals of the pending bouts, each on top of the latest stored ones before it, and the bouts
    pointing to them. Of the stored totals only those of the pending bouts' competitors are read wide."""
    pending = stage(pending_bouts(bouts, cutoff), "pending_bouts")
    fought = stats.join(pending.select("bout_id"), "bout_id", "left_semi")
    since = totals_since_stored(pending, fought, totals, rows_per_slot=rows_per_slot)
    grown = with_age(since, competitors).withColumn("place", F.when(F.col("corner") == "r", 0).otherwise(1))
    # Numbering reads its input for the count, the slots and the rows.
    numbered = append_with_keys(
        totals,
        stage(grown, "grown_totals"),
        "totals_id",
        ["bout_ts", "bout_id", "place"],
        rows_per_slot,
    ).drop("place")
    links = pair_up(numbered, ["totals_id"])
    return TotalsRefresh(numbered, overlay_update(bouts, links, "bout_id"))


@dataclass(frozen=True)
class LateRefresh:
    """``totals`` is the whole table: stored rows, corrected where a late bout changes them, and new ones."""

    totals: DataFrame
    bouts: DataFrame


def refresh_late_totals(
    bouts: DataFrame,
    stats: DataFrame,
    competitors: DataFrame,
    totals: DataFrame,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> LateRefresh:
    """Totals of all bouts that have none yet, whatever their date, and what they change in stored ones."""
    late = stage(bouts.filter("r_totals_id IS NULL AND b_totals_id IS NULL"), "late_bouts")
    fought = stats.join(late.select("bout_id"), "bout_id", "left_semi")
    found = late_totals(late, fought, totals, rows_per_slot=rows_per_slot)
    grown = with_age(found.added, competitors).withColumn("place", F.when(F.col("corner") == "r", 0).otherwise(1))
    numbered = stage(
        append_with_keys(
            totals, stage(grown, "grown_totals"), "totals_id", ["bout_ts", "bout_id", "place"], rows_per_slot
        ).drop("place"),
        "late_totals",
    )
    whole = overlay_update(totals, found.corrected, "totals_id").unionByName(numbered, allowMissingColumns=True)
    return LateRefresh(whole, overlay_update(bouts, pair_up(numbered, ["totals_id"]), "bout_id"))


@dataclass(frozen=True)
class OddsRefresh:
    bouts: DataFrame
    quotes: DataFrame
    unmatched: DataFrame


def refresh_odds(
    quotes: DataFrame, bouts: DataFrame, aliases: DataFrame, cutoff
) -> OddsRefresh:
    """Match the pending quotes to bouts and write the link on both tables."""
    pending = pending_quotes(quotes, cutoff)
    resolved = resolve_aliases(pending, ["left_name", "right_name"], aliases, "quote_id")
    oriented = orient_quotes(match_quotes(resolved, bouts), bouts)
    new_bouts, new_quotes = link_quotes_and_bouts(quotes, bouts, oriented)
    return OddsRefresh(new_bouts, new_quotes, unmatched_quotes(resolved, bouts))


@dataclass(frozen=True)
class QuotesRefresh:
    quotes: DataFrame
    # Pages that hold no quote.
    skipped: DataFrame


def refresh_quotes(pages: DataFrame, quotes: DataFrame) -> QuotesRefresh:
    """New quotes out of stored pages, with ids behind the greatest stored one, by day and page."""
    read = stage(quotes_from_page(pages), "read_quotes")
    return QuotesRefresh(
        append_with_keys(quotes, read, "quote_id", ["quote_date", "page_id"]), pages_without_quote(pages)
    )


@dataclass(frozen=True)
class BoutsRefresh:
    competitors: DataFrame
    bouts: DataFrame
    stats: DataFrame
    # Pages without two names, and pages that no event page leads to.
    unreadable: DataFrame
    unplaced: DataFrame


def new_competitors(
    bouts: DataFrame, competitors: DataFrame, directory: DataFrame
) -> DataFrame:
    """Directory entries of names that have a bout but no competitor yet, with new ids."""
    names = (
        bouts.select(F.explode(F.array("r_name", "b_name")).alias("name"))
        .distinct()
        .join(competitors.select("name").distinct(), "name", "left_anti")
    )
    # Written, as a lookup reads its facts twice and a directory may be read from pages.
    entries = stage(clean_competitors(directory), "directory")
    found = lookup(entries, names, ["name"], ["id"], "left_semi")
    # One entry per name, whichever the directory lists twice.
    single = found.groupBy("name").agg(
        *[
            F.expr(f"min_by({c}, id) AS {c}")
            for c in ("weight", "height", "reach", "stance", "date_of_birth", "gender")
        ]
    )
    ordered = stage(single.withColumn("_order", natural_order("name")), "unnumbered_competitors")
    return append_with_keys(competitors, ordered, "id", ["_order", "name"]).drop("_order")


def refresh_bouts(
    pages: DataFrame,
    events: DataFrame,
    listings: DataFrame,
    bouts: DataFrame,
    stats: DataFrame,
    competitors: DataFrame,
    directory: DataFrame,
) -> BoutsRefresh:
    """New bout, corner and competitor rows out of stored pages.

    Day, place, weight class and weight of a bout come down the links from the pages of listings and events.
    A bout and its two corner rows are numbered at once.
    """
    read = stage(bout_from_page(pages), "read_bouts")
    context = stage(bout_context(listings, events, pages), "bout_context")
    placed = read.join(context, "page_id")
    added = stage(new_competitors(placed, competitors, directory), "new_competitors")
    everyone = competitors.select("id", "name").unionByName(added.select("id", "name"))
    resolved = stage(resolve_names(placed, everyone, "page_id"), "resolved_bouts")
    ids = [f"{side}_stats_id" for side in CORNERS]
    numbered = stage(
        append_with_child_keys(bouts, stats, resolved, "bout_id", "stats_id", ["bout_date", "page_id"], ids),
        "new_bouts",
    )
    corners = (
        corner_stats_from_page(pages)
        .join(numbered.select("page_id", "bout_id", "r_id", "b_id", *ids), "page_id")
        .withColumn("competitor_id", F.expr("if(corner = 'r', r_id, b_id)"))
        .withColumn("stats_id", F.expr("if(corner = 'r', r_stats_id, b_stats_id)"))
        .drop("page_id", "r_id", "b_id", *ids)
    )
    unplaced = read.join(context.select("page_id"), "page_id", "left_anti").select("page_id")
    return BoutsRefresh(added, numbered.drop("page_id"), corners, unreadable_bouts(pages), unplaced)


@dataclass(frozen=True)
class FullRefresh:
    competitors: DataFrame
    bouts: DataFrame
    stats: DataFrame
    totals: DataFrame
    quotes: DataFrame
    dataset: DataFrame
    predictions: dict[str, DataFrame]
    # Rows of the dataset no model learns from, and bouts of the card none can place.
    not_learnt: DataFrame
    not_placed: DataFrame


def full_refresh(
    folder: str,
    pages: DataFrame,
    events: DataFrame,
    listings: DataFrame,
    competitors: DataFrame,
    bouts: DataFrame,
    stats: DataFrame,
    totals: DataFrame,
    quotes: DataFrame,
    aliases: DataFrame,
    directory: DataFrame,
    card: DataFrame,
    card_day,
    cutoff,
    gbt: dict | None = None,
    mlp: dict | None = None,
) -> FullRefresh:
    """Pages, totals, odds, dataset, models, predictions, in this order.

    Each step is written under ``folder``, a place every executor can reach; the next one starts from
    the stored table, so a lost executor costs at most one step.
    """
    def keep(frame, name):
        return save_snapshot(frame, f"{folder}/{name}")

    read = refresh_bouts(pages, events, listings, bouts, stats, competitors, directory)
    all_competitors = keep(competitors.unionByName(read.competitors), "competitors")
    fresh = read.bouts.withColumn(ORDER[0], F.col("bout_date").cast(bouts.schema[ORDER[0]].dataType))
    all_bouts = keep(bouts.unionByName(fresh, allowMissingColumns=True), "bouts")
    all_stats = keep(zero_fill(stats.unionByName(read.stats, allowMissingColumns=True)), "stats")

    grown = refresh_totals(all_bouts, all_stats, all_competitors, totals, cutoff)
    all_totals = keep(totals.unionByName(grown.new_totals, allowMissingColumns=True), "totals")
    linked = keep(
        overlay_update(
            all_bouts,
            pair_up(all_totals.select("bout_id", "corner", "totals_id"), ["totals_id"]),
            "bout_id",
        ),
        "linked_bouts",
    )
    odds = refresh_odds(quotes, linked, aliases, cutoff)
    priced = keep(odds.bouts, "priced_bouts")
    all_quotes = keep(odds.quotes, "quotes")

    dataset = training_dataset(priced, all_stats, all_competitors)
    export_dataset(dataset, f"{folder}/dataset_csv", "overwrite")
    stored = read_feature_csv(pages.sparkSession, f"{folder}/dataset_csv")

    usable = no_draws(stored)
    train = labelled(usable)
    features = upcoming_features(
        card, F.lit(card_day).cast("date"), all_competitors, latest_totals(all_totals)
    )
    models = {"gbt": train_gbt(train, **(gbt or {})), "mlp": train_mlp(train, **(mlp or {}))}
    predictions = {name: predict_upcoming(m, features) for name, m in models.items()}
    return FullRefresh(
        all_competitors,
        priced,
        all_stats,
        all_totals,
        all_quotes,
        stored,
        predictions,
        unlabelled(usable),
        not_placed(features),
    )
