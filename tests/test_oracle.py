"""Queries against DuckDB over the same tables. BOUTLAB_ORACLE=all compares every query."""

import os
from pathlib import Path

import pytest

from checks.oracle import build
from checks.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
FOLDER = Path(os.environ.get("BOUTLAB_DATA", "/root/testdata/sf0.001"))
ORACLE = build()
SOME = [
    "scan_pending_bouts", "append_with_keys", "append_competitors", "link_quotes_and_bouts",
    "link_bouts_onto_quotes", "update_weight_by_pair", "chunk_cells", "slice_items", "follow_links",
    "bout_record_from_page", "corner_records_from_page", "pad_rounds", "fold_accents_and_hyphens",
    "clean_competitors", "previous_bout", "predictable_only", "dedupe_anti", "split_hot_totals",
    "cumulative_totals", "column_mean_std", "training_dataset", "upcoming_features",
    "classification_report", "betting_units", "refresh_totals", "refresh_totals_links",
    "refresh_odds", "refresh_bouts", "refresh_bouts_stats", "late_bouts_totals", "bout_context", "nested_cells",
    "quotes_from_page", "competitors_from_page", "card_page_features",
]
NAMES = list(ORACLE) if os.environ.get("BOUTLAB_ORACLE") == "all" else SOME


@pytest.fixture(scope="module")
def duck():
    if not FOLDER.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    answer = duck.sql(ORACLE[name])
    assert sorted(frame.columns) == sorted(answer.columns)
    assert _sorted(frame.columns, frame.collect()) == _sorted(answer.columns, answer.fetchall())


def test_every_relational_query_has_sql():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {
        "top_importances", "train_gbt", "train_gbt_multiclass", "train_random_forest", "train_mlp",
        "grid_search", "cross_val_score", "score", "save_model", "predict_upcoming",
        "model_comparison", "full_refresh", "train_network", "grid_search_network",
    }
