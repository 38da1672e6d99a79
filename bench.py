"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the cores.
Every query runs once to warm up and is then timed, building its plan included.
"""

from __future__ import annotations

import json
import os
import time

from boutlab.session import build_session
from checks import queries
from checks.queries import QUERIES

HEADLINES = [
    "scan_pending_bouts",
    "running_record",
    "running_opponent_record",
    "cumulative_totals",
    "pre_bout_totals",
    "incremental_totals",
    "split_hot_totals",
    "previous_bout",
    "match_quotes",
    "link_quotes_and_bouts",
    "same_name_semi",
    "dedupe_anti",
    "extract_links",
    "corner_records_from_page",
    "fold_accents_and_hyphens",
    "training_dataset",
    "column_mean_std",
    "upcoming_features",
    "classification_report",
    "betting_units",
    "train_gbt",
    "late_bouts_corrections",
    "bout_context",
    "refresh_totals",
    "refresh_odds",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.log.level": "ERROR",
        },
    )
    seconds = {}
    for name in HEADLINES:
        times = []
        for _ in range(2):
            # Models are kept for later queries of a session; here each run fits its own.
            queries._FITTED.clear()
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(times[1], 3)
    # The same job on every machine and in every round, to compare rounds by.
    start = time.perf_counter()
    spark.range(200_000_000).selectExpr("sum(hash(id) % 7)").collect()
    machine = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "machine": machine,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
