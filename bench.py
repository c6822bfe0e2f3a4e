"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR chooses the tables, BENCH_CPUS the number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tallyproof.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "quarter_total",
    "clean_ledger_totals",
    "stage_totals",
    "rank_entities",
    "verify_routes",
    "evidence_full",
    "asof_convert",
    "asof_convert_quotes",
    "refund_totals",
    "sensitivity_lines",
    "currency_profile",
    "column_profile",
    "quality_score",
    "summary_reconciliation",
    "cube_cells",
    "cube_rollups",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyproof-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # stages with very long generated methods run operator by operator; mixed effect, see the README
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["latest_year"](spark, sf_dir).collect()  # start the JVM's warm-up outside the clock
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
