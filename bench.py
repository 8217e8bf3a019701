"""Time the headline queries at one scale and print one JSON line.

Every query starts cold: cached views are dropped before it, so each time
includes the scan of the trades and everything derived from them.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from panelweave.plans import catalog, views  # noqa: E402

HEADLINE = [
    "market_breadth", "adjusted_bars_view", "bars_weekly", "calendar_gaps", "limit_breaches", "momentum_factors", "volatility_factors",
    "value_factors", "factor_processed", "factor_summary", "performance", "crowding_weekly", "flow_waves", "volatility_index",
    "stage_classification", "candle_patterns", "upsert_newest", "version_append", "asof_purchase_signup", "account_positions",
    "event_study", "session_replay",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true").config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    entries = catalog.entries()
    picked = [n for n in (os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE)]
    spark.read.parquet(f"{directory}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # start the JVM's reader once
    times = {}
    for name in picked:
        views.forget(spark)
        began = time.time()
        entries[name].build(spark, directory).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": Path(directory).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
