"""Times the headline queries (median of ``BENCH_RUNS`` runs) and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from query_catalog import QUERIES  # noqa: E402
from tillwise.session import build_session, scratch_run  # noqa: E402

HEADLINE = (
    "headline_numbers",
    "top_products",
    "revenue_by_location",
    "revenue_over_time_month",
    "funnel_of_orders",
    "funnel_of_orders_by_channel",
    "basket_pairs",
    "basket_pairs_of_stock_codes",
    "recency_on_lines",
    "latest_customer_label",
    "customer_features",
    "customer_features_asof",
    "recommend_actions",
    "name_segments",
    "forward_churn_labels",
    "segment_customers",
    "churn_risks",
    "dashboard_decisions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    scratch = tempfile.TemporaryDirectory(prefix="bench-")
    spark = build_session(
        app_name="bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": scratch.name,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up work of the JVM is not part of any query.
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_custkey").count().count()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            with scratch_run(spark):
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 3)
    spark.stop()
    scratch.cleanup()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
