"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores; every
result is computed in full (noop sink).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import queries  # noqa: E402
from retailoom.session import local_session  # noqa: E402


HEADLINE = (
    "revenue_per_month", "revenue_per_day", "top_customers", "kpis", "daily_orders", "overdue_customers",
    "rfm", "churn_alerts", "rfm_with_items", "customer_profile", "merged_customers", "item_season_perf",
    "item_catalog", "top_customers_per_item", "top_items_per_customer", "stock_status", "stockouts",
    "revenue_by_dept", "revenue_by_country", "geo_dept_customers", "entity_resolution", "prospects",
    "prospects_by_dept", "prospect_page", "classify_documents",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "retailoom-bench")
    registered = queries()
    registered["freshness"](spark, folder).collect()  # starts the engine
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)

    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
