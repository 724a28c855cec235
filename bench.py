"""Headline timings: one JSON line with seconds per query over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

# One or two queries of each family; results are computed in full and discarded.
HEADLINE = [
    "b01_canonicalize_urls", "b03_canonical_key", "b05_dedup_by_key", "b17_rollup_parent_urls", "b20_top_hosts", "c02_parse_feeds",
    "c05_infer_feed_order", "e01_page_links", "e06_text_dates", "e09_strip_common_affixes", "h03_blog_posts",
    "i02_subscription_overview", "i05_schedule_preview", "j02_next_runs", "k01_next_posts", "k06_user_items", "k11_publish_plan",
    "l05_dispatch_batch", "l09_telemetry_dashboard", "l11_progress_regressions", "l12_triage_bounces", "m04_row_verdicts",
    "n01_mine_links", "n03_feed_stats", "g19_choose_candidate",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from feedlake.plans import catalog

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("feedlake-bench")
        .config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up of the engine is not part of any query.
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_query_seconds_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
