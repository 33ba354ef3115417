"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the cores. Each query runs once to warm up, then three times; the
median counts. A run covers building the plan, any tables it stages, and computing every row of the result.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from contract.queries import QUERIES  # noqa: E402

HEADLINE = (
    "gedcom_parse", "gedcom_events", "events_by_century", "place_people", "gedcom_rewrite", "normalize_text", "replacement_apply",
    "exact_match", "wildcard_match", "word_match", "soundex_match", "place_disposition", "run_stats", "review_queue",
    "spell_vocab", "spell_suggest", "ancestor_closure", "enclosed_by", "hierarchy_csv", "capwords", "xml_places",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", str(max(int(cpus), 1)))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    places = spark.read.parquet(f"{folder}/orders.parquet").count()
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, sum of medians of warm runs", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"), "places_per_second": round(places / seconds["place_disposition"], 1),
    }))


if __name__ == "__main__":
    main()
