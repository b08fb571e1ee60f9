#!/usr/bin/env python
"""Headline-query benchmark.

Runs the main steps of the analysis on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.
Each query is forced end to end with the ``noop`` sink (every column computed,
nothing collected); times are wall-clock seconds in one warmed-up session.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultline.plans.registry import QUERIES  # noqa: E402
from faultline.session import get_spark  # noqa: E402

HEADLINE = [
    "clean_catalog",
    "cleaning_audit",
    "describe_numeric",
    "region_breakdown",
    "top_places",
    "region_significance",
    "magnitude_histogram_by_class",
    "split_assignment",
    "feature_table",
    "dbscan_labels",
    "zone_profile",
    "nearest_label",
    "dbscan_precise",
    "within_distance_hot",
    "nearest_label_hot",
    "silhouette_squared",
    "classification_report",
    "model_predictions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", app="faultline-bench", shuffle_partitions=int(cpus),
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="faultline-bench-")})
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # JVM and file-system warm-up
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
