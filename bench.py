"""Time the headline queries: one JSON line, seconds by query.

$BENCH_SF_DIR has the tables, $BENCH_CPUS the number of local cores. Every query
is run in full, its result written to nowhere; the session's start is left out.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from cuewright.plans import adapters
from cuewright.plans.queries import QUERIES

HEADLINE = ("plain_cues", "scene_labels", "scene_rollup", "event_scenes", "conversation_scenes", "srt_cues", "parse_warnings", "clean_pages", "annotation_report", "timeline_overlaps", "element_frames", "scene_frames", "merged_offsets", "allowed_areas", "replaced_subjects", "contour_areas", "stroke_order")

ADAPTERS = ("caption_sources", "elements")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, built = {}, {}
    for name in ADAPTERS:  # what the captions' queries begin with, not counted in the value
        began = time.time()
        getattr(adapters, name)(spark, folder).write.format("noop").mode("overwrite").save()
        built[name] = round(time.time() - began, 2)
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 2)
    spark.stop()
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "adapters": built, "sf": folder.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
