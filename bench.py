"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fathomline.plans import catalogue  # noqa: E402
from fathomline.runtime import session  # noqa: E402

HEADLINES = (
    "class_status_counts", "training_eligible", "event_aggregate", "band_duplicates", "dedup_disposition", "point_in_polygon",
    "single_linkage", "terrain_slope_aspect", "terrain_roughness_tpi", "terrain_bpi", "station_covariates", "baseline_cv", "cv_scores",
    "variogram_fit", "surface_agreement", "minable_cells",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINES:
        taken = []
        for _ in range(RUNS):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(taken), 3)
    out = {"metric": "sum of median query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
