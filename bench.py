"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import catalogue
from rasterloom.operators.linking import link
from rasterloom.session import get_session

HEADLINE = [
    "velocity_neff", "ps_select", "shp_glrt_count", "mosaic_last_finite", "coverage_anti", "triplets",
    "coherence_pairs", "closure_phase", "residues", "link_emi", "link_evd", "coherence_full", "unwrap_network", "l2_network",
    "loop_qc", "tide_grid", "haversine_pairs",
]
REPEATS = 3
EPOCHS, SIDE = 9, 384  # the linking case: 9 x 384 x 384 complex samples, made by expressions


def samples(spark: SparkSession) -> DataFrame:
    """A ramp in time with speckle, one row a pixel."""
    n = F.col("id")
    noise = lambda k: (F.pmod(F.xxhash64(n, F.lit(k)), F.lit(20001)) / 10000.0 - 1.0)
    parts = [x for t in range(EPOCHS) for x in (noise(1000) * F.cos(F.lit(0.3 * t)) - noise(1001) * F.sin(F.lit(0.3 * t)) + 0.3 * noise(2 * t), noise(1000) * F.sin(F.lit(0.3 * t)) + noise(1001) * F.cos(F.lit(0.3 * t)) + 0.3 * noise(2 * t + 1))]
    return spark.range(0, SIDE * SIDE, 1, 8).select((n / SIDE).cast("long").alias("row"), F.pmod(n, F.lit(SIDE)).alias("col"), F.array(*parts).alias("z"))


def seconds(run) -> float:
    """Median of repeated runs."""
    took = []
    for _ in range(REPEATS):
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - start)
    return round(statistics.median(took), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", os.environ.get("BENCH_CPUS", "8"))
    for name in ("velocity_neff", "link_emi"):  # starts the code generator and the Python workers
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    found = {name: seconds(lambda name=name: catalogue.QUERIES[name](spark, sf_dir)) for name in HEADLINE}
    total = round(sum(found.values()), 3)
    large = seconds(lambda: link(samples(spark), EPOCHS, (5, 5), shape=(SIDE, SIDE)))
    print(json.dumps({
        "metric": "headline_total", "value": total, "unit": "sec", "queries": found | {"link_9x384x384": large}, "sf": os.path.basename(sf_dir.rstrip("/")),
        "linked_kpix_epochs_per_sec": round(EPOCHS * SIDE * SIDE / large / 1000, 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
