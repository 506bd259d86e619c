"""Benchmark: headline queries on one scale factor, one JSON line on stdout.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3; the median is reported).
Each query is executed in full with the ``noop`` sink (no collect to the driver).
``value`` is the total of HEADLINE; the heavier plans of HEAVY stand beside it, one run each.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "G13_agent_counts_unclaimed_dataset",
    "G12_agent_counts_taxon",
    "B1_occurrence_refresh",
    "J1_missing_claims",
    "J9_recorded_with",
    "J15_employment_specimens_recorded",
    "J20_date_warnings",
    "G4_country_counts",
    "G7_year_bins_recorded_5",
    "G14_dataset_progress",
    "A3_package_attributions",
    "A8_package_problem_collector_dates",
    "X4_classify_roles",
    "M1_insert_ignore_source_claims",
]

HEAVY = [
    "J13_agents_recorded_with",
    "J31_same_organization_people",
    "T3_candidate_agents",
    "M2_bulk_claim",
    "G22_user_stats",
    "G26_agent_profile",
    "A7_package_not_them",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    from herbaria.session import get_session
    from herbaria.plans.catalog import QUERIES
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2), app_name="herbaria-bench")
    # warm-up: JVM start and first parquet footer reads are not query time
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()

    def median(name: str, runs: int) -> float:
        found = []
        for _ in range(runs):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            found.append(time.perf_counter() - t0)
        return round(statistics.median(found), 3)

    times = {name: median(name, repeat) for name in HEADLINE}
    heavy = {name: median(name, 1) for name in HEAVY}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "heavy": heavy, "repeat": repeat, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
