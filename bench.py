"""Time the linkage from raw text to quality measures.

Steps run in the order of a real job and later ones read what earlier ones stored.  Prints one JSON
line.  BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores.
"""

from __future__ import annotations

import json
import os
import time

from linkwright.plans import catalog, store
from linkwright.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
STEPS = [
    "B8_prepare_records",
    "E1_count_comparisons",
    "E3_cumulative_comparisons",
    "C4_multi_pass_blocking",
    "D7_estimate_u_sampled",
    "D8_em_session",
    "D10_score_pairs",
    "D12_cluster_at_threshold",
    "D18_pattern_examples",
    "E6_profile_columns",
    "F1_symmetric_edges",
    "G2_relative_corroboration",
    "H9_recall_at_threshold",
    "H13_evaluate",
]


def main() -> None:
    spark = local_session("bench", CPUS)
    # One throw-away query so that JVM start-up is not charged to the first step.
    spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count().collect()
    store.forget()
    seconds, rows = {}, {}
    for name in STEPS:
        started = time.perf_counter()
        rows[name] = len(catalog.QUERIES[name](spark, SF_DIR).collect())
        seconds[name] = round(time.perf_counter() - started, 3)
    result = {
        "metric": "linkage_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rows": rows,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "spark": spark.version,
        "cpus": CPUS,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
