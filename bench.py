"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from plumbline.plans import QUERIES
from plumbline.session import build_session

HEADLINE = (
    "bh_adjust bh_check correction_scope unit_multiplicity mean_difference effect_relevance design_integrity ols_sign "
    "selection_funnel column_profile identifier_equality snapshot_diff total_key_join conflicting_peers unique_paths "
    "leakage_texts segment_clock latest_per_id merge_by_id cluster_bootstrap metric_pairs span_containment matrix_profile "
    "pseudobulk document_spans quantity_reconcile panel_agreement required_matrix tolerance_compare multiset_difference"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = HEADLINE if len(sys.argv) == 1 else list(QUERIES) if sys.argv[1] == "all" else sys.argv[1:]
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )


if __name__ == "__main__":
    main()
