"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quantspan.queries import QUERIES  # noqa: E402
from quantspan.session import build_session  # noqa: E402

HEADLINE = (
    "bars_hourly",
    "returns_panel",
    "sleeve_validation",
    "pbo_cscv",
    "bma_posterior",
    "cost_calibration",
    "order_costs",
    "equity_gates",
    "risk_verdicts",
    "rule_matches",
    "asof_gates",
    "chain_links",
    "chain_verify",
    "decision_replay",
    "bm25_scores",
    "retrieval_ranked",
    "note_fields",
    "baseline_signals",
    "stream_gates",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="spark-"),
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.sql.files.maxPartitionBytes": "32m",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
