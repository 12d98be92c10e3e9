"""Times headline queries and prints one JSON line.

Every query starts without shared stages, so its time covers the whole chain from the tables. Results
are written to the no-op sink: all rows and columns are computed, nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from flowloom.plans import catalog
from flowloom.session import build_session

HEADLINE = (
    "drop_out_of_order", "packet_projection", "flow_sessions_idle", "flow_records", "snapshot_ticks",
    "dirty_flow_snapshots", "src_window_volume", "src_window_diversity", "target_window", "burstiness",
    "total_window_packets", "temporal_snapshot", "behaviour_features", "evidence_gate", "dedupe_alerts",
    "rate_samples", "flow_model_features", "drop_conflicting", "dedupe_exact", "preparation_report",
    "group_split", "class_thresholds", "classification_report", "capture_frames", "model_roundtrip", "stream_flows",
)


def main(names: list[str]) -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load_all()
    times = {}
    for name in names or HEADLINE:
        catalog.reset()
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main(sys.argv[1:])
