"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is planned and fully executed into Spark's ``noop`` sink (every
row computed, nothing collected to the driver).  Prints one JSON line:
{"metric": "headline_total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

    BENCH_QUERIES=all python bench.py      # every registered query
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "latest_delivery_status",   # A1: arg-max per key
    "order_tracking",           # C6: the flagship multi-join view
    "user_order_tracking",      # C7: view + skew-safe per-user ranking
    "status_transitions",       # W4: six-step state machine
    "available_couriers",       # C13
    "validate_order_payload",   # V7
    "stream_condense",          # W1: streaming foreachBatch condense
    "stream_latest_position",   # W2: streaming max_by state
    "nearest_node",             # C9: grid-cell join
    "shortest_paths",           # A6: frontier relaxation
    "nearest_courier",          # A5: bounded search + arg-min
    "auto_dispatch",            # M6: deferred acceptance
]


def main() -> None:
    from courierflow.plans.catalog import load_all
    from courierflow.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    entries = load_all()
    sel = os.environ.get("BENCH_QUERIES", "")
    if sel == "all":
        names = sorted(entries)
    elif sel:
        names = [n for n in sel.split(",") if n in entries]
    else:
        names = [n for n in HEADLINE if n in entries]

    spark = build_session(f"local[{cpus}]", int(cpus) * 2, app_name="courierflow-bench")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(int(cpus) * 8))
    # warm-up: JVM, parquet footers, Python workers
    entries["kitchen_list"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(0, 64, 1, int(cpus)).mapInPandas(lambda it: it, "id bigint").write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        df = entries[name].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"[bench] {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
