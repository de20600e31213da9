"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "MOD-2", "MOM-1", "MOM-2", "ARR-2", "ARR-10", "ARR-22", "AGG-3", "AGG-6", "AGG-10", "AGG-18", "AGG-24", "WIN-2", "WIN-4", "WIN-6",
    "TOP-5", "JN-5", "JN-11", "MOD-6", "MOD-7", "CV-9", "CV-11", "COR-4", "COR-8", "DRF-1", "DRF-2", "DRF-5", "CMP-2", "CMP-8",
)


def main() -> None:
    from bandwright.plans.catalog import queries
    from bandwright.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR",
        },
    )
    run = queries()
    names = sys.argv[1:] or HEADLINE
    run["FLT-1"](spark, sf).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        run[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
