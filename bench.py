"""Benchmark: run the headline queries at $BENCH_SF_DIR (default sf0.1) on
local[$BENCH_CPUS] and print ONE JSON line.

Each query is executed fully with the no-op sink (no collect to the driver),
warm (after one untimed warm-up run of the flagship query so JVM start-up
and code generation are not billed to the first query).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slatekit.queries import REGISTRY  # noqa: E402
from slatekit.session import local_session  # noqa: E402

HEADLINE = [
    "rank_metrics", "initial_rank_metrics", "exposure_js", "auc", "log_loss", "rerank",
    "hist_asof", "filter_users", "user_ladder", "vocab", "neg_sample", "dataset",
    "relaxed_topk", "combined_loss", "attn_pool", "batch_score", "stream_score",
]


def machine() -> float:
    """Milliseconds of a fixed loop, the least of some: how slow the CPUs are now."""
    def spin() -> float:
        t = time.thread_time()
        sum(range(1_000_000))
        return time.thread_time() - t
    return round(min(spin() for _ in range(9)) * 1000, 2)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), "bench")
    REGISTRY["rank_metrics"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": total, "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus), "machine_ms": machine()}))
    spark.stop()


if __name__ == "__main__":
    main()
