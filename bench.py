"""Benchmark: run the registered queries at ``$BENCH_SF_DIR`` on
``local[$BENCH_CPUS]`` and print one JSON line.

Each query is fully executed with a ``noop`` write (every row computed, none
collected to the driver).  The JVM start and a warm-up query are not timed.
A query under ``REPEAT_BELOW`` seconds, where noise weighs most, runs three
times and its median counts; longer ones run once.
Set ``BENCH_QUERIES`` (comma list) to run a subset.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


REPEAT_BELOW = 5.0


def seconds(spark, query, sf_dir: str) -> float:
    def once() -> float:
        t0 = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    first = once()
    return first if first >= REPEAT_BELOW else statistics.median([first, once(), once()])


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from wordloom.plans.catalog import QUERIES
    from wordloom.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or sorted(QUERIES)

    # warm-up: JIT, Python workers, file listing
    QUERIES["c9_group_word_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        try:
            times[name] = round(seconds(spark, QUERIES[name], sf_dir), 3)
        except Exception as e:  # keep going; report it
            errors[name] = str(e)[:300]
    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir,
           "cpus": cpus}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
