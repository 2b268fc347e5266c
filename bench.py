"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line: medians of three runs after a first one.

Once BUDGET seconds are over, queries are run once after the first run, and after twice that only once at all, so that a slow
machine still gives a line; what each query had is on the error output.

The BM25 index is written once, which is timed apart (bm25_build, one run), since queries share it.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

QUERIES = (
    "bm25_topk bm25_batch bm25_filtered vector_topk hybrid_rrf hybrid_grouped library_summary citation_edges dedup_semantic chunk_windows "
    "chunk_tokens enrich_merge refresh_metadata index_targets"
).split()
RUNS, BUDGET = 3, 120.0


def main() -> None:
    from lectern.plans.catalog import QUERIES as every
    from lectern.plans.catalog import bm25_index
    from lectern.session import session

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    began = t = time.perf_counter()
    bm25_index(spark, sf)
    took = {"bm25_build": round(time.perf_counter() - t, 3)}
    for name in QUERIES:
        times = []
        late = (time.perf_counter() - began) / BUDGET
        for _ in range(RUNS + 1 if late < 1 else 2 if late < 2 else 1):
            t = time.perf_counter()
            every[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        took[name] = round(statistics.median(times[1:] or times), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "sum of medians of 3 and one index build", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
