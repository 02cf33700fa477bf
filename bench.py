"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
sys.path.insert(0, ROOT)

HEADLINE = ("line_scan", "grep_literal", "grep_ci", "grep_cap", "search_topk", "delegate_topk", "chunk_windows", "vec_knn_batch", "kmeans_step", "probe_search", "recall_curve")


def main() -> None:
    from millrace import queries
    from millrace.checkpoint import session
    from millrace.operators.vectors import percentiles

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm, out = {}, {}, {}
    for name in HEADLINE:
        for times in (cold, warm):  # the first run of each is the warm-up, reported on its own
            began = time.time()
            queries.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
    lines = queries.line_scan(spark, sf).count()
    out["grep_lines_per_s"] = round(lines / warm["grep_literal"])
    vectors = queries.table(spark, sf, "embeddings").count()
    out["knn_queries_per_s"] = round(vectors / warm["vec_knn_batch"], 1)
    out["probe_queries_per_s"] = round(vectors / warm["probe_search"], 1)
    times = []
    for _ in range(5):  # one query at a time, as a caller has it
        began = time.time()
        queries.QUERIES["grep_cap"](spark, sf).collect()
        times.append(1000 * (time.time() - began))
    out["grep_cap_ms"] = {k: round(v) for k, v in percentiles(times).items()}
    out["recall_at_10"] = {r.probe: r.recall for r in queries.recall_curve(spark, sf).collect()}
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), **out}))


if __name__ == "__main__":
    main()
