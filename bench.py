"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4), BENCH_RUNS warm runs per query
(median reported), BENCH_QUERIES a comma-separated choice. Tables the queries write for each other
(vocabulary, tokens) go to a new folder per run; ``tokenise`` is the time to build them.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weftline.plans import derived, registry  # noqa: E402
from weftline.session import build_session  # noqa: E402

HEADLINE = [
    "german_packing", "source_normalise", "quality_filter", "lines_to_docs", "normalise_text", "split_head", "split_tail",
    "shuffle_global", "epoch_order", "word_freq", "bpe_pairs", "encode_vocab", "encode_bytes", "doc_offsets", "offset_check",
    "pack_greedy", "pack_report", "sample_packed", "sample_segments", "sample_packed_plain", "sample_padded", "sample_contiguous",
    "segment_lengths", "init_mean", "init_heuristic", "init_overlap", "eval_nll", "throughput", "time_totals", "tensor_hist",
    "tensor_norms", "run_summary", "best_config", "ranked_report",
]


def run(spark, sf_dir: str, name: str) -> float:
    started = time.perf_counter()
    registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    folder = os.environ.get("BENCH_WORK") or "file://" + tempfile.mkdtemp(prefix="weftline-bench-")
    spark = build_session(
        f"local[{cpus}]", int(cpus), spark__driver__memory=os.environ.get("BENCH_MEMORY", "6g"), spark__checkpoint__dir=folder
    )
    spark.sparkContext.setLogLevel("OFF")
    started = time.perf_counter()
    derived.tokens(spark, sf_dir)
    queries = {"tokenise": round(time.perf_counter() - started, 3)}
    for name in names:
        run(spark, sf_dir, name)
        queries[name] = round(statistics.median(run(spark, sf_dir, name) for _ in range(runs)), 3)
        print(name, queries[name], file=sys.stderr, flush=True)
    total = round(sum(queries.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": queries, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
