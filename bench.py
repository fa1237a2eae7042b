"""Time the headline queries; prints one JSON line.

Reads ``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS``.
A time covers building the plan and computing every row of the result.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "graph_prerequisite_answers", "graph_credit_answers", "graph_all_triples", "graph_edge_upsert",
    "graph_node_upsert", "graph_dangling_edges", "graph_subtree_removal", "vector_best_match",
    "vector_top_above_threshold", "vector_embedded_documents", "chat_router_intents", "chat_history",
    "retrieval_contexts", "text_match_keys", "text_headings", "programme_sections", "programme_outcomes",
    "programme_edge_counts", "course_hierarchy", "course_nodes", "carried_state", "regulation_tree",
    "regulation_citation_edges", "jobs_states",
    "programme_metrics", "programme_graph_labels", "course_edges", "course_many_codes", "stream_ingest_jobs",
    "stream_retrieval_contexts", "stream_first_uploads",
)


def main() -> None:
    from lectern.queries import all_queries
    from lectern.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # One small query starts the executors, the readers and the code generator.
    queries["chat_history"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
