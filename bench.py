"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Each query runs once to warm up and then
``BENCH_RUNS`` times; its best time counts. Every run computes the whole result (a ``noop`` write), and the
queries that write tables include the writing.
"""

from __future__ import annotations

import json
import os
import time

from flowlens.operators.scoring import score
from flowlens.session import build_session
from flowlens.suite.registry import queries
from flowlens.suite.views import Views

HEADLINE = [
    "d10_hits_per_source", "d11_hits_of_two_labels", "d12_events_with_flows", "d13_dns_flows",
    "d2_attack_breakdown", "d8_top_applications", "a3_count_distinct", "a8_group_by",
    "j1_inner_metrics", "j2_left_metrics", "j7_join_sequence", "j9_join_rows_limited", "u1_union_all",
    "t8_flow_rate", "t10_label_window", "c5_classified_flows", "c3_model_backend", "j10_augment",
    "w3_last_record", "w2_idle_sessions", "a12_flow_statistics", "t7_meter", "e2_incidents",
    "v1_knn_cosine", "v7_similar_past", "s8_month_layout", "t2_incremental_classification",
]


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session("bench", f"local[{cpus}]", **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        call = lambda n=name: known[n](spark, sf_dir)
        timed(call)
        times[name] = round(min(timed(call) for _ in range(runs)), 3)
    views = Views(spark, sf_dir)
    flows, vectors = views.flows.count(), views.table("embeddings").count()
    scoring = timed(lambda: score(views.flows).select("flow_id", "label", "confidence"))
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf_dir.rsplit("sf", 1)[-1].strip("/"),
        "scored_flows_per_sec": round(flows / scoring),
        "query_vectors_per_sec": round(vectors / times["v1_knn_cosine"]),
        "metered_packets_per_sec": round(flows / times["t7_meter"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
