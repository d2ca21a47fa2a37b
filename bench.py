"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from tarn.plans import catalog
from tarn.session import build_session

HEADLINE = (
    "knn_l2 knn_batch knn_filtered ivf_search pq_adc ivfpq_search binary_rerank graph_search crossmodal_search bm25_classic bm25_log_tf_idf "
    "tpch_q1 tpch_q3 tpch_q4 tpch_q5 tpch_q6 tpch_q10 tpch_q14 tpch_q18 tpch_q22 agg_cube agg_distinct_multi win_rank_family join_semi connect_by_tree merge_upsert stream_tumbling"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the first also compiles
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(min(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
