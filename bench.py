"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stylematch import workload  # noqa: E402
from stylematch.session import build_session  # noqa: E402

HEADLINE = [
    "weighted_scaled_top3", "additive_top3", "gated_top3_best_two_values", "scaled_top3", "batch_scaled_first_users",
    "precision_at_k_per_user", "mean_precision_at_k", "weight_grid_all_users", "best_weights_stored_scores",
    "score_rating_correlation", "score_rating_correlation_per_user", "epsilon_histograms", "document_tf_idf",
    "rare_value_fixpoint", "similar_neighbours_dropped", "result_details", "result_cards", "prompt_rows_self",
    "keyed_upsert", "enriched_outfits", "filled_with_modes", "scaled_per_group", "vector_clusters", "basket_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.log.level": "ERROR",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
    })
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    # one warm-up on the smallest data, so the first query does not pay for starting the JVM's compilers
    warm = sf_dir.replace("sf0.1", "sf0.001")
    workload.QUERIES["weighted_scaled_top3"](spark, warm if os.path.isdir(warm) else sf_dir).collect()
    times = {}
    for name in names:
        start = time.time()
        workload.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
