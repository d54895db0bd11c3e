"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["label_statistics", "describe_numeric", "items_per_group_hist", "gap_statistics", "spearman_order", "contiguity", "series_validation", "rank_candidates", "triplets_index", "triplets_nearest", "clip_normalize", "roc_auc_per_label", "mean_pool", "attention_pool"]


def main() -> None:
    from sliceframe.plans.catalog import queries
    from sliceframe.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    took = {}
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    for name in HEADLINE:
        start = time.time()
        queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
