"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from ledgerlens.catalog import load
from ledgerlens.session import local_session

HEADLINE = (
    "retail_prepared_by_brand",
    "rfm_metrics",
    "rfm_segments",
    "calculated_lifetime_value",
    "lifetime_features",
    "top_fifth_within_segment",
    "frequent_item_sets",
    "association_rules",
    "recommended_by_lift",
    "user_title_ratings",
    "user_based_top",
    "item_based_next",
    "hybrid_recommendations",
    "similar_documents",
    "course_rating_by_title",
    "title_sorting_scores",
    "vote_scores",
    "table_profile",
    "numeric_summary",
    "correlation_matrix",
    "rare_category_report",
    "missing_values",
    "outlier_check",
    "robust_scaling",
    "level_table",
    "film_records_cleaned",
    "local_outlier_factors",
    "nearest_mean_price",
    "classification_report",
    "roc_area",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registered = load()
    registered["top_products_by_quantity"].run(spark, folder).collect()  # starts the JVM's compilers
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        registered[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
