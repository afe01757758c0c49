"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: median of three runs after a warm-up, one JSON line.

They run on the derived variants as a store, which is written once before (``store_write``, not in the sum): what is
measured are scans and queries of variants, not the making of variants from orders and line items.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from locusframe.plans import catalog, filed

#: Site projection, region searches, filtered scans, annotation (also by group), per-sample statistics, VCF text.
HEADLINE = ["field_slice", "region_single", "region_multi_semi", "filter_quality", "filter_af_any", "region_af_annotated", "annotate_counts", "annotate_hwe", "annotate_fisher", "group_fstats", "site_summary", "sample_tstv", "conversion_matrix", "vcf_lines"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    builds = catalog.builds()
    began = time.time()
    filed.written(spark, sf_dir, "store")
    written = round(time.time() - began, 3)
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.time()
            builds[name][0](filed.stored(spark, sf_dir)).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline variant queries, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "store_write": written, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "spark": spark.version, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
