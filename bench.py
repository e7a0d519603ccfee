"""Time the headline queries in a warm session; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from catalog import models, structured, text
from catalog.common import table
from tabweave.operators.profile import profile
from tabweave.plans.feature_plan import fit_plan
from tabweave.plans.roles import Roles


def profile_sketched(spark, sf_dir):
    return spark.createDataFrame([(c, p.distinct) for c, p in profile(table(spark, sf_dir, "lineitem")).items()], "c string, n long")


def profile_exact(spark, sf_dir):
    found = profile(table(spark, sf_dir, "lineitem"), exact=True)
    return spark.createDataFrame([(c, p.distinct) for c, p in found.items()], "c string, n long")


def plan_and_transform(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate", "l_returnflag"
    )
    cores = spark.sparkContext.defaultParallelism
    plan, made = fit_plan(rows, Roles("l_returnflag", ("l_orderkey",)), "classification", partitions=cores)
    return made


HEADLINE = {
    "profile_sketched": profile_sketched,
    "profile_exact": profile_exact,
    "fill_median": structured.QUERIES["fill_median"],
    "exact_quantiles": structured.QUERIES["exact_quantiles"],
    "pairwise_product_ratio": structured.QUERIES["pairwise_product_ratio"],
    "row_statistics": structured.QUERIES["row_statistics"],
    "target_encoding": structured.QUERIES["target_encoding"],
    "correlation_prune": structured.QUERIES["correlation_prune"],
    "anova_topk": structured.QUERIES["anova_topk"],
    "standard_scale": structured.QUERIES["standard_scale"],
    "cv_folds_stratified": structured.QUERIES["cv_folds_stratified"],
    "classification_report": structured.QUERIES["classification_report"],
    "plan_and_transform": plan_and_transform,
    "clean_text": text.QUERIES["clean_text"],
    "text_statistics_cleaned": text.QUERIES["text_statistics_cleaned"],
    "tfidf_long": text.QUERIES["tfidf_long"],
    "knn_classify": models.QUERIES["knn_classify"],
    "fit_logistic_regression": models.QUERIES["fit_predict_logisticregression"],
    "fit_random_forest": models.QUERIES["fit_predict_randomforestclassifier"],
    "grid_search": models.QUERIES["grid_search"],
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name, run in HEADLINE.items():
        for _ in range(2):  # the first run compiles; the second counts
            start = time.time()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
