"""Command line: train, score, or both.

    python -m tabweave --train train.csv --test test.csv --target price --algorithm LinearRegression
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from tabweave.automl import AutoTable, FittedTable, load_prepared, save_prepared
from tabweave.models.registry import GRIDS, task_of
from tabweave.sources.tables import read_feature_cache, read_pair, read_table, write_table

ALGORITHMS = [name for group in GRIDS.values() for name in group]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tabweave", description="Tabular and text AutoML on Spark")
    data = out.add_argument_group("data")
    data.add_argument("--path", "-p", help="folder with one train and one test table")
    data.add_argument("--train", help="training table")
    data.add_argument("--test", help="table to score")
    data.add_argument("--format", choices=["csv", "parquet", "json"], help="table format; by file name if absent")
    data.add_argument("--target", "-t", help="column to predict")
    data.add_argument("--output_columns", "-o", nargs="+", default=[], help="columns passed through untouched")
    data.add_argument("--from_cache", action="store_true", help="take the processed features of an earlier run; raw tables are not read")
    data.add_argument("--dataset_type", choices=["structured", "text", "mixed"], default="structured")
    data.add_argument("--text_columns", nargs="+", help="columns that hold prose; found if absent")
    model = out.add_argument_group("model")
    model.add_argument("--algorithm", "-a", choices=ALGORITHMS)
    model.add_argument("--classification", "-c", action="store_true")
    model.add_argument("--regression", "-r", action="store_true")
    model.add_argument("--cv_folds", type=int, default=3)
    model.add_argument("--random_state", type=int, default=42)
    model.add_argument("--n_jobs", type=int, default=4, help="fits that run at the same time; -1 for the default")
    mode = out.add_argument_group("mode")
    mode.add_argument("--only_train", action="store_true")
    mode.add_argument("--only_test", action="store_true")
    mode.add_argument("--model_path", help="saved run to score with")
    steps = out.add_argument_group("steps")
    steps.add_argument("--no_feature_engineering", action="store_true")
    steps.add_argument("--no_handle_missing", action="store_true")
    steps.add_argument("--no_encode_categorical", action="store_true")
    steps.add_argument("--no_tuning", action="store_true")
    steps.add_argument("--nlp_method", choices=["tfidf", "count"], default="tfidf")
    steps.add_argument("--max_features", type=int, default=2000)
    steps.add_argument("--no_topic_modeling", action="store_true")
    steps.add_argument("--no_dimensionality_reduction", action="store_true")
    result = out.add_argument_group("output")
    result.add_argument("--save_model", "-sm", action="store_true")
    result.add_argument("--output_dir", default="results")
    return out


def task_from(args: argparse.Namespace) -> str:
    """Task by flag, else by the algorithm's name."""
    if args.classification and args.regression:
        raise SystemExit("choose one of --classification and --regression")
    if args.classification or args.regression:
        return "classification" if args.classification else "regression"
    return task_of(args.algorithm)


def check(args: argparse.Namespace) -> None:
    if args.only_train and args.only_test:
        raise SystemExit("choose one of --only_train and --only_test")
    if args.only_test:
        if not args.model_path or not (args.test or args.from_cache):
            raise SystemExit("--only_test needs --model_path and --test or --from_cache")
        return
    if not (args.path or args.train or args.from_cache):
        raise SystemExit("give --path, --train or --from_cache")
    if not args.target or not args.algorithm:
        raise SystemExit("training needs --target and --algorithm")


def settings(args: argparse.Namespace) -> AutoTable:
    return AutoTable(
        target=args.target,
        algorithm=args.algorithm,
        task=task_from(args),
        keep=tuple(args.output_columns),
        text=tuple(args.text_columns) if args.text_columns else None,
        dataset_type=args.dataset_type,
        cv_folds=args.cv_folds,
        seed=args.random_state,
        tune=not args.no_tuning or args.only_train,
        feature_engineering=not args.no_feature_engineering,
        handle_missing=not args.no_handle_missing,
        encode_categorical=not args.no_encode_categorical,
        nlp_method=args.nlp_method,
        max_features=args.max_features,
        topic_modeling=not args.no_topic_modeling,
        dimensionality_reduction=not args.no_dimensionality_reduction,
        parallelism=args.n_jobs if args.n_jobs > 0 else 4,
    )


def finish(fitted: FittedTable, test: DataFrame, folder: str) -> None:
    """Metrics, predictions, the run record and, for classes, the report of a scored table."""
    if fitted.evaluate(test) and fitted.settings.task == "classification":
        write_table(fitted.report(test), f"{folder}/report", "csv")
    fitted.save_results(test, folder)


def run(spark: SparkSession, argv: list[str] | None = None) -> dict:
    """Run one command; returns the metrics on the test table, if it is labelled."""
    args = parser().parse_args(argv)
    check(args)
    cache = f"{args.output_dir}/cache"
    if args.only_test:
        fitted = FittedTable.load(spark, args.model_path)
        test = spark.read.parquet(f"{cache}/test") if args.from_cache else read_table(spark, args.test, args.format)
        finish(fitted, test, args.output_dir)
        return fitted.metrics
    run_settings = settings(args)
    if args.from_cache:
        _, test = read_feature_cache(spark, cache)
    else:
        train, test = read_pair(spark, args.path, args.train, args.test, args.format)
        save_prepared(spark, cache, *run_settings.prepare(train))
    if args.only_train:
        test = None
    fitted = run_settings.fit_prepared(*load_prepared(spark, cache, run_settings))
    if test is not None and not args.from_cache:
        write_table(fitted.prepared(test), f"{cache}/test", "parquet")
        test = spark.read.parquet(f"{cache}/test")
    if args.save_model:
        fitted.save(spark, f"{args.output_dir}/{args.algorithm}_model")
    if test is not None:
        finish(fitted, test, args.output_dir)
    return fitted.metrics


def main() -> None:
    spark = SparkSession.builder.appName("tabweave").getOrCreate()
    print(run(spark))


if __name__ == "__main__":
    main()
