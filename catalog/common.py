"""Shared helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank(df: DataFrame, name: str, condition: str) -> DataFrame:
    """Null a column where a key rule holds; rows all stay."""
    return df.withColumn(name, F.expr(f"CASE WHEN {condition} THEN NULL ELSE `{name}` END"))


def rounded(c: Column | str, places: int) -> Column:
    """Rounded, with -0.0 as 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)


def round_columns(df: DataFrame, places: int, names: list[str] | None = None) -> DataFrame:
    names = names if names is not None else [n for n, t in df.dtypes if t == "double"]
    return df.select(*[rounded(f"`{c}`", places).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


def sql_round(expression: str, places: int) -> str:
    return f"round({expression}, {places}) + 0.0"


def blanked(name: str, condition: str) -> str:
    return f"CASE WHEN {condition} THEN NULL ELSE {name} END AS {name}"
