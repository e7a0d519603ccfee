"""Date features from columns whose name or type says date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.plans.roles import Roles, col, has_date_name, is_datetime, is_string

DATE_FORMATS = (
    "yyyy/MM/dd",
    "yyyyMMdd",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
    "dd-MM-yyyy",
    "yyyy-MM-dd HH:mm",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
)


def date_columns(df: DataFrame, roles: Roles) -> list[str]:
    """String columns with a date-like name, and all date or timestamp columns."""
    out = []
    for c in roles.features(df):
        kind = df.schema[c].dataType
        if is_datetime(kind) or (is_string(kind) and has_date_name(c)):
            out.append(c)
    return out


def parse_date(c: Column) -> Column:
    """Timestamp by the ISO form or the first format that fits, else null."""
    return F.coalesce(F.try_to_timestamp(c), *[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def date_parts(c: Column, name: str) -> list[Column]:
    """Year, month, day and weekday with Monday as 0."""
    return [
        F.year(c).alias(f"{name}_year"),
        F.month(c).alias(f"{name}_month"),
        F.day(c).alias(f"{name}_day"),
        F.weekday(c).alias(f"{name}_dayofweek"),
    ]


def _timestamp(df: DataFrame, name: str) -> Column:
    return parse_date(col(name)) if is_string(df.schema[name].dataType) else col(name)


def fit_dates(df: DataFrame, roles: Roles) -> dict:
    """Which date columns have at least one readable value."""
    columns = date_columns(df, roles)
    if not columns:
        return {"op": "dates", "columns": [], "parts": []}
    row = df.agg(*[F.count(_timestamp(df, c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return {"op": "dates", "columns": columns, "parts": [c for i, c in enumerate(columns) if row[f"n{i}"] > 0]}


def apply_dates(df: DataFrame, spec: dict) -> DataFrame:
    """Add the parts and drop the raw date, which no estimator can take."""
    out = [col(c) for c in df.columns if c not in spec["columns"]]
    for c in spec["parts"]:
        out += date_parts(_timestamp(df, c), c)
    return df.select(*out)
