"""Column profile: row count, null share, distinct count, minimum and skew in one scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.plans.roles import col, is_numeric

SKETCH_LOG_SIZE = 14
"""2^14 registers: a standard error of 0.8 %, and exact counts of small sets."""
NEAR = 0.03
SURELY_NEAR = 0.05
"""For decisions that have to be exact: six standard errors."""
COLUMNS_TOGETHER = 200
CARDINALITY_LIMITS = (1, 10, 15)
NEAR_UNIQUE = 0.9


@dataclass(frozen=True)
class ColumnProfile:
    rows: int
    nulls: int
    distinct: int
    minimum: float | None
    skew: float | None

    @property
    def null_share(self) -> float:
        return self.nulls / self.rows if self.rows else 0.0


def sample_skew(c: Column) -> Column:
    """Bias-corrected skew G1; Spark's skewness is the population form g1."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sketched_distinct(df: DataFrame, name: str) -> Column:
    """Estimated distinct non-null values.

    ``hll_sketch_agg`` keeps one binary buffer per column, where ``approx_count_distinct`` widens
    the aggregation row by hundreds of fields each.
    """
    c = col(name)
    if isinstance(df.schema[name].dataType, T.FractionalType):
        c = c.cast("double") + F.lit(0.0)
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), F.lit(SKETCH_LOG_SIZE)))


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact distinct non-null counts of many columns with narrow rows.

    Each column becomes (position, value) rows that are combined map-side before the shuffle, so
    a value holding a third of the rows costs one row per task. Columns are grouped by storage
    class to keep values in their own type.
    """
    groups: dict[str, list[str]] = {}
    for name in columns:
        kind = df.schema[name].dataType
        if isinstance(kind, T.IntegralType):
            groups.setdefault("bigint", []).append(name)
        elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            groups.setdefault("double", []).append(name)
        else:
            groups.setdefault("string", []).append(name)
    out = dict.fromkeys(columns, 0)
    for storage, names in groups.items():
        cells = F.array(
            *[F.struct(F.lit(i).alias("i"), col(c).cast(storage).alias("v")) for i, c in enumerate(names)]
        )
        values = df.select(F.inline(cells)).where("v is not null").groupBy("i", "v").agg(F.lit(1).alias("one"))
        for row in values.groupBy("i").count().collect():
            out[names[row["i"]]] = row["count"]
    return out


def _summary(df: DataFrame, columns: list[str], sketch: bool, moments: bool = True) -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        c = col(name)
        aggs.append(F.count(c).alias(f"n{i}"))
        if sketch:
            aggs.append(sketched_distinct(df, name).alias(f"d{i}"))
        if moments and is_numeric(df.schema[name].dataType):
            aggs += [F.min(c).cast("double").alias(f"m{i}"), sample_skew(c).alias(f"s{i}")]
    return aggs


def _near_threshold(distinct: int, rows: int, near: float) -> bool:
    limits = [*CARDINALITY_LIMITS, NEAR_UNIQUE * rows]
    return any(abs(distinct - t) <= max(1.0, near * t) for t in limits)


def profile(
    df: DataFrame, columns: list[str] | None = None, exact: bool = False, moments: bool = True, near: float = NEAR
) -> dict[str, ColumnProfile]:
    """Profile columns in one scan for ``COLUMNS_TOGETHER``; exact distinct counts only where a decision hangs on them.

    Distinct counts come from a sketch. A column whose estimate lies near a decision limit
    (1, 10, 15 values or 90 % of the rows), by the share ``near``, is counted exactly in a second, narrow pass; with
    ``exact`` all columns are. Without ``moments`` minimum and skew are left out.
    """
    columns = df.columns if columns is None else list(columns)
    if not columns:
        return {}
    if len(columns) > COLUMNS_TOGETHER:
        parts = [columns[k : k + COLUMNS_TOGETHER] for k in range(0, len(columns), COLUMNS_TOGETHER)]
        return {c: p for part in parts for c, p in profile(df, part, exact, moments, near).items()}
    row = df.agg(*_summary(df, columns, not exact, moments)).first().asDict()
    rows = row["rows"]
    if exact:
        known = distinct_counts(df, columns)
    else:
        known = {c: row[f"d{i}"] for i, c in enumerate(columns)}
        doubtful = [c for c in columns if _near_threshold(known[c], rows, near)]
        if doubtful:
            known |= distinct_counts(df, doubtful)
    return {
        c: ColumnProfile(rows, rows - row[f"n{i}"], known[c], row.get(f"m{i}"), row.get(f"s{i}"))
        for i, c in enumerate(columns)
    }


def type_class(dtype: T.DataType) -> str:
    if is_numeric(dtype):
        return "numeric"
    return "categorical" if isinstance(dtype, T.StringType) else dtype.simpleString()


def profile_frame(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """The profile as a table, one row per column."""
    columns = df.columns if columns is None else list(columns)
    found = profile(df, columns, exact=exact)
    rows = [
        (c, type_class(df.schema[c].dataType), p.rows, p.nulls, p.null_share, p.distinct, p.minimum, p.skew)
        for c, p in found.items()
    ]
    schema = (
        "column_name string, type_class string, n_rows bigint, n_null bigint, null_share double, "
        "n_distinct bigint, min_value double, skew double"
    )
    return df.sparkSession.createDataFrame(rows, schema)
