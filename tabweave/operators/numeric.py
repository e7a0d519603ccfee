"""Numeric feature construction: pairs, bins, logs, powers and row statistics."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.quantiles import quantiles
from tabweave.operators import pairs
from tabweave.operators.pairs import product, ratio
from tabweave.operators.profile import ColumnProfile, profile
from tabweave.plans.roles import Roles, col, numeric_columns

BINS = 5
BIN_DISTINCT_ABOVE = 10
LOG_SKEW_ABOVE = 1.0
EQUAL_WIDTH_SLACK = 0.001


def pairwise(columns: list[str]) -> list[Column]:
    """Product and ratio of every pair, as one projection."""
    out = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            out += [product(a, b), ratio(a, b)]
    return out


def distinct_edges(edges: list[float]) -> list[float]:
    return sorted(set(edges))


def bin_index(c: Column, edges: list[float]) -> Column:
    """0-based index of the right-closed bin; the first bin also holds its lower edge."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    value = c.cast("double")
    out = F.when(value.isNull() | (value < edges[0]) | (value > edges[-1]), F.lit(None).cast("int"))
    for i, right in enumerate(edges[1:]):
        out = out.when(value <= right, F.lit(i))
    return out


def quantile_edges(df: DataFrame, columns: list[str], bins: int = BINS, exact: bool = True) -> dict[str, list[float]]:
    """Bin edges at equal shares of the rows, repeated edges merged."""
    shares = [i / bins for i in range(bins + 1)]
    found = quantiles(df, {c: shares for c in columns}, exact=exact)
    return {c: distinct_edges([v for v in edges if v is not None]) for c, edges in found.items()}


def equal_width_edges(df: DataFrame, columns: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """Edges at equal steps, the lowest moved out by 0.1 % of the range so that it is included."""
    row = df.agg(
        *[F.min(col(c)).cast("double").alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.max(col(c)).cast("double").alias(f"b{i}") for i, c in enumerate(columns)],
    ).first()
    out = {}
    for i, c in enumerate(columns):
        low, high = row[f"a{i}"], row[f"b{i}"]
        if low is None:
            out[c] = []
            continue
        if low == high:
            slack = EQUAL_WIDTH_SLACK * abs(low) if low else EQUAL_WIDTH_SLACK
            low, high = low - slack, high + slack
            out[c] = [low + (high - low) * k / bins for k in range(bins + 1)]
        else:
            edges = [low + (high - low) * k / bins for k in range(bins + 1)]
            edges[0] = low - (high - low) * EQUAL_WIDTH_SLACK
            edges[-1] = high
            out[c] = edges
    return out


def log_column(c: str) -> Column:
    return F.log1p(col(c).cast("double")).alias(f"{c}_log")


def square(c: str) -> Column:
    return (col(c).cast("double") * col(c).cast("double")).alias(f"{c}_squared")


def root(c: str) -> Column:
    return F.sqrt(F.abs(col(c).cast("double"))).alias(f"{c}_sqrt")


def add_row_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add mean, sample deviation and sum over the row's non-null numbers.

    Plain arithmetic in three projections, so that it compiles and the mean is computed once.
    """
    values = [col(c).cast("double") for c in columns]
    total = reduce(add, [F.coalesce(v, F.lit(0.0)) for v in values])
    count = reduce(add, [v.isNotNull().cast("int") for v in values])
    kept = [col(c) for c in df.columns]
    summed = df.select(*kept, total.alias("row_sum"), count.alias("__n"))
    mean = F.when(F.col("__n") > 0, F.col("row_sum") / F.col("__n"))
    centred = summed.select(*kept, "row_sum", "__n", mean.alias("row_mean"))
    gaps = [F.coalesce((v - F.col("row_mean")) * (v - F.col("row_mean")), F.lit(0.0)) for v in values]
    std = F.when(F.col("__n") > 1, F.sqrt(reduce(add, gaps) / (F.col("__n") - 1)))
    return centred.select(*kept, "row_mean", std.alias("row_std"), "row_sum")


def fit_numeric(
    df: DataFrame,
    roles: Roles,
    profiles: dict[str, ColumnProfile] | None = None,
    exact: bool = True,
    encoded_target: bool = False,
) -> dict:
    """Choose bins, logs and row statistics from the profile and the quantiles; "pairs" is None for all pairs.

    Row statistics need more than two numeric columns. The target counts, unless its numbers are encoded classes.
    """
    columns = numeric_columns(df, roles.features(df))
    everything = [c for c in numeric_columns(df) if not (encoded_target and c == roles.target)]
    profiles = profiles or profile(df, columns, exact=exact)
    binned = [c for c in columns if profiles[c].distinct > BIN_DISTINCT_ABOVE]
    edges = quantile_edges(df, binned, exact=exact)
    logs = [
        c
        for c in columns
        if profiles[c].minimum is not None
        and profiles[c].minimum > 0
        and profiles[c].skew is not None
        and profiles[c].skew > LOG_SKEW_ABOVE
    ]
    return {
        "op": "numeric",
        "columns": columns,
        "pairs": None,
        "bins": edges,
        "logs": logs,
        "row_statistics": columns if len(everything) > 2 else [],
    }


def fit_pairs(df: DataFrame, columns: list[str], drop) -> tuple[list[list[str]], dict[str, ColumnProfile]]:
    """Pair features that ``drop``, a rule on a column's profile, leaves, and the profiles of all, by name.

    Of features with one name the first counts; a name that the frame has already is no feature.
    """
    kept, known, seen = [], {}, set(df.columns)
    for key, p in pairs.profile_pairs(df, columns).items():
        name = pairs.name_of(key)
        if name in seen:
            continue
        seen.add(name)
        known[name] = p
        if drop(p) is None:
            kept.append(list(key))
    return kept, known


def apply_numeric(df: DataFrame, spec: dict) -> DataFrame:
    out = pairwise(spec["columns"]) if spec["pairs"] is None else [pairs.column(tuple(k)) for k in spec["pairs"]]
    for c in spec["columns"]:
        if c in spec["bins"]:
            out.append(bin_index(col(c), spec["bins"][c]).alias(f"{c}_bin"))
        if c in spec["logs"]:
            out.append(log_column(c))
        out += [square(c), root(c)]
    if spec["row_statistics"]:
        df = add_row_statistics(df, spec["row_statistics"])
    return df.select("*", *out)
