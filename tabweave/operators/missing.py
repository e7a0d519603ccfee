"""Missing values: drop, flag with a sentinel, or fill with a statistic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.quantiles import quantiles
from tabweave.operators.prune import drop_columns
from tabweave.plans.roles import Roles, col, is_numeric, is_string

DROP_ABOVE = 0.8
FLAG_ABOVE = 0.3
NUMERIC_SENTINEL = -999
STRING_SENTINEL = "Missing"
STRING_FILL = "Unknown"


def null_shares(df: DataFrame, columns: list[str]) -> dict[str, float]:
    if not columns:
        return {}
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)]
    ).first()
    rows = row["rows"]
    return {c: (rows - row[f"n{i}"]) / rows if rows else 0.0 for i, c in enumerate(columns)}


def fit_missing(df: DataFrame, roles: Roles, exact: bool = True, shares: dict[str, float] | None = None) -> dict:
    """Decide per column by its null share: above 80 % drop, above 30 % flag, else fill.

    Strings that were whole in training still get a fill, for rows to score.
    """
    columns = [c for c in roles.features(df) if is_numeric(df.schema[c].dataType) or is_string(df.schema[c].dataType)]
    shares = null_shares(df, columns) if shares is None else shares
    holed = {c: shares[c] for c in columns if shares[c] > 0}
    drop = [c for c, s in holed.items() if s > DROP_ABOVE]
    flag = [c for c, s in holed.items() if FLAG_ABOVE < s <= DROP_ABOVE]
    plain = [c for c, s in holed.items() if s <= FLAG_ABOVE]
    numeric = {c for c in columns if is_numeric(df.schema[c].dataType)}
    medians = quantiles(df, {c: [0.5] for c in plain if c in numeric}, exact=exact)
    fill: dict[str, float | str] = {}
    for c in flag:
        fill[c] = NUMERIC_SENTINEL if c in numeric else STRING_SENTINEL
    for c in plain:
        fill[c] = (medians[c][0] or 0.0) if c in numeric else STRING_FILL
    fill |= {c: STRING_FILL for c in columns if c not in numeric and c not in holed}
    return {"op": "missing", "drop": drop, "flag": flag, "fill": fill}


def spare_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Medians for columns that were whole in training, should a row to score lack a value."""
    return {c: v[0] for c, v in quantiles(df, {c: [0.5] for c in columns}, exact=False).items() if v[0] is not None}


def _filled(df: DataFrame, name: str, value) -> Column:
    kind = df.schema[name].dataType
    if is_numeric(kind) and not float(value).is_integer():
        return F.coalesce(col(name).cast("double"), F.lit(float(value)))
    return F.coalesce(col(name), F.lit(value).cast(kind))


def apply_missing(df: DataFrame, spec: dict) -> DataFrame:
    present = [c for c in df.columns if c not in spec["drop"]]
    flags = [col(c).isNull().cast("int").alias(f"{c}_is_missing") for c in spec["flag"] if c in present]
    out = [_filled(df, c, spec["fill"][c]).alias(c) if c in spec["fill"] else col(c) for c in present]
    return df.select(*out, *flags)


def mode_values(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest on ties, ``Unknown`` without values.

    ``mode`` keeps a count per distinct value in one buffer, so counting is a shuffle instead and
    only the winner of each column is read back.
    """
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("string").alias("v")) for i, c in enumerate(columns)])
    counts = df.select(F.inline(cells)).where("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    winners = counts.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("best"))
    found = {columns[r["i"]]: r["best"]["v"] for r in winners.collect()}
    return {c: found.get(c, STRING_FILL) for c in columns}


def fill_own_statistics(df: DataFrame, roles: Roles, exact: bool = True) -> DataFrame:
    """Fill from the frame's own mode (strings) and median (numbers)."""
    columns = [c for c, s in null_shares(df, roles.features(df)).items() if s > 0]
    numeric = [c for c in columns if is_numeric(df.schema[c].dataType)]
    medians = quantiles(df, {c: [0.5] for c in numeric}, exact=exact)
    fill: dict = {c: v[0] for c, v in medians.items() if v[0] is not None}
    fill |= mode_values(df, [c for c in columns if is_string(df.schema[c].dataType)])
    return apply_missing(df, {"drop": [], "flag": [], "fill": fill})


def drop_null_above(df: DataFrame, roles: Roles, share: float = DROP_ABOVE) -> DataFrame:
    shares = null_shares(df, roles.features(df))
    return drop_columns(df, [c for c, s in shares.items() if s > share])
