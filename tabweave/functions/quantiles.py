"""Exact and approximate quantiles of many columns that never hold a column in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.operators.profile import sketched_distinct
from tabweave.plans.roles import col

BUFFER_VALUES = 50_000
"""Most distinct values one aggregation buffer, or one collected bracket, may hold."""
ACCURACY = 10_000


def _interpolate(low: float, high: float, share: float) -> float:
    return low if low == high else low * (1 - share) + high * share


def quantiles(
    df: DataFrame,
    wanted: dict[str, list[float]],
    exact: bool = True,
    buffer_values: int = BUFFER_VALUES,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column; ``None`` for a column without values.

    Approximate mode is one ``percentile_approx`` scan. Exact mode uses ``percentile`` for
    columns with few distinct values, over their counts, and narrows a bracket round each
    quantile for the rest.
    """
    wanted = {c: list(p) for c, p in wanted.items()}
    if not wanted:
        return {}
    names = list(wanted)
    if not exact:
        row = df.agg(
            *[
                F.percentile_approx(col(c).cast("double"), F.lit(wanted[c]), ACCURACY).alias(f"q{i}")
                for i, c in enumerate(names)
            ]
        ).first()
        return {c: list(row[f"q{i}"]) if row[f"q{i}"] else [None] * len(wanted[c]) for i, c in enumerate(names)}
    sizes = df.agg(*[sketched_distinct(df, c).alias(f"d{i}") for i, c in enumerate(names)]).first()
    small = [c for i, c in enumerate(names) if sizes[f"d{i}"] <= buffer_values]
    large = [c for c in names if c not in small]
    out: dict[str, list[float | None]] = {}
    if small:
        out |= _counted(df, {c: wanted[c] for c in small})
    if large:
        out |= _bracketed(df, {c: wanted[c] for c in large}, buffer_values)
    return out


def _counted(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Quantiles from the counts of each column's values.

    The counts are added up in narrow (column, value) rows first; ``percentile`` over the table would send the values of all
    columns from every task to a single one.
    """
    names, shares = list(wanted), sorted({p for some in wanted.values() for p in some})
    cells = F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("double").alias("v")) for i, c in enumerate(names)])
    counts = df.select(F.inline(cells)).where("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy("i").agg(F.percentile("v", F.lit(shares), F.col("n")).alias("q")).collect()  # a row a column
    known = {names[r["i"]]: dict(zip(shares, r["q"])) for r in found}
    return {c: [known[c][p] if c in known else None for p in some] for c, some in wanted.items()}


def _bracketed(df: DataFrame, wanted: dict[str, list[float]], buffer_values: int) -> dict[str, list[float]]:
    """Exact order statistics by narrowing value brackets, one fused scan per round.

    Each round asks a quantile sketch, restricted to the current bracket, for two values that
    enclose the wanted ranks, then counts the rows below and inside them. A sketch answers
    within 1/ACCURACY of the bracket's rows, so a trillion rows need three rounds; only a bracket
    of at most ``buffer_values`` rows, or of one repeated value, is read back.
    """
    names = list(wanted)
    bounds = df.agg(
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.min(col(c)).cast("double").alias(f"a{i}") for i, c in enumerate(names)],
        *[F.max(col(c)).cast("double").alias(f"b{i}") for i, c in enumerate(names)],
    ).first()
    goals = []
    for i, c in enumerate(names):
        n = bounds[f"n{i}"]
        for p in wanted[c]:
            position = (n - 1) * p
            goals.append(
                {
                    "column": c,
                    "position": position,
                    "first": math.floor(position),
                    "last": math.ceil(position),
                    "low": bounds[f"a{i}"],
                    "high": bounds[f"b{i}"],
                    "below": 0,
                    "inside": n,
                    "closed": False,
                }
            )

    def is_open(g: dict) -> bool:
        return not g["closed"] and g["inside"] > buffer_values and g["low"] < g["high"]

    while any(is_open(g) for g in goals):
        active = [g for g in goals if is_open(g)]
        aggs = []
        for j, g in enumerate(active):
            c = col(g["column"]).cast("double")
            width = g["inside"]
            left = max(0.0, (g["first"] - g["below"]) / width - 3 / ACCURACY)
            right = min(1.0, (g["last"] - g["below"] + 1) / width + 3 / ACCURACY)
            inside = F.when(c.between(g["low"], g["high"]), c)
            aggs.append(F.percentile_approx(inside, F.lit([left, right]), ACCURACY).alias(f"p{j}"))
        guess = df.agg(*aggs).first()
        counts = []
        for j, g in enumerate(active):
            c = col(g["column"]).cast("double")
            low, high = guess[f"p{j}"]
            counts.append(F.count_if(c < F.lit(low)).alias(f"l{j}"))
            counts.append(F.count_if(c.between(low, high)).alias(f"i{j}"))
        seen = df.agg(*counts).first()
        for j, g in enumerate(active):
            low, high = guess[f"p{j}"]
            below, inside = seen[f"l{j}"], seen[f"i{j}"]
            encloses = below <= g["first"] and g["last"] < below + inside
            if encloses and inside < g["inside"]:
                g.update(low=low, high=high, below=below, inside=inside)
            else:
                g.update(_halve(df, g))

    pieces = F.array_compact(
        F.array(
            *[
                F.when(
                    col(g["column"]).cast("double").between(g["low"], g["high"]),
                    F.struct(F.lit(j).alias("j"), col(g["column"]).cast("double").alias("v")),
                )
                for j, g in enumerate(goals)
            ]
        )
    )
    values: dict[int, list[tuple[float, int]]] = {}
    for row in df.select(F.inline(pieces)).groupBy("j", "v").count().collect():
        values.setdefault(row["j"], []).append((row["v"], row["count"]))
    out: dict[str, list[float]] = {c: [] for c in names}
    for j, g in enumerate(goals):
        picked, rank = {}, g["below"]
        for value, count in sorted(values[j]):
            for target in (g["first"], g["last"]):
                if rank <= target < rank + count:
                    picked[target] = value
            rank += count
        share = g["position"] - g["first"]
        out[g["column"]].append(_interpolate(picked[g["first"]], picked[g["last"]], share))
    return out


def _halve(df: DataFrame, g: dict) -> dict:
    """Keep the part of a bracket that holds both ranks, cut at a middle value."""
    c = col(g["column"]).cast("double")
    middle = g["low"] / 2 + g["high"] / 2
    left_side, right_side = c.between(g["low"], middle), (c > middle) & (c <= g["high"])
    row = df.agg(
        F.count_if(left_side).alias("n"),
        F.max(F.when(left_side, c)).alias("left"),
        F.min(F.when(right_side, c)).alias("right"),
    ).first()
    split = g["below"] + row["n"]
    if g["last"] < split:
        return {"high": row["left"], "inside": row["n"]}
    if g["first"] >= split:
        return {"low": row["right"], "below": split, "inside": g["inside"] - row["n"]}
    # the ranks sit on either side of the cut, so the bracket is just those two values
    lower = df.agg(F.count_if(left_side & (c == row["left"])).alias("n")).first()["n"]
    return {"low": row["left"], "high": row["right"], "below": split - lower, "closed": True}
