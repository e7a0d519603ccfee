"""Attach per-value statistics to rows: a left join whose strategy follows measured sizes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.plans.roles import col

BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD_BYTES = 64
HOT_SHARE = 0.01


@dataclass
class Lookup:
    """Statistics per value of one column, with the sizes that pick the join.

    ``table`` has the columns ``value``, ``n`` (training rows) and any statistics. ``hot`` lists
    the values that hold at least 1 % of the rows, so it has at most 100 entries.
    """

    table: DataFrame
    values: int
    bytes: int
    rows: int
    top: str | None = None
    hot: list[str] = field(default_factory=list)

    def sizes(self) -> dict:
        return {"values": self.values, "bytes": self.bytes, "rows": self.rows, "top": self.top, "hot": self.hot}


def measure(stats: DataFrame, names: list[str]) -> dict[str, Lookup]:
    """Sizes, most common and hot values of statistics rows ``(i, value, n, ...)`` per column."""
    sizes = stats.groupBy("i").agg(
        F.count(F.lit(1)).alias("values"),
        F.sum("n").alias("rows"),
        F.sum(F.octet_length("value")).alias("bytes"),
        F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("top"),
    )
    found = {r["i"]: r for r in sizes.collect()}
    limit = F.lit(None).cast("double")
    for i, r in found.items():
        limit = F.when(F.col("i") == i, F.lit(max(2.0, HOT_SHARE * r["rows"]))).otherwise(limit)
    hot: dict[int, list[str]] = {}
    for r in stats.where(F.col("n") >= limit).select("i", "value").collect():
        hot.setdefault(r["i"], []).append(r["value"])
    out = {}
    for i, name in enumerate(names):
        table = stats.where(F.col("i") == i).drop("i")
        if i in found:
            r = found[i]
            size = r["bytes"] + ROW_OVERHEAD_BYTES * r["values"]
            out[name] = Lookup(table, r["values"], size, r["rows"], r["top"], sorted(hot.get(i, [])))
        else:
            out[name] = Lookup(table, 0, 0, 0)
    return out


def attach(
    df: DataFrame,
    key: str,
    lookup: Lookup,
    outputs: dict[str, Column],
    drop_key: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left-join a lookup on a column and add ``outputs``, expressions over its statistics.

    A table measured below ``broadcast_bytes`` is broadcast. A larger one is joined by a shuffle,
    but the rows of hot values and of null, which could pile up in one task, take the broadcast
    join with the few hot entries; each row goes down one branch by its value alone, so retried
    tasks agree.
    """
    stats = [c for c in lookup.table.columns if c != "value"]
    renamed = lookup.table.select(F.col("value").alias("__value"), *[F.col(c).alias(f"__{c}") for c in stats])
    left = [c for c in df.columns if not (drop_key and c == key)]

    def joined(rows: DataFrame, table: DataFrame) -> DataFrame:
        merged = rows.join(table, col(key) == F.col("__value"), "left")
        return merged.select(*[col(c) for c in left], *[e.alias(name) for name, e in outputs.items()])

    if lookup.bytes <= broadcast_bytes:
        return joined(df, F.broadcast(renamed))
    in_hot = F.col("__value").isin(lookup.hot) if lookup.hot else F.lit(False)
    is_hot = col(key).isNull() | (col(key).isin(lookup.hot) if lookup.hot else F.lit(False))
    hot = joined(df.where(is_hot), F.broadcast(renamed.where(in_hot)))
    rest = joined(df.where(~is_hot), renamed.where(~in_hot))
    return hot.unionByName(rest)
