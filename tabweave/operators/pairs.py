"""Profile of the products and ratios of all pairs of columns, without making them columns.

Each task computes the pair features of its rows in blocks and keeps a HyperLogLog sketch and a null count a feature. Only features that the
pruning rules leave are then built, so the width of the frame follows what stays and not the square of the columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.operators.profile import NEAR_UNIQUE, ColumnProfile, distinct_counts
from tabweave.plans.roles import col

RATIO_SHIFT = 1e-8
SKETCH_BITS = 12
"""2^12 registers: a standard error of 1.6 %."""
NEAR = 0.06
"""Estimates so close to a limit are counted exactly; nearly four standard errors."""
FEATURES_PER_PASS = 32_768
"""Pair features of one scan; their sketches take 128 MB in a task. More columns take more scans."""
COUNTED_TOGETHER = 100
GROUP = 64
"""Features whose sketches make one row between tasks."""
TASK_GROUPS = 32
ROWS = 2_048

_M = 1 << SKETCH_BITS
_Q = 64 - SKETCH_BITS


def product_name(a: str, b: str) -> str:
    return f"{a}_x_{b}"


def ratio_name(a: str, b: str) -> str:
    return f"{a}_div_{b}"


def product(a: str, b: str) -> Column:
    return (col(a).cast("double") * col(b).cast("double")).alias(product_name(a, b))


def ratio(a: str, b: str) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double") + RATIO_SHIFT).alias(ratio_name(a, b))


def _hashed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes of doubles; both zeros are one value, and all NaN."""
    x = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _observe(registers: np.ndarray, values: np.ndarray, known: np.ndarray) -> None:
    """Take the known ``values`` (rows x features) into ``registers`` (features x registers)."""
    h = _hashed(values)
    place = (h >> np.uint64(_Q)).astype(np.int64) + np.arange(values.shape[1]) * _M
    rest = h << np.uint64(SKETCH_BITS)
    rank = np.minimum(65 - np.frexp(rest.astype(np.float64))[1], _Q + 1).astype(np.uint8)
    np.maximum.at(registers.reshape(-1), place[known], rank[known])


def estimate(registers: np.ndarray) -> np.ndarray:
    """Different values that each row of registers has seen, by the estimator for HyperLogLog that needs no bias table."""
    counts = np.stack([(registers == k).sum(axis=1) for k in range(_Q + 2)], axis=1).astype(float)
    z = _M * _tau(1 - counts[:, -1] / _M)
    for k in range(_Q, 0, -1):
        z = 0.5 * (z + counts[:, k])
    z += _M * _sigma(counts[:, 0] / _M)
    return np.where(np.isinf(z), 0.0, _M * _M / (2 * math.log(2)) / z)


def _sigma(x: np.ndarray) -> np.ndarray:
    """x + the sum over k of x^(2^k) * 2^(k - 1); infinite at 1."""
    y, z, p = np.ones_like(x), x.copy(), x.copy()
    for _ in range(64):
        p = p * p
        z = z + p * y
        y = y + y
    return np.where(x == 1, np.inf, z)


def _tau(x: np.ndarray) -> np.ndarray:
    """A third of 1 - x - the sum over k of (1 - x^(2^-k))^2 * 2^-k; 0 at 0 and 1."""
    y, z, p = np.ones_like(x), 1 - x, x.copy()
    for _ in range(64):
        p = np.sqrt(p)
        y = y * 0.5
        z = z - (1 - p) ** 2 * y
    return np.where((x == 0) | (x == 1), 0.0, z / 3)


def _numbered(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1, d)]


def _passes(d: int) -> list[tuple[int, int]]:
    """Ranges of first columns whose pair features fit into one scan, at least one column each."""
    out, start, size = [], 0, 0
    for i in range(d - 1):
        more = 2 * (d - 1 - i)
        if size and size + more > FEATURES_PER_PASS:
            out.append((start, i))
            start, size = i, 0
        size += more
    return [*out, (start, d - 1)]


_ROW = "task int, part int, nulls binary, registers binary"


def _combine(table: pa.Table) -> pa.Table:
    """Sums of null counts and maxima of registers."""
    nulls, registers = (np.frombuffer(table.column(c)[0].as_buffer(), t).copy() for c, t in (("nulls", np.int64), ("registers", np.uint8)))
    for n, r in zip(table.column("nulls")[1:], table.column("registers")[1:]):
        nulls += np.frombuffer(n.as_buffer(), np.int64)
        np.maximum(registers, np.frombuffer(r.as_buffer(), np.uint8), out=registers)
    return pa.table({"task": table.column("task")[:1], "part": table.column("part")[:1], "nulls": [nulls.tobytes()], "registers": [registers.tobytes()]}).cast(table.schema)


def _sketched(df: DataFrame, columns: list[str], first: tuple[int, int]) -> DataFrame:
    """part, at, nulls, distinct: for each feature of pairs whose first column is in range ``first``; product and ratio take turns."""
    d = len(columns)
    features = sum(2 * (d - 1 - i) for i in range(*first))
    parts = -(-features // GROUP)
    values = F.array(*[col(c).cast("double") for c in columns]).alias("v")
    known = F.array(*[col(c).isNotNull() for c in columns]).alias("known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registers, nulls = np.zeros((parts * GROUP, _M), np.uint8), np.zeros(parts * GROUP, np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                x, there = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) for c in ("v", "known"))
                x, there, at = np.where(there, x, 0.0), there.astype(bool), 0
                for i in range(*first):
                    a, b, both = x[:, i : i + 1], x[:, i + 1 :], there[:, i : i + 1] & there[:, i + 1 :]
                    divisor = b + RATIO_SHIFT
                    with np.errstate(all="ignore"):
                        made = np.stack([a * b, a / divisor], axis=2).reshape(len(x), -1)
                    fine = np.stack([both, both & (divisor != 0)], axis=2).reshape(len(x), -1)
                    _observe(registers[at : at + made.shape[1]], made, fine)
                    nulls[at : at + made.shape[1]] += (~fine).sum(axis=0)
                    at += made.shape[1]
        task = TaskContext.get().partitionId()
        for p in range(parts):
            cut = slice(p * GROUP, (p + 1) * GROUP)
            yield pa.record_batch(
                [pa.array([task], pa.int32()), pa.array([p], pa.int32()), pa.array([nulls[cut].tobytes()], pa.binary()), pa.array([registers[cut].tobytes()], pa.binary())],
                names=["task", "part", "nulls", "registers"],
            )

    def estimates(table: pa.Table) -> pa.Table:
        one = _combine(table)
        nulls = np.frombuffer(one.column("nulls")[0].as_buffer(), np.int64)
        registers = np.frombuffer(one.column("registers")[0].as_buffer(), np.uint8).reshape(GROUP, _M)
        part = one.column("part")[0].as_py()
        return pa.table({"at": pa.array(np.arange(GROUP) + part * GROUP), "nulls": nulls, "distinct": estimate(registers)})

    some = df.select(values, known).mapInArrow(run, _ROW).groupBy("part", (F.col("task") % TASK_GROUPS).alias("g")).applyInArrow(_combine, _ROW)
    return some.groupBy("part").applyInArrow(estimates, "at long, nulls long, distinct double").filter(F.col("at") < features)


def profile_pairs(df: DataFrame, columns: list[str]) -> dict[tuple[str, str, str], ColumnProfile]:
    """Null and distinct counts of the product and the ratio of every pair, by ("x" or "div", first, second).

    Distinct counts are estimates where no limit of the pruning rules is near, else exact.
    """
    if len(columns) < 2:
        return {}
    rows, numbered, at = df.count(), _numbered(len(columns)), 0
    out: dict[tuple[str, str, str], ColumnProfile] = {}
    for first in _passes(len(columns)):
        for r in sorted(_sketched(df, columns, first).collect()):  # three numbers a feature
            i, j = numbered[(at + r["at"]) // 2]
            known = rows - r["nulls"]
            out["div" if r["at"] % 2 else "x", columns[i], columns[j]] = ColumnProfile(rows, r["nulls"], min(round(r["distinct"]), known), None, None)
        at += sum(2 * (len(columns) - 1 - i) for i in range(*first))
    limit = NEAR_UNIQUE * rows
    open_ = [k for k, p in out.items() if p.distinct <= 2 or abs(p.distinct - limit) <= max(1.0, NEAR * limit)]
    for start in range(0, len(open_), COUNTED_TOGETHER):
        some = open_[start : start + COUNTED_TOGETHER]
        made = df.select(*[column(k).alias(f"p{n}") for n, k in enumerate(some)])
        for name, n in distinct_counts(made, made.columns).items():
            p = out[some[int(name[1:])]]
            out[some[int(name[1:])]] = ColumnProfile(p.rows, p.nulls, n, None, None)
    return out


def name_of(key: tuple[str, str, str]) -> str:
    return (product_name if key[0] == "x" else ratio_name)(*key[1:])


def column(key: tuple[str, str, str]) -> Column:
    return (product if key[0] == "x" else ratio)(*key[1:])
