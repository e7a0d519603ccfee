"""Products of all pairs of many columns as a table of blocks, so that no columns x columns matrix has to lie in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.plans.roles import col
from tabweave.session import materialize

BLOCK = 256
"""Columns of a block: a row of the table holds the products of two blocks."""
TILE = 2048
"""Columns whose products a task sums at once; more of them are read in several scans, each of two tiles of columns."""
TASK_GROUPS = 16
"""Partial sums of so many tasks are added up together first."""
PASSES = 8
"""Products with the matrix for each width of the subspace."""
START = 256


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _add(table: pa.Table) -> pa.Table:
    """Sum of the cells of all rows, in the order of their tasks."""
    table = table.sort_by("task")
    total = np.frombuffer(table.column("cells")[0].as_buffer(), np.float64).copy()
    for cell in table.column("cells")[1:]:
        total += np.frombuffer(cell.as_buffer(), np.float64)
    return pa.table({"bi": table.column("bi")[:1], "bj": table.column("bj")[:1], "task": table.column("task")[:1], "cells": pa.array([total.tobytes()], pa.binary())})


def _block(cells: pa.Scalar, rows: int) -> np.ndarray:
    return np.frombuffer(cells.as_buffer(), np.float64).reshape(rows, -1)


_CELLS = "bi int, bj int, task int, cells binary"


class Gram:
    """Centred products of ``columns``: ``blocks`` has rows (bi, bj, cells), bi <= bj, cells the doubles of a block row by row.

    A null or NaN makes all products of its column NaN. ``means`` and ``constant`` say what each column was centred by, and which hold one value only.
    """

    def __init__(self, df: DataFrame, columns: list[str], block: int = BLOCK, tile: int = TILE):
        self.columns, self.block = list(columns), block
        d = len(self.columns)
        values = F.array(*[F.coalesce(col(c).cast("double"), F.lit(float("nan"))) for c in self.columns])
        rows = df.select(values.alias("v"))
        self.n, self.means, self.constant = self._centres(df)
        step = max(block, tile // block * block)
        parts = None
        for i in range(0, d, step):
            for j in range(i, d, step):
                one = self._products(rows, (i, min(i + step, d)), (j, min(j + step, d)))
                parts = one if parts is None else parts.unionByName(one)
        some = parts.groupBy("bi", "bj", (F.col("task") % TASK_GROUPS).alias("g")).applyInArrow(_add, _CELLS)
        summed = some.groupBy("bi", "bj").applyInArrow(_add, _CELLS).select("bi", "bj", "cells")
        self.blocks = materialize(summed, "gram-blocks")

    def _centres(self, df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
        from tabweave.operators.selection import assemble

        if df.isEmpty():
            return 0, np.zeros(len(self.columns)), np.ones(len(self.columns), bool)
        stats = Summarizer.metrics("count", "mean", "min", "max").summary(F.col("features"))
        s = assemble(df, self.columns).agg(stats.alias("s")).first()["s"]
        return s["count"], s["mean"].toArray(), s["min"].toArray() == s["max"].toArray()

    def _products(self, rows: DataFrame, left: tuple[int, int], right: tuple[int, int]) -> DataFrame:
        block, means = self.block, self.means
        same = left == right

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((left[1] - left[0], right[1] - right[0]))
            for batch in batches:
                x = _matrix(batch.column("x"), left[1] - left[0]) - means[slice(*left)]
                y = x if same else _matrix(batch.column("y"), right[1] - right[0]) - means[slice(*right)]
                total += x.T @ y
            task, out = TaskContext.get().partitionId(), []
            for i in range(left[0], left[1], block):
                for j in range(right[0], right[1], block):
                    if i <= j:
                        cells = total[i - left[0] : i - left[0] + block, j - right[0] : j - right[0] + block]
                        out.append((i // block, j // block, task, np.ascontiguousarray(cells).tobytes()))
            for bi, bj, t, cells in out:
                yield pa.record_batch([pa.array([v], k) for v, k in ((bi, pa.int32()), (bj, pa.int32()), (t, pa.int32()), (cells, pa.binary()))], names=["bi", "bj", "task", "cells"])

        x = F.slice("v", left[0] + 1, left[1] - left[0]).alias("x")
        y = [] if same else [F.slice("v", right[0] + 1, right[1] - right[0]).alias("y")]
        return rows.select(x, *y).mapInArrow(run, _CELLS)

    def squares(self) -> np.ndarray:
        """Sum of squares of each centred column; exactly 0 for a constant one."""
        block, d = self.block, len(self.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, cells in zip(batch.column("bi").to_pylist(), batch.column("cells")):
                    yield pa.record_batch([pa.array([b], pa.int32()), pa.array([np.diag(_block(cells, min(block, d - b * block))).tolist()])], names=["b", "squares"])

        found = self.blocks.filter("bi = bj").select("bi", "cells")
        local = {r["b"]: r["squares"] for r in found.mapInArrow(run, "b int, squares array<double>").collect()}
        out = np.array([x for b in sorted(local) for x in local[b]])
        out[self.constant] = 0.0
        return out

    def strong_columns(self, limit: float) -> list[str]:
        """Columns whose correlation with an earlier one is above ``limit`` in magnitude; undefined ones never are."""
        if len(self.columns) < 2 or not self.n:
            return []
        norms = np.sqrt(self.squares())
        block, d = self.block, len(self.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bi, bj, cells in zip(batch.column("bi").to_pylist(), batch.column("bj").to_pylist(), batch.column("cells")):
                    x = _block(cells, min(block, d - bi * block))
                    i, j = np.arange(x.shape[0]) + bi * block, np.arange(x.shape[1]) + bj * block
                    with np.errstate(divide="ignore", invalid="ignore"):
                        r = np.abs(x / norms[i][:, None] / norms[j])
                    found = j[((r > limit) & (i[:, None] < j) & np.isfinite(r)).any(axis=0)]
                    yield pa.record_batch([pa.array(found.astype(np.int32))], names=["j"])

        found = {r["j"] for r in self.blocks.mapInArrow(run, "j int").distinct().collect()}  # a number a column at most
        return [c for j, c in enumerate(self.columns) if j in found]

    def times(self, q: np.ndarray) -> np.ndarray:
        """The symmetric matrix times ``q``: one pass over the blocks."""
        block, d = self.block, len(self.columns)
        shared = self.blocks.sparkSession.sparkContext.broadcast(q)  # columns x subspace

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for bi, bj, cells in zip(batch.column("bi").to_pylist(), batch.column("bj").to_pylist(), batch.column("cells")):
                    x = _block(cells, min(block, d - bi * block))
                    at = bi * block, bj * block
                    pairs = [(bi, x @ shared.value[at[1] : at[1] + x.shape[1]])]
                    if bi != bj:
                        pairs.append((bj, x.T @ shared.value[at[0] : at[0] + x.shape[0]]))
                    for b, y in pairs:
                        total[b] = total[b] + y if b in total else y
            task = TaskContext.get().partitionId()
            for b, y in total.items():
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([0], pa.int32()), pa.array([task], pa.int32()), pa.array([y.tobytes()], pa.binary())], names=["bi", "bj", "task", "cells"])

        found = self.blocks.mapInArrow(run, _CELLS).groupBy("bi").applyInArrow(_add, _CELLS).select("bi", "cells").toArrow().sort_by("bi")
        return np.concatenate([np.frombuffer(c.as_buffer(), np.float64).reshape(-1, q.shape[1]) for c in found.column("cells")])

    def leading(self, share: float, start: int = START) -> tuple[np.ndarray, np.ndarray, float]:
        """Leading eigenvectors (columns), their variances, falling, and the total variance.

        Randomized subspace iteration with ``PASSES`` products; the subspace is doubled until its first half, the part that has settled, holds
        more than ``share`` of the variance, or it is the whole space, which is then solved exactly.
        """
        d, total = len(self.columns), float(self.squares().sum())
        width = min(d, start)
        q = np.linalg.qr(np.random.default_rng(42).standard_normal((d, width)))[0]
        while True:
            for _ in range(PASSES if width < d else 1):
                y = self.times(q)
                values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
                if width == d:
                    break
                q = np.linalg.qr(y)[0]
            if width < d:
                y = self.times(q)
                values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
            values, vectors = np.clip(values[::-1], 0, None), q @ turn[:, ::-1]
            settled = width if width == d else width // 2
            if width == d or values[:settled].sum() > share * total:
                return vectors[:, :settled], values[:settled] / max(self.n - 1, 1), total / max(self.n - 1, 1)
            more = np.random.default_rng(width).standard_normal((d, min(d, 2 * width) - width))
            q = np.linalg.qr(np.hstack([q, more]))[0]
            width = q.shape[1]

