"""Embedding whitening: the leading components of the covariance by contour integration (FEAST), and rows in their coordinates.

The covariance is summed on the executors. Its spectrum is then cut into intervals, and each is solved by itself: a quadrature of shifted
solves along a circle around the interval, the inverse of (z I - V) at complex points z, projects a few random vectors onto the
eigenvectors inside; Rayleigh-Ritz takes these out of the small subspace, and both are repeated until the residuals vanish. The number of
eigenvalues in an interval is known beforehand from inertia: the signs of a symmetric factorization of V - s I at both ends, so
none can be missed. The intervals are tasks of a Spark job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.common import small_batches
from tabweave.session import materialize

# fixed values of the task
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16

#: Quadrature points on the upper half of a circle; the lower half is their mirror image.
POINTS = 8
#: Eigenvalues of an interval, if a cut between them can be found.
PER_INTERVAL = 8
ROUNDS = 60
#: Partial sums of so many tasks are added up together.
TASK_GROUPS = 64
#: Sums in integers stay exact up to here.
EXACT = 1 << 62


class Missed(ArithmeticError):
    """The eigenvalues found in an interval are not as many as inertia counts."""


def inertia_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` are above ``shift``.

    Signs of the pivots of a symmetric factorization of v - shift * I, by Bunch and Parlett's complete pivoting: a 2 x 2 pivot
    has one eigenvalue of each sign.
    """
    a = v - shift * np.eye(len(v))
    positive = 0
    while len(a):
        n = len(a)
        diagonal = np.abs(np.diag(a))
        off = np.abs(a - np.diag(np.diag(a)))
        r, s = np.unravel_index(int(off.argmax()), off.shape)
        d = int(diagonal.argmax())
        if diagonal[d] == 0 and off[r, s] == 0:
            return positive
        pivot = [d] if diagonal[d] >= 0.6403882032022076 * off[r, s] else [int(r), int(s)]  # (1 + sqrt 17) / 8
        positive += int(a[d, d] > 0) if len(pivot) == 1 else 1
        rest = np.setdiff1d(np.arange(n), pivot)
        part = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - part @ np.linalg.solve(a[np.ix_(pivot, pivot)], part.T)
        a = (a + a.T) / 2
    return positive


def intervals(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues in it) for intervals, from the highest, that hold the ``k`` largest positive eigenvalues.

    Cuts come from bisection by inertia. Eigenvalues that lie too close for a cut stay in one interval. Eigenvalues which rounding can't tell
    from 0 are in none.
    """
    top = float(np.abs(v).sum(axis=1).max(initial=0.0))  # no eigenvalue is larger
    floor = float(top * len(v) * np.finfo(float).eps * 4)
    if top <= 0:
        return []
    todo = [(floor, top * (1 + 1e-12), 0, inertia_above(v, floor))]  # low, high, eigenvalues above high, above low
    out = []
    while todo:
        low, high, above, below = todo.pop()
        if below == above or above >= k:
            continue
        if below - above <= PER_INTERVAL or high - low <= 1e-9 * top:
            out.append((low, high, below - above))
            continue
        middle = (low + high) / 2
        inside = inertia_above(v, middle)
        todo += [(low, middle, inside, below), (middle, high, above, inside)]  # the higher part is taken first
    return out


def feast(v: np.ndarray, low: float, high: float, expected: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in (low, high], falling, and their unit eigenvectors as rows; raises where they are not ``expected`` many."""
    d = len(v)
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi / 2 * (nodes + 1)
    centre, radius = (low + high) / 2, (high - low) / 2
    size = min(d, 2 * expected + 4)
    rng = np.random.default_rng(0)
    scale = np.abs(v).sum(axis=1).max()
    while True:
        q, last = rng.standard_normal((d, size)), np.inf
        for _ in range(ROUNDS):
            made = np.zeros((d, q.shape[1]))
            for angle, weight in zip(angles, weights):
                turn = radius * np.exp(1j * angle)
                solved = np.linalg.solve((centre + turn) * np.eye(d) - v, q.astype(complex))
                made += weight / 2 * (turn * solved).real
            basis, sizes, _ = np.linalg.svd(made, full_matrices=False)
            q = basis[:, sizes > sizes[0] * 1e-14]
            values, turn_ = np.linalg.eigh(q.T @ v @ q)
            q = q @ turn_
            inside = (values > low) & (values <= high)
            error = np.linalg.norm(v @ q[:, inside] - q[:, inside] * values[inside], axis=0).max(initial=0.0)
            if int(inside.sum()) == expected and (error <= 4 * np.finfo(float).eps * scale or error >= last / 2 and error <= 1e-12 * scale):
                order = np.argsort(-values[inside])
                return values[inside][order], q[:, inside].T[order]
            last = error
        if size == d:
            raise Missed(f"{int(inside.sum())} of {expected} eigenvalues found between {low} and {high}")
        size = min(d, 2 * size)  # too many neighbours just outside


@dataclass
class Whitening:
    """A fitted whitening: sums S and number n of the fit list, components as rows, their eigenvalues, and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def gaps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S of integer rows, exactly: as integers that may be Python's, and as doubles."""
        largest = max(int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums))
        kind = np.int64 if largest < EXACT else object
        exact = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return exact, exact.astype(np.float64)

    def whiten(self, gaps: np.ndarray) -> np.ndarray:
        return gaps @ self.components.T / (self.n * np.sqrt(self.values))


def integers(vectors: DataFrame) -> DataFrame:
    """id and x, the entries as integers, of ``vectors`` (id, vector) that are whole: not null or empty, without nulls, all finite.

    An entry too large for a long is the largest one. Vectors whose length is not that of most whole ones (of equally many, the shortest)
    are left out too.
    """
    entries = F.col("vector").cast("array<double>")
    kept = vectors.select("id", entries.alias("e")).filter(F.col("e").isNotNull() & (F.size("e") > 0))
    kept = kept.filter(F.forall("e", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False))))  # NaN is above infinity
    made = materialize(kept.select("id", F.transform("e", lambda e: F.floor(e * SCALE) + SHIFT).alias("x")), "whitening-rows")
    sizes = made.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), "d").limit(2).collect()
    return made.filter(F.size("x") == most[0]["d"]) if len(most) > 1 else made


def _matrix(part: pa.RecordBatch) -> np.ndarray:
    lists = part.column("x")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and their sum in each dimension, exactly."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for part in parts:
            x = _matrix(part)
            if len(x):
                kind = np.int64 if int(np.abs(x).max()) * len(x) < EXACT else object
                total = [a + int(b) for a, b in zip(total or [0] * x.shape[1], x.sum(axis=0, dtype=kind))]
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "s"])

    found = fit.mapInArrow(run, "i int, s decimal(38, 0)").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return fit.count(), [int(r["s"]) for r in found]


def _gram(fit: DataFrame, rows: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``rows`` of the fit list, and of their products; added up on the executors, row by row of the result."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            z = rows(_matrix(part))
            z = np.hstack([np.ones((len(z), 1)), z])
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            n, task = len(total), TaskContext.get().partitionId()
            yield pa.record_batch([pa.array([task] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["task", "i", "row"])

    def add(table: pa.Table) -> pa.Table:
        rows_ = table.sort_by("task").column("row").combine_chunks()
        total = rows_.flatten().to_numpy().reshape(len(rows_), -1).sum(axis=0)
        first = table.slice(0, 1)
        return pa.table({"task": first.column("task"), "i": first.column("i"), "row": pa.array([total], pa.list_(pa.float64()))})

    schema = "task int, i int, row array<double>"
    some = fit.mapInArrow(run, schema).groupBy("i", (F.col("task") % TASK_GROUPS).alias("g")).applyInArrow(add, schema)
    every = some.groupBy("i").applyInArrow(add, schema).select("i", "row").toArrow().sort_by("i")
    if not every.num_rows:
        return np.zeros(0), np.zeros((0, 0))
    total = np.array(every.column("row").to_pylist())
    return total[0, 1:], total[1:, 1:]


def _solved(spark: SparkSession, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest positive eigenvalues and their unit eigenvectors as rows; a task an interval."""
    parts = intervals(v, k)
    if not parts:
        return np.zeros(0), np.zeros((0, len(v)))
    shared = spark.sparkContext.broadcast(v)  # a row and a column for each dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, n in zip(*(c.to_pylist() for c in batch.columns)):
                values, vectors = feast(shared.value, low, high, n)
                yield pa.record_batch([pa.array(values), pa.array(list(vectors), pa.list_(pa.float64()))], names=["value", "vector"])

    asked = spark.createDataFrame(parts, "low double, high double, n int").repartition(len(parts))
    found = asked.mapInArrow(run, "value double, vector array<double>").toArrow().sort_by([("value", "descending")])
    return found.column("value").to_numpy()[:k], np.array(found.column("vector").to_pylist())[:k]


def fit_whitening(rows: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Fit on each different ``x`` of ``rows`` once; None where there are no rows."""
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    n, sums = _sums(fit)
    if not n:
        return None
    none = np.zeros((0, len(sums)))
    made = Whitening(n, sums, none, np.zeros(0), 0.0)
    v = _gram(fit, lambda x: made.gaps(x)[1] / made.n)[1] / n
    made.values, made.components = _solved(rows.sparkSession, v, k)
    made.trace = float(np.trace(v))
    if len(made.values):
        sums_, products = _gram(fit, lambda x: made.whiten(made.gaps(x)[1]))
        covariance = products / n - np.outer(sums_ / n, sums_ / n)
        made.identity_error = float(np.abs(covariance - np.eye(len(covariance))).max())
    return made


_WHITE = "id {}, component int, n long, deviation decimal(38, 0), whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """A row for each of ``rows`` (id, x) and component: id, component, n, deviation, whitened, explained, identity_error."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fitted.values)
        for part in parts:
            exact, gaps = fitted.gaps(_matrix(part))
            if exact.dtype != object and float(np.square(gaps).sum(axis=1).max(initial=0.0)) >= EXACT:
                exact = exact.astype(object)
            squares = (exact * exact).sum(axis=1)
            deviation = pa.array([Decimal(int(s)) for s in squares], pa.decimal128(38, 0))
            row = pa.array(np.repeat(np.arange(part.num_rows), k))
            many = len(row)
            yield pa.record_batch(
                [
                    part.column("id").take(row),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)),
                    pa.array(np.full(many, fitted.n)),
                    deviation.take(row),
                    pa.array(fitted.whiten(gaps).reshape(-1)),
                    pa.array(np.tile(fitted.values / fitted.trace, part.num_rows)),
                    pa.array(np.full(many, fitted.identity_error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = _WHITE.format(rows.schema["id"].dataType.simpleString())
    if not len(fitted.values):
        return rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(run, schema)


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every whole vector of ``vectors`` (id, vector), a row for each component.

    Entries become floor(64 * entry) + 1000000. The fit list is each different vector once: n of them, with sums S. Components are
    the unit eigenvectors of its covariance, the largest eigenvalue first, at most ``k``, and only those whose eigenvalue rounding
    can tell from 0: one different vector, or none, gives no rows. deviation is the sum of (n * x - S)^2, exact;
    explained the eigenvalue's share of the trace; identity_error how far the covariance of the coordinates is from
    the identity. Null vectors and those with null or not finite entries go, and so do those that :func:`integers` leaves out. Rows
    that repeat an id, or have none, are rows of their own; other columns are ignored. The driver and a task hold a row and a column
    for each dimension, whatever the number of rows.
    """
    small_batches(vectors.sparkSession)
    rows = integers(vectors.select("id", "vector"))
    fitted = fit_whitening(rows, k)
    return whitened(rows, fitted or Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0))
