"""Exact distributed k-nearest-neighbour join.

Rows are grouped in cells round a bounded set of pivots. The triangle inequality gives each query
an upper bound on its k-th distance, and with it the few cells that can hold a neighbour, so
queries meet training rows through an equi-join on the cell (the scheme of Lu et al., "Efficient
Processing of k Nearest Neighbor Joins using MapReduce", VLDB 2012). Small cells are bundled, so that a
query is sent once for a bundle and not for each cell; large ones and the queries of a bundle are split
into parcels of bounded size, and each pair of parcels is a task. Inside, tiles of distances are screened
by cheap arithmetic against the k-th distance found so far; only k rows per query leave a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabweave.session import materialize

TRAIN_BLOCK = 16_384
QUERY_BLOCK = 4_096
ROWS_PER_CELL = 4_096
MAX_CELLS = 256
#: Rows of either side that one task gets: an eighth of the training rows within these limits. What is sent is rows times parcels.
PARCELS = 8
LEAST_PARCEL = 4_096
MOST_PARCEL = 65_536
#: A tile of distances stays in the processor's cache.
QUERY_TILE = 256
TRAIN_TILE = 2_048
SLACK = 1e-9
SCREEN_ERROR = 1e-12
#: Sums of 16-bit steps, and up to how many entries a vector is rounded to them.
MOST_STEPS = 32_000
MOST_STEPPED = 1_000


def distances(left: np.ndarray, right: np.ndarray, p: int) -> np.ndarray:
    """Minkowski distances between all rows of two small matrices."""
    total = np.zeros((len(left), len(right)))
    for i in range(left.shape[1]):
        gap = left[:, i, None] - right[None, :, i]
        total += np.abs(gap) if p == 1 else gap * gap
    return total if p == 1 else np.sqrt(total)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.vstack(values.to_numpy()).astype(float)


def _nearest_pivot(pivots: np.ndarray, p: int):
    @pandas_udf("struct<cell:int,gap:double>")
    def assign(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"cell": [], "gap": []})
        gaps = distances(_matrix(vectors), pivots, p)
        cell = gaps.argmin(axis=1)
        return pd.DataFrame({"cell": cell, "gap": gaps[np.arange(len(cell)), cell]})

    return assign


def _candidate_cells(pivots: np.ndarray, near: np.ndarray, inner: np.ndarray, outer: np.ndarray, k: int, p: int):
    """Cells that may hold one of a query's k nearest rows.

    ``near[j]`` lists the k smallest pivot distances in cell j, ``inner`` and ``outer`` its radii.
    """

    @pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return vectors
        gaps = distances(_matrix(vectors), pivots, p)
        out = []
        for row in gaps:
            reach = np.sort((row[:, None] + near).ravel())
            bound = reach[k - 1] if len(reach) >= k else math.inf
            bound += SLACK * (1 + abs(bound)) if math.isfinite(bound) else 0.0
            fits = (row - outer <= bound) & (inner - row <= bound)
            out.append(np.flatnonzero(fits).astype("int32"))
        return pd.Series(out)

    return cells


def _exact(left: np.ndarray, right: np.ndarray, p: int) -> np.ndarray:
    """Distances of row pairs."""
    gap = left - right
    return np.cumsum(np.abs(gap), axis=1)[:, -1] if p == 1 else np.sqrt((gap * gap).sum(axis=1))


class _Squares:
    """Screen for p = 2: one matrix product a tile. Its rounding error is bounded, so every true neighbour passes."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right
        self.asked, self.norms = (left * left).sum(axis=1), (right * right).sum(axis=1)
        self.slack = 2 * SCREEN_ERROR * (self.asked + self.norms.max(where=np.isfinite(self.norms), initial=0.0))

    def rough(self, rows: np.ndarray, columns: slice) -> np.ndarray:
        out = -2 * self.left[rows] @ self.right[columns].T
        out += self.norms[columns]
        out += self.asked[rows, None]
        return out

    def limit(self, rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return bound * bound * (1 + SCREEN_ERROR) + self.slack[rows]


class _Steps:
    """Screen for p = 1: vectors rounded to 16-bit steps, half a step off at most, so a sum over d entries is off by d steps at most."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        low, high = min(left.min(), right.min()), max(left.max(), right.max())
        width = left.shape[1]
        self.fine = bool(np.isfinite(high - low)) and high > low and width <= MOST_STEPPED
        if self.fine:
            self.step = (high - low) / (MOST_STEPS // width)
            left, right = (np.rint((x - low) / self.step).astype("int16") for x in (left, right))
        self.left, self.right, self.width = left, np.ascontiguousarray(right.T), width

    def rough(self, rows: np.ndarray, columns: slice) -> np.ndarray:
        left, right = self.left[rows], self.right[:, columns]
        total = np.zeros((len(left), right.shape[1]), left.dtype)
        gap = np.empty_like(total)
        for i in range(self.width):
            np.subtract(left[:, i, None], right[i], out=gap)
            np.abs(gap, out=gap)
            np.add(total, gap, out=total)
        return total

    def limit(self, rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
        if not self.fine:
            return bound * (1 + SCREEN_ERROR)
        return np.minimum(np.floor(bound / self.step * (1 + SCREEN_ERROR)) + self.width + 1, MOST_STEPS).astype("int16")


class _Nearest:
    """The k nearest rows found so far for a few queries, by distance, then id."""

    def __init__(self, count: int, k: int, ids: np.ndarray):
        self.k, self.ids = k, ids
        self.bound = np.full(count, math.inf)
        self.rows, self.columns, self.gaps = np.empty(0, int), np.empty(0, int), np.empty(0)

    def lower(self, rows: np.ndarray, gaps: np.ndarray) -> None:
        """No k-th distance of these rows is above the largest of k known distances."""
        self.bound[rows] = np.fmin(self.bound[rows], np.where(np.isnan(gaps).any(axis=1), math.inf, gaps.max(axis=1)))

    def add(self, rows: np.ndarray, columns: np.ndarray, gaps: np.ndarray) -> None:
        rows, columns, gaps = (np.concatenate(x) for x in ((self.rows, rows), (self.columns, columns), (self.gaps, gaps)))
        order = np.lexsort((self.ids[columns], gaps, rows))
        rows, columns, gaps = rows[order], columns[order], gaps[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
        self.rows, self.columns, self.gaps = rows[first], columns[first], gaps[first]
        full = np.flatnonzero(np.bincount(self.rows, minlength=len(self.bound)) == self.k)
        self.bound[full] = np.fmin(self.bound[full], self.gaps[np.searchsorted(self.rows, full, side="right") - 1])


def _nearest(left: np.ndarray, reached: np.ndarray, right: np.ndarray, cell: np.ndarray, ids: np.ndarray, k: int, p: int, tile: tuple[int, int]):
    """Rows, columns and distances of the k nearest ``right`` rows of each ``left`` row among the cells it reaches.

    ``reached`` has a row for each ``left`` row and a column for each of the cells by which ``right`` is ordered. Tiles are screened
    against the k-th distance found so far, and only what passes is measured exactly.
    """
    screen = _Steps(left, right) if p == 1 else _Squares(left, right)
    starts = np.append(np.searchsorted(cell, np.unique(cell)), len(cell))
    for start in range(0, len(left), tile[0]):
        asking = reached[start : start + tile[0]]
        best = _Nearest(len(asking), k, ids)
        for c, (first, last) in enumerate(zip(starts, starts[1:])):
            here = np.flatnonzero(asking[:, c])
            for at in range(first, last if len(here) else first, tile[1]):
                columns = slice(at, min(last, at + tile[1]))
                rough = screen.rough(start + here, columns)
                unbounded = np.flatnonzero(np.isinf(best.bound[here]))
                if len(unbounded) and k < rough.shape[1]:
                    some = at + np.argpartition(rough[unbounded], k - 1, axis=1)[:, :k]
                    known = _exact(left[start + np.repeat(here[unbounded], k)], right[some.ravel()], p)
                    best.lower(here[unbounded], known.reshape(-1, k))
                i, j = np.divmod(np.flatnonzero(rough <= screen.limit(start + here, best.bound[here])[:, None]), rough.shape[1])
                if len(i):
                    best.add(here[i], at + j, _exact(left[start + here[i]], right[at + j], p))
        yield start + best.rows, best.columns, best.gaps


def _parcel_top_k(k: int, p: int, tile: tuple[int, int]):
    """The k nearest rows of each query of one parcel among one parcel of training rows."""

    def top_k(queries: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": [], "train_id": [], "label": [], "distance": []})]
        if len(queries) and len(train):
            train = train.sort_values("cell")
            left, right = _matrix(queries["query_vector"]), _matrix(train["train_vector"])
            asked, ids, labels, cell = (x.to_numpy() for x in (queries["query_id"], train["train_id"], train["label"], train["cell"]))
            wanted = np.concatenate(queries["cells"].to_numpy())
            reached = np.zeros((len(left), max(cell.max(), wanted.max()) + 1), bool)
            reached[np.repeat(np.arange(len(left)), queries["cells"].map(len)), wanted] = True
            reached = reached[:, np.unique(cell)]
            # queries of the same cells lie together, so that few tiles are half empty
            order = np.lexsort(reached.T)
            for rows, columns, gaps in _nearest(left[order], reached[order], right, cell, ids, k, p, tile):
                parts.append(pd.DataFrame({"query_id": asked[order][rows], "train_id": ids[columns], "label": labels[columns], "distance": gaps}))
        return pd.concat(parts[1:]) if len(parts) > 1 else parts[0]

    return top_k


def _chained(pivots: np.ndarray, p: int) -> list[int]:
    """Cells in an order in which near ones mostly follow each other."""
    left, order = set(range(1, len(pivots))), [0]
    while left:
        rest = sorted(left)
        gaps = distances(pivots[order[-1:]], pivots[rest], p)[0]
        order.append(rest[int(gaps.argmin())])
        left.discard(order[-1])
    return order


def _bundles(order: list[int], sizes: dict[int, int], most: int) -> list[int]:
    """The bundle of each cell: neighbours in ``order`` share one up to ``most`` rows; a larger cell is alone."""
    out, bundle, rows = [0] * len(order), 0, 0
    for cell in order:
        n = sizes.get(cell, 0)
        if rows and rows + n > most:
            bundle, rows = bundle + 1, 0
        out[cell], rows = bundle, rows + n
    return out


def _parcels(queries: DataFrame, placed: DataFrame, reach, pivots: np.ndarray, sizes: dict[int, int], p: int, parcel: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with keys bundle, qb and tb, each row once for each parcel of the other side that it meets."""
    bundles = _bundles(_chained(pivots, p), sizes, parcel)
    bundle_of = F.array(*[F.lit(b) for b in bundles])

    def bundle(cell: Column) -> Column:
        return F.element_at(bundle_of, cell + 1)

    spread = queries.select("query_id", "query_vector", reach("query_vector").alias("reached"))
    spread = spread.select("*", F.explode(F.array_distinct(F.transform("reached", bundle))).alias("bundle"))
    spread = spread.select("query_id", "query_vector", "bundle", F.filter("reached", lambda c: bundle(c) == F.col("bundle")).alias("cells"))
    asked = {r["bundle"]: r["count"] for r in spread.groupBy("bundle").count().collect()}
    held = {}
    for cell, n in sizes.items():
        held[bundles[cell]] = held.get(bundles[cell], 0) + n

    def parts(counts: dict) -> Column:
        wanted = [max(1, math.ceil(counts.get(b, 0) / parcel)) for b in range(max(bundles) + 1)]
        return F.element_at(F.array(*[F.lit(w) for w in wanted]), F.col("bundle") + 1)

    n_train, n_query = parts(held), parts(asked)

    def every(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), count - 1))

    def own(key: str, count: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(17), key), count).cast("int")

    left = spread.select("*", own("query_id", n_query).alias("qb"), every(n_train).alias("tb"))
    right = placed.drop("gap").withColumns({"place": F.monotonically_increasing_id(), "bundle": bundle(F.col("cell"))})
    right = right.select("*", own("place", n_train).alias("tb"), every(n_query).alias("qb")).drop("place")
    return left, right


def knn_join(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    p: int = 2,
    cells: int | None = None,
    train_block: int = TRAIN_BLOCK,
    query_block: int = QUERY_BLOCK,
    parcel: int | None = None,
) -> DataFrame:
    """``(query_id, train_id, label, distance, rank)`` of the k nearest training rows of every query.

    ``queries`` has ``query_id bigint, query_vector array<double>`` and ``train`` has
    ``train_id bigint, train_vector array<double>, label double``; query ids are unique, and training
    rows that share an id are equal rows. Ties go to the smaller id. ``train_block`` and ``query_block`` bound the rows whose distances
    are one matrix, ``parcel`` the rows that a task gets of either side.
    """
    if p not in (1, 2):
        raise ValueError("p is 1 or 2")
    total = train.count()
    if cells is None:
        cells = max(1, min(MAX_CELLS, total // ROWS_PER_CELL))
    if parcel is None:
        parcel = max(LEAST_PARCEL, min(MOST_PARCEL, math.ceil(total / PARCELS)))
    chosen = train.orderBy(F.xxhash64("train_id"), "train_id").limit(cells).select("train_vector").collect()
    if not chosen:
        return queries.sparkSession.createDataFrame([], "query_id bigint, train_id bigint, label double, distance double, rank int")
    pivots = np.array([r["train_vector"] for r in chosen], dtype=float)
    placed = train.select("*", _nearest_pivot(pivots, p)("train_vector").alias("at")).select(
        "train_id", "train_vector", "label", F.col("at.cell").alias("cell"), F.col("at.gap").alias("gap")
    )
    placed = materialize(placed, "knn-cells")

    nearest = Window.partitionBy("cell").orderBy("gap")
    near = np.full((len(pivots), k), math.inf)
    first = placed.select("cell", "gap", F.row_number().over(nearest).alias("r")).where(F.col("r") <= k)
    for row in first.collect():
        near[row["cell"], row["r"] - 1] = row["gap"]
    inner, outer = np.full(len(pivots), math.inf), np.full(len(pivots), -math.inf)
    sizes = {}
    for row in placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("gap").alias("a"), F.max("gap").alias("b")
    ).collect():
        sizes[row["cell"]], inner[row["cell"]], outer[row["cell"]] = row["n"], row["a"], row["b"]

    reach = _candidate_cells(pivots, near, inner, outer, k, p)
    left, right = _parcels(queries, placed, reach, pivots, sizes, p, parcel)
    keys = ["bundle", "qb", "tb"]
    tile = min(query_block, QUERY_TILE), min(train_block, TRAIN_TILE)
    pairs = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(_parcel_top_k(k, p, tile), "query_id bigint, train_id bigint, label double, distance double")
    )
    best = Window.partitionBy("query_id").orderBy("distance", "train_id")
    return pairs.select("*", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k)


def neighbour_weight(weights: str) -> Column:
    """Weight of a neighbour; with ``distance`` a neighbour at distance 0 silences the others."""
    if weights == "uniform":
        return F.lit(1.0)
    if weights != "distance":
        raise ValueError(f"unknown weights '{weights}'")
    closest = F.min("distance").over(Window.partitionBy("query_id"))
    return F.when(closest == 0, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance"))


def vote(neighbours: DataFrame, weights: str = "uniform") -> DataFrame:
    """``(query_id, prediction)``: the label with most weight, the smaller on ties."""
    weighed = neighbours.select("query_id", "label", neighbour_weight(weights).alias("w"))
    summed = weighed.groupBy("query_id", "label").agg(F.sum("w").alias("w"))
    best = summed.groupBy("query_id").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("b"))
    return best.select("query_id", F.col("b.label").alias("prediction"))


def average(neighbours: DataFrame, weights: str = "uniform") -> DataFrame:
    """``(query_id, prediction)``: the weighted mean of the neighbours' labels."""
    weighed = neighbours.select("query_id", "label", neighbour_weight(weights).alias("w"))
    return weighed.groupBy("query_id").agg((F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("prediction"))
