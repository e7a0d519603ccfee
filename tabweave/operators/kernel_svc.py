"""Support vector classifier on random Fourier features that are made again in each pass and never stored."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasRegParam, HasSeed, HasTol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.operators.fourier import SIZE, fourier_weights

#: Rows of a stored block, and rows whose Fourier features are made at once.
BLOCK_ROWS = 8_192
MADE_ROWS = 1_024
#: Bytes of rows that are dealt to blocks by neighbourhood together.
GROUP_BYTES = 16 << 20
#: Largest error of a feature that a block takes from others: root of its mean square, the feature itself being a cosine.
LOST = 1e-6
#: Turns around the middle of a block up to which single precision holds them.
NEAR_TURNS = 4.0
#: Features that a pass makes at once, by rows.
PASS_NUMBERS = 131_072
#: Steps of a line search that one pass tries.
AHEAD = 3
#: cos(pi u) for u in -0.5 to 0.5 by powers of u squared, to within 5e-8.
COSINE = np.array([0.99999995, -4.93479283, 4.05841137, -1.33187662, 0.21968961], "float32")
PARALLEL_CLASSES = 4
MEMORY = 10
VALUES = 20
ARMIJO = 1e-4
WOLFE = 0.9
TRIES = 20


def neighbourhoods(x: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The places of the rows in groups of at most ``most`` that lie close together: halves along the widest side."""
    waiting = [np.arange(len(x))]
    while waiting:
        places = waiting.pop()
        if len(places) <= most:
            yield places
            continue
        part = x[places]
        side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        order = np.argpartition(part[:, side], len(places) // 2)
        waiting += [places[order[: len(places) // 2]], places[order[len(places) // 2 :]]]


def packed(dataset: DataFrame, features: str, label: str, names: tuple[str, ...] = (), more: Callable[..., tuple] = lambda x, y: ()) -> DataFrame:
    """Feature rows and labels as blocks of bytes, neighbours together, which a pass hands to numpy as they are.

    ``more`` gives the arrays of the further columns ``names`` of a block.
    """
    columns = ["x", "y", *names]

    def blocks(rows: list[np.ndarray], labels: list[np.ndarray]):
        x, y = np.concatenate(rows), np.concatenate(labels)
        for places in neighbourhoods(x, BLOCK_ROWS):
            block = x[places], y[places]
            yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()]) for part in (*block, *more(*block))], columns)

    def pack(batches):
        rows, labels, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column(0).null_count:
                raise ValueError("labels and features must not be null, NaN or infinite")
            labels.append(batch.column(1).flatten().to_numpy(zero_copy_only=False))
            rows.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(labels[-1]), -1))
            held += rows[-1].nbytes
            if held >= GROUP_BYTES:
                yield from blocks(rows, labels)
                rows, labels, held = [], [], 0
        if rows:
            yield from blocks(rows, labels)

    rows = dataset.select(vector_to_array(dataset[features]).alias("x"), F.array(dataset[label].cast("double")).alias("y"))
    return rows.mapInArrow(pack, ", ".join(f"{name} binary" for name in columns))


def skeleton(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that the others follow from, and the mix of them that makes each feature: all columns are ``kept @ mix`` to within ``LOST``.

    Pivoted Cholesky steps on the mean products of the features; what is left on the diagonal is the mean squared error of each.
    """
    size = len(gram)
    left, root, kept = gram.diagonal().copy(), np.zeros((size, size)), []
    while np.isfinite(gram).all() and left.max() > LOST * LOST:
        if 2 * len(kept) >= size:
            return np.arange(size), np.eye(size)
        at, n = int(left.argmax()), len(kept)
        root[:, n] = (gram[:, at] - root[:, :n] @ root[at, :n]) / np.sqrt(left[at])
        left -= root[:, n] ** 2
        kept.append(at)
        left[kept] = 0.0
    if not kept:
        return np.arange(size), np.eye(size)
    return np.array(kept), np.linalg.solve(root[kept, : len(kept)].T, root[:, : len(kept)].T)


def condensed(x: np.ndarray, y: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, ...]:
    """The features of a block that a pass must make, the mix for the others, and the sums of all features and of their squares."""
    size = len(shift)
    gram, total = np.zeros((size, size)), np.zeros(size)
    for at in range(0, len(y), MADE_ROWS):
        made = fourier(x[at : at + MADE_ROWS], weights, shift)
        gram += made.T @ made
        total += made.sum(axis=0)
    kept, mix = skeleton(gram * (size / 2 / len(y)))
    if len(kept) == size:
        mix = np.empty(0)
    return kept.astype("int32"), mix.astype("float32"), np.concatenate([[len(y)], total, gram.diagonal(), [y.sum()]])


def summed(blocks: DataFrame, part: Callable[..., np.ndarray], size: int) -> np.ndarray:
    """Sum of ``part`` of the columns of a block, ``size`` numbers, over all blocks: one vector a task comes back."""

    def partial(batches):
        total = np.zeros(size)
        for batch in batches:
            for row in zip(*batch.columns):
                total += part(*[value.as_buffer() for value in row])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["v"])

    return np.sum([r["v"] for r in blocks.mapInArrow(partial, "v array<double>").collect()], axis=0)


def fourier(x: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Fourier features: turns are taken in double precision, the cosine of what is left in single."""
    turns = x @ (weights / (2 * np.pi)) + shift / (2 * np.pi)
    turns -= np.rint(turns)
    left = turns.astype("float32")
    left *= np.float32(2 * np.pi)
    return np.cos(left, out=left).astype(float) * np.sqrt(2 / len(shift))


def half_cosines(x: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> Iterator[np.ndarray]:
    """Squares of the cosines of half the angles, some rows at a time in single precision; a cosine is twice that less one.

    Turns are counted from the middle of the rows, which is taken in double precision, as all are where rows lie far apart. What is
    handed out is overwritten by the next rows.
    """
    middle, turns = x.mean(axis=0), weights / (2 * np.pi)
    start = middle @ turns + shift / (2 * np.pi)
    moved, turns = x - middle, np.vstack([turns, start - np.rint(start)])
    near = (np.abs(moved).max(axis=0) @ np.abs(turns[:-1])).max() <= NEAR_TURNS
    moved = np.hstack([moved, np.ones((len(x), 1))])
    if near:
        moved, turns = moved.astype("float32"), turns.astype("float32")
    rows = max(1, PASS_NUMBERS // len(shift))
    counted = np.empty((min(rows, len(x)), len(shift)), moved.dtype)
    whole, angles = np.empty_like(counted), counted if near else np.empty(counted.shape, "float32")
    made = whole if near else np.empty_like(angles)
    for at in range(0, len(x), rows):
        part = moved[at : at + rows]
        c, w, u, m = (held[: len(part)] for held in (counted, whole, angles, made))
        np.dot(part, turns, out=c)
        np.rint(c, out=w)
        np.subtract(c, w, out=u, casting="same_kind")
        u *= u
        np.multiply(u, COSINE[-1], out=m)
        for power in COSINE[-2:0:-1]:
            m += power
            m *= u
        m += COSINE[0]
        m *= m
        yield m


def minimise(objective: Callable[[list[np.ndarray]], list[tuple[float, np.ndarray]]], start: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """Limited-memory quasi-Newton steps for a loss with kinks; each call of ``objective`` is one pass over the rows.

    Most steps are shortened once or more, so a pass takes the next ``AHEAD`` lengths together.

    A step keeps to directions that go down in every coordinate and to the orthant it starts from, and is shortened or
    lengthened until it meets the strong Wolfe conditions.
    """
    x = start
    value, grad = objective([x])[0]
    first, values = value, [math.inf]
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    reset = False
    iteration = 0
    while iteration < max_iter:
        direction, stack = grad.copy(), []
        for s, y in zip(reversed(steps), reversed(changes)):
            a = (s @ direction) / (s @ y)
            direction -= a * y
            stack.append(a)
        if steps:
            direction *= (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
        for s, y, a in zip(steps, changes, reversed(stack)):
            direction += s * (a - (y @ direction) / (s @ y))
        direction = np.where(direction * grad > 0, -direction, 0.0)
        orthant = np.where(x != 0, np.sign(x), -np.sign(grad))

        slope = grad @ direction
        size, shrink = (0.5 / np.linalg.norm(grad), 0.1) if iteration < 1 else (1.0, 0.5)
        tried: dict[float, tuple[np.ndarray, float, np.ndarray]] = {}

        def moved(size: float) -> tuple[np.ndarray, float, np.ndarray]:
            if size not in tried:
                sizes = [size]
                while len(sizes) < AHEAD:
                    sizes.append(sizes[-1] * shrink)
                ends = [x + s * direction for s in sizes]
                ends = [np.where(np.sign(end) == orthant, end, 0.0) for end in ends]
                tried.update((s, (end, *there)) for s, end, there in zip(sizes, ends, objective(ends)))
            return tried[size]

        found = None
        for _ in range(TRIES + 1):
            there, new, new_grad = moved(size)
            along = new_grad @ direction
            if new > value + size * slope * ARMIJO:
                size *= shrink
            elif along < WOLFE * slope:
                size *= 2.1
            elif along > -WOLFE * slope:
                size *= shrink
            else:
                found = there, new, new_grad
                break
            if not 1e-10 <= size <= 1e10:
                break
        if found is None:
            if reset:
                break
            # once, the search starts anew without what it has seen
            steps, changes, reset = [], [], True
            continue
        there, new, new_grad = found
        steps, changes = [*steps, there - x][-MEMORY:], [*changes, new_grad - grad][-MEMORY:]
        x, value, grad = there, new, new_grad
        values = [*values, value][-VALUES:]
        iteration += 1
        if abs(value - max(values)) <= tol * first or np.linalg.norm(grad) <= max(tol * abs(value), 1e-8):
            break
    return x


class _KernelParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    width = Param(Params._dummy(), "width", "input dimensions", TypeConverters.toInt)
    size = Param(Params._dummy(), "size", "Fourier features", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes; labels are 0 to classes - 1", TypeConverters.toInt)

    def _defaults(self):
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", gamma=1.0, width=1, size=SIZE, classes=2, seed=42)

    def _map(self) -> tuple[np.ndarray, np.ndarray]:
        return fourier_weights(*(self.getOrDefault(p) for p in (self.seed, self.gamma, self.width, self.size)))


class KernelSVC(Estimator, _KernelParams, HasMaxIter, HasRegParam, HasTol, DefaultParamsReadable, DefaultParamsWritable):
    """Hinge loss on Fourier features with a ridge; more than two classes are one against the rest.

    The input rows are kept, packed in blocks of neighbours. Their features, many times wider, live for ``MADE_ROWS`` rows at a time. In a
    block many of them follow from others, which are all that a pass makes; a block that needs most of them makes all.
    """

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", gamma=1.0, width=1, size=SIZE, classes=2, regParam=0.0, maxIter=100, tol=1e-6, seed=42):
        super().__init__()
        self._defaults()
        self._setDefault(regParam=0.0, maxIter=100, tol=1e-6)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> KernelSVCModel:
        weights, shift = self._map()
        size, ridge = len(shift), self.getRegParam()
        columns = self.getFeaturesCol(), self.getLabelCol()
        blocks = packed(dataset, *columns, ("kept", "mix", "sums"), lambda x, y: condensed(x, y, weights, shift)).persist(StorageLevel.MEMORY_AND_DISK)
        sums = summed(blocks.select("sums"), np.frombuffer, 2 * size + 2)
        n = sums[0]
        if not n:
            raise ValueError("no rows to fit")
        if not np.isfinite(sums).all():
            raise ValueError("labels and features must not be null, NaN or infinite")
        mean = sums[1 : size + 1] / n
        spread = np.sqrt(np.maximum((sums[size + 1 : -1] - n * mean * mean) / max(n - 1, 1), 0.0))
        scale = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1.0), 0.0)

        def fitted(c: int) -> list[float]:
            def objective(points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
                plains = np.array([w[:-1] * scale for w in points])
                bases = np.array([w[-1] for w in points]) - plains @ mean

                def part(x, y, kept, mix):
                    side = np.where(np.frombuffer(y) == c, np.float32(1), np.float32(-1))
                    chosen, mixed = np.frombuffer(kept, "int32"), None if not mix.size else np.frombuffer(mix, "float32").reshape(-1, size)
                    short = plains[:, chosen] if mixed is None else plains @ mixed.T.astype(float)
                    # a feature is high times the square of a cosine, less half of high
                    high = 2 * np.sqrt(2 / size)
                    lines, starts = (high * short).astype("float32"), (bases - high / 2 * short.sum(axis=1)).astype("float32")
                    out, gone = np.zeros((len(points), len(chosen))), np.zeros((len(points), 2))
                    at, rows = 0, np.frombuffer(x).reshape(len(side), -1)
                    for made in half_cosines(rows, weights[:, chosen], shift[chosen]):
                        sides = side[at : at + len(made)]
                        at += len(made)
                        for k, (line, start) in enumerate(zip(lines, starts)):
                            lost = made @ line
                            lost += start
                            lost *= sides
                            np.subtract(1, lost, out=lost)
                            pulled = sides * (lost > 0)
                            out[k] -= pulled @ made
                            gone[k] += -pulled.sum(dtype=float), np.maximum(lost, 0, out=lost).sum(dtype=float)
                    out = high * out - high / 2 * gone[:, :1]
                    return np.hstack([out if mixed is None else out @ mixed, gone]).ravel()

                totals = summed(blocks.select("x", "y", "kept", "mix"), part, len(points) * (size + 2)).reshape(len(points), -1) / n
                found = []
                for total, plain in zip(totals, plains):
                    grad = np.append((total[:size] - total[size] * mean) * scale, total[size])
                    grad[:-1] += ridge * plain * scale
                    found.append((total[-1] + ridge * (plain @ plain) / 2, grad))
                return found

            w = minimise(objective, np.zeros(size + 1), self.getMaxIter(), self.getTol())
            plain = w[:-1] * scale
            return [*plain.tolist(), float(w[-1] - plain @ mean)]

        classes = self.getOrDefault(self.classes)
        try:
            with ThreadPoolExecutor(PARALLEL_CLASSES) as pool:
                found = list(pool.map(fitted, [1] if classes <= 2 else range(classes)))
        finally:
            blocks.unpersist()
        model = KernelSVCModel()
        self._copyValues(model)
        return model._set(weights=[v for row in found for v in row])


class KernelSVCModel(Model, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    """The class on the positive side of the margin, or of the largest margin."""

    weights = Param(Params._dummy(), "weights", "coefficients, then the intercept, of each margin", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()
        self._defaults()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, shift = self._map()
        margins = np.array(self.getOrDefault(self.weights)).reshape(-1, len(shift) + 1)

        @F.arrow_udf("double")
        def predict(batch: pa.Array) -> pa.Array:
            if batch.null_count:
                raise ValueError("features must not be null")
            rows, out = batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(weights)), [np.empty(0)]
            for at in range(0, len(batch), MADE_ROWS):
                made = fourier(rows[at : at + MADE_ROWS], weights, shift)
                found = made @ margins[:, :-1].T + margins[:, -1]
                out.append((found[:, 0] > 0 if len(margins) == 1 else found.argmax(axis=1)).astype(float))
            return pa.array(np.concatenate(out))

        return dataset.withColumn(self.getPredictionCol(), predict(vector_to_array(dataset[self.getFeaturesCol()])))
