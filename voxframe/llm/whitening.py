"""Whitening of vectors: leading components by Chebyshev-filtered subspace iteration over distributed passes.

The covariance is never formed. A pass sends a thin matrix Q to every task; each task centres its rows and adds up
``Xᵀ(XQ)``, the sums meet in a few tasks and then on the driver (vector length x columns of Q). A round runs a Chebyshev
polynomial of the covariance over the columns that are not certified yet: the recurrence keeps the spectrum below the
smallest Ritz value within [-1, 1] and lets what lies above grow. QR and Rayleigh-Ritz follow. A component counts as
certified when its residual is at rounding level; certified ones are locked and projected out of the rest.

Components are floored to integers, ``floor(scale * c) + offset``. Sums are exact integers; rows are centred by an
integer near the mean and then by the rest of it, so a large offset costs no digits.

Defined results: vectors that are null, empty or hold null or non-finite entries are dropped, and so are those of another
length than the commonest (of equally common lengths, the smallest). Integers beyond 2^52 count as 2^52. Components whose
eigenvalue is zero but for rounding have no whitened value and no rows, so one row alone, equal rows and empty tables
give none. A deviation beyond a long is null. Rows that repeat an id, or have none, count and are returned each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.session import materialize

#: Columns beside the wanted ones; they part the wanted spectrum from the rest.
GUARD = 16
#: Longest polynomial, and how much it may enlarge one column over another.
DEGREE, SPREAD = 32, 1e8
#: Rounds at most, and the residual of a certified component, relative to the largest eigenvalue and for each dimension.
ROUNDS, RESIDUAL = 200, 1e-15
#: Integers beyond this count as this.
LARGEST = 1 << 52
#: Components that are worked on at a time, and partial sums that the driver adds up itself.
PART, DIRECT = 1 << 20, 64

Apply = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Fit:
    """Count and exact sums of the integer rows, the leading eigenpairs of their covariance, and its trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def base(self) -> np.ndarray:
        """Integers near the means."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the means have beyond ``base``."""
        return np.array([s % self.n / self.n for s in self.sums])


def integers(vectors: DataFrame, *, vector_col: str, id_col: str, scale: int, offset: int) -> tuple[DataFrame, int]:
    """``id, x`` as a written table, and the length: floored vectors of the commonest length, as blobs of 8 byte integers."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(fine)
    length = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = length["dim"] if length else 0
    kind = rows.schema["id"].dataType.simpleString()

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            whole = np.floor(np.clip(values * scale, -LARGEST, LARGEST)).astype(np.int64) + offset
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * (8 * dim)
            blobs = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(whole)])
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "x": blobs})

    return materialize(rows.where(F.size("v") == dim).mapInArrow(floored, f"id {kind}, x binary")), dim


def _matrices(batch: pa.RecordBatch, dim: int) -> Iterator[np.ndarray]:
    """The vectors of a batch, some rows at a time."""
    column = batch.column("x")
    step = max(1, PART // dim)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset :]
    for at in range(0, len(column), step):
        rows = min(step, len(column) - at)
        yield np.frombuffer(column.buffers()[2], np.int64, rows * dim, int(ends[at])).reshape(rows, dim)


def _sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of each component. Two halves of each integer keep the partial sums within a long."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            for x in _matrices(batch, dim) if batch.num_rows else ():
                n, high, low = n + len(x), high + (x >> 26).sum(axis=0), low + (x & ((1 << 26) - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(high)), pa.int32()), "n": pa.array([n] * len(high)), "high": pa.array(high), "low": pa.array(low)})

    parts = rows.select("x").mapInArrow(add, "at int, n long, high long, low long")
    found = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("at").collect()
    return (found[0]["n"] if found else 0), [(r["high"] << 26) + r["low"] for r in found]


def _added(rows: DataFrame, dim: int, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum of ``work(x)`` over blocks of rows: within tasks, then here; if these are many, first within fewer tasks."""

    def one(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"m": pa.array([total.tobytes()], pa.binary())})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for x in _matrices(batch, dim) if batch.num_rows else ():
                total += work(x)
        yield one(total)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for blob in batch.column("m").to_pylist():
                total += np.frombuffer(blob).reshape(shape)
        yield one(total)

    parts = rows.select("x").mapInArrow(first, "m binary")
    if (tasks := rows.rdd.getNumPartitions()) > DIRECT:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(second, "m binary")
    return sum((np.frombuffer(r["m"]).reshape(shape) for r in parts.collect()), np.zeros(shape))


def centred(x: np.ndarray, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - base).astype(np.float64) - rest


def leading(apply: Apply, dim: int, wanted: int, *, guard: int = GUARD) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenpairs of a symmetric matrix without negative eigenvalues, given as a product."""
    columns = min(dim, wanted + guard)
    start = np.random.default_rng(11).standard_normal((dim, columns))
    active, locked = np.linalg.qr(start)[0], np.zeros((dim, 0))
    fixed = np.zeros(0)
    for _ in range(ROUNDS):
        image = apply(active)
        small = active.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        active, image = active @ turn, image @ turn
        top = max([*fixed[:1], values[0], 0.0])
        residual = np.linalg.norm(image - active * values, axis=0)
        # Locked in order, so that none of the larger ones is missing.
        good = residual <= RESIDUAL * dim * top
        sure = int(np.argmin(good)) if not good.all() else len(good)
        sure = min(sure, wanted - locked.shape[1])
        if locked.shape[1] + sure == wanted or columns == dim:
            # With as many columns as dimensions, Rayleigh-Ritz has all of the spectrum.
            locked, fixed = np.hstack([locked, active]), np.concatenate([fixed, values])
            order = np.argsort(-fixed, kind="stable")[:wanted]
            return fixed[order], locked[:, order]
        if sure:
            locked, fixed = np.hstack([locked, active[:, :sure]]), np.concatenate([fixed, values[:sure]])
            active, image, values = active[:, sure:], image[:, sure:], values[sure:]
        # Rounding along locked columns would grow with the polynomial, so every product is freed of them.
        active = _filtered(lambda q: _without(locked, apply(q)), active, _without(locked, image), values)
        # Twice, since the first projection leaves rounding of large columns.
        for _ in range(2):
            active = np.linalg.qr(_without(locked, active))[0]
    raise ArithmeticError(f"{locked.shape[1]} of {wanted} components certified after {ROUNDS} rounds")


def _without(locked: np.ndarray, q: np.ndarray) -> np.ndarray:
    return q - locked @ (locked.T @ q)


def _filtered(apply: Apply, q: np.ndarray, image: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Chebyshev polynomial of the matrix over the columns ``q``: what lies in [0, smallest value] stays small."""
    half = max(values[-1], 1e-13 * values[0]) / 2
    if half <= 0:
        return q
    reach = np.arccosh(max(1.0 + 1e-12, values[0] / half - 1))
    degree = int(min(DEGREE, max(2, math.log(SPREAD) // reach)))
    before, now = q, image / half - q
    for _ in range(degree - 1):
        before, now = now, 2 * (apply(now) / half - now) - before
    return now / np.linalg.norm(now, axis=0)


def fit(rows: DataFrame, dim: int, components: int) -> Fit:
    """Means and leading components of ``rows(x)``."""
    n, sums = _sums(rows, dim)
    if not n:
        return Fit(0, (), np.zeros(0), np.zeros((0, 0)), 0.0)
    bare = Fit(n, tuple(sums), np.zeros(0), np.zeros((dim, 0)), 0.0)
    base, rest = bare.base, bare.rest

    def squares(x: np.ndarray) -> np.ndarray:
        return (centred(x, base, rest) ** 2).sum(axis=0)[None, :]

    def apply(q: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            c = centred(x, base, rest)
            return c.T @ (c @ q)

        return _added(rows, dim, product, q.shape) / n

    trace = float(_added(rows, dim, squares, (1, dim)).sum()) / n
    if not trace:
        return bare
    values, vectors = leading(apply, dim, min(components, dim))
    real = values > values[0] * max(dim, 64) * np.finfo(float).eps
    return Fit(n, tuple(sums), values[real], vectors[:, real], trace)


def _deviations(x: np.ndarray, model: Fit, base: np.ndarray) -> list[int | None]:
    """Sum of ``(n x - S)^2`` over components, exact; in longs if they suffice."""
    near = x - base
    over = [s - model.n * b for s, b in zip(model.sums, base.tolist())]
    if (int(np.abs(near).max(initial=0)) + 1) ** 2 * model.n**2 * len(over) < 1 << 62:
        return ((model.n * near - np.array(over, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((model.n * v - o) ** 2 for v, o in zip(row, over)) for row in near.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whitened(vectors: DataFrame, *, vector_col: str = "embedding", id_col: str = "vec_id", scale: int = 64, offset: int = 1_000_000, components: int = 32) -> DataFrame:
    """One row for each vector and component: the id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``
    and ``identity_error``, the largest entry by which the covariance of the whitened values is off the identity."""
    rows, dim = integers(vectors, vector_col=vector_col, id_col=id_col, scale=scale, offset=offset)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, dim, components)
    count = len(model.values)
    if not count:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    base, rest = model.base, model.rest
    turn = model.vectors / np.sqrt(model.values)
    mean = _added(rows, dim, lambda x: (centred(x, base, rest) @ turn).sum(axis=0)[None, :], (1, count)) / model.n

    def spread(x: np.ndarray) -> np.ndarray:
        w = centred(x, base, rest) @ turn - mean
        return w.T @ w

    error = float(np.abs(_added(rows, dim, spread, (count, count)) / model.n - np.eye(count)).max())
    explained = model.values / model.trace

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _matrices(batch, dim):
                values = centred(x, base, rest) @ turn
                each = pa.array(np.repeat(np.arange(at, at + len(x)), count))
                deviation = np.array(_deviations(x, model, base), dtype=object).repeat(count)
                at += len(x)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column("id").take(each),
                        "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                        "n": pa.array(np.full(len(each), model.n)),
                        "deviation": pa.array(deviation, pa.int64()),
                        "whitened": pa.array(values.ravel()),
                        "explained": pa.array(np.tile(explained, len(x))),
                        "identity_error": pa.array(np.full(len(each), error)),
                    }
                )

    return rows.mapInArrow(out, schema).withColumnRenamed("id", id_col)
