"""Whitening of embeddings: Welford states per partition, merged by the parallel update, symmetric QR.

A task streams its vectors through Welford's update: each vector adds one rank-one term, (i - 1) / i
times the outer square of its difference from the mean of those before it. The terms of an Arrow
block are added by one matrix product; the running means within it come from a cumulative sum. The
states (n, exact sums, mean, squares about the mean) of the partitions are merged by the parallel
formula, a few at a time over several rounds, so no task or driver meets more than FAN of
them. The last one, of d x d numbers, is solved on the driver: Householder reflections make it
tridiagonal, implicit QR steps with Wilkinson's shift make it diagonal.

The whitened vectors are written once; how far their covariance is from the identity is measured
over them by the same streaming states.

Entries c become floor(1024 c) + 100000, integers; sums and squared deviations are exact.

Defined results: rows whose vector is null, or holds an entry that is null, not finite or at least LARGEST
in size, are dropped; so are vectors of another length than most (of ties the shorter). Repeated rows and null ids
stay, each by itself. Components of no variance (rank, equal vectors, a single row) can't be whitened
and are left out, so there may be fewer than asked for, or no rows. A squared deviation that no
long can hold is null. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.common import discard, stored, unclashed

GRID, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries from this size on are no better than infinite: their grid values would not be exact.
LARGEST = 2.0**30
#: Vectors added by one product; states merged by one task; lengths of vectors a task keeps apart.
BLOCK, FAN, LENGTHS = 1024, 16, 8


@dataclass
class State:
    """Vectors seen: how many, their exact sums, mean, and summed outer squares about the mean."""

    n: int
    sums: list[int]
    mean: np.ndarray
    squares: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> State:
        return cls(0, [0] * dims, np.zeros(dims), np.zeros((dims, dims)))

    def add(self, x: np.ndarray) -> None:
        """Welford's rank-one updates for the rows of x, in their order."""
        k = self.n + np.arange(1, len(x) + 1)[:, None]
        at_first = self.mean if self.n else x[0].astype(np.float64)
        centred = x - at_first
        after = np.cumsum(centred, axis=0) / k  # running mean, less at_first
        before = np.vstack([np.zeros(x.shape[1]), after[:-1]])
        delta = centred - before
        self.squares += (delta * ((k - 1) / k)).T @ delta
        self.mean = at_first + after[-1]
        self.n += len(x)
        if x.dtype.kind == "i":
            self.sums = [a + b for a, b in zip(self.sums, x.sum(axis=0).tolist(), strict=True)]

    def merge(self, other: State) -> State:
        """The parallel update: squares of both and of the way between their means."""
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        way = other.mean - self.mean
        squares = self.squares + other.squares + np.outer(way, way) * (self.n * other.n / n)
        return State(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.mean + way * (other.n / n), squares)

    def row(self, key: tuple[int, int]) -> dict:
        return {"dims": len(self.mean), "part": key[0], "nth": key[1], "n": self.n, "sums": [str(s) for s in self.sums], "mean": self.mean.tolist(), "squares": self.squares.ravel().tolist()}


_STATE = "dims int, part int, nth int, n long, sums array<string>, mean array<double>, squares array<double>"
_ARROW = pa.schema([("dims", pa.int32()), ("part", pa.int32()), ("nth", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.list_(pa.float64())), ("squares", pa.list_(pa.float64()))])


def _of(row: dict) -> State:
    d = row["dims"]
    return State(row["n"], [int(s) for s in row["sums"]], np.array(row["mean"]), np.array(row["squares"]).reshape(d, d))


def vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix of doubles) for each length of the vectors that can be used."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        values = column.take(pa.array(rows)).flatten().cast(pa.float64())
        matrix = values.to_numpy(zero_copy_only=False).reshape(-1, d)  # a null entry becomes NaN
        with np.errstate(invalid="ignore"):
            good = (np.abs(matrix) < LARGEST).all(axis=1)
        yield d, rows[good], matrix[good]


def gridded(matrix: np.ndarray) -> np.ndarray:
    return np.floor(GRID * matrix).astype(np.int64) + SHIFT


def _states(batches: Iterator[pa.RecordBatch], read) -> Iterator[pa.RecordBatch]:
    """States of a partition by length of vector; one is given out early where there are too many lengths."""
    states: dict[int, State] = {}
    part, nth = TaskContext.get().partitionId(), 0
    for batch in batches:
        for d, _, matrix in vectors(batch.column(0)):
            if d not in states and len(states) == LENGTHS:
                yield pa.RecordBatch.from_pylist([states.pop(next(iter(states))).row((part, nth))], _ARROW)
                nth += 1
            state = states.setdefault(d, State.empty(d))
            for at in range(0, len(matrix), BLOCK):
                state.add(read(matrix[at : at + BLOCK]))
    for state in states.values():
        if state.n:
            yield pa.RecordBatch.from_pylist([state.row((part, nth))], _ARROW)
            nth += 1


def summed(column: DataFrame, read=gridded) -> State | None:
    """The state of all vectors of the one column, of the length most of them have."""
    states = stored(column.mapInArrow(lambda batches: _states(batches, read), _STATE), "welford")
    counts = states.groupBy("dims").agg(F.sum("n").alias("n"), F.count("*").alias("states")).orderBy(F.desc("n"), "dims").first()
    if not counts:
        discard(states)
        return None
    left, rest = states.filter(F.col("dims") == counts.dims), counts.states
    written = [states]

    def merged(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["nth"]))
        total = _of(rows[0])
        for r in rows[1:]:
            total = total.merge(_of(r))
        return pa.Table.from_pylist([total.row((rows[0]["part"], rows[0]["nth"]))], _ARROW)

    while rest > FAN:
        groups = -(-rest // FAN)
        left = stored(left.withColumn("g", F.pmod(F.xxhash64("part", "nth"), F.lit(groups))).groupBy("g").applyInArrow(merged, _STATE), "welford")
        written.append(left)
        rest = left.count()
    total = State.empty(counts.dims)
    for r in sorted((r.asDict() for r in left.collect()), key=lambda r: (r["part"], r["nth"])):  # FAN states at most
        total = total.merge(_of(r))
    discard(*written)
    return total


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with q' matrix q tridiagonal, by Householder reflections."""
    a, n = matrix.astype(np.float64).copy(), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if not size:
            continue
        v[0] += math.copysign(size, v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -math.copysign(size, v[0])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, by implicit QR steps with Wilkinson's shift."""
    d, e, q = tridiagonal(matrix)
    tiny = np.finfo(np.float64).eps
    high, rows = len(d) - 1, q.T.copy()  # eigenvectors as rows, so that a rotation touches two of them
    while high > 0:
        low = high
        while low > 0 and abs(e[low - 1]) > tiny * (abs(d[low - 1]) + abs(d[low])):
            low -= 1
        if low == high:
            e[high - 1] = 0.0
            high -= 1
            continue
        gap = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (gap + math.copysign(math.hypot(gap, e[high - 1]), gap))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * dk + 2 * c * s * ek + s * s * dn, s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = (c * c - s * s) * ek + c * s * (dn - dk)
            if k < high - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            rows[[k, k + 1]] = np.array([[c, s], [-s, c]]) @ rows[[k, k + 1]]
    order = np.argsort(-d, kind="stable")
    return d[order], rows[order].T


@dataclass
class Whitener:
    """What a fit gives: n, exact sums, mean, eigenvectors over the roots of their eigenvalues, shares of the variance."""

    n: int
    sums: list[int]
    mean: np.ndarray
    axes: np.ndarray
    explained: list[float]

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 of each row, exact; None where no long holds it."""
        widest = max((abs(self.n * int(v) - s) for v, s in zip((*x.max(axis=0), *x.min(axis=0)), self.sums * 2, strict=True)), default=0)
        if widest * widest * x.shape[1] < 2**63 and max(map(abs, self.sums)) < 2**62 and self.n * int(np.abs(x).max()) < 2**62:
            far = self.n * x - np.array(self.sums, np.int64)
            return (far * far).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """The whitener of df's vectors; None without any."""
    total = summed(df.select(vector))
    if total is None:
        return None
    values, axes = symmetric_qr(total.squares / total.n)
    least = values[0] * len(values) * np.finfo(np.float64).eps * 16
    k = min(components, int((values > max(least, 0.0)).sum()))
    return Whitener(total.n, total.sums, np.array([s / total.n for s in total.sums]), axes[:, :k] / np.sqrt(values[:k]), (values[:k] / np.trace(total.squares / total.n)).tolist())


def whitened(df: DataFrame, model: Whitener | None, vector: str = "embedding") -> DataFrame:
    """Every usable row of df with `whitened` (array<double>, a number per component) and `deviation`; clashing names get _in."""
    names = unclashed(df.columns, ["whitened", "deviation"])
    plain = df.toDF(*names)
    schema = T.StructType([*plain.schema.fields, T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())])
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    at, fields = df.columns.index(vector), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, matrix in vectors(batch.column(at)):
                for a in range(0, len(rows) if d == len(model.sums) else 0, BLOCK):
                    x = gridded(matrix[a : a + BLOCK])
                    projected = (x - model.mean) @ model.axes
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * projected.shape[1], pa.int32()), pa.array(projected.ravel()))
                    kept = batch.take(pa.array(rows[a : a + BLOCK]))
                    yield pa.RecordBatch.from_arrays([*kept.columns, lists, pa.array(model.deviation(x), pa.int64())], names=fields)

    return plain.mapInArrow(run, schema)


def identity_error(rows: DataFrame) -> float:
    """Largest entry, in size, of the covariance of `whitened` less the identity; 0 without rows."""
    state = summed(rows.select("whitened"), read=np.asarray)
    return float(np.abs(state.squares / state.n - np.eye(len(state.mean))).max()) if state else 0.0


def components_long(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    model = fit(df, vector, components)
    rows = stored(whitened(df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")), model, "vector").drop("vector"), "whitened")
    error = identity_error(rows)
    explained = F.array(*[F.lit(v) for v in model.explained]) if model and model.explained else F.array().cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
