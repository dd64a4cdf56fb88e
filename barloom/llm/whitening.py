"""Whitening of embeddings by a bidiagonal qd solver.

1. Vectors become integers, and each distinct integer vector counts once: the fit list. It is
   written to the shared folder. Its size n and sums S are exact.
2. Blockwise QR: every task folds its centred rows into one triangle, block by block; triangles of
   tasks are folded in turn, `FAN` at a time. No product of the rows is ever formed.
3. On the last triangle R, whose size depends on the dimensions only, Householder reflections give
   a bidiagonal B with the singular values of the centred fit list.
4. dqds finds the squares of B's singular values. Every step shifts by a proven lower bound of the
   least one, so no step fails and small values keep their digits.
5. Twisted factorisations of B'B - e give the directions: the factorisation from above and the one
   from below meet where they fit best. Directions of values that lie close together are
   orthogonalised by inverse iteration.
6. One pass over all rows projects them; one over the fit list measures what whitening has left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import map_batches, staged

SCALE = 256
#: Entries whose integer would be as large as this make a vector unusable, like those that aren't finite.
LARGEST = float(1 << 40)
#: Triangles that are folded into one.
FAN = 64
#: Rows of a block at least; a block also has four times the dimensions.
BLOCK_ROWS = 2048
EPS = np.finfo(float).eps


# --- the solver on one small triangle --------------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper diagonal of B, and V, such that r = U B V' for an orthogonal U."""
    a, d = np.array(r, float), len(r)
    v = np.eye(d)
    for k in range(d):
        _reflect(a[k:, k:], a[k:, k].copy())
        if k < d - 2:
            row = a[k, k + 1 :].copy()
            h = _reflect(a[k:, k + 1 :].T, row)
            if h is not None:
                v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ h, 2 * h)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v


def _reflect(part: np.ndarray, x: np.ndarray) -> np.ndarray | None:
    """Reflect the rows of `part` in place so that x becomes a multiple of the first unit vector."""
    scale = np.abs(x).max(initial=0.0)
    if scale == 0 or len(x) < 2 or not x[1:].any():
        return None
    h = x / scale
    h[0] += math.copysign(float(np.linalg.norm(h)), h[0])
    h /= np.linalg.norm(h)
    part -= np.outer(2 * h, h @ part)
    return h


def _qd(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One dqds step: the new q and e, and the pivots on the way."""
    nq, ne, pivots, d = [], [], [], q[0] - shift
    for i, ei in enumerate(e):
        pivots.append(d)
        total = d + ei
        nq.append(total)
        ratio = q[i + 1] / total if total > 0 else 0.0
        ne.append(ei * ratio)
        d = d * ratio - shift if total > 0 else q[i + 1] - shift
    pivots.append(d)
    nq.append(d)
    return nq, ne, pivots


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The squares of the singular values of an upper bidiagonal matrix, falling."""
    scale = max(float(np.abs(diagonal).max(initial=0.0)), float(np.abs(upper).max(initial=0.0)))
    if scale == 0:
        return np.zeros(len(diagonal))
    q, e = ((diagonal / scale) ** 2).tolist(), ((upper / scale) ** 2).tolist()
    done: list[float] = []
    blocks, small = [(q, e, 0.0)], (4 * EPS) ** 2
    while blocks:
        q, e, shifted = blocks.pop()
        while len(q) > 1:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= small * (shifted + min(q[i], q[i + 1])) or e[i] < 1e-300), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], shifted))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            least = min(_qd(q, e, 0.0)[2])
            if least <= 0:  # a zero diagonal: one plain step moves it to the end
                q, e, _ = _qd(q, e, 0.0)
                if q[-1] <= 0:
                    done.append(shifted)
                    q, e = q[:-1], e[:-1]
                continue
            # The pivots of a plain step are the reciprocals of the inverse's diagonal: their harmonic sum bounds the least value.
            shift = (1 - 4 * len(q) * EPS) / sum(1 / p for p in _qd(q, e, 0.0)[2])
            nq, ne, pivots = _qd(q, e, shift)
            if min(pivots) < 0:  # by rounding only
                shift = 0.0
                nq, ne, _ = _qd(q, e, 0.0)
            q, e, shifted = nq, ne, shifted + shift
        if q:
            done.append(shifted + max(q[0], 0.0))
    return np.sort(np.array(done))[::-1] * scale**2


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float) -> np.ndarray:
    """The direction of B'B that belongs to one of its values, from its best twisted factorisation."""
    d = len(diagonal)
    main = diagonal**2 + np.r_[0.0, upper**2] - value
    side = diagonal[:-1] * upper
    tiny = EPS * EPS * max(float(np.abs(main).max()), value, 1e-300)
    down, up = main.copy(), main.copy()
    for i in range(1, d):
        down[i] -= side[i - 1] ** 2 / (down[i - 1] if down[i - 1] else tiny)
    for i in range(d - 2, -1, -1):
        up[i] -= side[i] ** 2 / (up[i + 1] if up[i + 1] else tiny)
    meet = int(np.abs(down + up - main).argmin())
    z = np.zeros(d)
    z[meet] = 1.0
    for i in range(meet - 1, -1, -1):
        z[i] = -side[i] * z[i + 1] / (down[i] if down[i] else tiny)
    for i in range(meet + 1, d):
        z[i] = -side[i - 1] * z[i - 1] / (up[i] if up[i] else tiny)
    z /= np.abs(z).max()
    return z / np.linalg.norm(z)


def directions(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal directions of B'B, one column for each of its largest `values`."""
    full = np.diag(diagonal) + np.diag(upper, 1)
    gram = full.T @ full
    norm, rng = float(values[0]), np.random.default_rng(0)
    out: list[np.ndarray] = []
    for j, value in enumerate(values):
        near = [out[i] for i in range(j) if values[i] - value <= 1e-3 * norm]
        z = twisted(diagonal, upper, float(value))
        if near or np.linalg.norm(gram @ z - value * z) > 64 * EPS * norm:
            z = _refined(gram, float(value), z, near, norm, rng)
        out.append(z)
    return np.array(out).T


def _refined(gram, value, z, near, norm, rng) -> np.ndarray:
    """Inverse iteration beside the directions found for values close to this one."""

    def apart(x):
        for _ in range(2):
            for y in near:
                x = x - (x @ y) * y
        return x / max(float(np.linalg.norm(x)), 1e-300)

    start = apart(z)
    if np.linalg.norm(z - sum(((z @ y) * y for y in near), np.zeros(len(z)))) < 0.1:
        start = apart(rng.standard_normal(len(z)))
    shifted = gram - (value + 8 * EPS * norm) * np.eye(len(gram))
    for _ in range(4):
        try:
            start = apart(np.linalg.solve(shifted, start))
        except np.linalg.LinAlgError:
            shifted = shifted - 64 * EPS * norm * np.eye(len(gram))
    return start


def principal(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest squared singular values of a triangle that aren't zero, and their right directions."""
    diagonal, upper, v = bidiagonal(r)
    values = dqds(diagonal, upper)
    values = values[:k][values[:k] > values[0] * (8 * len(r) * EPS) ** 2] if len(values) and values[0] > 0 else values[:0]
    if not len(values):
        return values, np.zeros((len(r), 0))
    out = v @ directions(diagonal, upper, values)
    lead = out[np.abs(out).argmax(0), np.arange(out.shape[1])]
    return values, out * np.sign(lead)


# --- passes over the rows --------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation: `directions` has one column for each component."""

    n: int
    sums: tuple[int, ...]
    largest: int
    values: np.ndarray
    directions: np.ndarray
    trace: float
    identity_error: float = math.nan

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.directions / np.sqrt(self.values)

    @property
    def deviation_fits(self) -> bool:
        """Whether every deviation of a vector of the fit list is a long."""
        return len(self.sums) * (2 * self.n * self.largest) ** 2 < 1 << 63

    def deviation(self, x: np.ndarray) -> np.ndarray:
        if self.deviation_fits:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1)
        return ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1)


def integers(embedding: Column) -> Column:
    """floor(256 * c) of every entry as an array of longs, null where the vector can't be used."""
    entry = lambda c: c.cast("double") * SCALE
    usable = F.forall(embedding, lambda c: F.coalesce(F.abs(entry(c)) < LARGEST, F.lit(False)))
    return F.when(usable & (F.size(embedding) > 0), F.transform(embedding, lambda c: F.floor(entry(c)).cast("long")))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _usual_size(prepared: DataFrame) -> int:
    """The most frequent number of dimensions, the greater of equally frequent ones; 0 without vectors."""
    found = prepared.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def _moments(fit: DataFrame, d: int) -> tuple[int, tuple[int, ...], int]:
    """Exact size, sums and greatest magnitude of the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, largest = 0, [0] * d, 0
        for batch in batches:
            x = _matrix(batch.column(0), d)
            if len(x):
                n += len(x)
                sums = [a + int(b) for a, b in zip(sums, x.sum(0), strict=True)]
                largest = max(largest, int(np.abs(x).max()))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array(map(Decimal, sums), pa.decimal128(38, 0)), pa.array([n] * d), pa.array([largest] * d)],
                names=["i", "s", "n", "largest"],
            )

    rows = map_batches(fit, run, "i int, s decimal(38,0), n long, largest long").groupBy("i").agg(
        F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("n").alias("n"), F.max("largest").alias("largest")
    )
    got = sorted(rows.collect())
    return (got[0].n, tuple(int(r.s) for r in got), got[0].largest) if got else (0, (), 0)


def _fold(blocks: Iterator[np.ndarray], d: int) -> np.ndarray:
    """The triangle of all rows of the blocks."""
    r, held, size = np.zeros((0, d)), [], 0
    for block in blocks:
        held.append(block)
        size += len(block)
        if size >= max(BLOCK_ROWS, 4 * d):
            r, held, size = np.linalg.qr(np.concatenate([r, *held]), mode="r"), [], 0
    return np.linalg.qr(np.concatenate([r, *held, np.zeros((d, d))]), mode="r")


def triangle(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the centred fit list."""
    d = len(mean)

    def packed(r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(_fold((_matrix(b.column(0), d) - mean for b in batches), d))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(_fold((np.frombuffer(r.as_py()).reshape(d, d) for b in batches for r in b.column(0)), d))

    parts, found = fit.rdd.getNumPartitions(), map_batches(fit, first, "r binary")
    while parts > FAN:
        parts = -(-parts // FAN)
        found = map_batches(found.repartition(parts), again, "r binary")
    return _fold((np.frombuffer(r.r).reshape(d, d) for r in found.collect()), d)


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry of |covariance of the whitened fit list - identity|."""
    d, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            y = np.c_[np.ones(batch.num_rows), model.project(_matrix(batch.column(0), d))]
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range((k + 1) ** 2), pa.int32()), pa.array(total.ravel())], names=["i", "s"])

    rows = map_batches(fit, run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((k + 1) ** 2)
    for row in rows:
        total[row.i] = row.s
    total = total.reshape(k + 1, k + 1) / model.n
    # The mean is zero but for rounding, so taking its square off loses nothing.
    return float(np.abs(total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:]) - np.eye(k)).max())


def fit(vectors: DataFrame, k: int = 4, *, embedding: str = "embedding") -> Whitening | None:
    """Fit on the distinct integer vectors of all rows; None if there is no usable vector."""
    prepared = vectors.select(integers(F.col(embedding)).alias("x")).where("x is not null")
    d = _usual_size(prepared)
    if not d:
        return None
    listed = staged(prepared.where(F.size("x") == d).distinct(), "fit-list")
    n, sums, largest = _moments(listed, d)
    r = triangle(listed, np.array([s / n for s in sums]))
    values, found = principal(r, k)
    model = Whitening(n, sums, largest, values / n, found, float((r**2).sum()) / n)
    if not len(values):
        return model
    return Whitening(n, sums, largest, values / n, found, model.trace, _identity_error(listed, model))


def whiten(vectors: DataFrame, k: int = 4, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each usable row and each of the first `k` components: `vec_id`, `component` (from 1), `n` and
    `deviation` (a long, or a decimal(38,0) where longs don't suffice), `whitened`, `explained` and
    `identity_error`.

    Defined results: a row whose vector is null, empty, holds a null or non-finite entry or one of
    2**32 or more takes no part, nor does one whose number of dimensions isn't the most frequent
    one (the greater, if two are equally frequent). Repeated rows and null ids are kept as
    they come. A component without variance is left out, so equal vectors give no row; so does an
    empty table. Other columns aren't read.
    """
    spark, kind = vectors.sparkSession, vectors.schema[vec_id].dataType
    model = fit(vectors, k, embedding=embedding)
    fits = model is None or model.deviation_fits
    deviation_type = T.LongType() if fits else T.DecimalType(38, 0)
    schema = T.StructType(
        [
            T.StructField("vec_id", kind),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", deviation_type),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    d, found = len(model.sums), len(model.values)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = batch.num_rows
            x = _matrix(batch.column(1), d)
            deviation = m.deviation(x)
            deviation = pa.array(np.repeat(deviation, found)) if fits else pa.array([Decimal(v) for v in np.repeat(deviation, found)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), found))),
                    pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * found, m.n, np.int64)),
                    deviation,
                    pa.array(m.project(x).ravel()),
                    pa.array(np.tile(m.values / m.trace, rows)),
                    pa.array(np.full(rows * found, m.identity_error)),
                ],
                names=schema.names,
            )

    rows = vectors.select(F.col(vec_id).alias("vec_id"), integers(F.col(embedding)).alias("x")).where(F.size("x") == d)
    return map_batches(rows, run, schema)
