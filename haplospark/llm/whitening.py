"""Whitening of embeddings by covariances from exact sums of squares (polarisation)."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, drop

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Scaled entries from here on don't fit in a long.
_TOO_LARGE = 2.0**62
#: Sums of squares leave a task in limbs of so many bits.
_LIMB, _LIMBS = 40, 5


def finite_vectors(df: DataFrame, id_col: str, vector_col: str, extra: Column | None = None) -> DataFrame:
    """``vec_id, v`` (doubles) of the rows whose vector has no null and no non-finite entry.

    Vectors have the length that most rows have (the larger of equally many);
    empty ones and those of other lengths are left out.
    """
    v = F.col(vector_col).cast("array<double>")
    whole = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) & (extra(c) if extra else F.lit(True)))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(whole)
    width = rows.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    return rows.where(F.size("v") == (width["k"] if width else 0))


def _matrix(col: pa.ListArray) -> np.ndarray:
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False))
    return flat.reshape(len(col), -1)


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """``x`` as 64-bit integers if sums up to ``most`` fit, else as Python's."""
    return x if most < 2**63 else x.astype(object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of each dimension in two halves of 32 bits."""
    high = low = None
    for b in batches:
        if not b.num_rows:
            continue
        x = _matrix(b.column(0))
        h, l = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
        high, low = (h, l) if high is None else (high + h, low + l)
    if high is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high))), pa.array(high), pa.array(low)], names=["i", "high", "low"])


def pair_squares(d: np.ndarray) -> list[int]:
    """Sums over the rows of ``d`` of d_i squared (j = i) and of (d_i + d_j) squared, i < j, row by row of the upper triangle; exact."""
    top = 2 * int(np.abs(d).max(initial=0))
    d = _exact(d, top * top * max(len(d), 1))
    out: list[int] = []
    for i in range(d.shape[1]):
        t = d[:, i:] + d[:, i : i + 1]
        t[:, 0] = d[:, i]
        out += (t * t).sum(0).tolist()
    return out


def _squares(middle: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                q = pair_squares(_matrix(b.column(0)) - np.array(middle))
                total = q if total is None else [x + y for x, y in zip(total, q)]
        if total is not None:
            limbs = [pa.array([v >> _LIMB * k & ((1 << _LIMB) - 1) for v in total], pa.int64()) for k in range(_LIMBS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *limbs], names=["i", *(f"l{k}" for k in range(_LIMBS))])

    return run


def covariance(n: int, rest: list[int], squares: list[int]) -> np.ndarray:
    """Covariances (divisor n) from the squares of entries and pair sums, both less a whole number, and from what each dimension's sum is still away from zero.

    cov(a, b) = (var(a + b) - var(a) - var(b)) / 2, in whole numbers; only the
    last division rounds.
    """
    k = len(rest)
    at = iter(squares)
    q = [[next(at) for _ in range(i, k)] for i in range(k)]
    var = [n * q[i][0] - rest[i] ** 2 for i in range(k)]  # times n squared
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            pair = var[i] if i == j else (n * q[i][j - i] - (rest[i] + rest[j]) ** 2 - var[i] - var[j]) / Fraction(2)
            out[i, j] = out[j, i] = float(Fraction(pair) / n**2)
    return out


class Model:
    """Components of the covariance and what turns a row of whole numbers into its whitened form."""

    def __init__(self, n: int, sums: list[int], squares: list[int], components: int):
        self.n = n
        self.middle = [(2 * s + n) // (2 * n) for s in sums]
        self.rest = [s - n * m for s, m in zip(sums, self.middle)]
        v = covariance(n, self.rest, squares)
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        self.count = int(min(components, (e > e[0] * len(e) * np.finfo(float).eps).sum())) if len(e) and e[0] > 0 else 0
        u = u * np.where(u[np.abs(u).argmax(0), np.arange(len(e))] < 0, -1, 1)
        self.project = u[:, : self.count] / np.sqrt(e[: self.count])
        self.explained = e[: self.count] / np.trace(v)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - np.array(self.middle)).astype(float) - np.array(self.rest) / self.n) @ self.project

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S) squared; null where it needs over 64 bits."""
        d = x - np.array(self.middle)
        top = self.n * (int(np.abs(d).max(initial=0)) + 1)
        if top * top * x.shape[1] < 2**63:
            y = d * self.n - np.array(self.rest)
            return (y * y).sum(1).tolist()
        whole = [sum((self.n * c - r) ** 2 for c, r in zip(row, self.rest)) for row in d.tolist()]
        return [w if w < 2**63 else None for w in whole]


def _whitened_products(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(model.count), np.zeros((model.count, model.count))
        for b in batches:
            if b.num_rows:
                w = model.whitened(_matrix(b.column(0)))
                first, second = first + w.sum(0), second + w.T @ w
        cells = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["i", "s"])

    return run


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _rows(model: Model, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.count
        for b in batches:
            if not b.num_rows or not k:
                continue
            x, m = _matrix(b.column(1)), b.num_rows
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(model.deviation(x), pa.int64()).take(at), pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each row and component.

    Entries become whole numbers, floor(64 c) + 1000000.  The model is fitted on
    each distinct vector once: the squares of every centred dimension and of
    every sum of two are added exactly, and differences of variances give the
    covariances.  Centred means less the whole number next to the mean; what
    is left of the mean is taken off exactly at the end.  Only dims^2 / 2 sums
    reach the driver, where the eigenvectors are found; their largest entry is
    positive.

    Rows with a null vector, a null or non-finite entry, another length than
    most rows or an entry whose whole number needs over 62 bits are left out.
    Components without variance (fewer vectors than dimensions, one vector, a
    constant dimension) have no whitened form and give no rows.  A deviation
    beyond 64 bits is null.  Repeated rows and null ids keep their rows; other
    columns are ignored; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    whole = finite_vectors(embeddings, id_col, vector_col, lambda c: F.abs(c * SCALE) < _TOO_LARGE)
    rows = cut(whole.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x")), "quantised")
    fit = cut(rows.select("x").distinct(), "fit")
    n = fit.count()
    if not n:
        return spark.createDataFrame([], _OUT)
    sums = fit.mapInArrow(_sums, "i long, high long, low long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("i").collect()
    sums = [(r["high"] << 32) + r["low"] for r in sums]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    limbs = [f"l{k}" for k in range(_LIMBS)]
    squares = fit.mapInArrow(_squares(middle), "i long, " + ", ".join(f"{c} long" for c in limbs)).groupBy("i").agg(*[F.sum(c).alias(c) for c in limbs]).orderBy("i").collect()
    model = Model(n, sums, [sum(r[c] << _LIMB * k for k, c in enumerate(limbs)) for r in squares], components)
    cells = fit.mapInArrow(_whitened_products(model), "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    cells, k = np.array([r["s"] for r in cells]) / n, model.count
    error = float(np.abs(cells[k:].reshape(k, k) - np.outer(cells[:k], cells[:k]) - np.eye(k)).max(initial=0))
    drop(fit)
    return rows.mapInArrow(_rows(model, error), _OUT)
