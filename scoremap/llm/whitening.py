"""Whitening of embeddings by QDWH spectral divide and conquer.

Vectors become integers, so sums over them are exact. Spark finds the distinct vectors,
their sums and, centred, their covariance: a task adds up the d x d products of its rows
and Spark sums these over tasks, so that only d numbers in d rows reach the driver. There
the covariance is split: the polar factor of the shifted matrix (by dynamically weighted
Halley steps) gives the projector on all components above the shift, bases of its range
and of the rest split the matrix in two, and so on down to single components. The few
kept components, divided by the roots of their eigenvalues, go to all tasks as a small
array, and each row is centred and projected where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremap.llm.common import bound_session, materialize

SCALE = 256
COMPONENTS = 4
EPS = float(np.finfo(float).eps)
#: Halley steps that always suffice for doubles, with room.
STEPS = 30


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix (its matrix sign)."""
    x = a / np.linalg.norm(a)
    m, one = len(a), np.eye(len(a))
    try:  # a lower bound of the smallest singular value
        low = float(np.clip(1 / np.linalg.norm(np.linalg.inv(x)), EPS, 1.0))
    except np.linalg.LinAlgError:
        low = EPS
    for _ in range(STEPS):
        sq = low * low
        d = np.cbrt(4 * (1 - sq) / sq**2)
        f = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - sq) / (sq * np.sqrt(1 + d))) / 2
        g = (f - 1) ** 2 / 4
        h = f + g - 1
        if h > 100:  # by QR, which bears a badly conditioned matrix
            q = np.linalg.qr(np.vstack([np.sqrt(h) * x, one]))[0]
            new = g / h * x + (f - g / h) / np.sqrt(h) * (q[:m] @ q[m:].T)
        else:
            new = g / h * x + (f - g / h) * np.linalg.solve(one + h * (x.T @ x), x.T).T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (f + g * sq) / (1 + h * sq))
        if moved <= np.cbrt(5 * EPS) and 1 - low <= 10 * EPS:
            break
    return x


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the components above and below a shift inside the spectrum;
    none if all eigenvalues are the same to rounding."""
    m, mean = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - mean * np.eye(m)) / np.sqrt(m)
    if spread <= EPS * m * np.linalg.norm(a):
        return None
    draw = np.random.default_rng(m)
    # the mean lies inside the spectrum; the others serve where it meets an eigenvalue
    for shift in (float(np.median(np.diag(a))), mean, *(mean + spread * t / 16 for t in (1, -1, 2, -2, 3, -3, 5, -5))):
        p = (polar(a - shift * np.eye(m)) + np.eye(m)) / 2
        k = round(float(np.trace(p)))
        if 0 < k < m and np.linalg.norm(p @ p - p) <= 1e-12 * m:
            base = np.linalg.qr(p @ draw.standard_normal((m, k)))[0]
            q = np.linalg.qr(p @ base, mode="complete")[0]
            return q[:, :k], q[:, k:]
    raise ArithmeticError("no shift splits the spectrum")


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, each
    with its largest entry positive."""
    whole, done, todo = np.linalg.norm(a), [], [np.eye(len(a))]
    while todo:
        v = todo.pop()
        part = v.T @ a @ v
        part = (part + part.T) / 2
        # what is rounding against the whole matrix is not split further
        halves = _halves(part) if len(part) > 1 and np.linalg.norm(part) > EPS * whole else None
        if halves is None:
            done.append(v)
        else:
            todo += [v @ h for h in halves]
    vectors = np.column_stack(done)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(a))]
    return values[order], vectors * np.where(top < 0, -1.0, 1.0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def gram(x: DataFrame, centre: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """Sum over the rows of the products of centred entries, of centred and projected
    ones with ``project``; a last row and column of sums."""
    d = len(centre)
    size = 1 + (d if project is None else project.shape[1])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            y = _matrix(batch.column(0), d) - centre
            y = np.column_stack([y if project is None else y @ project, np.ones(len(y))])
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    parts = x.select("x").mapInArrow(partial, "i int, v array<double>")
    sums = parts.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(size)]).alias("v")).collect()
    out = np.zeros((size, size))
    for r in sums:
        out[r["i"]] = r["v"]
    return out


def whole_numbers(vector: Column) -> Column:
    """floor(256 c) of each entry; null where the vector or an entry is null or not
    finite. Entries beyond the range of a long take its ends."""
    entries = vector.cast("array<double>")
    odd = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~odd, F.transform(entries, lambda c: F.floor(c * SCALE)))


@dataclass
class Whitening:
    """``n`` distinct vectors of the fit, their exact ``sums``, all eigenvalues, and the
    ``d x k`` matrix that whitens a centred vector."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    matrix: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @staticmethod
    def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
        """From the column ``x`` of long vectors, each distinct one once. Components
        whose eigenvalue is nothing but rounding are left out. None without rows.

        The driver holds d x d numbers, whatever the number of rows."""
        x = materialize(x.select("x").distinct(), "distinct")
        first = x.first()
        if first is None:
            return None
        d = len(first["x"])
        entry = [F.col("x")[i] for i in range(d)]
        row = x.agg(F.count("*"), *[F.try_sum(e) for e in entry]).first()
        if None in tuple(row):  # sums beyond a long
            row = x.agg(F.count("*"), *[F.sum(e.cast("decimal(38,0)")) for e in entry]).first()
        n, sums = row[0], [int(s) for s in row[1:]]
        mean = np.array([s / n for s in sums])
        values, vectors = eigen(gram(x, mean)[:d, :d] / n)
        k = min(components, int((values > d * EPS * max(values[0], 0.0)).sum()))
        matrix = vectors[:, :k] / np.sqrt(values[:k])
        moment = gram(x, mean, matrix) / n
        drift = moment[k, :k]
        error = float(np.abs(moment[:k, :k] - np.outer(drift, drift) - np.eye(k)).max(initial=0.0))
        return Whitening(n, sums, values, matrix, error)

    def transform(self, rows: DataFrame, carry: str) -> DataFrame:
        """``<carry>, component, n, deviation, whitened, explained, identity_error`` of
        every row with a column ``x``."""
        d, k = self.matrix.shape
        n, sums, mean, matrix, error = self.n, self.sums, self.mean, self.matrix, self.identity_error
        share = self.eigenvalues[:k] / self.eigenvalues.sum()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), d)
                white = (x - mean) @ matrix
                who = pa.array(np.repeat(np.arange(len(x)), k))
                cols = [batch.column(0).take(who), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(x) * k, n), pa.array(deviations(x, n, sums), pa.int64()).take(who), white.ravel(), np.tile(share, len(x)), np.full(len(x) * k, error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[carry, "component", "n", "deviation", "whitened", "explained", "identity_error"])

        kind = rows.schema[carry].dataType.simpleString()
        return rows.select(F.col(f"`{carry}`"), "x").mapInArrow(run, f"`{carry}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None] | np.ndarray:
    """Per row the sum of (n x - sums) squared, exact; null beyond a long."""
    most = n * max(map(abs, (int(x.max(initial=0)), int(x.min(initial=0))))) + max(map(abs, sums))
    if most < 2**31 and most * most * x.shape[1] < 2**63:
        return ((n * x - np.array(sums)) ** 2).sum(axis=1)
    exact = [reduce(lambda t, p: t + (n * p[0] - p[1]) ** 2, zip(r, sums, strict=True), 0) for r in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``<id_col>, component, n, deviation, whitened, explained, identity_error``: a row per
    usable row and component.

    Rows whose vector is null, empty, or has a null or non-finite entry are left out;
    of vectors of unlike lengths those of the commonest length (of several, the longest)
    are used. Repeated vectors count once in the fit and get a row each; so do repeated
    and null ids. Without usable rows, or where all vectors are equal, there are no
    rows; components of eigenvalue 0 are none. ``deviation`` is null beyond a long.
    Other columns are ignored whatever their names.
    """
    bound_session(df.sparkSession)
    names = {"_id": F.col(f"`{id_col}`"), "x": whole_numbers(F.col(f"`{vector_col}`"))}
    rows = df.select(*[c.alias(n) for n, c in names.items()]).where("size(x) > 0")
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("x") == (size["d"] if size else 0))
    found = Whitening.fit(rows, components)
    if found is None:
        return rows.select(F.col("_id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    return found.transform(rows, "_id").withColumnRenamed("_id", id_col)
