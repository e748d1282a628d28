"""Embedding whitening: eigenpairs of the covariance by Jacobi-Davidson, without ever forming the covariance.

The covariance meets vectors only as a product: tasks send (x - mean)' ((x - mean) Q) of their rows for a whole block of
vectors Q, parts of them are summed in the tasks of a second stage, and the driver gets at most PARTS blocks of the
shape of Q. Differences from the mean are exact integers n x - S until they become doubles.

The driver holds a basis of a few times the wanted number of vectors, each as long as a row. Rayleigh-Ritz on it gives
approximations; those whose residual is as small as doubles allow are locked and deflated, in order. For the next ones
the correction equations, projected against locked and current vectors, are solved inexactly by MINRES, all at once, so
that an inner step is one distributed product. A basis at its limit restarts with its best Ritz vectors. The residuals
that count in the end are those of fresh products.

Defined results: the dimension is the length that most vectors have (the least of these on ties), and vectors of another
length are dropped like null ones; repeated rows count and return each; a component of no variance (1e-12 of the largest,
as doubles can't tell it from none) isn't returned; a deviation beyond 64 bits is null; an entry
beyond 2**56 is an error; an empty table, or one without
variance, gives an empty result; null ids are kept; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, staged

#: Tasks of the second stage of a sum, and blocks that the driver gets.
PARTS = 64
#: Residuals are at double precision when below this part of the largest eigenvalue, times the root of the dimension.
PRECISION = 4 * np.finfo(float).eps
#: A component's least part of the largest variance.
LEAST = 1e-12
#: Inner MINRES steps to a correction, and Ritz pairs that are corrected together.
INNER, TOGETHER = 4, 16
#: Basis vectors to a wanted one at most, and rounds after which the search ends with an error.
BASIS, ROUNDS = 3, 200
_MOST = 1 << 28


@dataclass
class Fit:
    n: int
    sums: list[int]
    variance: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int
    identity_error: float = 0.0


def entries(rows: pa.Array) -> np.ndarray:
    """Vectors as a matrix of integers floor(64 c) + 1000000; of Python integers where those are large."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = np.floor(64 * flat).reshape(len(rows), -1)
    if x.size and np.abs(x).max() >= 1 << 62:
        raise OverflowError("an entry of a vector is beyond 64-bit integers")
    if x.size and np.abs(x).max() >= _MOST:
        return np.array([[int(c) + 1_000_000 for c in r] for r in x.tolist()], object).reshape(x.shape)
    return x.astype(np.int64) + 1_000_000


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact."""
    large = x.dtype == object or n >= _MOST or max(map(abs, sums), default=0) >= 1 << 62 or (len(x) and int(np.abs(x).max()) * n >= 1 << 62)
    return x.astype(object) * n - np.array(sums, object) if large else x * n - np.array(sums, np.int64)


def deviations(centre: np.ndarray) -> list[int | None]:
    if centre.dtype != object and (not centre.size or int(np.abs(centre).max()) ** 2 * centre.shape[1] < 1 << 63):
        return (centre * centre).sum(1).tolist()
    exact = [sum(int(c) ** 2 for c in r) for r in centre.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def _block(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, "<f8").tobytes()


def _add(parts: Iterator[bytes]) -> np.ndarray:
    return np.sum([np.frombuffer(b, "<f8") for b in parts], axis=0)


def summed(rows: DataFrame, of, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over the batches of rows of what ``of(batch)`` gives, an array of this shape: tasks, then parts, then the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % PARTS], pa.int32()), pa.array([_block(total)], pa.binary())], names=["part", "block"])

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([_block(_add(table.column("block").to_pylist()))], pa.binary())})

    parts = rows.mapInArrow(task, "part int, block binary").groupBy("part").applyInArrow(merge, "block binary").collect()
    return _add(r["block"] for r in parts).reshape(shape) if parts else np.zeros(shape)


class Covariance:
    """Products of the covariance of vectors (column x) with blocks of vectors."""

    def __init__(self, rows: DataFrame, n: int, sums: list[int]) -> None:
        self.rows, self.n, self.sums, self.size, self.products = rows.select("x"), n, sums, len(sums), 0

    def __call__(self, q: np.ndarray) -> np.ndarray:
        n, sums, q = self.n, self.sums, np.ascontiguousarray(q)
        self.products += 1

        def of(batch: pa.RecordBatch) -> np.ndarray:
            c = centred(entries(batch.column(0)), n, sums).astype(float) / n
            return c.T @ (c @ q)

        return summed(self.rows, of, q.shape) / n


def orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what new adds to an orthonormal basis."""
    norms = np.linalg.norm(new, axis=0)
    new = new[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        new = new - basis @ (basis.T @ new)
        q, r = np.linalg.qr(new)
        new = q[:, np.abs(np.diag(r)) > 1e-10]
    return new


def corrections(product, theta: np.ndarray, residuals: np.ndarray, away: np.ndarray, steps: int) -> np.ndarray:
    """Steps of MINRES on (1 - QQ')(A - theta)(1 - QQ') t = -r with Q = away, for all columns at once."""
    outside = lambda v: v - away @ (away.T @ v)
    v_old, v = np.zeros_like(residuals), outside(-residuals)
    beta = np.linalg.norm(v, axis=0)
    eta, tiny = beta.copy(), np.finfo(float).tiny
    v = v / np.maximum(beta, tiny)
    t, w_old, w = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    cos_old, cos, sin_old, sin = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    beta = np.zeros_like(beta)
    for _ in range(steps):
        u = outside(product(v) - v * theta)
        alpha = (u * v).sum(0)
        u = u - v * alpha - v_old * beta
        beta_new = np.linalg.norm(u, axis=0)
        delta = cos * alpha - cos_old * sin * beta
        upper = sin * alpha + cos_old * cos * beta
        most = sin_old * beta
        rho = np.maximum(np.hypot(delta, beta_new), tiny)
        cos_old, cos, sin_old, sin = cos, delta / rho, sin, beta_new / rho
        w_old, w = w, (v - w * upper - w_old * most) / rho
        t = t + w * (cos * eta)
        eta = -sin * eta
        v_old, v, beta = v, u / np.maximum(beta_new, tiny), beta_new
        done = beta_new <= 1e-14 * np.abs(theta)
        v, eta = np.where(done, 0, v), np.where(done, 0, eta)
    return outside(t)


def jacobi_davidson(product, size: int, wanted: int, inner: int = INNER, together: int = TOGETHER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors, norms of residuals) of the wanted largest eigenvalues, falling."""
    wanted = min(wanted, size)
    limit = min(size, max(BASIS * wanted, wanted + 2 * together))
    basis = orthonormal(np.random.default_rng(size).standard_normal((size, min(size, wanted + together))), np.zeros((size, 0)))
    images = product(basis)
    locked, locked_values, scale = np.zeros((size, 0)), [], 0.0
    for _ in range(ROUNDS):
        inside = basis.T @ images
        values, turn = np.linalg.eigh((inside + inside.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, images = basis @ turn, images @ turn  # Ritz vectors and their images
        residuals = images - basis * values
        residuals -= locked @ (locked.T @ residuals)
        scale = max(scale, float(np.abs(values).max(initial=0)), *map(abs, locked_values[:1]), np.finfo(float).tiny)
        small = np.linalg.norm(residuals, axis=0) <= PRECISION * np.sqrt(size) * scale
        ready = 0
        while ready < len(small) and len(locked_values) + ready < wanted and small[ready]:
            ready += 1
        if ready:
            locked = np.hstack([locked, basis[:, :ready]])
            locked_values += values[:ready].tolist()
            basis, images, values, residuals, small = basis[:, ready:], images[:, ready:], values[ready:], residuals[:, ready:], small[ready:]
        missing = wanted - len(locked_values)
        if not missing or not basis.shape[1]:
            break
        if basis.shape[1] + together > limit - len(locked_values) and len(locked_values) + basis.shape[1] < size:
            keep = min(basis.shape[1], missing + together // 2)
            basis, images = basis[:, :keep], images[:, :keep]
        open_ = np.flatnonzero(~small[:missing])[:together]
        solved = corrections(product, values[open_], residuals[:, open_], np.hstack([locked, basis[:, :missing]]), inner)
        new = orthonormal(np.hstack([solved, residuals[:, open_]]), np.hstack([locked, basis]))[:, : size - len(locked_values) - basis.shape[1]]
        if not new.shape[1]:  # nothing is left to add: rounding has the rest
            new = orthonormal(np.random.default_rng(len(locked_values)).standard_normal((size, together)), np.hstack([locked, basis]))
            if not new.shape[1]:
                locked, locked_values = np.hstack([locked, basis[:, :missing]]), locked_values + values[:missing].tolist()
                break
        basis, images = np.hstack([basis, new]), np.hstack([images, product(new)])
    else:
        raise ArithmeticError(f"residuals aren't at double precision after {ROUNDS} rounds: {np.linalg.norm(residuals, axis=0)[:missing].max():.3g}")
    order = np.argsort(-np.array(locked_values), kind="stable")
    vectors = locked[:, order] / np.linalg.norm(locked[:, order], axis=0)
    images = product(vectors)
    values = (vectors * images).sum(0)
    return values, vectors, np.linalg.norm(images - vectors * values, axis=0)


def vectors_of(table: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key and x, the finite vectors of the length that most of them have."""
    rows = table.select(table[key].alias("key"), table[vector].cast("array<double>").alias("x"))
    rows = rows.filter("x IS NOT NULL AND size(x) > 0").filter(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("x") == (lengths[0]["d"] if lengths else 0))


def fit(rows: DataFrame, components: int = 32) -> Fit:
    """Eigenpairs of the covariance of staged vectors (x), to double precision."""
    size = rows.select(F.size("x")).limit(1).collect()
    if not size:
        return Fit(0, [], 0.0, np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0)
    size = size[0][0]
    whole = F.transform("x", lambda c: F.floor(c * 64).cast("decimal(38,0)") + 1_000_000)
    sums = rows.select(F.posexplode(whole).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.count("*").alias("n")).collect()
    n, sums = sums[0]["n"], [int(r["s"]) for r in sorted(sums)]
    product = Covariance(rows, n, sums)
    squares = summed(rows.select("x"), lambda b: np.square(centred(entries(b.column(0)), n, sums).astype(float) / n).sum(keepdims=True)[0], (1,))
    variance = float(squares[0]) / n
    if not variance:
        return Fit(n, sums, 0.0, np.zeros(0), np.zeros((size, 0)), np.zeros(0), 0)
    values, vectors, residuals = jacobi_davidson(product, size, components)
    some = values > LEAST * values[0]
    out = Fit(n, sums, variance, values[some], vectors[:, some], residuals[some], product.products)
    out.identity_error = identity_error(rows, out)
    return out


def projected(x: np.ndarray, f: Fit) -> tuple[np.ndarray, np.ndarray]:
    """(n x - S exact, whitened)"""
    centre = centred(x, f.n, f.sums)
    return centre, centre.astype(float) / f.n @ f.vectors / np.sqrt(f.values)


def identity_error(rows: DataFrame, f: Fit) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = len(f.values)
    white = lambda b: projected(entries(b.column(0)), f)[1]
    mean = summed(rows.select("x"), lambda b: white(b).sum(0), (k,)) / f.n
    square = summed(rows.select("x"), lambda b: (white(b) - mean).T @ (white(b) - mean), (k, k)) / f.n
    return float(np.abs(square - np.eye(k)).max(initial=0))


def whiten(table: DataFrame, components: int = 32, vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, Fit]:
    """Of each finite vector key, deviation and the array whitened; and the fit."""
    small_batches(table.sparkSession)
    rows = staged(vectors_of(table, vector, key), "vectors")
    f = fit(rows, components)
    kind = rows.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(f.values):
                continue
            centre, white = projected(entries(batch.column(1)), f)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(centre), pa.int64()), pa.array(list(white), pa.list_(pa.float64()))], names=["key", "deviation", "whitened"])

    return rows.mapInArrow(work, f"key {kind}, deviation long, whitened array<double>"), f


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, f = whiten(read(spark, sf_dir, "embeddings"))
    explained = F.array(*[F.lit(float(v)) for v in f.values / f.variance]) if len(f.values) else F.array().cast("array<double>")
    long = rows.select("key", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return long.select(
        F.col("key").alias("vec_id"),
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(f.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("i")).alias("explained"),
        F.lit(f.identity_error).alias("identity_error"),
    )
