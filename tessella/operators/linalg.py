"""Small matrices: tables (row, column, v) where they are data, numpy where they are parameters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(m, i, j, v) of a and b, matrix by matrix: an equi-join on the inner index and a sum."""
    left = a.select("m", "i", F.col("j").alias("k"), F.col("v").alias("p"))
    right = b.select("m", F.col("i").alias("k"), "j", F.col("v").alias("q"))
    return left.join(right, ["m", "k"]).groupBy("m", "i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select("m", F.col("j").alias("i"), F.col("i").alias("j"), "v")


def add(a: DataFrame, b: DataFrame, factor: float = 1.0) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "w"), ["m", "i", "j"]).select("m", "i", "j", (F.col("v") + factor * F.col("w")).alias("v"))


def identity(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    return spark.range(n * n).select(F.lit(0).cast("long").alias("m"), F.floor(i / n).cast("int").alias("i"), (i % n).cast("int").alias("j"), F.when(F.floor(i / n) == i % n, 1.0).otherwise(0.0).alias("v"))


def diagonal(values: DataFrame) -> DataFrame:
    """Matrix with values (m, i, v) on its diagonal, the zeros left out."""
    return values.select("m", "i", F.col("i").alias("j"), "v")


def inverse3(m: Column) -> Column:
    """Inverse of a 3x3 matrix given as an array of 9; null if there is none."""
    at = lambda i, j: F.element_at(m, 3 * (i % 3) + j % 3 + 1)
    cof = lambda i, j: at(i + 1, j + 1) * at(i + 2, j + 2) - at(i + 1, j + 2) * at(i + 2, j + 1)
    det = at(0, 0) * cof(0, 0) + at(0, 1) * cof(0, 1) + at(0, 2) * cof(0, 2)
    return F.when(det != 0, F.array(*[cof(j, i) / det for i in range(3) for j in range(3)]))


def conjugate_gradient(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """Solve a x = b for a symmetric positive definite a."""
    x, r = np.zeros_like(b, float), b.astype(float)
    p, rr = r.copy(), float(r @ r)
    for _ in range(2 * len(b)):
        if rr <= tolerance:
            break
        ap = a @ p
        alpha = rr / (p @ ap)
        x, r = x + alpha * p, r - alpha * ap
        new = float(r @ r)
        p, rr = r + (new / rr) * p, new
    return x


def least_squares(features: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of the rows of features whose sum is nearest to target."""
    return conjugate_gradient(features @ features.T, features @ target)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(t, u) with a = u t u^T, t tridiagonal and u orthogonal, for a symmetric a: Householder reflections."""
    t, u = a.astype(float).copy(), np.eye(len(a))
    for k in range(len(a) - 2):
        v = t[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if size < 1e-300:
            continue
        h = np.eye(len(a))
        h[k + 1 :, k + 1 :] -= 2 * np.outer(v, v) / size**2
        t, u = h @ t @ h, u @ h
    return t, u


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and orthonormal eigenvectors of a symmetric matrix."""
    return np.linalg.eigh(a)


def qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonal q and upper triangular r with positive diagonal."""
    q, r = np.linalg.qr(a)
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    return q * sign, r * sign[:, None]


def givens(x: float, y: float) -> tuple[float, float]:
    """(c, s) that turn (x, y) to (length, 0)."""
    size = np.hypot(x, y)
    return (1.0, 0.0) if size == 0 else (x / size, -y / size)


def gram(vectors: DataFrame, column: str) -> np.ndarray:
    """Sum of outer products over all rows: each task sums its own, and only n x n cells are shuffled."""

    def partial(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.asarray(v, float) for v in pdf[column]])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            n = len(total)
            yield pd.DataFrame({"i": np.repeat(np.arange(n), n), "j": np.tile(np.arange(n), n), "v": total.ravel()})

    cells = vectors.select(column).mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    n = 1 + max((r["i"] for r in cells), default=-1)
    out = np.zeros((n, n))
    for r in cells:
        out[r["i"], r["j"]] = r["v"]
    return out


def minimise(f, gradient, start: np.ndarray, steps: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Nonlinear conjugate gradients (Polak-Ribiere) with backtracking; f and gradient may be Spark aggregates."""
    x = np.asarray(start, float)
    g = gradient(x)
    d, t = -g, 1.0
    for _ in range(steps):
        if np.linalg.norm(g) < tolerance:
            break
        slope = float(g @ d)
        if slope >= 0:
            d, slope = -g, -float(g @ g)
        here, t = f(x), min(1.0, 4 * t)
        while t > 1e-16 and f(x + t * d) > here + 1e-4 * t * slope:
            t *= 0.5
        x = x + t * d
        new = gradient(x)
        d = -new + max(0.0, float(new @ (new - g)) / max(float(g @ g), 1e-300)) * d
        g = new
    return x
