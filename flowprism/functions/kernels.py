"""Kernels and kernel distances, as column expressions and as numpy blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

KERNELS = ("linear", "poly", "rbf", "sigmoid")
COEF0 = 1.0
DEGREE = 3


def _check(kernel: str, euclidean: bool = False) -> None:
    if kernel not in KERNELS and not (euclidean and kernel == "euclidean"):
        raise ValueError(f"unknown kernel {kernel!r}")


def dot(x: Column, y: Column) -> Column:
    same = F.size(x) == F.size(y)
    total = F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.when(same, total).otherwise(
        F.raise_error(F.lit("the number of features in both vectors must be the same")).cast("double")
    )


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def kernel(x: Column, y: Column, name: str) -> Column:
    """K(x, y); gamma is 1 / number of features."""
    _check(name)
    gamma = F.lit(1.0) / F.size(x)
    if name == "linear":
        return dot(x, y)
    if name == "poly":
        return F.pow(gamma * dot(x, y) + COEF0, F.lit(float(DEGREE)))
    if name == "rbf":
        return F.exp(-gamma * squared_distance(x, y))
    return F.tanh(gamma * dot(x, y) + COEF0)


def kernel_distance(x: Column, y: Column, name: str) -> Column:
    """K(x,x) - 2 K(x,y) + K(y,y); plain distance for ``euclidean``."""
    _check(name, euclidean=True)
    if name == "euclidean":
        return F.sqrt(squared_distance(x, y))
    return kernel(x, x, name) - 2 * kernel(x, y, name) + kernel(y, y, name)


def _square(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


def block_distances(x: np.ndarray, y: np.ndarray, name: str) -> np.ndarray:
    """Kernel distances of every row of one block to every row of another."""
    gamma = 1.0 / x.shape[1]
    products = x @ y.T
    xx, yy = _square(x)[:, None], _square(y)[None, :]
    if name == "linear":
        return xx - 2 * products + yy
    apart = np.maximum(xx - 2 * products + yy, 0.0)
    if name == "euclidean":
        return np.sqrt(apart)
    if name == "rbf":
        return 2.0 - 2.0 * np.exp(-gamma * apart)
    shape = (lambda p: (gamma * p + COEF0) ** DEGREE) if name == "poly" else (lambda p: np.tanh(gamma * p + COEF0))
    return shape(xx) - 2 * shape(products) + shape(yy)


def paired_distances(x: np.ndarray, y: np.ndarray, name: str) -> np.ndarray:
    """Kernel distances of row after row of two equal blocks, from differences where the kernel allows it."""
    gamma = 1.0 / x.shape[1]
    apart = _square(x - y)
    if name == "linear":
        return apart
    if name == "euclidean":
        return np.sqrt(apart)
    if name == "rbf":
        return -2.0 * np.expm1(-gamma * apart)
    xx, xy, yy = _square(x), np.einsum("ij,ij->i", x, y), _square(y)
    shape = (lambda p: (gamma * p + COEF0) ** DEGREE) if name == "poly" else (lambda p: np.tanh(gamma * p + COEF0))
    return shape(xx) - 2 * shape(xy) + shape(yy)


def to_metric(distances: np.ndarray, name: str) -> np.ndarray:
    """A true metric that grows with the kernel distance (linear, poly, rbf, euclidean)."""
    if name == "euclidean":
        return distances
    return np.sqrt(np.maximum(distances, 0.0))
