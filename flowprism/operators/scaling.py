"""Feature scalers over an array<double> column: fit on train, apply anywhere.

A fitted scaler holds a few numbers per dimension, so it lives on the driver like an
MLlib model and is inlined into the projection that applies it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowprism.operators.numbering import exact_quantiles

KINDS = ("standard", "minmax", "robust", "l2", "quantile_normal")
QUANTILES = 1000
CLIP = 1e-7

# Coefficients of the rational approximation of the inverse normal
# distribution function (P. J. Acklam).
PROBIT_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
PROBIT_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
PROBIT_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
PROBIT_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
PROBIT_LOW = 0.02425


def probit(p: np.ndarray) -> np.ndarray:
    """Inverse normal distribution function for 0 < p < 1."""
    p = np.asarray(p, dtype=float)
    out = np.empty_like(p)
    low, high = p < PROBIT_LOW, p > 1 - PROBIT_LOW
    middle = ~(low | high)
    q = p[middle] - 0.5
    r = q * q
    out[middle] = np.polyval(PROBIT_A, r) * q / (np.polyval(PROBIT_B, r) * r + 1.0)
    for mask, tail, sign in ((low, p[low], 1.0), (high, 1 - p[high], -1.0)):
        q = np.sqrt(-2.0 * np.log(tail))
        out[mask] = sign * np.polyval(PROBIT_C, q) / (np.polyval(PROBIT_D, q) * q + 1.0)
    return out


@dataclass
class Scaler:
    kind: str
    center: list[float] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)
    quantiles: list[list[float]] = field(default_factory=list)

    def transform(self, rows: DataFrame, vector: str = "vector") -> DataFrame:
        if self.kind == "quantile_normal":
            return _to_normal(rows, vector, self.quantiles)
        return rows.withColumn(vector, self.expression(F.col(vector)))

    def apply(self, x: np.ndarray) -> np.ndarray:
        """The scaled rows of a matrix."""
        if self.kind == "quantile_normal":
            return _normal_scores(x, np.asarray(self.quantiles))
        if self.kind == "l2":
            norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
            return x / np.where(norm == 0, 1.0, norm)
        return (x - np.asarray(self.center)) / np.asarray(self.spread)

    def expression(self, vector: Column) -> Column:
        if self.kind == "l2":
            norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))
            return F.transform(vector, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))
        return F.array(
            *[(vector[i] - F.lit(c)) / F.lit(s) for i, (c, s) in enumerate(zip(self.center, self.spread, strict=True))]
        )


def _nonzero(values) -> list[float]:
    return [float(v) if v else 1.0 for v in values]


def dimension(rows: DataFrame, vector: str = "vector") -> int:
    return rows.select(F.size(vector)).first()[0]


def by_dimension(rows: DataFrame, vector: str = "vector") -> DataFrame:
    return rows.select(F.posexplode(vector).alias("key", "value"))


def _quantile_table(rows: DataFrame, vector: str, probs, size: int) -> list[list[float]]:
    table = [[0.0] * len(probs) for _ in range(size)]
    # dimensions x probabilities numbers: the fitted model itself
    for row in exact_quantiles(by_dimension(rows, vector), probs).collect():
        table[row["key"]][row["idx"]] = row["quantile"]
    return table


def fit_scaler(rows: DataFrame, kind: str, vector: str = "vector") -> Scaler:
    if kind not in KINDS:
        raise ValueError(f"unknown scaler {kind!r}")
    if kind == "l2":
        return Scaler(kind)
    size = dimension(rows, vector)
    if kind == "robust":
        quartiles = _quantile_table(rows, vector, [0.25, 0.5, 0.75], size)
        return Scaler(kind, [q[1] for q in quartiles], _nonzero(q[2] - q[0] for q in quartiles))
    if kind == "quantile_normal":
        points = min(QUANTILES, rows.count())
        return Scaler(kind, quantiles=_quantile_table(rows, vector, np.linspace(0, 1, points).tolist(), size))
    item = [F.col(vector)[i] for i in range(size)]
    if kind == "standard":
        first, second = (F.avg(x) for x in item), (F.stddev_pop(x) for x in item)
    else:
        first, second = (F.min(x) for x in item), (F.max(x) for x in item)
    stats = rows.agg(F.array(*first).alias("a"), F.array(*second).alias("b")).first()
    if kind == "standard":
        return Scaler(kind, list(stats["a"]), _nonzero(stats["b"]))
    return Scaler(kind, list(stats["a"]), _nonzero(b - a for a, b in zip(stats["a"], stats["b"], strict=True)))


def fit_scalers(rows: DataFrame, kinds: Sequence[str], by: str, vector: str = "vector") -> dict[tuple[int, str], Scaler]:
    """A scaler for every kind and value of the integer column ``by``: as ``fit_scaler`` on its rows, in three passes for all."""
    if unknown := set(kinds) - set(KINDS):
        raise ValueError(f"unknown scaler {min(unknown)!r}")
    size = dimension(rows, vector)
    item = [F.col(vector)[i] for i in range(size)]
    columns = {"avg": F.avg, "dev": F.stddev_pop, "least": F.min, "most": F.max}
    stats = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.array(*[f(x) for x in item]).alias(name) for name, f in columns.items()])
    stats = {r[by]: r for r in stats.collect()}
    grids = {run: np.linspace(0, 1, min(QUANTILES, r["n"])).tolist() for run, r in stats.items()} if "quantile_normal" in kinds else {}
    probs = sorted({0.25, 0.5, 0.75, *(p for grid in grids.values() for p in grid)}) if {"robust", "quantile_normal"} & set(kinds) else []
    found: dict[int, np.ndarray] = {run: np.zeros((size, len(probs))) for run in stats}
    if probs:
        values = rows.select(F.col(by), F.posexplode(vector).alias("pos", "value")).select((F.col(by) * size + F.col("pos")).alias("key"), "value")
        # runs x dimensions x probabilities numbers: the fitted models themselves
        for r in exact_quantiles(values, probs).collect():
            found[r["key"] // size][r["key"] % size, r["idx"]] = r["quantile"]
    at = {p: k for k, p in enumerate(probs)}
    out = {}
    for (run, r), kind in product(stats.items(), kinds):
        if kind == "standard":
            out[run, kind] = Scaler(kind, list(r["avg"]), _nonzero(r["dev"]))
        elif kind == "minmax":
            out[run, kind] = Scaler(kind, list(r["least"]), _nonzero(b - a for a, b in zip(r["least"], r["most"], strict=True)))
        elif kind == "robust":
            low, middle, high = (found[run][:, at[p]].tolist() for p in (0.25, 0.5, 0.75))
            out[run, kind] = Scaler(kind, middle, _nonzero(b - a for a, b in zip(low, high, strict=True)))
        elif kind == "quantile_normal":
            out[run, kind] = Scaler(kind, quantiles=found[run][:, [at[p] for p in grids[run]]].tolist())
        else:
            out[run, kind] = Scaler(kind)
    return out


def _normal_scores(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Empirical distribution by interpolation (ties take the middle), then probit."""
    grid = np.linspace(0, 1, table.shape[1])
    bound = probit(np.array([1 - CLIP]))[0]
    p = np.empty_like(x)
    for d in range(x.shape[1]):
        up = np.interp(x[:, d], table[d], grid)
        down = np.interp(-x[:, d], -table[d][::-1], -grid[::-1])
        p[:, d] = 0.5 * (up - down)
        p[x[:, d] <= table[d][0], d] = 0.0
        p[x[:, d] >= table[d][-1], d] = 1.0
    return np.clip(probit(np.clip(p, CLIP, 1 - CLIP)), -bound, bound)


def _to_normal(rows: DataFrame, vector: str, quantiles: list[list[float]]) -> DataFrame:
    table = np.asarray(quantiles)

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch = batch.assign(**{vector: list(_normal_scores(np.vstack(batch[vector].to_numpy()), table))})
            yield batch

    return rows.mapInPandas(scale, rows.schema)


def save_scaler(spark: SparkSession, scaler: Scaler, path: str) -> None:
    schema = "kind string, center array<double>, spread array<double>, quantiles array<array<double>>"
    spark.createDataFrame([(scaler.kind, scaler.center, scaler.spread, scaler.quantiles)], schema).write.mode(
        "overwrite"
    ).parquet(path)


def load_scaler(spark: SparkSession, path: str) -> Scaler:
    row = spark.read.parquet(path).first()
    return Scaler(row["kind"], list(row["center"]), list(row["spread"]), [list(q) for q in row["quantiles"]])
