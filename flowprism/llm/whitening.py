"""Whitening of embeddings by principal components, refined from float32 to double precision.

The fit list is each distinct integer vector ``floor(scale * c) + shift`` once. Spark removes the repeats (equal
vectors meet inside the tasks first), adds up exact sums per dimension and then the centred products; the
covariance, a matrix of dimension x dimension, is all that reaches the driver.

Its eigenvectors are taken in float32 and corrected by Ogita and Aishima's iteration in extended precision: with
``R = I - X'X`` and ``S = X'AX`` the correction of X is ``X E``, where ``E`` follows from R, S and the differences
of the eigenvalues. Eigenvalues closer than the error bound of that step form a cluster: there the iteration only
makes the vectors orthogonal, and each cluster is solved apart as a small matrix, shifted by its mean and scaled
up, which turns its vectors into eigenvectors before the next step.

Rows with a null vector or a null or non-finite component are left out, like rows whose vector is not of the
commonest length among the distinct ones (ties: the shortest). An empty table gives no rows. Directions whose
eigenvalue is at most ``LEAST`` of the trace cannot be scaled to one and are left out, so equal vectors alone have
no components. Repeated rows each keep their row; other columns pass through, and columns named ``whitened`` or
``deviation`` are replaced. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowprism.llm import vectors as V
from flowprism.llm.columns import fresh, schema_of
from flowprism.session import stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
LEAST = 1e-10
STEPS = 30
BLOCK = 8192


@dataclass
class Model:
    """Distinct vectors, their sums per dimension (without the shift), and components by falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray  # dimension x components
    trace: float
    shift: int = SHIFT
    scale: int = SCALE
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        return (self.eigenvalues / self.trace).tolist()


def _integers(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            yield pa.RecordBatch.from_arrays([V.floors(batch.column(0), scale).drop_null()], names=["x"])

    column = F.col(f"`{vector}`").cast("array<double>").alias("v")
    return rows.select(column).where(F.col("v").isNotNull()).mapInArrow(batches, "x binary")


def _sum_batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and sums per vector length of a task; sums as text, as they may pass 64 bits."""
    n: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in parts:
        for length, (_, x) in V.matrices(batch.column(0)).items():
            n[length] = n.get(length, 0) + len(x)
            small = len(x) * int(np.abs(x).max(initial=0)) < 1 << 62
            sums[length] = sums.get(length, 0) + (x if small else x.astype(object)).sum(axis=0).astype(object)
    rows = [(length, -1, str(n[length])) for length in n] + [(length, k, str(s)) for length in n for k, s in enumerate(sums[length])]
    for a in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[a : a + 10_000]), (pa.int32(), pa.int32(), pa.string()), strict=True)], names=["length", "place", "value"])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n`` in double precision."""
    mean = [divmod(s, n) for s in sums]
    return (x - np.array([m for m, _ in mean], np.int64)).astype(np.float64) - np.array([r / n for _, r in mean])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of ``(n * x - sums)^2``, exact."""
    mean = [divmod(s, n) for s in sums]
    near = x - np.array([m for m, _ in mean], np.int64)
    rest = [r for _, r in mean]
    reach = n * int(np.abs(near).max(initial=0)) + max(rest, default=0)
    if reach * reach * max(1, x.shape[1]) < 1 << 62:
        t = near * n - np.array(rest, np.int64)
        return (t * t).sum(axis=1).tolist()
    t = near.astype(object) * n - np.array(rest, object)
    return [v if v < 1 << 63 else None for v in (t * t).sum(axis=1).tolist()]


def _products(fit: DataFrame, length: int, n: int, sums: list[int], into: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the outer products of the centred vectors (or of their images under ``into``), and their sum."""
    width = length if into is None else into.shape[1]

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in parts:
            _, x = V.matrices(batch.column(0)).get(length, (None, np.zeros((0, length), np.int64)))
            for a in range(0, len(x), BLOCK):
                z = centred(x[a : a + BLOCK], n, sums)
                z = z if into is None else z @ into
                total[:width] += z.T @ z
                total[width] += z.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array([row.tobytes() for row in total], pa.binary())], names=["line", "body"])

    def add(table: pa.Table) -> pa.Table:
        bodies = table.column("body").to_pylist()
        total = np.sum([np.frombuffer(b) for b in bodies], axis=0)
        return pa.table({"line": pa.array([table.column("line")[0].as_py()], pa.int32()), "body": pa.array([total.tobytes()], pa.binary())})

    # As many rows as the width of the matrix, whatever the number of vectors.
    lines = fit.mapInArrow(batches, "line int, body binary").groupBy("line").applyInArrow(add, "line int, body binary").collect()
    total = np.zeros((width + 1, width))
    for line in lines:
        total[line["line"]] = np.frombuffer(line["body"])
    return total[:width], total[width]


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of indices whose sorted values follow each other by at most ``gap``; only runs of two and more."""
    order = np.argsort(values, kind="stable")
    breaks = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [run for run in np.split(order, breaks) if len(run) > 1]


def refine(a: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, to double precision."""
    size = len(a)
    scale = float(np.abs(a).max(initial=0.0)) or 1.0
    high = np.longdouble if size <= 256 else np.float64
    work = np.asarray(a, high) / high(scale)
    _, start = np.linalg.eigh((np.asarray(a) / scale).astype(np.float32))
    x = start.astype(high)
    one = np.eye(size, dtype=high)
    norm = np.sqrt((work * work).sum())
    for _ in range(steps):
        r = one - x.T @ x
        s = x.T @ work @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        bound = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        # Below this, rounding errors divided by the gap would not be small.
        bound = max(bound, norm * np.sqrt(np.finfo(high).eps))
        apart = values[None, :] - values[:, None]
        far = np.abs(apart) > bound
        e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
        x = x + x @ e
        for group in clusters(values, float(bound)):
            x[:, group] = _apart(work, x[:, group])
        if float(np.abs(e).max(initial=0)) < np.finfo(np.float64).eps / 64:
            break
    for _ in range(2):
        x = x + x @ (one - x.T @ x) / 2
    values = np.diag(x.T @ work @ x) / np.diag(x.T @ x)
    x = x / np.sqrt((x * x).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    return (values[order] * high(scale)).astype(np.float64), x[:, order].astype(np.float64)


def _apart(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Eigenvectors of ``a`` inside the span of the columns of ``x``."""
    # Two rounds make nearly orthogonal columns orthogonal to working precision.
    for _ in range(2):
        x = x + x @ (np.eye(x.shape[1], dtype=x.dtype) - x.T @ x) / 2
    small = x.T @ a @ x
    small = (small + small.T) / 2
    small = small - np.eye(len(small), dtype=a.dtype) * np.trace(small) / len(small)
    most = np.abs(small).max()
    if not most:
        return x
    _, turn = np.linalg.eigh((small / most).astype(np.float64))
    return x @ turn.astype(x.dtype)


def fit(rows: DataFrame, vector: str = "embedding", *, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Model | None:
    """The model of a table; None where no vector takes part."""
    distinct = stored(_integers(rows, vector, scale).distinct(), "whitening")
    value = F.sum(F.col("value").cast("decimal(38,0)")).alias("value")
    found = distinct.mapInArrow(_sum_batches, "length int, place int, value string").groupBy("length", "place").agg(value)
    found = stored(found, "sums")
    sizes = found.where("place = -1").orderBy(F.desc("value"), "length").first()
    if sizes is None:
        return None
    length, n = sizes["length"], int(sizes["value"])
    # One number for each dimension.
    sums = [int(r["value"]) for r in found.where((F.col("length") == length) & (F.col("place") >= 0)).orderBy("place").collect()]
    products, _ = _products(distinct, length, n, sums)
    covariance = (products + products.T) / (2 * n)
    trace = float(np.trace(covariance))
    values, x = refine(covariance) if length else (np.zeros(0), np.zeros((0, 0)))
    chosen = np.flatnonzero(values > LEAST * trace)[:components]
    model = Model(n, sums, values[chosen], x[:, chosen], trace, shift, scale)
    if len(chosen):
        squares, total = _products(distinct, length, n, sums, model.components / np.sqrt(model.eigenvalues))
        spread = squares / n - np.outer(total / n, total / n)
        model.identity_error = float(np.abs(spread - np.eye(len(chosen))).max())
    return model


def transform(rows: DataFrame, model: Model | None, vector: str = "embedding") -> DataFrame:
    """The rows that take part, with ``whitened`` (array<double>) and ``deviation`` (bigint)."""
    kept = [c for c in rows.columns if c not in ("whitened", "deviation")]
    (given,) = fresh(kept, "v")
    schema = ", ".join([*([schema_of(rows, kept)] if kept else []), "whitened array<double>, deviation bigint"])
    columns = [F.col(f"`{c}`") for c in kept]
    if model is None:
        return rows.limit(0).select(*columns, F.lit(None).cast("array<double>").alias("whitened"), F.lit(None).cast("bigint").alias("deviation"))
    n, sums, scale, length = model.n, model.sums, model.scale, len(model.sums)
    into = model.components / np.sqrt(model.eigenvalues)

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            at, x = V.matrices(V.floors(batch.column(batch.num_columns - 1), scale)).get(length, (np.zeros(0, np.int64), np.zeros((0, length), np.int64)))
            w = centred(x, n, sums) @ into
            offsets = pa.array(np.arange(len(at) + 1) * w.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))
            own = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*own.columns[:-1], lists, pa.array(deviations(x, n, sums), pa.int64())], names=[*kept, "whitened", "deviation"])

    return rows.select(*columns, F.col(f"`{vector}`").cast("array<double>").alias(given)).mapInArrow(batches, schema)


def components_of(rows: DataFrame, row_id: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """One row for each row that takes part and component: the projection and what the fit knows of the component."""
    model = fit(rows, vector, **options)
    out = transform(rows.select(row_id, vector), model, vector)
    explained = F.lit(model.explained if model else []).cast("array<double>")
    return out.select(F.col(row_id), "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        row_id, (F.col("_at") + 1).alias("component"), F.lit(model.n if model else 0).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_at")).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
