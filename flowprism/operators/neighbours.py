"""Exact nearest neighbours by blocks.

Vectors lie in cells around a bounded set of pivots. A cell of more than one block is cut
into tiles by two distances, to its own pivot and to a pivot far away, and a tile is hashed
into blocks of bounded size. Tasks compare rows as matrix products and emit only each
query's own short list, so pairs are never rows. First every query meets its own tile (its
ring or cell where the tile is too small), which bounds how far its list can reach. Then
cells are gathered into lots, a bounded number of them up to a bounded size, and a task
takes a lot of queries and a lot of points: it visits the pairs of blocks that the triangle
inequality cannot exclude, in a query's own cell too, and there only the queries that can
reach the block. So a row is shuffled once per lot of
the other side, not once per block. A kernel without a metric has one cell and visits every
pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowprism.functions.kernels import block_distances, paired_distances, to_metric
from flowprism.session import broadcast_if_small, durable, stored

BLOCK_ROWS = 2048
# Pivots grow with the square root of the points between these two.
LEAST_PIVOTS = 256
MAX_PIVOTS = 4096
# A cell is cut into at most BINS x BINS tiles; the far pivot is one of the first REFERENCES.
BINS = 16
REFERENCES = 16
# A side has some LOTS lots, whatever its size, so what is shuffled grows with the rows; lots of more than LOT_ROWS rows are not made, so very large sides have more.
LOTS = 6
LOT_ROWS = 65536
LEAST_LOT = 512
# Distances held at once by a task.
HELD = 1 << 21
# Queries with a bound that are compared together, whatever blocks they are from; small enough for a core's own cache.
TOGETHER = 1024
# Rows of the units of one group of a comparison at home.
UNIT_ROWS = 65536
# Share of the squares of two vectors by which their squared distance may be off as a matrix product.
DOUBT = 1e-12
# Distances equal after rounding count as one step.
DIGITS = 9
_METRIC = ("linear", "poly", "rbf", "euclidean")
# Kernels whose distance grows with the squared distance of the vectors.
_BY_SQUARE = ("linear", "rbf", "euclidean")


def knn_rank(pairs: DataFrame, steps: int, gap: float = 0.5e-9) -> DataFrame:
    """Walk each point's pairs by (d, j) and stop at the ``steps``-th distance step.

    A step is a distance that differs from the one before it (the walk starts at 0).
    Ties before the last step all stay; at the last step only the first one does.
    """
    order = Window.partitionBy("i").orderBy("d", "j")
    stepped = F.abs(F.col("d") - F.coalesce(F.lag("d").over(order), F.lit(0.0))) > gap
    walked = pairs.withColumn("is_step", stepped)
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = walked.withColumn("step", F.sum(F.col("is_step").cast("int")).over(run))
    return (
        walked.where((F.col("step") < steps) | ((F.col("step") == steps) & F.col("is_step")))
        .withColumn("pos", F.row_number().over(order))
    )


def k_distance(ranked: DataFrame) -> DataFrame:
    """Distance of the last counted step per point, -1 when there is none."""
    last = F.max(F.when(F.col("is_step"), F.col("d")))
    return ranked.groupBy("i").agg(F.coalesce(last, F.lit(-1.0)).alias("k_distance"))


def topk_neighbours(pairs: DataFrame, k: int) -> DataFrame:
    """The k smallest pairs per point by (d, j)."""
    order = Window.partitionBy("i").orderBy("d", "j")
    return pairs.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def nearest_one(pairs: DataFrame) -> DataFrame:
    """The closest point and its distance, as a plain aggregate."""
    return pairs.groupBy("i").agg(
        F.min_by("j", F.struct("d", "j")).alias("j"), F.min("d").alias("d")
    )


def _pivots(points: DataFrame, rows: int, block_rows: int) -> np.ndarray | None:
    wanted = min(-(-rows // block_rows), max(LEAST_PIVOTS, math.isqrt(rows)), MAX_PIVOTS)
    if wanted <= 1:
        return None
    chosen = points.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vector")
    # At most MAX_PIVOTS vectors reach the driver.
    return np.vstack([row["vector"] for row in chosen.collect()])


def _opposite(pivots: np.ndarray, kernel: str) -> np.ndarray:
    """The far pivot of each cell."""
    return block_distances(pivots, pivots[:REFERENCES], kernel).argmax(axis=1)


def _assign(rows: DataFrame, pivots: np.ndarray | None, kernel: str) -> DataFrame:
    """Add ``cell`` (closest pivot), ``reach`` (metric distance to it) and ``slant`` (to the cell's far pivot)."""
    if pivots is None:
        return rows.withColumns({"cell": F.lit(0), "reach": F.lit(0.0), "slant": F.lit(0.0)})
    opposite = _opposite(pivots, kernel)

    def exact(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
        return to_metric(paired_distances(vectors, others, kernel), kernel)

    def closest(vectors: np.ndarray) -> np.ndarray:
        some = max(1, HELD // len(pivots))
        parts = [block_distances(vectors[at : at + some], pivots, kernel).argmin(axis=1) for at in range(0, len(vectors), some)]
        return np.concatenate(parts)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = np.vstack(batch["vector"].to_numpy())
                cell = closest(vectors)
                reach, slant = exact(vectors, pivots[cell]), exact(vectors, pivots[opposite[cell]])
                batch = batch.assign(cell=cell.astype("int32"), reach=reach, slant=slant)
            else:
                none = pd.Series(dtype="float64")
                batch = batch.assign(cell=pd.Series(dtype="int32"), reach=none, slant=none)
            yield batch

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(place, f"{schema}, cell int, reach double, slant double")


def _placed(rows: DataFrame, pivots: np.ndarray | None, kernel: str) -> DataFrame:
    """Rows in their cells; kept, as sizes, blocks and both phases read them."""
    placed = _assign(rows, pivots, kernel)
    return placed if pivots is None else stored(placed, "placed")


def _edges(rows: DataFrame, block_rows: int) -> DataFrame:
    """``grp, cell, by_reach, by_slant``: where a cell is cut, quantiles of its two distances; none in a cell of one block."""
    cuts = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    found = rows.groupBy("grp", "cell").agg(
        F.count(F.lit(1)).alias("n"), *(F.percentile_approx(c, cuts, F.lit(1000)).alias(f"by_{c}") for c in ("reach", "slant"))
    )
    # Tiles a side: a power of two, so that each takes every such step of the sixteen quantiles.
    side = F.least(F.lit(float(BINS)), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / block_rows, F.lit(1.0))) / 2)))
    step = (F.lit(BINS) / side).cast("int")
    chosen = [F.filter(f"by_{c}", lambda _, at: (at + 1) % step == 0).alias(f"by_{c}") for c in ("reach", "slant")]
    return found.select("grp", "cell", *chosen)


def _blocked(rows: DataFrame, block_rows: int, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their tile and block (``tile``, ``sub``), and the tiles with the ranges of both distances."""
    # At most MAX_PIVOTS cells per group: rows of a hot cell stay where they are.
    cut = rows.join(broadcast_if_small(edges), ["grp", "cell"], "left")
    ring = F.size(F.filter("by_reach", lambda edge: edge < F.col("reach")))
    slice_ = F.size(F.filter("by_slant", lambda edge: edge < F.col("slant")))
    cut = cut.withColumn("tile", F.coalesce(ring * BINS + slice_, F.lit(0))).drop("by_reach", "by_slant")
    tiles = cut.groupBy("grp", "cell", "tile").agg(
        F.count(F.lit(1)).alias("n"),
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"),
        F.min("reach").alias("inner"),
        F.max("reach").alias("radius"),
        F.min("slant").alias("low"),
        F.max("slant").alias("high"),
        F.min("weight").alias("least"),
    )
    tiles = durable(tiles)
    parts = broadcast_if_small(tiles.select("grp", "cell", "tile", "parts"))
    blocked = cut.join(parts, ["grp", "cell", "tile"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return blocked.drop("parts"), tiles


def _side(blocks: DataFrame, side: str) -> DataFrame:
    """Tile or cell columns with the prefix of their side of a comparison."""
    return blocks.select("grp", *(F.col(c).alias(f"{side}_{c}") for c in blocks.columns if c != "grp"))


def _limits(far: np.ndarray, steps: int, levels: bool, digits: int) -> np.ndarray:
    """Per row a distance that its list among these columns does not pass; infinite where a few columns cannot tell."""
    some = 2 * steps if levels else steps
    if some >= far.shape[1]:
        return np.full(len(far), np.inf)
    least = np.sort(np.partition(far, some - 1, axis=1)[:, :some], axis=1)
    if not levels:
        return least[:, -1]
    near = np.round(least, digits) + 0.0
    passed = (near != np.hstack([np.zeros((len(near), 1)), near[:, :-1]])).sum(axis=1)
    return np.where(passed >= steps, least[:, -1], np.inf)


def _short_lists(far: np.ndarray, ids: np.ndarray, cut: np.ndarray, plan: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and rounded distance of each row's short list; ``cut`` is as far as the lists reach."""
    steps, levels, digits = plan["steps"], plan["levels"], plan["digits"]
    slack = 10.0**-digits
    # Not <=, so undefined distances stay; they come last.
    held = ~(far > (cut + slack)[:, None])
    if held.sum() > 4 * steps * len(far):
        held &= ~(far > (_limits(far, steps, levels, digits) + slack)[:, None])
    row, at = held.nonzero()
    return _walked(row, ids[at], far[row, at], len(far), plan)[:3]


def _walked(row: np.ndarray, j: np.ndarray, far: np.ndarray, rows: int, plan: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and rounded distance of each row's short list among these pairs, and where each list ends; infinite where it is not full."""
    steps = plan["steps"]
    d = np.round(far, plan["digits"]) + 0.0
    order = np.lexsort((j, d, row))
    row, d, j = row[order], d[order], j[order]
    begins = np.searchsorted(row, np.arange(rows))
    if plan["levels"]:
        before = np.concatenate([[0.0], d[:-1]])
        before[begins[begins < len(row)]] = 0.0
        is_step = d != before
        total = np.concatenate([[0], is_step.cumsum()])
        step = total[1:] - total[begins][row]
        keep = (step < steps) | ((step == steps) & is_step)
        last = keep & (step == steps)
    else:
        place = np.arange(len(row)) - begins[row]
        keep = (place < steps) & np.isfinite(d)
        last = keep & (place == steps - 1)
    ends = np.full(rows, np.inf)
    ends[row[last]] = d[last]
    # An undefined distance ends no list.
    return row[keep], j[keep], d[keep], np.where(np.isnan(ends), np.inf, ends)


def _lists(query: pd.DataFrame, point: pd.DataFrame, plan: dict, pivots: np.ndarray | None) -> pd.DataFrame:
    """``i, j, d``: short lists of the queries ``(id, vector, cell, tile, sub, reach, slant, cut)`` among the points, from the blocks their cuts reach."""
    if not len(query) or not len(point):
        return pd.DataFrame({"i": [], "j": [], "d": []})
    (query, q_blocks), (point, p_blocks) = _in_blocks(query), _in_blocks(point)
    ids, weight, own, cut = (rows.to_numpy() for rows in (point["id"], point["weight"], query["id"], query["cut"]))
    x, y = np.vstack(query["vector"].to_numpy()), np.vstack(point["vector"].to_numpy())
    kernel, digits = plan["kernel"], plan["digits"]
    sizes = p_blocks["end"] - p_blocks["begin"]
    most = np.maximum.reduceat(cut, q_blocks["begin"])
    least = np.minimum.reduceat(weight, p_blocks["begin"])
    bounded = pivots is not None and kernel in _BY_SQUARE
    # Blocks of queries that all know how far their lists reach.
    known = np.isfinite(most) if bounded else np.zeros(len(most), bool)
    lists = []
    if known.any():
        points = _Blocks(p_blocks, y, ids, weight, least, pivots, kernel)
        asking = np.flatnonzero(np.repeat(known, q_blocks["end"] - q_blocks["begin"]))
        some = max(1, min(TOGETHER, HELD // len(sizes)))
        for at in range(0, len(asking), some):
            rows = asking[at : at + some]
            row, j, d = _lists_within(x[rows], own[rows], cut[rows], points, plan)
            lists.append((own[rows][row], j, d))
    for k in np.flatnonzero(~known):
        begin, end = q_blocks["begin"][k], q_blocks["end"][k]
        met = np.ones(len(sizes), bool)
        if pivots is not None:
            gap = _gaps({name: values[k] for name, values in q_blocks.items()}, p_blocks, pivots, kernel)
            closest = (gap if kernel == "euclidean" else gap * gap) * least * (1 - 1e-9) - 10.0**-digits
            met = ~(closest > most[k])
        if not met.any():
            continue
        here = slice(None) if met.all() else np.repeat(met, sizes)
        lists += _all_lists(x[begin:end], own[begin:end], cut[begin:end], y[here], ids[here], weight[here], plan)
    return _as_table(lists)


def _all_lists(x: np.ndarray, own: np.ndarray, cut: np.ndarray, y: np.ndarray, ids: np.ndarray, weight: np.ndarray, plan: dict) -> list[tuple]:
    """Ids and rounded distance of the short lists of these queries among all these points, some queries at a time."""
    lists, some = [], max(1, HELD // len(ids))
    by_id = np.argsort(ids, kind="stable") if plan["same"] else None
    for at in range(0, len(x), some):
        rows = slice(at, at + some)
        far = block_distances(x[rows], y, plan["kernel"]) * weight[None, :]
        if plan["same"]:
            first, last = (np.searchsorted(ids, own[rows], side, sorter=by_id) for side in ("left", "right"))
            twins = np.repeat(np.arange(len(far)), last - first)
            nth = np.arange(len(twins)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
            far[twins, by_id[first[twins] + nth]] = 0.0 if plan["levels"] else np.inf
        row, j, d = _short_lists(far, ids, cut[rows], plan)
        lists.append((own[rows][row], j, d))
    return lists


def _as_table(lists: list[tuple]) -> pd.DataFrame:
    if not lists:
        return pd.DataFrame({"i": [], "j": [], "d": []})
    i, j, d = (np.concatenate(parts) for parts in zip(*lists, strict=True))
    return pd.DataFrame({"i": i, "j": j, "d": d})


class _Blocks:
    """Blocks of points, made ready for queries that know how far their lists reach."""

    def __init__(self, blocks: dict[str, np.ndarray], y: np.ndarray, ids: np.ndarray, weight: np.ndarray, least: np.ndarray, pivots: np.ndarray, kernel: str):
        self.blocks, self.ids, self.weight, self.least, self.kernel = blocks, ids, weight, least, kernel
        square = np.einsum("ij,ij->i", y, y)
        # With a query's numbers and a 1, the product is the squared distance less the query's own square.
        self.sides = np.hstack([-2.0 * y, square[:, None]])
        self.largest = np.maximum.reduceat(square, blocks["begin"])
        # The pivots of these cells and their far ones, each once.
        told, self.place = np.unique(np.concatenate([blocks["cell"], _opposite(pivots, kernel)[blocks["cell"]]]), return_inverse=True)
        self.pivots = pivots[told]

    def closest(self, x: np.ndarray, digits: int) -> np.ndarray:
        """How close each block can be to each query, by the query's distances to the two pivots of the block's cell."""
        apart = block_distances(x, self.pivots, "linear")
        off = DOUBT * (np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", self.pivots, self.pivots)[None, :])
        low, high = (to_metric(_of_square(np.maximum(at, 0.0), self.kernel, x.shape[1]), self.kernel) for at in (apart - off, apart + off))
        own, far = np.split(self.place, 2)
        ranges = self.blocks
        gap = np.maximum.reduce([low[:, own] - ranges["radius"], ranges["inner"] - high[:, own], low[:, far] - ranges["high"], ranges["low"] - high[:, far]])
        gap = np.maximum(gap, 0.0)
        return (gap if self.kernel == "euclidean" else gap * gap) * self.least * (1 - 1e-9) - 10.0**-digits


def _products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    return queries @ points.T


def _of_square(square: np.ndarray, kernel: str, size: int) -> np.ndarray:
    """Kernel distance of vectors of ``size`` numbers at this squared distance."""
    if kernel == "rbf":
        return -2.0 * np.expm1(-square / size)
    return np.sqrt(square) if kernel == "euclidean" else square


def _square_of(distance: np.ndarray, kernel: str, size: int) -> np.ndarray:
    """The squared distance at which vectors of ``size`` numbers have this kernel distance; infinite where none has."""
    if kernel == "rbf":
        return np.where(distance < 2.0, -size * np.log1p(-np.minimum(distance, 2.0 - 1e-15) / 2.0), np.inf)
    return distance * distance if kernel == "euclidean" else distance


def _lists_within(x: np.ndarray, own: np.ndarray, cut: np.ndarray, points: _Blocks, plan: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and rounded distance of the short lists of queries that end at ``cut``, from the blocks in their reach, the closest first."""
    slack, size, kernel = 10.0 ** -plan["digits"], x.shape[1], points.kernel
    # A block after the other is looked at for all queries.
    closest = np.asfortranarray(points.closest(x, plan["digits"]))
    near = np.flatnonzero((~(closest > cut[:, None])).any(axis=0))
    near = near[np.argsort(closest.min(axis=0)[near], kind="stable")]
    square = np.einsum("ij,ij->i", x, x)
    sides = np.hstack([x, np.ones((len(x), 1))])
    cut = cut.copy()
    held, some = [], 0
    for b in near:
        rows = np.flatnonzero(~(closest[:, b] > cut))
        if not len(rows):
            continue
        begin, end = points.blocks["begin"][b], points.blocks["end"][b]
        with np.errstate(divide="ignore", invalid="ignore"):
            limit = _square_of((cut[rows] + slack) / points.least[b], kernel, size)
        limit = limit + DOUBT * (square[rows] + points.largest[b]) - square[rows]
        apart = _products(sides if len(rows) == len(x) else sides[rows], points.sides[begin:end])
        # Not <=, so undefined distances stay.
        found = np.flatnonzero(~(apart > limit[:, None]))
        if not len(found):
            continue
        row, at = np.divmod(found, end - begin)
        far = _of_square(np.maximum(apart.ravel()[found] + square[rows][row], 0.0), kernel, size) * points.weight[begin + at]
        row, j = rows[row], points.ids[begin + at]
        if plan["same"]:
            twin = j == own[row]
            far[twin] = 0.0 if plan["levels"] else np.inf
        held.append((row, j, far))
        some += len(row)
        if some > 16 * plan["steps"] * len(x):
            *kept, ends = _walked(*(np.concatenate(parts) for parts in zip(*held, strict=True)), len(x), plan)
            # Lists that are full by now end sooner.
            cut, held, some = np.minimum(cut, ends), [tuple(kept)], 0
    if not held:
        none = np.array([], dtype="int64")
        return none, none, np.array([])
    return _walked(*(np.concatenate(parts) for parts in zip(*held, strict=True)), len(x), plan)[:3]


def _in_blocks(rows: pd.DataFrame) -> tuple[pd.DataFrame, dict[str, np.ndarray]]:
    """Rows by block, and each block's place, cell and ranges of both distances."""
    rows = rows.sort_values(["cell", "tile", "sub", "id"], kind="stable")
    place = rows[["cell", "tile", "sub"]].to_numpy()
    begin = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]).any(axis=1)]))
    reach, slant = rows["reach"].to_numpy(), rows["slant"].to_numpy()
    return rows, {
        "begin": begin,
        "end": np.append(begin[1:], len(rows)),
        "cell": place[begin, 0],
        "inner": np.minimum.reduceat(reach, begin),
        "radius": np.maximum.reduceat(reach, begin),
        "low": np.minimum.reduceat(slant, begin),
        "high": np.maximum.reduceat(slant, begin),
    }


def _gaps(q: dict, p: dict[str, np.ndarray], pivots: np.ndarray, kernel: str) -> np.ndarray:
    """How close a point of each block ``p`` can be to a query of the block ``q``, by the triangle inequality."""
    apart = to_metric(block_distances(pivots[q["cell"]][None, :], pivots[p["cell"]], kernel), kernel)[0]
    # One side's ring may also lie outside all that the other side can reach around the first pivot.
    other = np.maximum.reduce([apart - q["radius"] - p["radius"], q["inner"] - apart - p["radius"], p["inner"] - apart - q["radius"]])
    # In one cell both distances are to the same two pivots.
    inside = np.maximum.reduce([q["inner"] - p["radius"], p["inner"] - q["radius"], q["low"] - p["high"], p["low"] - q["high"]])
    return np.maximum(np.where(p["cell"] == q["cell"], inside, other), 0.0)


def _lots(rows: DataFrame, tiles: DataFrame, block_rows: int) -> DataFrame:
    """Rows with their ``lot`` and its ``piece``: small cells share a lot, a cell that is larger than a lot is cut by id."""
    total = tiles.agg(F.sum("n")).first()[0] or 0
    size = max(min(block_rows, LEAST_LOT), min(LOT_ROWS, -(-total // LOTS)))
    cells = tiles.groupBy("grp", "cell").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("grp").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    shared = -1 - F.floor(F.coalesce(before, F.lit(0)) / size)
    cells = cells.select(
        "grp", "cell", F.when(F.col("n") > size, F.col("cell")).otherwise(shared).cast("int").alias("lot"), F.ceil(F.col("n") / size).cast("int").alias("pieces")
    )
    placed = rows.join(broadcast_if_small(durable(cells)), ["grp", "cell"])
    return placed.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).drop("pieces")


def _search(queries: DataFrame, points: DataFrame, plan: dict, pivots: np.ndarray | None) -> DataFrame:
    """Short lists of queries with their ``cut`` from every lot of points of their group."""
    at, held = ["grp", "lot", "piece"], ["id", "vector", "cell", "tile", "sub", "reach", "slant"]
    # A lot's rows go to every lot of the other side, each pair of lots to a task.
    named = [F.collect_set(F.struct("lot", "piece")).alias("lots")]
    q_lots, p_lots = queries.groupBy("grp").agg(*named), points.groupBy("grp").agg(*named)

    def meeting(rows: DataFrame, own: str, other: str, lots: DataFrame, *columns: str) -> DataFrame:
        rows = rows.join(broadcast_if_small(durable(lots)), "grp").withColumn("_met", F.explode("lots"))
        mine, theirs = F.struct("lot", "piece").alias(own), F.col("_met").alias(other)
        return rows.select(F.col("grp").alias(f"{own}_grp"), mine, theirs, *columns)

    left = meeting(queries.select(*at, *held, "cut"), "q", "p", p_lots, *held, "cut")
    right = meeting(points.select(*at, *held, "weight"), "p", "q", q_lots, *held, "weight")
    right = right.select(*[F.col(c).alias(f"p_{c}") for c in right.columns])

    def lists(_, query: pd.DataFrame, point: pd.DataFrame) -> pd.DataFrame:
        return _lists(query, point.rename(columns=lambda c: c.removeprefix("p_")), plan, pivots)

    left, right = left.groupBy("q_grp", "q", "p"), right.groupBy("p_p_grp", "p_q", "p_p")
    return left.cogroup(right).applyInPandas(lists, "i bigint, j bigint, d double")


def _compare(queries: DataFrame, points: DataFrame, units: DataFrame, plan: dict) -> DataFrame:
    """Run the block comparisons listed in ``units`` and return the per-query short lists."""
    # Units are small where blocks are: many share a group, so a task's time goes into the comparisons.
    count, cores = units.count(), units.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(count, max(4 * cores, -(-count * 2 * plan["block_rows"] // UNIT_ROWS))))
    units = units.withColumn("some", F.pmod(F.xxhash64("unit"), F.lit(groups)).cast("int"))

    def side(rows: DataFrame, prefix: str) -> DataFrame:
        listed = units.select("grp", *(F.col(f"{prefix}_{c}").alias(c) for c in ("cell", "tile", "sub")), "unit", "some")
        return rows.join(listed, ["grp", "cell", "tile", "sub"])

    left, right = side(queries, "q"), side(points, "p")
    # The two sides may come from one table: fresh column names keep them apart.
    left = left.select("some", "unit", "id", "vector")
    right = right.select(*[F.col(c).alias(f"p_{c}") for c in ("some", "unit", "id", "vector", "weight")])

    def lists(_, query: pd.DataFrame, point: pd.DataFrame) -> pd.DataFrame:
        theirs = point.groupby("p_unit").indices
        x, y = (np.vstack(vectors.to_numpy()) if len(vectors) else None for vectors in (query["vector"], point["p_vector"]))
        own, ids, weight = (rows.to_numpy() for rows in (query["id"], point["p_id"], point["p_weight"]))
        found = []
        for unit, mine in query.groupby("unit").indices.items():
            if unit in theirs:
                there = theirs[unit]
                found += _all_lists(x[mine], own[mine], np.full(len(mine), np.inf), y[there], ids[there], weight[there], plan)
        return _as_table(found)

    return left.groupBy("some").cogroup(right.groupBy("p_some")).applyInPandas(lists, "i bigint, j bigint, d double")


@dataclass
class Index:
    """Points placed in cells and cut into tiles and blocks, ready for any number of searches.

    pivots: one vector per cell (None: a single cell), rows(grp, id, vector, weight, cell, reach, slant, tile, sub),
    tiles(grp, cell, tile, n, parts, inner, radius, low, high, least), edges(grp, cell, by_reach, by_slant).
    """

    kernel: str
    block_rows: int
    pivots: np.ndarray | None
    rows: DataFrame
    tiles: DataFrame
    edges: DataFrame


def build_index(points: DataFrame, kernel: str = "linear", *, weight: Column | None = None, block_rows: int = BLOCK_ROWS) -> Index:
    """Place ``points(grp, id, vector)``; ``weight`` multiplies distances to a point."""
    points = points.select("grp", "id", "vector", (F.lit(1.0) if weight is None else weight).alias("weight"))
    pivots = None
    if kernel in _METRIC:
        # Cells are for large groups; many small ones are compared as they are.
        largest = points.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        pivots = _pivots(points, largest, block_rows)
    placed = _placed(points, pivots, kernel)
    edges = durable(_edges(placed, block_rows))
    return Index(kernel, block_rows, pivots, *_blocked(placed, block_rows, edges), edges)


def neighbours(
    queries: DataFrame,
    points: DataFrame,
    steps: int,
    *,
    kernel: str = "linear",
    levels: bool = True,
    same: bool = True,
    weight: Column | None = None,
    digits: int = DIGITS,
    block_rows: int = BLOCK_ROWS,
    index: Index | None = None,
) -> DataFrame:
    """Neighbour lists ``i, j, d, pos`` of ``queries(grp, id, vector)`` among ``points``
    of the same ``grp``.

    levels: lists end at the ``steps``-th distance step (see ``knn_rank``, columns
    is_step and step are kept); otherwise they hold the ``steps`` nearest points.
    same: queries and points are the same table (a point is at distance 0 from itself
    with levels, and left out otherwise). weight: multiplies distances to a point.
    index: the points as ``build_index`` made them; ``points`` and ``weight`` are not looked at then.
    """
    queries = queries.select("grp", "id", "vector", F.lit(1.0).alias("weight"))
    if index is None:
        index = build_index(points, kernel, weight=weight, block_rows=block_rows)
    kernel, block_rows, pivots, p_rows, p_tiles = index.kernel, index.block_rows, index.pivots, index.rows, index.tiles
    if same:
        # One table, placed and cut once; the weight belongs to points only.
        q_rows, q_tiles = p_rows, p_tiles
    else:
        q_rows, q_tiles = _blocked(_placed(queries, pivots, kernel), block_rows, index.edges)
    plan = {"kernel": kernel, "steps": steps, "levels": levels, "same": same, "digits": digits, "block_rows": block_rows}

    def finish(pairs: DataFrame) -> DataFrame:
        return knn_rank(pairs, steps, gap=0.5 * 10.0**-digits) if levels else topk_neighbours(pairs, steps)

    p_lots = _lots(p_rows, p_tiles, block_rows)
    if pivots is None:
        q_lots = p_lots if same else _lots(q_rows, q_tiles, block_rows)
        return finish(_search(q_lots.withColumn("cut", F.lit(float("inf"))), p_lots, plan, None))

    q_side, p_side = _side(q_tiles.drop("least", "n"), "q"), _side(p_tiles, "p")
    # A tile that holds enough points bounds the lists of its queries, else the ring of its tiles, else the whole cell.
    for width, name in ((BINS, "ring"), (1, "tile")):
        span = F.floor(F.col("tile") / width)
        enough = p_tiles.groupBy("grp", F.col("cell").alias("q_cell"), span.alias("_span")).agg((F.sum("n") >= 2 * steps).alias(f"q_by_{name}"))
        q_side = q_side.withColumn("_span", F.floor(F.col("q_tile") / width)).join(enough, ["grp", "q_cell", "_span"], "left").drop("_span")
    q_side = durable(q_side.na.fill(False, ["q_by_ring", "q_by_tile"]))
    unit = F.concat_ws("/", "q_cell", "q_tile", "q_sub", "p_cell", "p_tile", "p_sub", "grp").alias("unit")
    at = ["grp", "q_cell", "q_tile", "q_sub", "p_cell", "p_tile", "p_sub", unit]

    def blocks(tiles: DataFrame, side: str) -> DataFrame:
        return tiles.withColumn(f"{side}_sub", F.explode(F.sequence(F.lit(0), F.col(f"{side}_parts") - 1)))

    here = q_side.join(p_side.withColumn("q_cell", F.col("p_cell")), ["grp", "q_cell"])
    one_ring = F.floor(F.col("q_tile") / BINS) == F.floor(F.col("p_tile") / BINS)
    met = F.when(F.col("q_by_tile"), F.col("q_tile") == F.col("p_tile")).otherwise(~F.col("q_by_ring") | one_ring)
    home = _compare(q_rows, p_rows, blocks(blocks(here.where(met), "q"), "p").select(*at), plan)
    # How far each query's list can still reach: its last kept distance at home.
    spans = finish(home).groupBy("i").agg(F.max("d").alias("cut"), (F.max("step") if levels else F.max("pos")).alias("have"))
    spans = spans.select(F.col("i").alias("id"), F.when(F.col("have") >= steps, F.col("cut")).alias("cut"))
    reaching = q_rows.join(spans, "id", "left").withColumn("cut", F.coalesce(F.nanvl("cut", F.lit(float("inf"))), F.lit(float("inf"))))
    # Home lists are found again: the blocks they are from are within reach.
    return finish(_search(_lots(stored(reaching, "reaching"), q_tiles, block_rows), p_lots, plan, pivots))
