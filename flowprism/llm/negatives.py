"""Hard negatives by slot-decomposed selection.

Every anchor has its positives, the best rows of its own label, and each positive asks for the best rows of other
labels whose score lies in a window below the positive's own. The windows of an anchor overlap. Their upper limits
cut the score axis into disjoint slots, and a row of another label falls into exactly one of them, so all windows
are answered from one short list per slot:

1. Anchors meet the rows of their label; each task keeps the best few of each anchor, Spark the best of those.
2. Anchors, now with the limits of their slots, meet all rows. Each task keeps the best ``negatives`` of every slot
   and Spark merges these lists slot by slot.
3. The lists of an anchor, slot after slot, are its candidates by falling score. A window holds the suffix that
   begins at its own slot, so its answer is the first rows of that suffix that reach the window's lower limit.

Rows and anchors meet in blocks of bounded size, one group of a cogroup for each pair of blocks; a hot label is cut
into blocks like any other rows, and pairs never become rows. A score is the integer inner product of the vectors'
``floor(scale * x)``, exact at every size and held inside 64 bits; higher comes first, then the smaller id.

Rows with a null id or label, a null vector or a null or non-finite component take no part. Of rows that share an
id the one with the smallest label, then the smallest bytes, takes part, so repeated rows are one. Vectors of
different lengths have no score. An anchor without positives, a positive with a negative score (its window is
empty) and a window without rows give no rows; an empty table gives none. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowprism.llm import vectors as V
from flowprism.session import broadcast_if_small, stored

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
ROWS, ANCHORS = 8192, 4096
CELLS = 1 << 21
NONE = -(2**63)
HELD = 2**63 - 1
#: The window of a positive: the least integer at or above half its score, the largest at or below 95% of it.
LOW = "score div 2 + score % 2"
HIGH = "19 * (score div 20) + 19 * (score % 20) div 20"
POINT = "vec_id bigint, label bigint, body binary"


def points(rows: DataFrame, row_id: Column, label: Column, vector: Column, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, body`` of the rows that take part, one for each id."""

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            body = V.floors(batch.column(2), scale)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), body], names=["vec_id", "label", "body"])
            yield out.filter(body.is_valid())

    given = rows.select(row_id.cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), vector.cast("array<double>").alias("v"))
    given = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    found = given.mapInArrow(batches, POINT).groupBy("vec_id").agg(F.min(F.struct("label", "body")).alias("p"))
    return found.select("vec_id", "p.label", "p.body")


def _spread(name: str, parts) -> Column:
    return F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias(name)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held inside 64 bits."""
    reach = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if reach < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if reach < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -HELD, HELD).astype(np.int64)


def best(found: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest allowed scores of every row; of equal ones the first columns."""
    n = found.shape[1]
    if int(np.abs(found).max(initial=0)) < (1 << 62) // max(1, n):
        key = np.where(allowed, found * n + np.arange(n - 1, -1, -1), NONE)
        at = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), key.shape)
        row, place = np.nonzero(np.take_along_axis(key, at, axis=1) != NONE)
        return row, at[row, place]
    # Scores too wide to carry the place: a stable order of the negated ones (none is the least 64-bit number).
    order = np.argsort(np.where(allowed, -found, HELD), axis=1, kind="stable")[:, :k]
    row, place = np.nonzero(np.take_along_axis(allowed, order, axis=1))
    return row, order[row, place]


def _met(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple]:
    """Scores of the anchors with the rows of a unit, for each vector length, a bounded matrix at a time."""
    ids, labels = (rows.column(c).to_numpy() for c in ("r_vec_id", "r_label"))
    own, own_labels = (anchors.column(c).to_numpy() for c in ("vec_id", "label"))
    left, right = V.matrices(anchors.column("body")), V.matrices(rows.column("r_body"))
    for length in sorted(left.keys() & right.keys()):
        (at, a), (to, b) = left[length], right[length]
        order = np.argsort(ids[to])
        to, b = to[order], b[order]
        step = max(1, CELLS // len(to))
        for k in range(0, len(at), step):
            mine = at[k : k + step]
            yield mine, own[mine], own_labels[mine], ids[to], labels[to], scores(a[k : k + step], b)


def _table(schema: dict, parts: list[tuple]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(schema)
    return pa.table({name: pa.array(c.astype(kind)) for (name, kind), c in zip(schema.items(), columns, strict=True)})


def _positives(k: int):
    schema = {"anchor_id": "int64", "positive_id": "int64", "score": "int64"}

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        parts = []
        for _, own, own_labels, ids, labels, found in _met(anchors, rows):
            row, at = best(found, (own_labels[:, None] == labels) & (own[:, None] != ids), k)
            parts.append((own[row], ids[at], found[row, at]))
        return _table(schema, parts)

    return run, "anchor_id bigint, positive_id bigint, score bigint"


def _slots(k: int):
    schema = {"anchor_id": "int64", "slot": "int32", "negative_id": "int64", "score": "int64"}

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        limits = anchors.column("limits").to_pylist()
        width = max(map(len, limits), default=0)
        # A slot holds scores up to its limit and above the next one; those no window reaches are in none.
        top = np.array([x + [-1] * (width - len(x)) for x in limits], np.int64).reshape(len(limits), width)
        least = anchors.column("least").to_numpy()
        parts = []
        for mine, own, own_labels, ids, labels, found in _met(anchors, rows):
            other = (own_labels[:, None] != labels) & (found >= least[mine][:, None])
            for slot in range(width):
                inside = other & (found <= top[mine, slot][:, None])
                if slot + 1 < width:
                    inside &= found > top[mine, slot + 1][:, None]
                row, at = best(found, inside, k)
                parts.append((own[row], np.full(len(row), slot), ids[at], found[row, at]))
        return _table(schema, parts)

    return run, "anchor_id bigint, slot int, negative_id bigint, score bigint"


def _meet(anchors: DataFrame, rows: DataFrame, unit: list[str], run) -> DataFrame:
    function, schema = run
    # Both sides come from one table: fresh column names keep them apart.
    right = rows.select(*[F.col(c).alias(f"r_{c}") for c in rows.columns])
    return anchors.groupBy(*unit).cogroup(right.groupBy(*[f"r_{c}" for c in unit])).applyInArrow(function, schema)


def _first(found: DataFrame, group: list[str], other: str, k: int) -> DataFrame:
    """The k best rows of each group; Spark keeps k of each task before the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), other)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _each(name: str, parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts - 1)).alias(name)


def positives_of(marked: DataFrame, k: int = POSITIVES, block: int = ROWS, most: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, score``: the k best other rows of each anchor's label.

    ``marked(vec_id, label, body, is_anchor)``. Small labels share a unit, large ones are cut into several.
    """
    n = F.count(F.lit(1))
    units = max(1, -(-marked.count() // block))
    sizes = marked.groupBy("label").agg(
        F.ceil(n / block).cast("int").alias("parts"), F.greatest(F.ceil(F.count_if("is_anchor") / most), F.lit(1)).cast("int").alias("cuts")
    )
    sizes = broadcast_if_small(stored(sizes, "sizes"))
    home = F.when(F.col("parts") > 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(units))).alias("home")
    placed = marked.join(sizes, "label").select("*", home, (F.col("parts") > 1).alias("large"))
    rows = placed.select("vec_id", "label", "body", "home", "large", _spread("part", F.col("parts")), F.col("cuts"))
    rows = rows.select("vec_id", "label", "body", "home", "large", "part", _each("cut", F.col("cuts")))
    own = placed.where("is_anchor").select("vec_id", "label", "body", "home", "large", "parts", _spread("cut", F.col("cuts")))
    own = own.select("vec_id", "label", "body", "home", "large", "cut", _each("part", F.col("parts")))
    return _first(_meet(own, rows, ["home", "large", "part", "cut"], _positives(k)), ["anchor_id"], "positive_id", k)


def slots_of(anchors: DataFrame, rows: DataFrame, k: int = NEGATIVES, block: int = ROWS, most: int = ANCHORS) -> DataFrame:
    """``anchor_id, slot, negative_id, score``: the k best rows of other labels in each slot.

    ``anchors(vec_id, label, body, limits, least)``: falling upper limits, and the least score any window takes.
    """
    parts, cuts = (max(1, -(-df.count() // size)) for df, size in ((rows, block), (anchors, most)))
    own = anchors.select("*", _spread("cut", F.lit(cuts))).select("*", _each("part", F.lit(parts)))
    met = rows.select("vec_id", "label", "body", _spread("part", F.lit(parts))).select("*", _each("cut", F.lit(cuts)))
    return _first(_meet(own, met, ["part", "cut"], _slots(k)), ["anchor_id", "slot"], "negative_id", k)


def mine(
    rows: DataFrame, anchor: Column, *, row_id: str = "vec_id", label: Column | None = None, vector: str = "embedding",
    scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = ROWS, most: int = ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor``: which rows are anchors, a condition on the column ``vec_id``. ``label``: by default the column
    of that name.
    """
    given = points(rows, F.col(f"`{row_id}`"), F.col("label") if label is None else label, F.col(f"`{vector}`"), scale)
    marked = stored(given.withColumn("is_anchor", F.coalesce(anchor, F.lit(False))), "points")
    wanted = stored(positives_of(marked, positives, block, most).where(F.col("score") >= 0), "positives")
    windows = wanted.select("anchor_id", "positive_id", "score", F.expr(HIGH).alias("high"), F.expr(LOW).alias("low"))
    limits = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_set("high"), asc=False).alias("limits"), F.min("low").alias("least"))
    limits = limits.withColumnRenamed("anchor_id", "vec_id")
    anchors = marked.where("is_anchor").join(limits, "vec_id").select("vec_id", "label", "body", "limits", "least")
    anchors = stored(anchors, "anchors")
    lists = slots_of(anchors, marked, negatives, block, most)
    # At most slots x negatives entries for each anchor; slots fall with their limits, so this is the order of scores.
    entry = F.struct("slot", (-F.col("score")).alias("down"), "negative_id", "score")
    lists = lists.groupBy("anchor_id").agg(F.array_sort(F.collect_list(entry)).alias("lists"))
    asked = windows.join(limits.withColumnRenamed("vec_id", "anchor_id"), "anchor_id")
    asked = asked.withColumn("slot", F.array_position("limits", F.col("high")) - 1)
    suffix = F.slice(F.filter("lists", lambda e: e["slot"] >= F.col("slot")), 1, negatives)
    found = asked.join(lists, "anchor_id").withColumn("answer", F.filter(suffix, lambda e: e["score"] >= F.col("low")))
    found = found.select("anchor_id", "positive_id", "score", F.posexplode("answer").alias("at", "e"))
    return found.select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.negative_id").alias("negative_id"),
        F.col("score").alias("positive_score"), F.col("e.score").alias("negative_score"),
    )
