"""Dense row numbers and exact order statistics without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowprism.session import broadcast_if_small, durable, stored


def rank_rows(rows: DataFrame, order: Sequence[str], name: str, parts: int | None = None) -> tuple[DataFrame, int]:
    """``rows`` with 0-based ``name`` in the given order, and the number of rows.

    Rows are dealt into ranges and sorted there; what earlier ranges hold is added from their counts.
    A hot value is split as long as later columns of ``order`` differ. Ties get different ranks.
    """
    parts = parts or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The low 33 bits of this id are the row's place in its partition.
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_at": inside}), "ranks")
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    before = rows.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    ranked = placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_start") + F.col("_at"))
    return ranked.drop("_part", "_at", "_start"), total


def number_rows(rows: DataFrame, row_id: str, name: str, first: Sequence[str] = (), bits: int | None = None) -> DataFrame:
    """Add 0-based ``name`` in the order (first..., row_id), whatever the spread of the ids.

    Rows are dealt into ``2**bits`` ranges, by default as many as the session has shuffle partitions.
    """
    return rank_rows(rows, [*first, row_id], name, None if bits is None else 1 << bits)[0]


def _splitters(counts: DataFrame, parts: int) -> DataFrame:
    """Rows of each key and approximate cut points of its distinct values; they only balance the buckets."""
    cuts = [(i + 1) / parts for i in range(parts - 1)]
    return counts.groupBy("key").agg(
        F.sum("n").alias("rows"),
        F.array_distinct(F.percentile_approx("value", F.array(*[F.lit(c) for c in cuts]), 10 * parts)).alias("cuts"),
    )


def exact_quantiles(values: DataFrame, probs: Sequence[float], parts: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles of ``(key, value)``: columns key, idx, prob, quantile.

    Equal values are counted first and stored, so ``values`` is computed once and a hot
    value is one row. An approximate sketch of the counted values cuts each key's range into buckets; bucket totals tell which buckets hold the wanted
    positions, and only those buckets are ordered. No key is ever sorted in one task.
    """
    values = values.where(F.col("value").isNotNull())
    counts = stored(values.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")), "counts")
    if parts is None:
        largest = counts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        parts = int(min(4096, max(16, largest // 1_000_000)))
    # Fixed before the exact pass, so both passes see the same cuts.
    cuts = broadcast_if_small(durable(_splitters(counts, parts)), max_rows=10_000)
    placed = counts.join(cuts, "key").withColumn(
        "bucket", F.size(F.filter("cuts", lambda cut: cut < F.col("value")))
    )
    totals = placed.groupBy("key", "bucket").agg(F.sum("n").alias("n"), F.first("rows").alias("rows"))
    along = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("start", F.coalesce(F.sum("n").over(along), F.lit(0)))
    # Wanted positions: the two neighbours of prob * (rows - 1).
    at = F.transform(F.lit([float(p) for p in probs]), lambda p, i: F.struct(i.alias("idx"), (p * (F.col("rows") - 1)).alias("at")))
    inside = F.filter(
        at, lambda w: (F.ceil(w["at"]) >= F.col("start")) & (F.floor(w["at"]) < F.col("start") + F.col("n"))
    )
    needed = totals.withColumn("wanted", inside).where(F.size("wanted") > 0)
    position = F.explode(F.array_distinct(F.array(F.floor("w.at"), F.ceil("w.at"))))
    positions = (
        needed.select("key", "bucket", "start", "n", F.explode("wanted").alias("w"))
        .select("key", "bucket", "start", "n", "w.idx", "w.at", position.alias("coord"))
        .where((F.col("coord") >= F.col("start")) & (F.col("coord") < F.col("start") + F.col("n")))
        .select("key", "bucket", "coord", "idx", "at", F.lit(None).cast("double").alias("value"))
    )
    by_value = Window.partitionBy("key", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    first_place = F.col("start") + F.coalesce(F.sum("n").over(by_value), F.lit(0))
    ordered = placed.select("key", "bucket", "value", "n").join(needed.select("key", "bucket", "start"), ["key", "bucket"])
    places = ordered.select(
        "key", "bucket", first_place.alias("coord"), F.lit(None).cast("int").alias("idx"),
        F.lit(None).cast("double").alias("at"), F.col("value").cast("double").alias("value"),
    )
    # A position takes the last value whose first place is not after it.
    along_places = Window.partitionBy("key", "bucket").orderBy("coord", F.col("idx").asc_nulls_first())
    hits = places.unionByName(positions).withColumn("found", F.last("value", ignorenulls=True).over(along_places))
    low, high = F.min("found"), F.max("found")
    fraction = F.first("at") - F.floor(F.first("at"))
    prob_of = F.element_at(F.lit([float(p) for p in probs]), F.col("idx") + 1)
    return (
        hits.where(F.col("idx").isNotNull())
        .groupBy("key", "idx")
        .agg((low + (high - low) * fraction).alias("quantile"))
        .select("key", "idx", prob_of.alias("prob"), "quantile")
    )
