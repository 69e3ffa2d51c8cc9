"""Label codes and the stratified train/test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowprism.session import broadcast_if_small, durable


def fit_labels(rows: DataFrame, label: str = "label", code: str = "code") -> DataFrame:
    """Sorted distinct labels with codes 0..n-1 (one row per class)."""
    classes = rows.select(label).distinct()
    # The window runs over the distinct classes only, one row each.
    return classes.withColumn(code, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(label)) - 1)


def encode_labels(rows: DataFrame, encoder: DataFrame, label: str = "label", code: str = "code") -> DataFrame:
    return rows.join(broadcast_if_small(encoder.select(label, code)), label)


def decode_labels(rows: DataFrame, encoder: DataFrame, label: str = "label", code: str = "code") -> DataFrame:
    return rows.join(broadcast_if_small(encoder.select(code, label)), code)


def hash_key(seed: int, *ids: str) -> Column:
    """Uniform 32-bit key of a row, the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1 << 32))


def stratified_split(
    rows: DataFrame, label: str, row_id: str, share: float, key: Column | None = None, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: in each class exactly round(share * n) rows, those of smallest key.

    A class may be huge, so it is never ranked as a whole: counts per (class, key
    bucket) show which bucket holds the cut. Buckets below it are test rows, buckets
    above it train rows, and only rows of the one bucket with the cut are ranked.
    """
    bucket = F.shiftright("_key", 16)
    keyed = rows.withColumn("_key", key if key is not None else hash_key(seed, row_id)).withColumn("_bucket", bucket)
    along = Window.partitionBy(label).orderBy("_bucket")
    whole = Window.partitionBy(label)
    cut = (
        keyed.groupBy(label, "_bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"upto": F.sum("n").over(along), "want": F.round(F.sum("n").over(whole) * share).cast("long")})
        .where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")))
        .select(label, F.col("_bucket").alias("_cut"), (F.col("want") - F.col("upto") + F.col("n")).alias("_need"))
    )
    # One row per class: rows of a hot class are not shuffled to meet their cut.
    placed = keyed.join(broadcast_if_small(durable(cut)), label, "left")
    at_cut = F.coalesce(F.col("_bucket") == F.col("_cut"), F.lit(False))
    clear = placed.where(~at_cut).withColumn("is_test", F.coalesce(F.col("_bucket") < F.col("_cut"), F.lit(False)))
    in_class = Window.partitionBy(label).orderBy("_key", row_id)
    ranked = placed.where(at_cut).withColumn("is_test", F.row_number().over(in_class) <= F.col("_need"))
    return clear.unionByName(ranked).drop("_key", "_bucket", "_cut", "_need")
