"""Local outlier factor over neighbour lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowprism.operators.neighbours import neighbours
from flowprism.operators.numbering import exact_quantiles
from flowprism.session import broadcast_if_small, durable

NEIGHBOURS = 20
TINY = 1e-10


def local_density(lists: DataFrame, reach: DataFrame, tiny: float = 0.0) -> DataFrame:
    """``i, lrd``: inverse mean reachability max(d, k_distance(j)) over each list.

    ``copies`` on the list rows, when present, weighs a neighbour that stands for
    several equal points. A list of zero distances has no finite density: null.
    """
    weight = F.col("copies") if "copies" in lists.columns else F.lit(1)
    far = lists.join(reach.select(F.col("i").alias("j"), "k_distance"), "j")
    mean = F.sum(F.greatest("d", "k_distance") * weight) / F.sum(weight)
    return far.groupBy("i").agg(F.try_divide(F.lit(1.0), mean + F.lit(tiny)).alias("lrd"))


def outlier_factor(lists: DataFrame, density: DataFrame, points_density: DataFrame | None = None) -> DataFrame:
    """``i, lof``: mean neighbour density over own density; 1 where undefined."""
    weight = F.col("copies") if "copies" in lists.columns else F.lit(1)
    of_points = points_density if points_density is not None else density
    near = lists.join(of_points.select(F.col("i").alias("j"), F.col("lrd").alias("lrd_j")), "j")
    means = near.groupBy("i").agg((F.sum(F.col("lrd_j") * weight) / F.sum(weight)).alias("around"))
    return means.join(density, "i").select("i", F.coalesce(F.try_divide("around", "lrd"), F.lit(1.0)).alias("lof"))


def lof_scores(rows: DataFrame, k: int = NEIGHBOURS, **options) -> DataFrame:
    """LOF of every row within its ``grp`` (k nearest others, plain distance)."""
    lists = neighbours(rows, rows, k, kernel="euclidean", levels=False, same=True, **options)
    reach = lists.groupBy("i").agg(F.max("d").alias("k_distance"))
    density = local_density(lists, reach, TINY)
    return outlier_factor(lists, density)


def lof_outlier_filter(rows: DataFrame, keep_all, k: int = NEIGHBOURS, share: float = 0.05, **options) -> DataFrame:
    """Drop the most outlying ``share`` of every class except ``keep_all``.

    The cut is the interpolated percentile of the factor in the class, so a row
    leaves when its factor is strictly above it.
    """
    tested = rows.where(F.col("grp") != keep_all)
    scores = durable(tested.join(lof_scores(tested, k, **options).withColumnRenamed("i", "id"), "id"))
    cut = exact_quantiles(scores.select(F.col("grp").alias("key"), (-F.col("lof")).alias("value")), [share])
    cut = broadcast_if_small(durable(cut.select(F.col("key").alias("grp"), "quantile")))
    kept = scores.join(cut, "grp").where(-F.col("lof") >= F.col("quantile"))
    return rows.where(F.col("grp") == keep_all).unionByName(kept.select(*rows.columns))
