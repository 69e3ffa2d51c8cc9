"""k inverse nearest neighbours: fit on labelled vectors, predict new ones.

Training rows are ``id, class, vector``. Equal vectors of a class are one node with a
number of copies: they always sit in one cluster, and lists stay short however often a
packet repeats.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowprism.operators.components import connected_components
from flowprism.operators.lof import local_density, outlier_factor
from flowprism.operators.neighbours import DIGITS, Index, build_index, k_distance, knn_rank, nearest_one, neighbours, topk_neighbours
from flowprism.operators.numbering import number_rows
from flowprism.session import durable

TYPES = ("distance", "density")
COMPAT = ("deployed", "nearest")
INDEX_PARTS = ("rows", "tiles", "edges")


@dataclass
class Kinn:
    """A fitted model: tables, not objects.

    nodes(id, class, vector, copies), members(id, class, node), lists(i, j, d, pos, ...),
    edges(i, j), clusters(id, cluster), cluster_map(cluster, class, conflicts). A model that was
    loaded holds the nodes placed for searches as well.
    """

    steps: int
    kernel: str
    nodes: DataFrame
    members: DataFrame
    lists: DataFrame
    edges: DataFrame
    clusters: DataFrame
    cluster_map: DataFrame
    digits: int = DIGITS
    index: Index | None = None

    TABLES = ("nodes", "members", "lists", "edges", "clusters", "cluster_map")


def distinct_nodes(train: DataFrame) -> DataFrame:
    """One node per (class, vector): the smallest id and the number of copies."""
    return train.groupBy("class", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def mutual_edges(lists: DataFrame) -> DataFrame:
    """Keep i -> j when i is in j's list too."""
    back = lists.select(F.col("j").alias("i"), F.col("i").alias("j"))
    return lists.select("i", "j").join(back, ["i", "j"], "left_semi")


def with_copies(lists: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """How many equal points each list entry stands for: at the last step only one."""
    sizes = nodes.select(F.col("id").alias("j"), F.col("copies").alias("all"))
    one = F.col("is_step") & (F.col("step") == steps)
    return lists.join(sizes, "j").withColumn("copies", F.when(one, 1).otherwise(F.col("all"))).drop("all")


def density_weights(lists: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """``i, lof`` of the training nodes over their own lists (self included)."""
    counted = with_copies(lists, nodes, steps)
    density = local_density(counted, k_distance(lists))
    return outlier_factor(counted, density)


def fit_lists(nodes: DataFrame, steps: int, kernel: str = "linear", kind: str = "distance", **options) -> DataFrame:
    """Neighbour lists inside each class, by distance or by density-weighted distance."""
    if kind not in TYPES:
        raise ValueError(f"unknown type {kind!r}")
    rows = nodes.select(F.col("class").alias("grp"), "id", "vector", "copies")
    lists = neighbours(rows, rows, steps, kernel=kernel, **options)
    if kind == "distance":
        return lists
    lof = durable(density_weights(durable(lists), nodes, steps))
    weighted = rows.join(lof.withColumnRenamed("i", "id"), "id")
    return neighbours(weighted, weighted, steps, kernel=kernel, weight=F.col("lof"), **options)


def cluster_class_map(clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """Class of each cluster (its first member's) and how many members disagree."""
    members = clusters.join(classes.select("id", "class"), "id")
    # Counted per class first, so a giant cluster is a few rows.
    counts = members.groupBy("cluster", "class").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return counts.groupBy("cluster").agg(
        F.min_by("class", "first").alias("class"), (F.sum("n") - F.min_by("n", "first")).alias("conflicts")
    )


def fit(
    train: DataFrame, steps: int, *, kernel: str = "linear", kind: str = "distance", digits: int = DIGITS, **options
) -> Kinn:
    nodes = durable(distinct_nodes(train))
    named = nodes.select("class", "vector", F.col("id").alias("node"))
    members = durable(train.join(named, ["class", "vector"]).select("id", "class", "node"))
    lists = durable(fit_lists(nodes, steps, kernel, kind, digits=digits, **options))
    edges = durable(mutual_edges(lists))
    roots = connected_components(nodes, edges)
    numbers = number_rows(roots.select("root").distinct(), "root", "cluster")
    clusters = durable(roots.join(numbers, "root").select("id", "cluster"))
    return Kinn(steps, kernel, nodes, members, lists, edges, clusters, durable(cluster_class_map(clusters, nodes)), digits)


def node_classes(model: Kinn) -> DataFrame:
    """``id, class`` of each training node through its cluster."""
    return model.clusters.join(model.cluster_map.select("cluster", "class"), "cluster").select("id", "class")


def test_lists(model: Kinn, test: DataFrame, k: int, **options) -> DataFrame:
    """The ``k`` nearest training nodes of every test row (``id, vector``)."""
    options.setdefault("digits", model.digits)
    one = F.lit(0).alias("grp")
    queries, points = test.select(one, "id", "vector"), model.nodes.select(one, "id", "vector")
    if model.index is not None:
        options["index"] = model.index
    return neighbours(queries, points, k, kernel=model.kernel, levels=False, same=False, **options)


def first_points(ranked: DataFrame, model: Kinn, k: int) -> DataFrame:
    """Nodes that hold the ``k`` nearest training points, equal points counted one by one."""
    sizes = model.nodes.select(F.col("id").alias("j"), "copies")
    before = Window.partitionBy("i").orderBy("d", "j").rowsBetween(Window.unboundedPreceding, -1)
    counted = ranked.join(sizes, "j").withColumn("_before", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    return counted.where(F.col("_before") < k).drop("_before", "copies")


def inn_check(ranked: DataFrame, model: Kinn, test: DataFrame) -> DataFrame:
    """Keep p of a test row when the training row at the test row's own position is in p's list.

    Comparing a test position with training positions is what the deployed detector does.
    """
    at_test = number_rows(test.select("id"), "id", "at").select(F.col("id").alias("i"), "at")
    at_train = number_rows(model.members, "id", "at", first=["class"]).select(
        "at", F.col("node").alias("n"), (F.col("id") == F.col("node")).alias("leads")
    )
    return at_own_place(ranked, model, at_test, at_train)


def at_own_place(ranked: DataFrame, model: Kinn, at_test: DataFrame, at_train: DataFrame) -> DataFrame:
    """``inn_check`` with the places of the test rows ``(i, at)`` and the training rows ``(at, n, leads)`` given."""
    # The last step of a list holds one point only, the leading copy.
    one = F.col("is_step") & (F.col("step") == model.steps)
    listed = model.lists.select(F.col("i").alias("j"), F.col("j").alias("n"), one.alias("one"))
    placed = ranked.select("i", "j", "d").join(at_test, "i").join(at_train, "at")
    return placed.join(listed, ["j", "n"]).where(~F.col("one") | F.col("leads")).select("i", "j", "d")


def predict_supervised(model: Kinn, test: DataFrame, compat: str = "deployed", **options) -> DataFrame:
    """``id, pred``: class of the first checked neighbour, else of the nearest node.

    compat: ``deployed`` applies ``inn_check``, ``nearest`` leaves it out.
    """
    if compat not in COMPAT:
        raise ValueError(f"unknown compat mode {compat!r}")
    ranked = test_lists(model, test, model.steps if compat == "deployed" else 1, **options)
    if compat == "deployed":
        ranked = durable(ranked)
    chosen = nearest_one(ranked).select("i", F.col("j").alias("near"))
    if compat == "deployed":
        checked = inn_check(first_points(ranked, model, model.steps), model, test)
        first = nearest_one(checked).select("i", F.col("j").alias("checked"))
        chosen = chosen.join(first, "i", "left").select("i", F.coalesce("checked", "near").alias("near"))
    classes = node_classes(model).select(F.col("id").alias("near"), F.col("class").alias("pred"))
    return chosen.join(classes, "near").select(F.col("i").alias("id"), "pred")


def predict_scores(model: Kinn, test: DataFrame, **options) -> DataFrame:
    """``id, pred, score``: class of the nearest node and the distance to it."""
    nearest = nearest_one(test_lists(model, test, 1, **options))
    classes = node_classes(model).select(F.col("id").alias("j"), F.col("class").alias("pred"))
    return nearest.join(classes, "j").select(F.col("i").alias("id"), "pred", F.col("d").alias("score"))


def neighbours_of(model: Kinn, i: int) -> DataFrame:
    """The nearest training nodes of one training node, itself left out."""
    mine = model.lists.where((F.col("i") == i) & (F.col("j") != i))
    return topk_neighbours(mine, model.steps).select("i", "j", "d", "pos")


def indexed(model: Kinn, **options) -> Kinn:
    """The model with its nodes placed for searches, once for all of them."""
    return replace(model, index=build_index(model.nodes.select(F.lit(0).alias("grp"), "id", "vector"), model.kernel, **options))


def save(model: Kinn, path: str) -> None:
    """Tables, search index and, last of all, the settings: without them there is no model."""
    for name in Kinn.TABLES:
        getattr(model, name).write.mode("overwrite").parquet(f"{path}/{name}")
    index = model.index or indexed(model).index
    for part in INDEX_PARTS:
        getattr(index, part).write.mode("overwrite").parquet(f"{path}/index_{part}")
    pivots = None if index.pivots is None else index.pivots.tolist()
    row = (model.steps, model.kernel, model.digits, index.block_rows, pivots)
    schema = "steps int, kernel string, digits int, block_rows int, pivots array<array<double>>"
    model.nodes.sparkSession.createDataFrame([row], schema).write.mode("overwrite").parquet(f"{path}/settings")


def load(spark: SparkSession, path: str) -> Kinn:
    settings = spark.read.parquet(f"{path}/settings").first()
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in Kinn.TABLES}
    pivots = None if settings["pivots"] is None else np.array(settings["pivots"], np.float64)
    index = Index(settings["kernel"], settings["block_rows"], pivots, *(spark.read.parquet(f"{path}/index_{part}") for part in INDEX_PARTS))
    return Kinn(settings["steps"], settings["kernel"], digits=settings["digits"], index=index, **tables)


__all__ = [
    "Kinn",
    "distinct_nodes",
    "fit",
    "fit_lists",
    "inn_check",
    "knn_rank",
    "load",
    "mutual_edges",
    "neighbours_of",
    "predict_scores",
    "predict_supervised",
    "save",
    "test_lists",
]
