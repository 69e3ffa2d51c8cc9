"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowprism.session import stored


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, root`` for every node; root is the smallest id in its component.

    ``edges(i, j)`` holds both directions. Every round gives each node that still has edges the neighbour (or itself)
    that comes first in a random order of the round, and rewrites the edges to these representatives: equal ones
    become one, those inside a representative vanish, and finished components leave. On average at least a
    third of the nodes goes in a round, whatever the graph looks like, so the edges shrink and the rounds grow with
    the logarithm of the largest component. The rounds' tables are then followed from the last to the first.
    """
    left = stored(edges.select("i", "j").where(F.col("i") != F.col("j")).distinct(), "edges")
    rounds = []
    while left.limit(1).count():
        order = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        first = left.groupBy("i").agg(F.min(order("j")).alias("near"))
        chosen = stored(first.select("i", F.least("near", order("i"))["id"].alias("to")), "chosen")
        rounds.append(chosen)
        far = chosen.select(F.col("i").alias("j"), F.col("to").alias("to_j"))
        moved = left.join(chosen, "i").join(far, "j").where(F.col("to") != F.col("to_j"))
        left = stored(moved.select(F.col("to").alias("i"), F.col("to_j").alias("j")).distinct(), "edges")
    ends = None
    for chosen in reversed(rounds):
        if ends is not None:
            after = ends.select(F.col("i").alias("to"), F.col("to").alias("end"))
            chosen = chosen.join(after, "to", "left").select("i", F.coalesce("end", "to").alias("to"))
        ends = chosen
    if ends is None:
        return nodes.select("id", F.col("id").alias("root"))
    ends = stored(ends, "ends")
    least = ends.groupBy("to").agg(F.min("i").alias("root"))
    roots = ends.join(least, "to").select(F.col("i").alias("id"), "root")
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
