"""Connected components by contraction: nodes hook to their smallest neighbour, chains shorten by
pointer jumping, and edges move to the components until none is left between two of them.

All state is tables in the shared folder; nothing but counts reaches the driver. Nodes of very many edges, and
components of very many nodes, are dealt over many tasks in every join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsift.llm.common import discard, materialise, spread_join


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of the edges (a, b); component: its smallest id."""
    spark = edges.sparkSession
    left, path = materialise(edges.where("a <> b").select("a", "b"), "edges")
    labels, labels_path = None, None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("up"))
        parent, parent_path = materialise(hooked, "parents")
        while True:
            # a root points to itself, so that every parent is found
            over = parent.select(F.col("id").alias("up"), F.col("up").alias("_over"))
            jumped, jumped_path = materialise(spread_join(parent, over, "up", "id").select("id", F.col("_over").alias("up"), (F.col("_over") != F.col("up")).alias("moved")), "parents")
            discard(spark, parent_path)
            still = not jumped.where("moved").isEmpty()
            parent, parent_path = jumped.select("id", "up"), jumped_path
            if not still:
                break
        to = lambda key: parent.select(F.col("id").alias(key), F.col("up").alias("_to"))
        if labels is None:
            composed, composed_path = materialise(parent.select("id", F.col("up").alias("component")), "labels")
        else:
            moved = spread_join(labels, to("component"), "component", "id", "left")
            composed, composed_path = materialise(moved.select("id", F.coalesce("_to", "component").alias("component")), "labels")
            discard(spark, labels_path)
        labels, labels_path = composed, composed_path
        first = spread_join(left, to("a"), "a", "b").select(F.col("_to").alias("a"), "b").distinct()
        first, first_path = materialise(first, "edges")
        second = spread_join(first, to("b"), "b", "a").select("a", F.col("_to").alias("b"))
        fewer, fewer_path = materialise(second.where("a <> b").distinct(), "edges")
        discard(spark, path, first_path, parent_path)
        left, path = fewer, fewer_path
    discard(spark, path)
    if labels is None:
        return spark.createDataFrame([], "id long, component long")
    return labels
