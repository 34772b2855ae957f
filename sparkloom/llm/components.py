"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller node; loops and edges with a null end are left out."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, label) of every node of edges (u, v): label is the least node of its component.

    Each round hooks every node to its least neighbour, follows these hooks to their roots by pointer jumping, and
    contracts the edges: their ends become roots, loops and repeats go. A root is least among its neighbours, so a round
    leaves at most half of a component's nodes, and later rounds join ever smaller tables, however large a component is.
    Rounds go to the shared folder, so a lost executor costs one round. No edges give no rows; a node whose only edges are
    loops or have a null end gives none."""
    edges = cut(_oriented(edges))
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        hooks = edges.groupBy("u").agg(F.min("v").alias("label"))
        roots = edges.select(F.col("v").alias("u")).distinct().join(hooks, "u", "left_anti").select("u", F.col("u").alias("label"))
        labels = cut(hooks.union(roots))
        while True:
            ahead = labels.select(F.col("u").alias("label"), F.col("label").alias("far"))
            jumped = cut(labels.join(ahead, "label").select("u", F.col("label").alias("old"), F.col("far").alias("label")))
            labels = jumped.select("u", "label")
            if jumped.where("old <> label").isEmpty():
                break
        steps.append(labels)
        low, high = labels.withColumnsRenamed({"label": "low"}), labels.withColumnsRenamed({"label": "high"})
        moved = edges.join(high, "u").drop("u").join(low.withColumnRenamed("u", "v"), "v")
        edges = cut(_oriented(moved.select(F.col("high").alias("u"), F.col("low").alias("v"))))

    def then(first: DataFrame, later: DataFrame) -> DataFrame:
        far = later.select(F.col("u").alias("label"), F.col("label").alias("far"))
        return first.join(far, "label", "left").select("u", F.coalesce("far", "label").alias("label"))

    return reduce(then, steps) if steps else edges.select("u", F.col("v").alias("label"))
