"""Connected components of edges between whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasspool.operators.joins import reshuffled
from glasspool.workspace import Workspace


def _round(edges: DataFrame) -> DataFrame:
    """Edges are (node, parent), parent < node. Every node sends its other parents to its least one,
    then every parent is replaced by its own least parent."""
    least = edges.groupBy("node").agg(F.min("parent").alias("least"))
    met = edges.join(reshuffled(least, "node"), "node")
    own = F.struct("node", F.col("least").alias("parent"), F.lit(False).alias("moved"))
    side = F.struct(F.col("parent").alias("node"), F.col("least").alias("parent"), F.lit(True).alias("moved"))
    stars = (
        met.select(F.explode(F.when(F.col("parent") == F.col("least"), F.array(own)).otherwise(F.array(side, own))).alias("e"))
        .select("e.*")
        .groupBy("node", "parent")
        .agg(F.max("moved").alias("moved"))
    )
    above = stars.groupBy("node").agg(F.min("parent").alias("above")).withColumnRenamed("node", "parent")
    return stars.join(reshuffled(above, "parent"), "parent", "left").select(
        "node", F.coalesce("above", "parent").alias("parent"), (F.col("moved") | F.col("above").isNotNull()).alias("moved")
    )


def components(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """(node, component) of every node of the edges (a, b); the component is its least node.

    Alternating stars as joins and aggregates; a node with very many neighbours is absorbed by
    partial aggregation and split by skew joins. Rounds are written, so lineage stays short.
    """
    current = edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent"))
    slots = [workspace.fresh_path("stars-even"), workspace.fresh_path("stars-odd")]
    current, turn = workspace.store(current.distinct(), slots[0]), 0
    while True:
        turn += 1
        current = workspace.store(_round(current.select("node", "parent")), slots[turn % 2], overwrite=True)
        if not current.agg(F.max("moved")).first()[0]:
            break
    found = current.select("node", F.col("parent").alias("component")).distinct()
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
