"""Connected components of a distributed edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (u, v: long); label is one fixed node of its component.

    Each round points every node at its least neighbour (itself included), renames the edges' ends so and
    drops loops and repeats. A node that isn't the least among its neighbours vanishes, so at least half of
    the nodes that still have an edge go in each round: the rounds grow as the logarithm of the nodes.
    Everything stays in tables; the driver only learns how many edges are left. Hubs are split by adaptive
    skew joins, and minima are combined before their shuffle. No edges: no rows. Loops and repeated edges
    change nothing; edges with a null end are ignored.
    """
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null")
    e = stored(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    labels = stored(nodes.select("node", F.col("node").alias("label")), "labels")
    e = _renamed(e.where("u <> v"), None)
    while e.head(1):
        ends = e.select("u", "v").union(e.select("v", "u"))
        least = stored(ends.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to")), "least")
        onward, labelled = e, labels
        e = _renamed(e, least)
        labels = stored(
            labels.join(least.withColumnRenamed("u", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels"
        )
        for old in (onward, labelled, least):
            drop_stored(old)
    return labels


def _renamed(edges: DataFrame, least: DataFrame | None) -> DataFrame:
    if least is not None:
        for end in ("u", "v"):
            to = least.select(F.col("u").alias(end), F.col("to").alias(f"{end}_to"))
            edges = edges.join(to, end, "left").withColumn(end, F.coalesce(f"{end}_to", end)).select("u", "v")
    return stored(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
