"""Connected components of an edge table by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.llm.common import kept


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); component is the smallest node of each.

    Every round maps each node to the neighbour (or itself) of smallest hash
    and keeps the mapped edges; a constant share of the nodes goes per round,
    so the rounds grow with the logarithm of the longest path.  Only counts
    reach the driver.
    """
    links = kept(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "links")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = (both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("m"))
                .select(F.col("a").alias("node"), F.least(F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v")), F.col("m"))["v"].alias("to")))
        near = kept(near, "contract")
        rounds.append(near)
        to_a = near.select(F.col("node").alias("a"), F.col("to").alias("na"))
        to_b = near.select(F.col("node").alias("b"), F.col("to").alias("nb"))
        links = kept(links.join(to_a, "a").join(to_b, "b").where("na <> nb")
                     .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = rounds[0].withColumnRenamed("to", "at")
    for near in rounds[1:]:
        step = near.select(F.col("node").alias("at"), "to")
        labels = labels.join(step, "at", "left").select("node", F.coalesce("to", "at").alias("at"))
    labels = kept(labels, "labels")
    least = labels.groupBy("at").agg(F.min("node").alias("component"))
    return kept(labels.join(least, "at").select("node", "component"), "components")
