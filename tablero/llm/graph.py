"""Connected components of links between ids, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def roots(links: DataFrame) -> DataFrame:
    """node, root for the ends of ``links`` (a, b): every node follows its smallest neighbour, unless it is smaller itself, down to one that has no smaller.

    Following doubles its stride every round, so the rounds grow with the logarithm of the longest way; a round handles nodes, not links.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    at = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        step = at.select(F.col("node").alias("via"), F.col("root").alias("further"))
        follow = staged(at.join(step, at["root"] == step["via"]).select("node", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")))
        at = follow.select("node", "root")
        if follow.where("moved").isEmpty():
            return at


def relabelled(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``links`` (a, b) between the labels (node, label) of their ends, each once, without loops; an end without a label is its own."""
    for side in ("a", "b"):
        named = labels.select(F.col("node").alias(side), F.col("label").alias("_label"))
        links = links.join(named, side, "left").withColumn(side, F.coalesce("_label", side)).drop("_label")
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for the ends of ``links`` (a, b); loops and repeats are allowed.

    Every round joins nodes to their roots and keeps only links between different roots, so that a family of any number of links is
    handled about once. The smallest node of a component is its own root in every round. Nothing but two marks comes to the driver.
    """
    ends = links.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = staged(ends)
    left, found = staged(ends.where("a <> b")), staged(ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    while not left.isEmpty():
        root = roots(left)
        found = staged(_followed(found, root))
        left = staged(relabelled(left, root.withColumnRenamed("root", "label")))
    return found


def _followed(found: DataFrame, root: DataFrame) -> DataFrame:
    step = root.select(F.col("node").alias("component"), "root")
    return found.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component"))


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component) as of ``components``, with further ``links`` between nodes, of which some may be new."""
    between = components(relabelled(links, found.withColumnRenamed("component", "label")))
    known = _followed(found, between.withColumnRenamed("component", "root"))
    fresh = between.join(found.select("node"), "node", "left_anti")
    return staged(known.unionByName(fresh))
