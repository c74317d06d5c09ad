"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.runtime import drop_table, materialize


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b); the component is its smallest node.

    Each round points every node to the smallest of its neighbours, first those
    above it and then those below. Minima are taken before the shuffle, so a
    node with many links is one row a task. Rounds are logarithmic in the size
    of the longest path; each is written to the shared folder.
    """
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    before = None
    while (state := _sum(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).filter("x < y")
        new = small.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b")).distinct()
        old, now = now, materialize(new, "links")
        drop_table(old)
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def relabelled(component: DataFrame, links: DataFrame) -> DataFrame:
    """component(node, component) after links(a, b) between its nodes; only the components that they join are worked on."""
    links = materialize(links, "new_links")
    if links.isEmpty():
        return component
    side = lambda x: component.select(F.col("node").alias(x), F.col("component").alias(f"{x}_component"))
    between = links.join(side("a"), "a").join(side("b"), "b").select(F.col("a_component").alias("a"), F.col("b_component").alias("b"))
    joined = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return materialize(component.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component")), "component")
