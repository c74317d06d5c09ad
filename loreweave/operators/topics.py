"""The topic graph: topics, the domains they occur in, and bridges between domains. Derived, never stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes(chunks: DataFrame) -> DataFrame:
    """topic, domains, facets, n, dates (the last five) of chunks(topic, domain, facet, date); empty and 'general' topics are left out."""
    rows = chunks.filter((F.col("topic") != "") & (F.col("topic") != "general") & (F.col("domain") != ""))
    kept = lambda c: F.when(F.col(c) != "", F.col(c))
    last = F.array_sort(F.slice(F.sort_array(F.collect_set(kept("date")), False), 1, 5))
    return rows.groupBy("topic").agg(
        F.array_sort(F.collect_set("domain")).alias("domains"), F.array_sort(F.collect_set(kept("facet"))).alias("facets"), F.count("*").alias("n"), last.alias("dates")
    )


def edges(node_rows: DataFrame) -> DataFrame:
    """topic, domain_a < domain_b, facet ('' if the topic has none), n."""
    facets = F.when(F.size("facets") > 0, F.col("facets")).otherwise(F.array(F.lit("")))
    pairs = node_rows.select("topic", "domains", "n", F.explode(facets).alias("facet")).select("*", F.explode("domains").alias("domain_a"))
    return pairs.select("topic", "domain_a", F.explode("domains").alias("domain_b"), "facet", "n").filter("domain_a < domain_b").select("topic", "domain_a", "domain_b", "facet", "n")


def bridges(node_rows: DataFrame, domain_a: str | None = None, domain_b: str | None = None, limit: int = 50) -> DataFrame:
    """Topics of two domains or more, most chunks first."""
    out = node_rows.filter(F.size("domains") >= 2)
    for d in (domain_a, domain_b):
        out = out.filter(F.array_contains("domains", d)) if d else out
    return out.orderBy(F.desc("n"), "topic").limit(limit)


def traverse(node_rows: DataFrame, start: str, max_hops: int = 2, limit: int = 50) -> DataFrame:
    """topic, hop, n, connected_via of what shared domains reach from start, nearest first. A topic's hop is the least one.

    connected_via are the domains that a topic shares with the one it was reached from, the least by name of those
    one hop nearer; null for the start. Each hop joins the frontier with the topics not seen yet on their domains.
    """
    exploded = node_rows.select("topic", F.explode("domains").alias("domain"))
    seen = node_rows.filter(F.col("topic") == start).select("topic", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("parent"))
    for hop in range(1, max_hops + 1):
        frontier = exploded.join(seen.filter(F.col("hop") == hop - 1).select("topic"), "topic", "left_semi").groupBy("domain").agg(F.min("topic").alias("parent"))
        reached = exploded.join(frontier, "domain").groupBy("topic").agg(F.min("parent").alias("parent"))
        new = reached.join(seen.select("topic"), "topic", "left_anti")
        seen = seen.unionByName(new.select("topic", F.lit(hop).alias("hop"), "parent"))
    of_parent = node_rows.select(F.col("topic").alias("parent"), F.col("domains").alias("parent_domains"))
    rows = seen.join(node_rows.select("topic", "n", "domains"), "topic").join(of_parent, "parent", "left")
    shared = F.array_sort(F.array_intersect("domains", "parent_domains"))
    return rows.select("topic", "hop", "n", shared.alias("connected_via")).orderBy("hop", F.desc("n"), "topic").limit(limit)


def stats(node_rows: DataFrame) -> DataFrame:
    """topics, bridges and edges of the graph, one row."""
    size = F.size("domains")
    pairs = (size * (size - 1) / 2).cast("long") * F.greatest(F.size("facets"), F.lit(1))
    return node_rows.agg(F.count("*").alias("topics"), F.count_if(size >= 2).alias("bridges"), F.coalesce(F.sum(pairs), F.lit(0)).alias("edges"))


def topics_by_domain(node_rows: DataFrame) -> DataFrame:
    """domain, topics: how many topics each domain has."""
    return node_rows.select(F.explode("domains").alias("domain")).groupBy("domain").agg(F.count("*").alias("topics"))


def widest(node_rows: DataFrame, limit: int = 10) -> DataFrame:
    """The bridges of the most domains."""
    return node_rows.filter(F.size("domains") >= 2).select("topic", F.size("domains").alias("n_domains"), "n").orderBy(F.desc("n_domains"), F.desc("n"), "topic").limit(limit)


def suggest(node_rows: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """topic and score: 1.0 where it contains the query, 0.5 where it contains a hyphen-separated part of it."""
    parts = [p for p in query.lower().split("-") if p]
    topic = F.lower("topic")
    score = F.when(topic.contains(query.lower()), 1.0)
    for p in parts:
        score = score.when(topic.contains(p), 0.5)
    return node_rows.select("topic", score.alias("score")).filter("score is not null").orderBy(F.desc("score"), "topic").limit(limit)
