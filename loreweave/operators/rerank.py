"""Re-ranking of nearest neighbours. A distance is multiplied by (1 - boost); the least is the best.

Rows are hits(query_id, vec_id, distance, ...). Every boost is a column, so a whole mode is one projection and one rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(text: Column, keywords: list[str]) -> Column:
    """Share of the keywords (repeats counted) that the lower-cased text contains; 0 without keywords."""
    kept = [k.lower() for k in keywords if k]
    if not kept:
        return F.lit(0.0)
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [low.contains(k).cast("int") for k in kept]
    return sum(hits[1:], hits[0]) / F.lit(float(len(kept)))


def share(text: Column, parts: Column) -> Column:
    """Share of an array of keywords, phrases or names (repeats counted) that the lower-cased text contains; 0 without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    kept = F.filter(parts, lambda p: p != "")
    hits = F.size(F.filter(kept, lambda p: low.contains(F.lower(p))))
    return F.when(F.size(kept) > 0, hits / F.size(kept)).otherwise(F.lit(0.0))


def keywords(question: Column, stop: list[str] | None = None) -> Column:
    """Lower-cased words of three letters or more, repeats kept, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit("[a-z]{3,}"), 0)
    return F.filter(found, lambda w: ~w.isin(stop or [""]))


def without_names(words: Column, names: Column) -> Column:
    """Keywords that are no part of the names: what a question says of its people."""
    low = F.transform(names, F.lower)
    return F.filter(words, lambda w: ~F.array_contains(low, w))


def refers_to_answer(question: Column, phrases: list[str]) -> Column:
    """A question about what the assistant said before, by the phrases it has."""
    return F.coalesce(*[F.when(F.lower(question).contains(p), True) for p in phrases], F.lit(False))


def facet_boost(facet: Column, wanted: Column, validated: Column, general: str = "general") -> Column:
    """What the facets of a question, the first one above all, add to a document's, and the first pass to what it found."""
    primary = F.get(wanted, F.lit(0))
    keep = F.when((facet == primary) & (primary != general), 0.75).when(F.array_contains(wanted, facet), 0.9).otherwise(1.0)
    return 1 - keep * F.when(validated, 0.85).otherwise(1.0)


def day_boost(days_off: Column, tolerance: int, most: float = 0.40) -> Column:
    """`most` within the tolerance, falling to 0 at three times it."""
    tol = float(max(tolerance, 1))
    near = F.lit(most) * (1 - (days_off - tol) / (2 * tol))
    return F.when(days_off <= tolerance, F.lit(most)).when(days_off <= 3 * tol, near).otherwise(F.lit(0.0))


def fuse(hits: DataFrame, *boosts: Column, tie: str = "vec_id", k: int | None = None) -> DataFrame:
    """hits with `fused`, the boosted distance, and `rank` from 1 by it within each query."""
    fused = F.col("distance")
    for b in boosts:
        fused = fused * (1 - b)
    ranks = F.row_number().over(Window.partitionBy("query_id").orderBy("fused", tie))
    out = hits.withColumn("fused", fused).withColumn("rank", ranks)
    return out.filter(F.col("rank") <= k) if k else out


def by_session(ranked: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """query_id, session, rank of k sessions: by their first hit, then those without one in corpus order.

    ranked(query_id, session, rank) has at most k hits a query; corpus(session, position) has each session once. The
    first 2k sessions of the corpus are enough to fill up, so what is broadcast is bounded by k.
    """
    first = ranked.groupBy("query_id", "session").agg(F.min("rank").alias("best"))
    fill = F.broadcast(corpus.orderBy("position").limit(2 * k))
    unseen = first.select("query_id").distinct().join(fill).join(first, ["query_id", "session"], "left_anti")
    both = first.withColumn("position", F.lit(0).cast("long")).unionByName(unseen.withColumn("best", F.lit(None).cast("int")).select("query_id", "session", "best", F.col("position").cast("long")))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("best"), "position")
    return both.select("query_id", "session", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k)


def promote(ranked: DataFrame, picks: DataFrame) -> DataFrame:
    """ranked with the picked row of each query(query_id, vec_id) first, the others in their order."""
    flagged = ranked.join(picks.select("query_id", "vec_id", F.lit(0).alias("picked")), ["query_id", "vec_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.coalesce("picked", F.lit(1)), "rank")
    return flagged.withColumn("rank", F.row_number().over(order)).drop("picked")


def sessions_only(ranked: DataFrame) -> DataFrame:
    """query_id, session, rank by the first hit of each session; later hits of a session are left out."""
    first = ranked.groupBy("query_id", "session").agg(F.min("rank").alias("best"))
    return first.select("query_id", "session", F.row_number().over(Window.partitionBy("query_id").orderBy("best")).alias("rank"))


def routed(sections: DataFrame, text: Column, parts: Column, most: Column) -> DataFrame:
    """sections(query_id, section, ...) with `overlap`: of each query the first `most` by overlap, the greatest name first on a tie."""
    scored = sections.withColumn("overlap", share(text, parts))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), F.desc("section"))
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")


def rooms(sections: DataFrame, text: Column, parts: Column, most: int = 3) -> DataFrame:
    """As routed(), but all sections of a query of which none overlaps."""
    scored = sections.withColumn("overlap", share(text, parts))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), F.desc("section"))
    best = F.max("overlap").over(Window.partitionBy("query_id"))
    return scored.withColumn("place", F.row_number().over(order)).withColumn("best", best).filter((F.col("best") == 0) | (F.col("place") <= most)).drop("place", "best")
