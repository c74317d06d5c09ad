"""Retrieval metrics over ranked(query_id, item, rank) rows, rank from 1, and truth(query_id, item)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 10, 30, 50)


def _dcg(hits: Column) -> Column:
    """The gain of so many hits in the first places."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(hits, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))


def at_ks(ranked: DataFrame, truth: DataFrame, queries: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """query_id, k, recall_any, recall_all, recall and ndcg of every one of queries(query_id), also of those without a hit.

    Without truth recall_any is 0 and the other two recalls 1, as nothing was missed. The ideal order of ndcg is that
    of the retrieved hits. Ranks are compared for all k at once, so the ranked rows are shuffled once.
    """
    true = truth.select("query_id", "item").distinct()
    hits = ranked.join(true, ["query_id", "item"], "left_semi").groupBy("query_id").agg(F.collect_list(F.struct("rank", "item")).alias("hits"))
    sizes = true.groupBy("query_id").agg(F.count("*").alias("wanted"))
    rows = queries.select("query_id").distinct().join(hits, "query_id", "left").join(sizes, "query_id", "left")
    rows = rows.select("query_id", F.coalesce("wanted", F.lit(0)).alias("wanted"), "hits", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    top = F.filter(F.coalesce("hits", F.array().cast(rows.schema["hits"].dataType)), lambda h: h["rank"] <= F.col("k"))
    found = F.size(F.array_distinct(F.transform(top, lambda h: h["item"])))
    dcg = F.aggregate(top, F.lit(0.0), lambda s, h: s + 1 / F.log2(h["rank"] + 1.0))
    share = F.when(F.col("wanted") > 0, found / F.col("wanted")).otherwise(1.0)
    ndcg = F.when(F.size(top) > 0, dcg / _dcg(F.size(top))).otherwise(0.0)
    return rows.select("query_id", "k", (found > 0).cast("double").alias("recall_any"), (share >= 1).cast("double").alias("recall_all"), share.alias("recall"), ndcg.alias("ndcg"))


def summary(scores: DataFrame, by: str = "k") -> DataFrame:
    """by, the means, and how many queries have a recall of 1 (perfect), between (partial) and 0 (zero)."""
    r = F.col("recall")
    return scores.groupBy(by).agg(
        F.avg("recall_any").alias("recall_any"), F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"),
        F.count_if(r >= 1).alias("perfect"), F.count_if((r > 0) & (r < 1)).alias("partial"), F.count_if(r == 0).alias("zero"),
    )


def hits_by_category(ranked: DataFrame, targets: DataFrame, items: DataFrame, k: int, also: str | None = None) -> DataFrame:
    """category, hits, total and rate at k of items(query_id, category, indexed), with a row for all (null category).

    A query is hit if a target(query_id, item) is among the first k by item, or by the column `also` of ranked. The row
    for all divides by all items, the others by those that were indexed.
    """
    top = ranked.filter(F.col("rank") <= k)
    found = [top.select("query_id", F.col(c).alias("item")).join(targets, ["query_id", "item"], "left_semi").select("query_id") for c in ("item", also) if c]
    hit = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    rows = items.join(hit.distinct().withColumn("hit", F.lit(1)), "query_id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    out = rows.filter("indexed").groupBy("category").agg(F.sum("hit").alias("hits"), F.count("*").alias("total"))
    out = out.unionByName(rows.agg(F.sum("hit").alias("hits"), F.count("*").alias("total")).withColumn("category", F.lit(None).cast(items.schema["category"].dataType)))
    return out.withColumn("rate", F.col("hits") / F.col("total"))


def evidence_recall(retrieved: DataFrame, evidence: DataFrame, text: str = "text") -> DataFrame:
    """query_id, found, wanted, recall of evidence(query_id, text) that holds a retrieved(query_id, text) or lies in one, in any case, trimmed.

    Equal evidence of a query counts once. Both meet on the query, whose retrieved rows are few.
    """
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", ""))
    wanted = evidence.select("query_id", plain.alias("e")).distinct()
    met = wanted.join(retrieved.select("query_id", plain.alias("r")), "query_id").filter(F.col("r").contains(F.col("e")) | F.col("e").contains(F.col("r")))
    found = met.select("query_id", "e").distinct().groupBy("query_id").agg(F.count("*").alias("found"))
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("wanted"))
    rows = sizes.join(found, "query_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return rows.select("query_id", "found", "wanted", (F.col("found") / F.col("wanted")).alias("recall"))


def shared_words(a: Column, b: Column) -> Column:
    """How many words two lists have in common as multisets, by one walk over both in order."""
    side = lambda c, l, r: F.transform(c, lambda w: F.struct(w.alias("w"), F.lit(l).alias("l"), F.lit(r).alias("r")))
    state = lambda w, l, r, n: F.struct(w.alias("w"), l.alias("l"), r.alias("r"), n.alias("n"))

    def step(s: Column, x: Column) -> Column:
        same = s["w"].eqNullSafe(x["w"])
        return F.when(same, state(s["w"], s["l"] + x["l"], s["r"] + x["r"], s["n"])).otherwise(state(x["w"], x["l"], x["r"], s["n"] + F.least(s["l"], s["r"])))

    begin = state(F.lit(None).cast("string"), F.lit(0), F.lit(0), F.lit(0))
    return F.aggregate(F.sort_array(F.concat(side(a, 1, 0), side(b, 0, 1))), begin, step, lambda s: s["n"] + F.least(s["l"], s["r"]))


def token_f1(pairs: DataFrame, key: list[str]) -> DataFrame:
    """key, f1 of the word lists a and b as multisets; 0 where they share nothing. Rows without any word are left out.

    Lists are compared where they lie; those of a repeated key are put together.
    """
    whole = lambda c: F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))).alias(c)
    rows = pairs.groupBy(*key).agg(whole("a"), whole("b"))
    total = F.size("a") + F.size("b")
    return rows.filter(total > 0).select(*key, (2.0 * shared_words(F.col("a"), F.col("b")) / total).alias("f1"))


def regressions(current: DataFrame, baseline: DataFrame, threshold: float = 0.2, rising: str = "recall|hit|ndcg|accuracy|throughput") -> DataFrame:
    """metric, value, before, change of the metrics that got worse by more than the threshold; those whose name matches `rising` should grow, others shrink."""
    both = current.select("metric", "value").join(baseline.select("metric", F.col("value").alias("before")), "metric").filter("before <> 0")
    change = (F.col("value") - F.col("before")) / F.abs("before")
    worse = F.when(F.lower("metric").rlike(rising), change < -threshold).otherwise(change > threshold)
    return both.withColumn("change", change).filter(worse)


def split(ids: DataFrame, dev: int, seed: int, key: str = "id") -> DataFrame:
    """key, part: `dev` rows for tuning and the others held out, by a seeded hash that gives the same split in every run."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    first = ids.select(key, order.alias("order")).orderBy("order", key).limit(dev).select(key, F.lit("dev").alias("part"))
    return first.unionByName(ids.select(key).join(first.select(key), key, "left_anti").withColumn("part", F.lit("held_out")))
