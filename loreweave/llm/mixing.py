"""Mixing sources to target weights by hash-threshold histograms.

A document's hash decides its place in its source. Words are summed by source
and hash digit; the digit in which the budget ends is the boundary bucket, and
only the rows of that bucket are summed again by their next digit, until the
hash is used up. What lies below the threshold is taken, without a sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.runtime import materialize

#: Bits of a hash, and of the digit that one round refines it by.
HASH_BITS, DIGIT_BITS = 60, 12
#: Sources that are broadcast at most; with more, the join is left to the optimizer.
BROADCAST_SOURCES = 100_000


def word_count(text: str = "text"):
    """The words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    flat = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    words = F.array_remove(F.split(flat, " "), "")
    return F.size(words).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Targets by source from (source, source_size): min(most x size, level x weight), at the level where all are shared.

    Sharing by weight, capping, and sharing the excess again ends at that level,
    which a running sum over the sources by the level at which each is capped finds.
    """
    first = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (((F.row_number().over(first)) - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("caps_at", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("caps_at", F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(F.lit(1))
    ranked = (
        ranked.withColumn("total", share * F.sum("source_size").over(everywhere))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    )
    # the first source whose cap isn't reached has the level; if all are capped there is none
    level = F.min_by(F.when(F.col("caps_at") >= F.col("level"), F.col("level")), F.when(F.col("caps_at") >= F.col("level"), F.col("caps_at"))).over(everywhere)
    return ranked.withColumn("final_level", level).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("final_level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def by_source(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Join rows with a table of one row a source, which is broadcast if it is small."""
    side = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    return rows.join(side, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")


def place(seed: int):
    """A row's place in its source: a hash of its doc_id and text."""
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return F.shiftrightunsigned(key, 64 - HASH_BITS)


def thresholds(narrow: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, int]:
    """(of_source, source_size, target, base, prefix, edge_in) for each source of narrow(source, size, place), and their number."""
    sizes = materialize(source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "sources")
    n = sizes.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = sizes.select(
        F.col("source").alias("of_source"), "source_size", "target", whole.cast("int").alias("base"),
        (F.col("target") - whole * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix"),
    )
    for shift in range(HASH_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        # the boundary prefix has all digits before this one; sums by the next digit
        inside = by_source(narrow.select("source", "size", "place"), state.select("of_source", "prefix"), n).filter(
            F.shiftright("place", shift + DIGIT_BITS) == F.col("prefix")
        )
        sums = inside.groupBy("source", F.shiftright("place", shift).alias("next")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("next")
        sums = sums.withColumn("upto", F.sum("words").over(run)).withColumn("upto", F.col("upto") - F.col("words"))
        sums = sums.withColumnRenamed("source", "in_source")
        joined = state.join(sums, F.col("of_source").eqNullSafe(F.col("in_source")), "left").filter(F.col("upto").isNull() | (F.col("upto") <= F.col("budget")))
        # the last digit that begins within the budget is the boundary
        last = joined.groupBy("of_source", "source_size", "target", "base", "budget", "prefix").agg(F.max(F.struct("next", "upto", "words")).alias("b"))
        now = last.select(
            "of_source", "source_size", "target", "base",
            F.when(F.col("b.next").isNotNull(), F.col("budget") - F.col("b.upto")).otherwise(F.col("budget")).alias("budget"),
            F.coalesce("b.next", F.shiftleft("prefix", DIGIT_BITS)).alias("prefix"), F.coalesce("b.words", F.lit(0)).alias("edge"),
        )
        state = materialize(now, "boundary")
    # the rows of the boundary hash itself go in if the target is nearer with them
    return state.select("of_source", "source_size", "target", "base", "prefix", (2 * F.col("budget") >= F.col("edge")).alias("edge_in")), n


def with_copies(rows: DataFrame, found: DataFrame, n_sources: int, most: float) -> DataFrame:
    """Append copies, source_size and target to rows(source, place, ...)."""
    extra = (F.col("place") < F.col("prefix")) | ((F.col("place") == F.col("prefix")) & F.col("edge_in"))
    # at most x size is never passed: a source that is taken whole `most` times has no budget left
    copies = F.least(F.col("base") + extra.cast("int"), F.lit(int(most)))
    return by_source(rows, found, n_sources).withColumn("copies", copies).drop("base", "prefix", "edge_in")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 20) -> DataFrame:
    """How often the mix takes each row of docs(doc_id, source, text).

    Returns doc_id, source, size (words), source_size, target,
    copies and taken (copies x size). Sources, by code point and null last, have
    the repeating weights; together they get share x all words, and none more
    than most x its own. Every row of a source is taken floor(target / size of
    the source) times, and the rows of the lowest hashes once more until the
    target is met: the row at the boundary is taken if that comes nearer.

    The hash depends on doc_id, text and seed alone, so reruns agree; equal rows
    share their fate. Documents are read once; what is kept of them is one
    narrow row each. Sums are partial before every shuffle, so a hot source
    costs no more than others. A null text has size 0, a null source is a
    source; an empty table gives an empty table; a source of size 0 has target 0.
    """
    narrow = materialize(docs.select("doc_id", "source", word_count().alias("size"), place(seed).alias("place")), "mix")
    found, n = thresholds(narrow, weights, share, most)
    out = with_copies(narrow, found, n, most)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 20) -> DataFrame:
    """The rows of docs(doc_id, source, text, ...) as the mix takes them: each as many times as mix_sources() says.

    The thresholds are found on narrow rows and applied where the documents are
    read, so texts aren't shuffled.
    """
    columns = [docs[c] for c in docs.columns]
    narrow = materialize(docs.select("source", word_count().alias("size"), place(seed).alias("place")), "mix")
    found, n = thresholds(narrow, weights, share, most)
    row = F.struct(*columns).alias("row")
    out = with_copies(docs.select(row, "source", place(seed).alias("place")), found, n, most)
    return out.filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_")).select("row.*")
