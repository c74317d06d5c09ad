"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A benchmark item gives its windows of ten words (a shorter item is one window).
A document can only hold a window if it holds the window's rarest word, by the
frequency of words in the documents: that one-word prefix is joined, the place
of the word in the window and the length of the document bound where the window
can lie, and the words there are compared with the window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.runtime import materialize

#: Rows of benchmark windows or words that are broadcast at once; more are joined block by block.
BLOCK_ROWS = 200_000
_UPPER = "".join(map(chr, range(0x41, 0x5B)))
_SEPARATORS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def folded_words(text: str = "text") -> Column:
    """A-Z lower-cased, then the words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; null has none."""
    flat = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER + _SEPARATORS, _UPPER.lower() + " " * len(_SEPARATORS))
    return F.array_remove(F.split(flat, " "), "")


def blocks(df: DataFrame, key: str) -> list[DataFrame]:
    """df itself if it may be broadcast, else disjoint parts of it that may."""
    n = -(-df.count() // BLOCK_ROWS)
    return [df] if n <= 1 else [df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(window_id, window, items): each distinct window of items(item_id, text) with the ids that have it, as strings."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), folded_words().alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    windows = words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, width))).alias("window"))
    return windows.groupBy(F.md5(F.array_join("window", " ")).alias("window_id")).agg(F.first("window").alias("window"), F.collect_set("item_id").alias("items"))


def rare_prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(rare, at, window_id, window, items): the word of each window that documents have least, and its place.

    A window with a word that no document has can't occur and is left out.
    """
    placed = windows.select("window_id", F.posexplode("window").alias("at", "word"))
    words = materialize(placed.select("word").distinct(), "words")
    parts = [docs.select(F.explode("words").alias("word")).join(F.broadcast(b), "word").groupBy("word").agg(F.count("*").alias("n")) for b in blocks(words, "word")]
    counts = reduce(DataFrame.unionByName, parts)
    rarest = placed.join(counts, "word").groupBy("window_id").agg(F.min(F.struct("n", "word", "at")).alias("r"), F.count("*").alias("known"))
    return windows.join(rarest, "window_id").filter(F.col("known") == F.size("window")).select(
        F.col("r.word").alias("rare"), F.col("r.at").alias("at"), "window_id", "window", "items"
    )


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """Compare docs(doc_id, text) with items(item_id, text).

    Returns a row for each row of docs: doc_id, text_hash (xxhash64 of the
    text), n_words, n_hit (words inside an occurrence of a window), n_items,
    items_sha256 and contaminated.

    Documents are split into words twice, once to count the benchmark's words
    and once to match; only matches, and a row a document, are shuffled. The
    windows are broadcast in blocks of at most BLOCK_ROWS, so a larger benchmark
    takes more passes and no more memory. A null text has no words; an item
    without words has no window; empty documents or benchmarks give no hits;
    repeated rows give a row each; ids that are null are kept; other columns are
    not read.
    """
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), folded_words().alias("words"))
    windows = materialize(item_windows(items, width), "windows")
    prefixes = materialize(rare_prefixes(split.select("words"), windows), "prefixes")
    # each document begins with an empty word, which this window finds, so that none is lost
    marker = prefixes.sparkSession.range(1).select(
        F.lit("").alias("rare"), F.lit(0).alias("at"), F.lit("").alias("window_id"), F.array(F.lit("")).alias("window"), F.array().cast("array<string>").alias("items")
    )
    marked = split.select("doc_id", "text_hash", F.size("words").alias("n_words"), F.concat(F.array(F.lit("")), "words").alias("words"))
    spots = marked.select("*", F.posexplode("words").alias("spot", "word"))
    found = []
    for i, block in enumerate(blocks(prefixes, "rare")):
        block = block.unionByName(marker) if i == 0 else block
        start = F.col("spot") - F.col("at")
        within = (start >= F.when(F.col("rare") == "", 0).otherwise(1)) & (start + F.size("window") <= F.col("n_words") + 1)
        same = F.slice("words", start + 1, F.size("window")) == F.col("window")
        found.append(
            spots.join(F.broadcast(block), (F.col("word") == F.col("rare")) & within & same).select(
                "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), "window_id",
                F.struct(start.alias("start"), F.size("window").alias("long")).alias("hit"), "items",
            )
        )
    real = F.col("window_id") != ""
    per_doc = reduce(DataFrame.unionByName, found).groupBy("doc_id", "text_hash", "n_words").agg(
        F.count_if(~real).alias("rows"),
        F.collect_set(F.when(real, F.col("hit"))).alias("hits"),
        F.collect_set(F.when(real, F.col("items"))).alias("items"),
    )
    covered = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, h: F.struct(
            F.greatest(a["end"], h["start"] + h["long"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), h["start"] + h["long"] - F.greatest(a["end"], h["start"]))).alias("n"),
        ),
        lambda a: a["n"].cast("long"),
    )
    ids = F.array_sort(F.array_distinct(F.flatten("items")))
    out = per_doc.select("doc_id", "text_hash", "n_words", "rows", covered.alias("n_hit"), ids.alias("ids"))
    return out.select(
        "doc_id", "text_hash", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))).alias("_row"),
    ).drop("_row")
