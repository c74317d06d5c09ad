"""Substring dedup: an FM-index per shard, searched backwards by the documents' own passages.

The windows of a document fall into regions by their minimizer, the least hash
of the short word grams in them. Equal windows have equal minimizers, so a
shard that holds all regions of a minimizer sees all equal windows. Only
minimizers that several documents have, and of them only distinct regions, are
indexed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.fm_index import FmIndex
from loreweave.llm.words import WordHashes, ascii_words, mix, window_hashes
from loreweave.runtime import materialize

#: Words of the grams that minimizers are chosen from.
GRAM = 16
#: Regions of a shard, about.
SHARD_REGIONS = 6_000
#: A minimizer of more distinct regions than this is divided into single windows.
HOT_REGIONS = 2_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def regions(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and minimizer of each run of windows with one minimizer."""
    if len(hashes) < width:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    least = mix(window_hashes(hashes, min(GRAM, width)))
    span, done = width - min(GRAM, width) + 1, 1
    while done < span:
        step = min(done, span - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    windows = np.diff(np.append(first, len(least)))
    return first, windows + width - 1, least[first]


def span_hashes(hashes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each span of words, from running sums of a polynomial modulo 2^64."""
    power = np.cumprod(np.full(len(hashes), _BASE))
    upto = np.append(np.uint64(0), np.cumsum(mix(hashes) * power))
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    back = np.cumprod(np.append(np.uint64(1), np.full(len(hashes), inverse)))
    return mix((upto[first + length] - upto[first]) * back[first] + length.astype(np.uint64))


CUT = "n_words long, whole string, m array<long>, r array<long>, first array<int>, words array<int>"


def cut_documents(width: int):
    """A function of texts alone, so that ids never pass through Python."""

    @F.pandas_udf(CUT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            for start in range(0, len(batch), 1_000):
                rows = []
                for text in batch.iloc[start : start + 1_000]:
                    words = ascii_words(text)
                    hashes = known.of(words)
                    first, length, least = regions(hashes, width)
                    r = span_hashes(hashes, first, length) if len(first) else least
                    digest = hashlib.sha256(b" ".join(words)).hexdigest()
                    rows.append((len(words), digest, least.view(np.int64), r.view(np.int64), first.astype(np.int32), length.astype(np.int32)))
                yield pd.DataFrame(rows, columns=["n_words", "whole", "m", "r", "first", "words"])

    return run


def region_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The word hashes of the spans that each document carries."""
    known = WordHashes()
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["carried"], strict=True):
            hashes = known.of(ascii_words(text)).view(np.int64)
            rows += [(s["m"], s["r"], doc_id, s["hot"], hashes[s["first"] : s["first"] + s["words"]]) for s in spans]
        yield pd.DataFrame(rows, columns=["m", "r", "doc", "hot", "words"])


def index_shard(width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["words"].map(len).to_numpy()
        _, symbols = np.unique(np.concatenate(pdf["words"].to_numpy()), return_inverse=True)
        strings = np.split(symbols.astype(np.int64) + 1, np.cumsum(lengths)[:-1])
        least = FmIndex(strings, pdf["doc"].to_numpy(np.int64), width).least_values()
        return pd.DataFrame({"m": pdf["m"], "r": pdf["r"], "least": least})

    return run


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_windows(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, starts in zip(batch["text"], batch["starts"], strict=True):
                words = ascii_words(text)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.asarray(starts, np.int64), 1)
                np.add.at(edge, np.asarray(starts, np.int64) + width, -1)
                keep = np.cumsum(edge[:-1]) == 0
                kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
                rows.append((len(words), int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest()))
            n, removed, digest = zip(*rows, strict=True) if rows else ((), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": n, "n_removed": removed, "kept_sha256": digest})

    return run


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id (an integer), n_words, n_removed and kept_sha256.

    A word goes if a window of `width` words over it also starts in a document
    with a smaller doc_id; windows are judged on the input.

    Copies of a region are summed to one row with its smallest document before
    they are indexed, so groups of copies cost no more than one. Shards hold
    about SHARD_REGIONS regions, whatever the size of the input. A minimizer
    with more than HOT_REGIONS distinct regions, as a passage in many contexts
    has, is divided into its windows, which are summed by content first. A null
    or empty text and one below `width` words keep all; very long texts are cut
    in whole; rows that repeat a doc_id don't remove each other's words; a null
    doc_id is neither judged nor compared with; an empty table gives an empty
    table; other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), "text")
    cut = materialize(texts.withColumn("c", cut_documents(width)("text")).select("doc_id", "text_hash", "c.*"), "cut")
    spans = cut.filter("doc_id is not null").select("doc_id", "text_hash", F.explode(F.arrays_zip("m", "r", "first", "words")).alias("s")).select("doc_id", "text_hash", "s.*")
    shared = spans.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("m")
    found = materialize(spans.join(shared, "m"), "found")
    distinct = found.groupBy("m", "r").agg(F.min(F.struct("doc_id", "text_hash", "first", "words")).alias("c"))
    distinct = materialize(distinct.select("m", "r", "c.*"), "distinct")
    hot = distinct.groupBy("m").count().filter(F.col("count") > HOT_REGIONS).select("m", F.lit(True).alias("is_hot"))
    carried = (
        distinct.join(hot, "m", "left")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("m", "r", "first", "words", F.coalesce("is_hot", F.lit(False)).alias("hot"))).alias("carried"))
    )
    pieces = texts.join(carried, ["doc_id", "text_hash"]).select("doc_id", "text", "carried").mapInPandas(region_words, "m long, r long, doc long, hot boolean, words array<long>")
    pieces = materialize(pieces, "pieces")
    n_shards = max(1, -(-distinct.count() // SHARD_REGIONS))
    plain = pieces.filter("not hot").select("m", "r", "doc", "words", F.pmod(F.xxhash64("m"), F.lit(n_shards)).alias("shard"))
    starts = F.sequence(F.lit(1), F.size("words") - width + 1)
    single = pieces.filter("hot").select("m", "r", "doc", F.posexplode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("at", "window"))
    single = single.withColumn("w", F.xxhash64("window"))
    merged = single.groupBy("m", "w").agg(F.min("doc").alias("doc"), F.first("window").alias("words"))
    merged = merged.select("m", F.col("w").alias("r"), "doc", "words", (F.pmod(F.xxhash64("w"), F.lit(n_shards)) + n_shards).alias("shard"))
    answers = plain.unionByName(merged).groupBy("shard").applyInPandas(index_shard(width), "m long, r long, least array<long>")
    answers = materialize(answers, "least")
    by_window = answers.select("m", F.col("r").alias("w"), F.col("least")[0].alias("value"))
    hot_answers = single.select("m", "r", "at", "w").join(by_window, ["m", "w"]).groupBy("m", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("least"))
    regions_known = pieces.filter("not hot").select("m", "r").join(answers, ["m", "r"]).unionByName(hot_answers)
    judged = found.join(regions_known, ["m", "r"])
    gone = F.filter(F.sequence(F.lit(0), F.size("least") - 1), lambda i: F.element_at("least", (i + 1).cast("int")) < F.col("doc_id"))
    judged = judged.select("doc_id", "text_hash", F.transform(gone, lambda i: F.col("first") + i).alias("starts")).filter(F.size("starts") > 0)
    removed = materialize(judged.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")), "removed")
    changed = texts.join(removed, ["doc_id", "text_hash"]).select("doc_id", "text", "starts").mapInPandas(remove_windows(width), DIGEST)
    same = cut.join(removed.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_anti")
    return changed.unionByName(same.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole").alias("kept_sha256")))
