"""Quality rules: plain counts of a text, and a character n-gram perplexity held to a band per language.

The language model is a modified Kneser-Ney model of running character n-grams
of order ORDER, so it sees across the ends of words, one for each language; a
document is held against the model of its own language. Spark counts the
n-grams of all documents; the lower orders follow from the distinct ones
(continuation counts), level by level as tables. As every document is counted,
the probability of each of its n-grams stands in one table, whose frequent rows
are broadcast as a hash array and whose others are joined. Bands come from the
quartiles of all documents of a language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm.gram_table import KEPT_GRAMS, HeadValues, frame, head_values, tail_rows, text_parts
from loreweave.llm.words import WordHashes, ascii_words, mix, window_hashes
from loreweave.runtime import drop_table, materialize, on_executors

ORDER = 5
#: Characters before the first and after the last one of a text; what a text has of them is read as UNKNOWN.
PAD, END, UNKNOWN = 2, 3, 0xFFFD
#: Frequent n-grams whose probabilities are broadcast at most; those of the others are joined.
HEAD_GRAMS = 250_000
SYMBOLS = "#*$%&|<>"
#: A run of one punctuation mark is read as a single mark, so that long runs don't look like easy text.
_RUNS = re.compile(rb"([!-/:-@\[-`{-~])\1+")
_OWN = bytes.maketrans(bytes([0, PAD, END]), b"\x01\x01\x01")
_FACTORS = mix(np.arange(1, ORDER + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def lang_seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


def running_grams(words: list[list[bytes]], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit n-grams of texts (words in order, a space between), where each text's begin, and the characters of each.

    A text gives an n-gram for each character and one for its end.
    """
    plain = [_RUNS.sub(rb"\1", b" ".join(w).translate(_OWN)) for w in words]
    joined = b"".join(x for t in plain for x in (bytes([PAD]) * (ORDER - 1), t, bytes([END])))
    codes = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    size = len(codes) - ORDER + 1
    grams = np.zeros(size, np.uint64)
    for i in range(ORDER):
        grams += codes[i : size + i] * _FACTORS[i]
    inside = np.flatnonzero(codes[ORDER - 1 :] != PAD)
    ends = np.flatnonzero(codes[ORDER - 1 :][inside] == END)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    seeds = np.repeat(np.array([lang_seed(x) for x in langs], np.uint64), np.diff(np.append(starts, len(inside))))
    return mix(grams[inside] ^ seeds), starts, np.lib.stride_tricks.sliding_window_view(codes, ORDER)[inside]


COUNTED = "lang string, gram string, key long, n long"


def counted_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """n-gram counts of a partition by language, in sorted arrays of bounded size."""
    held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def sent() -> Iterator[pd.DataFrame]:
        for lang, (keys, n, chars) in held.items():
            for i in range(0, len(keys), 200_000):
                text = np.ascontiguousarray(chars[i : i + 200_000]).view(f"<U{ORDER}")[:, 0]
                yield pd.DataFrame({"lang": lang, "gram": text.astype(object), "key": keys[i : i + 200_000].view(np.int64), "n": n[i : i + 200_000]})
        held.clear()

    for batch in batches:
        for lang, part in batch.groupby("lang"):
            texts = [t or "" for t in part["text"]]
            for a, b in text_parts(texts, 4_000_000):
                grams, _, chars = running_grams([ascii_words(t) for t in texts[a:b]], [lang] * (b - a))
                keys, first, n = np.unique(grams, return_index=True, return_counts=True)
                chars = chars[first]
                if lang in held:
                    old = held[lang]
                    chars = np.concatenate([old[2], chars])
                    keys, first, at = np.unique(np.concatenate([old[0], keys]), return_index=True, return_inverse=True)
                    chars, n = chars[first], np.bincount(at, weights=np.concatenate([old[1], n])).astype(np.int64)
                held[lang] = (keys, n.astype(np.int64), chars.astype("<u4"))
                if sum(len(k) for k, _, _ in held.values()) > KEPT_GRAMS:
                    yield from sent()
    yield from sent()


def discount(c: Column) -> Column:
    """The Kneser-Ney discount of a count of 1, 2, or 3 and more, from how many n-grams of a language have counts 1 to 4 (columns n1 to n4).

    Half a count where the corpus is too small to tell.
    """
    many = [F.col(f"n{k}") for k in (1, 2, 3, 4)]
    y = many[0] / (many[0] + 2 * many[1])
    d = [F.least(F.greatest(k - (k + 1) * y * many[k] / many[k - 1], F.lit(0.05)), F.lit(float(k))) for k in (1, 2, 3)]
    enough = (many[0] > 0) & (many[1] > 0) & (many[2] > 0) & (many[3] > 0)
    return F.when(~enough, F.lit(0.5)).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def gram_logs(counts: DataFrame) -> DataFrame:
    """gram (its 64 bits), n and value: the log probability of every n-gram of counts(lang, gram, key, n) in its language's model."""
    level = {ORDER: counts.select("lang", "gram", F.col("n").alias("c"), F.col("n").alias("raw"))}
    for n in range(ORDER - 1, 0, -1):
        found = level[n + 1].select("lang", F.substring("gram", 2, n).alias("gram"), "raw").groupBy("lang", "gram").agg(F.count("*").alias("left"), F.sum("raw").alias("raw"))
        # what starts a text has one possible left neighbour, so its own count is used
        first = F.col("gram").startswith(chr(PAD)) if n > 1 else F.lit(False)
        level[n] = materialize(found.select("lang", "gram", F.when(first, F.col("raw")).otherwise(F.col("left")).alias("c"), "raw"), f"level{n}")
    lower = None
    for n in range(1, ORDER + 1):
        many = [F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
        of_lang = level[n].groupBy("lang").agg(*many, (1 / (F.count("*") + 1)).alias("floor"))
        grams = level[n].join(of_lang, "lang").select(
            "lang", "gram", F.substring("gram", 1, n - 1).alias("context"), F.substring("gram", 2, n - 1).alias("rest"), "c", "floor", F.least(discount(F.col("c")), F.col("c").cast("double")).alias("less")
        )
        contexts = grams.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("less").alias("kept"))
        grams = grams.join(contexts, ["lang", "context"])
        if lower is None:
            grams = grams.withColumn("lower", F.col("floor"))
        else:
            grams = grams.join(lower.select("lang", F.col("gram").alias("rest"), F.col("p").alias("lower")), ["lang", "rest"])
        p = (F.col("c") - F.col("less") + F.col("kept") * F.col("lower")) / F.col("total")
        before, lower = lower, materialize(grams.select("lang", "gram", p.alias("p")), f"order{n}")
        for done in (before, level[n]):  # the counts of the highest order are the caller's
            if done is not None and n < ORDER:
                drop_table(done)
    return counts.join(lower, ["lang", "gram"]).select(F.col("key").alias("gram"), "n", F.log("p").alias("value"))


def text_counts(text: str, hashes: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of a text whose words have these hashes."""
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    repeated = 0
    if len(hashes) > 3:
        _, inverse, n = np.unique(window_hashes(hashes, 3), return_inverse=True, return_counts=True)
        if len(n) < len(inverse):
            twice = n[inverse] > 1
            inside = np.zeros(len(hashes), bool)
            for i in range(3):
                inside[i : len(hashes) - 2 + i] |= twice
            repeated = int(inside.sum())
    return chars, symbols, len(lines) - len(set(lines)), repeated


RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, units long, tail array<long>, tail_n array<long>"


def rule_columns(df: DataFrame, head: HeadValues) -> DataFrame:
    """Append the struct `rules` to df(lang, text): plain counts, the sum of log probabilities, their number, and the n-grams that head lacks."""
    shared = on_executors(df.sparkSession, head)

    @F.pandas_udf(RULES)
    def rules(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        hashes, head = WordHashes(), shared()
        for langs, texts in batches:
            out: dict[str, list] = {x.split()[0]: [] for x in RULES.split(", ")}
            langs, texts = list(langs), [t or "" for t in texts]
            for a, b in text_parts(texts):
                words = [ascii_words(t) for t in texts[a:b]]
                grams, starts, _ = running_grams(words, langs[a:b])
                score, tail, tail_n = head.sums(grams, starts)
                for text, own in zip(texts[a:b], words, strict=True):
                    counts = text_counts(text, hashes.of(own))
                    for name, value in zip(out, (len(own), *counts), strict=False):
                        out[name].append(value)
                out["score"] += score.tolist()
                out["units"] += np.diff(np.append(starts, len(grams))).tolist()
                out["tail"] += tail
                out["tail_n"] += tail_n
            yield frame(out)

    return df.withColumn("rules", rules("lang", "text"))


def with_perplexity(scored: DataFrame, values: DataFrame) -> DataFrame:
    """Append log_ppl, the log perplexity a character (null without words), with what the tails of scored(row, ...) add."""
    rest = tail_rows(scored).join(values, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("rest_score"))
    total = F.col("score") + F.coalesce("rest_score", F.lit(0.0))
    return scored.drop("tail", "tail_n").join(rest, "row", "left").withColumn("log_ppl", F.when(F.col("n_words") > 0, -total / F.col("units")))


def quality_rules(df: DataFrame, id_col: str = "doc_id", width: float = 3.0, least: float = 0.03) -> DataFrame:
    """Judge every document of df(id_col, lang, text) by the rules and by its perplexity band.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    perplexity (a character), low and high (the language's band), base_failed
    and kept. The band is the quartiles of log perplexity among the language's
    documents that pass the base rules, widened by max(width x their distance,
    least) x sqrt(1 + 100 / n_words), as short texts scatter more; below by twice
    that, as a good text that has many copies is easy too.

    Counts and quartiles come from all documents and models have order ORDER at
    every size. No text is shuffled, only n-gram counts, one narrow row a
    document and, of n-grams beyond the HEAD_GRAMS most frequent, a row for each
    document that has them. A null lang is a language of its own; a null or
    empty text has no words and base_failed; one very long word is scored like
    any other; repeated rows are judged alike; ids of any type are kept as they
    are; an empty table gives an empty table; other columns, whatever their
    names, are not read.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col("lang").cast("string").alias("own_lang"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    counts = docs.select("lang", "text").mapInPandas(counted_grams, COUNTED).groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.first("key").alias("key"))
    values = materialize(gram_logs(materialize(counts, "grams")), "gram_values")
    scored = rule_columns(docs, head_values(values, HEAD_GRAMS)).select("id", F.col("own_lang").alias("lang"), "rules.*").withColumn("row", F.monotonically_increasing_id())
    scored = materialize(with_perplexity(materialize(scored, "rules"), values), "perplexity")
    scored = scored.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    q = F.percentile_approx("log_ppl", F.array(F.lit(0.25), F.lit(0.75)), 10_000)
    bands = scored.filter(~F.col("base_failed")).groupBy("lang").agg(q.alias("q"))
    wide = F.greatest(width * (F.col("q")[1] - F.col("q")[0]), F.lit(least))
    bands = bands.select(F.col("lang").alias("band_lang"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), wide.alias("wide"))
    slack = F.col("wide") * F.sqrt(1 + 100 / F.greatest("n_words", F.lit(1)))
    lo, hi = F.col("q1") - 2 * slack, F.col("q3") + slack
    inside = F.col("log_ppl").between(lo, hi)
    return scored.join(bands, F.col("lang").eqNullSafe(F.col("band_lang")), "left").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.exp("log_ppl").alias("perplexity"), F.exp(lo).alias("low"), F.exp(hi).alias("high"),
        "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
    )
