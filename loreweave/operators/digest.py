"""A short digest of a text: names, topics, a key sentence, moods and flags. Lexicons are parameters, as (keyword, code) pairs in order."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.text import bound, sentences, token_estimate, words


def signals(text: Column, lexicon: list[tuple[str, str]], most: int = 3) -> Column:
    """The first distinct codes, in the lexicon's order, whose keyword the lower-cased text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array(*[F.when(low.contains(k), F.lit(code)) for k, code in lexicon]) if lexicon else F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.array_compact(found)), 1, most)


def names(text: Column, stop: list[str], most: int = 3, known: dict[str, str] | None = None) -> Column:
    """The codes of known names that the text contains, in any case; without any, codes of three letters for capitalised words after the first word."""
    capital = bound(words(text), lambda ws: F.filter(ws, lambda w, i: (i > 0) & (F.upper(w) != w) & (F.lower(w) != w)))
    letters = F.transform(capital, lambda w: F.regexp_replace(w, "[^a-zA-Z]", ""))
    kept = F.filter(letters, lambda w: w.rlike("^[A-Z][a-z]+$") & ~F.lower(w).isin(stop or [""]))
    guessed = F.slice(F.array_distinct(F.transform(kept, lambda w: F.upper(F.substring(w, 1, 3)))), 1, most)
    if not known:
        return guessed
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(n.lower()), F.lit(c)) for n, c in known.items()])))
    return bound(found, lambda codes: F.when(F.size(codes) > 0, F.slice(codes, 1, most)).otherwise(guessed))


def key_sentence(text: Column, decision_words: list[str], most: int = 55) -> Column:
    """The sentence with the most decision words (2 each), short ones favoured; the first on a tie; '' if there is none."""

    def score(s: Column) -> Column:
        low, size = F.lower(s), F.length(s)
        hits = sum((F.when(low.contains(w), 2).otherwise(0) for w in decision_words), F.lit(0))
        return hits + F.when(size < 40, 2).when(size < 80, 1).when(size > 150, -2).otherwise(0)

    ranked = F.transform(sentences(text), lambda s, i: F.struct((-score(s)).alias("a"), i.alias("i"), s.alias("s")))
    best = F.coalesce(F.array_min(ranked)["s"], F.lit(""))
    return bound(best, lambda b: F.when(F.length(b) > most, F.concat(F.substring(b, 1, most - 3), F.lit("..."))).otherwise(b))


def topic_words(text: Column, stop: list[str], most: int = 3) -> Column:
    """The most frequent words of three letters or more, the first on a tie; capitals, inner capitals, _ and - weigh two more each time."""
    left_out = frozenset(stop)

    @F.pandas_udf("array<string>")
    def count(texts: pd.Series) -> pd.Series:
        word, inner = re.compile(r"[a-zA-Z][a-zA-Z_-]{2,}"), re.compile(r".+[A-Z]|[_-]")

        def of(t: str | None) -> list[str]:
            sums: dict[str, int] = {}
            for w, n in Counter(word.findall(t or "")).items():
                low = w.lower()
                if low not in left_out:
                    sums[low] = sums.get(low, 0) + n * (1 if w == low and "_" not in w and "-" not in w else 1 + 2 * ("A" <= w[0] <= "Z") + 2 * (inner.search(w) is not None))
            return sorted(sums, key=lambda w: -sums[w])[:most]

        return texts.map(of)

    return count(text)


def topics(docs: DataFrame, stop: list[str], most: int = 3, key: str = "id", text: str = "document") -> DataFrame:
    """key, topics: topic_words() of the texts that have any."""
    return docs.select(key, topic_words(F.col(text), stop, most).alias("topics")).filter(F.size("topics") > 0)


def digest(docs: DataFrame, stop: list[str], moods: list[tuple[str, str]], flags: list[tuple[str, str]], decision_words: list[str], known: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, digest and the columns to keep of docs(id, document, domain, topic, date): a head line and '0:names|topics|"sentence"|moods|flags'.

    All is read off the row itself, so nothing is shuffled.
    """
    text = F.col("document")
    some = lambda c, sep, other: bound(c, lambda x: F.when(F.size(x) > 0, F.array_join(x, sep)).otherwise(other))
    rows = docs.withColumn("topics", topic_words(text, stop))
    or_mark = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("?"))
    head = F.concat_ws("|", or_mark("domain"), or_mark("topic"), or_mark("date"), F.lit("?"))
    body = F.concat_ws(
        "|",
        F.concat(F.lit("0:"), some(names(text, stop, 3, known), "+", F.lit("???"))),
        some(F.col("topics"), "_", F.lit("misc")),
        bound(key_sentence(text, decision_words), lambda quote: F.when(quote != "", F.concat(F.lit('"'), quote, F.lit('"')))),
        some(signals(text, moods), "+", F.lit(None)),
        some(signals(text, flags), "+", F.lit(None)),
    )
    return rows.select("id", F.concat_ws("\n", head, body).alias("digest"), *keep)


def sizes(rows: DataFrame, text: str = "document", short: str = "digest") -> DataFrame:
    """rows with estimated tokens and characters of text and digest, and how much shorter the digest is."""
    whole, less = token_estimate(F.col(text)), token_estimate(F.col(short))
    counts = [F.length(F.coalesce(F.col(c), F.lit(""))).cast("bigint").alias(n) for c, n in ((text, "characters"), (short, "digest_characters"))]
    return rows.select("*", whole.alias("tokens"), less.alias("digest_tokens"), F.round(whole / less, 1).alias("ratio"), *counts)


def total_ratio(rows: DataFrame) -> DataFrame:
    """tokens, digest_tokens and their ratio over all rows of sizes()."""
    sums = rows.agg(F.sum("tokens").alias("tokens"), F.sum("digest_tokens").alias("digest_tokens"))
    return sums.withColumn("ratio", F.round(F.col("tokens") / F.greatest("digest_tokens", F.lit(1)), 4))


def decoded(digests: DataFrame, key: str = "id", text: str = "digest") -> DataFrame:
    """key, line_no, kind (arc, bridge, note or header) and the fields of every digest line; other lines are left out."""
    lines = digests.select(key, F.posexplode(F.split(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""), "\n", -1)).alias("line_no", "line"))
    fields = F.split("line", r"\|", -1)
    has_bar = F.col("line").contains("|")
    kind = F.when(F.col("line").startswith("ARC:"), "arc").when(F.col("line").startswith("T:"), "bridge").when(has_bar & F.get(fields, F.lit(0)).contains(":"), "note").when(has_bar, "header")
    return lines.select(key, "line_no", kind.alias("kind"), F.when(F.col("line").startswith("ARC:"), F.array(F.substring("line", 5, 1_000_000))).otherwise(fields).alias("fields")).filter("kind is not null")


# Structured notes: notes(file, place, id, people, topics, weight, moods, content, origin, notes, title, sensitivity, is_origin).


def note_flags() -> Column:
    """Flags of a note, in order, as an array."""
    told, origin = F.lower(F.coalesce("notes", F.lit(""))), F.lower(F.coalesce("origin", F.lit("")))
    flags = [
        (F.coalesce("is_origin", F.lit(False)), "ORIGIN"), (F.upper(F.coalesce("sensitivity", F.lit(""))).startswith("MAXIMUM"), "SENSITIVE"),
        (told.contains("foundational pillar") | told.contains("core"), "CORE"), (told.contains("genesis") | origin.contains("genesis"), "GENESIS"), (told.contains("pivot"), "PIVOT"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in flags]))


def note_quote(feelings: list[str]) -> Column:
    """The best quoted fragment of 8 to 55 characters: capital first 2, each word of feeling 2, over 20 characters 1; a title's second part without one."""
    text = F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("origin", F.lit("")), F.coalesce("notes", F.lit("")))
    pick = lambda p: F.regexp_extract_all(text, F.lit(p), 1)
    found = F.concat(pick('"([^"]{8,55})"'), pick(r"(?:^|[\s(])'([^']{8,55})'(?=[\s.,;:!?)]|$)"))
    found = F.filter(F.array_distinct(F.transform(found, lambda q: F.regexp_replace(q, r"^\s+|\s+$", ""))), lambda q: F.length(q) >= 8)

    def points(q: Column) -> Column:
        low = F.lower(q)
        felt = sum((F.when(low.contains(w), 2).otherwise(0) for w in feelings), F.lit(0))
        return felt + F.when(q.rlike(r"^\p{Lu}"), 2).otherwise(0) + F.when(F.length(q) > 20, 1).otherwise(0) - F.when(q.rlike("^(The|This|She) "), 2).otherwise(0)

    best = F.array_min(F.transform(found, lambda q, i: F.struct((-points(q)).alias("a"), i.alias("i"), q.alias("q"))))["q"]
    second = F.when(F.coalesce("title", F.lit("")).contains(" - "), F.substring(F.regexp_replace("title", "^.*? - ", ""), 1, 45)).otherwise("")
    return F.coalesce(best, second)


def note_lines(notes: DataFrame, codes: dict[str, str], moods: dict[str, str], feelings: list[str]) -> DataFrame:
    """file, place, line: each note as 'id:people|topics|"quote"|weight|moods|flags'."""
    code = lambda table, cut: lambda x: F.coalesce(*[F.when(F.lower(x) == k.lower(), F.lit(v)) for k, v in table.items()], cut(x))
    people = F.array_sort(F.array_distinct(F.transform(F.coalesce("people", F.array().cast("array<string>")), code(codes, lambda x: F.upper(F.substring(x, 1, 3))))))
    felt = F.slice(F.array_distinct(F.transform(F.coalesce("moods", F.array().cast("array<string>")), code(moods, lambda x: F.substring(x, 1, 4)))), 1, 3)
    quote, flags = note_quote(feelings), note_flags()
    some = lambda c, sep, other: F.when(F.size(c) > 0, F.array_join(c, sep)).otherwise(other)
    line = F.concat_ws(
        "|", F.concat(F.element_at(F.split("id", "-"), -1), F.lit(":"), some(people, "+", F.lit("???"))), some(F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, 2), "_", F.lit("misc")),
        F.when(quote != "", F.concat(F.lit('"'), quote, F.lit('"'))), F.coalesce("weight", F.lit(0.5)).cast("string"), some(felt, "+", F.lit(None)), some(flags, "+", F.lit(None)),
    )
    return notes.select("file", "place", line.alias("line"))


def bridge_line(source: Column, target: Column, label: Column) -> Column:
    """'T:a<->b|label', the label up to its first colon or 30 characters of it."""
    last = lambda c: F.element_at(F.split(c, "-"), -1)
    short = F.when(label.contains(":"), F.substring_index(label, ":", 1)).otherwise(F.substring(label, 1, 30))
    return F.concat(F.lit("T:"), last(source), F.lit("<->"), last(target), F.lit("|"), short)


def file_texts(lines: DataFrame) -> DataFrame:
    """file, text of lines(file, place, line) in order."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("file").agg(ordered.alias("text"))


def key_notes(notes: DataFrame, least: float = 0.85) -> DataFrame:
    """The notes of at least that weight, of an origin, or with a key flag, in the order of day, weight and id."""
    flags = note_flags()
    key = F.arrays_overlap(flags, F.array(*map(F.lit, ["ORIGIN", "CORE", "GENESIS"])))
    return notes.filter((F.coalesce("weight", F.lit(0.0)) >= least) | key)
