"""Spelling of user turns by a table of corrections; what isn't a plain lower-case word stays as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.text import bound
from loreweave.functions.text import words as words_of

# What marks a token as no plain word.
TECHNICAL = [r"\d", r"[A-Z][a-z]+[A-Z]", r"^[A-Z_@#$%^&*()+=\[\]{}|<>?.:/\\]+$", r"[-_]", r"(?i)https?://|www\.|/Users/|~/|\.[a-z]{2,4}$", r"[`*_#{}\[\]\\]"]
PUNCTUATION = r"""[.,!?;:'")]"""


def left_alone(token: Column, known: list[str] | None = None, least: int = 4) -> Column:
    """A token that is short, technical, or a known name."""
    odd = F.coalesce(*[F.when(token.rlike(p), True) for p in TECHNICAL], F.lit(False))
    return (F.length(token) < least) | odd | F.lower(token).isin(known or [""])


def bare(token: Column) -> Column:
    """A token without the punctuation at its end."""
    return F.regexp_replace(token, PUNCTUATION + r"+$", "")


def ending(token: Column) -> Column:
    """The punctuation at the end of a token."""
    return F.substring(token, F.length(bare(token)) + 1, F.length(token))


def close_enough(word: Column, corrected: Column) -> Column:
    """At most 2 edits for up to 7 letters, 3 for more."""
    return F.levenshtein(word, corrected) <= F.when(F.length(word) <= 7, 2).otherwise(3)


def corrected(texts: DataFrame, corrections: DataFrame, dictionary: DataFrame, known: list[str] | None = None, key: str = "id", text: str = "text") -> DataFrame:
    """key, text with the words of corrections(word, correction) put right; white space stays, and so do words of dictionary(word).

    The distinct words of a text are joined, and only those found go back to it: texts are moved once, and those without any stay as they are.
    """
    pieces = lambda c: F.regexp_extract_all(c, F.lit(r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"), 0)
    usable = corrections.join(dictionary.select(F.lower("word").alias("word")).distinct(), "word", "left_anti").filter(close_enough(F.col("word"), F.col("correction")))
    usable = usable.groupBy("word").agg(F.min("correction").alias("correction"))
    usable = usable.filter(~left_alone(F.col("word"), known) & ~F.substring("word", 1, 1).rlike(r"\p{Lu}"))
    body = F.coalesce(F.col(text), F.lit(""))
    words = texts.select(key, F.explode(F.array_distinct(F.transform(words_of(body), bare))).alias("word"))
    fixes = words.join(usable, "word").groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("word", "correction"))).alias("fixes"))

    def put_right(piece: Column) -> Column:
        return bound(bare(piece), lambda word: bound(F.element_at("fixes", word), lambda c: F.when(c.isNotNull(), F.concat(c, F.substring(piece, F.length(word) + 1, F.length(piece)))).otherwise(piece)))

    whole = F.when(F.col("fixes").isNull(), F.col("body")).otherwise(F.array_join(F.transform(pieces(F.col("body")), put_right), ""))
    return texts.select(key, body.alias("body")).join(fixes, key, "left").select(key, whole.alias(text))


def corrected_transcripts(transcripts: DataFrame, corrections: DataFrame, dictionary: DataFrame, known: list[str] | None = None, key: str = "id", text: str = "transcript") -> DataFrame:
    """key, text: transcripts of which only the quoted lines, the user's, are put right."""
    lines = transcripts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))
    said = F.ltrim(F.col("line")).startswith(">")
    lines = lines.withColumn("head", F.when(said, F.regexp_extract("line", r"^\s*>.?", 0)).otherwise("")).withColumn("row", F.struct(key, "line_no"))
    user = lines.filter(said).select("row", F.substring("line", F.length("head") + 1, F.length("line")).alias("text"))
    fixed = corrected(user, corrections, dictionary, known, "row", "text").withColumnRenamed("text", "fixed")
    rows = lines.join(fixed, "row", "left").withColumn("line", F.when(F.col("fixed").isNotNull(), F.concat("head", "fixed")).otherwise(F.col("line")))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(text))
