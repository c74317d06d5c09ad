"""Conversations: transcripts, look-ahead, sessions and save triggers, over (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transcript(messages: DataFrame) -> DataFrame:
    """conv_id, transcript: user turns led by '> ', the answer that follows at once in the same block, blocks apart by a blank line."""
    turns = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag("role").over(turns)
    line = F.when(F.col("role") == "user", F.concat(F.lit("> "), F.col("text"))).otherwise(F.col("text"))
    joins = F.when((F.col("role") == "assistant") & (before == "user"), F.lit("\n")).otherwise(F.lit("\n\n"))
    piece = F.when(before.isNull(), line).otherwise(F.concat(joins, line))
    rows = messages.withColumn("piece", piece)
    ordered = F.array_sort(F.collect_list(F.struct("turn", "piece")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("transcript"))


def user_document(messages: DataFrame) -> DataFrame:
    """conv_id, document: the user's turns in order, a line each."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text"))))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("document"))


def next_role(messages: DataFrame) -> DataFrame:
    return messages.withColumn("next_role", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")))


def save_points(messages: DataFrame, every: int = 15, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The user messages at which a session's count reaches a multiple of `every`."""
    human = messages.filter("role = 'user'")
    return human.withColumn("n_human", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("n_human") % every == 0)


def full_document(messages: DataFrame) -> DataFrame:
    """conv_id, document: all turns in order, a line each."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("document"))


def turn_documents(messages: DataFrame) -> DataFrame:
    """id, document: each user turn by itself, with an id of its session and place among the user's turns."""
    human = messages.filter("role = 'user'")
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return human.select(F.concat(F.col("conv_id").cast("string"), F.lit("_turn_"), nth.cast("string")).alias("id"), F.col("text").alias("document"))


def said(speaker: Column, text: Column) -> Column:
    """A turn as 'speaker said, "text"'."""
    return F.concat(F.coalesce(speaker, F.lit("?")), F.lit(' said, "'), F.coalesce(text, F.lit("")), F.lit('"'))


def said_document(messages: DataFrame) -> DataFrame:
    """conv_id, document: every turn as said(), in order, a line each."""
    return full_document(messages.withColumn("text", said(F.col("role"), F.col("text"))))


def turn_text(user: Column, assistant: Column, time: Column | None = None) -> Column:
    """Question and answer in one line, led by the time where there is one."""
    text = F.concat(F.lit("[User] "), F.coalesce(user, F.lit("")), F.lit(" [Assistant] "), F.coalesce(assistant, F.lit("")))
    return text if time is None else F.when(F.coalesce(time, F.lit("")) != "", F.concat(F.lit("["), time, F.lit("] "), text)).otherwise(text)


def mentions(messages: DataFrame, patterns: list[str], most: int = 12, shortest: int = 5, longest: int = 80) -> DataFrame:
    """conv_id, document: 'User has mentioned: a; b' of what the first group of the patterns finds in the lower-cased user turns.

    Turn by turn and pattern by pattern, each only once; sessions without any are left out.
    """
    low = F.lower("text")
    clean = lambda m: F.regexp_replace(F.regexp_replace(m, r"^\s+|\s+$", ""), r"[.,;!? ]+$", "")
    found = F.transform(F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), 1) for p in patterns])), clean)
    kept = F.filter(found, lambda m: F.length(m).between(shortest, longest))
    ordered = F.array_sort(F.collect_list(F.struct("turn", kept.alias("found"))))
    rows = messages.filter("role = 'user'").groupBy("conv_id").agg(F.slice(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["found"]))), 1, most).alias("found"))
    return rows.filter(F.size("found") > 0).select("conv_id", F.concat(F.lit("User has mentioned: "), F.array_join("found", "; ")).alias("document"))


def human_messages(messages: DataFrame, command: str = "<command-message>") -> DataFrame:
    """conv_id, n: the user's messages that are no commands."""
    human = (F.col("role") == "user") & ~F.coalesce(F.col("text"), F.lit("")).contains(command)
    return messages.groupBy("conv_id").agg(F.count_if(human).alias("n"))
