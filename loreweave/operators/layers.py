"""Layered views of a store: an identity text, an essential story, filtered recall and deep search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.operators import embed, store

TITLE, MORE = "## ESSENTIAL STORY", "  ... (more by search)"


def identity(lines: DataFrame) -> DataFrame:
    """text: the lines(at, line) of an identity file in order, stripped, or a hint that there is none."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "line")))
    text = F.regexp_replace(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    return lines.agg(F.when(F.count("*") > 0, text).otherwise(F.lit("## IDENTITY\nNo identity configured.")).alias("text"))


def story_lines(chunks: DataFrame, most: int = 15, budget: int = 3200) -> DataFrame:
    """at, topic, line: the `most` weightiest chunks(id, document, topic, source_file, weight), by topic, within a budget of characters.

    The budget counts a topic's head line (with the line break before it) and each entry; what follows the first entry that
    doesn't fit is left out, and one last line says so. Only `most` rows reach the windows.
    """
    top = chunks.withColumn("weight", store.importance(F.col("weight"))).orderBy(F.desc("weight"), "id").limit(most)
    topic = F.coalesce("topic", F.lit("general"))
    source = F.nullif(F.coalesce("source_file", F.lit("")), F.lit(""))
    entry = F.concat(F.lit("  - "), store.snippet(F.col("document")), F.when(source.isNotNull(), F.concat(F.lit("  ("), store.basename(source), F.lit(")"))).otherwise(F.lit("")))
    rows = top.select(topic.alias("topic"), "weight", "id", entry.alias("line"))
    first = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "id"))
    rows = rows.withColumn("head", F.when(first == 1, F.length("topic") + 3).otherwise(0))
    order = Window.orderBy("topic", F.desc("weight"), "id")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("used", F.sum(F.col("head") + F.length("line")).over(order))
    rows = rows.withColumn("full", F.max((F.col("used") > budget).cast("int")).over(order))
    heads = rows.filter("head > 0").withColumn("before", F.coalesce(F.col("full"), F.lit(0)))
    # a topic's head is written before it shows that its first entry doesn't fit
    shown = heads.withColumn("earlier", F.lag("full", 1, 0).over(Window.orderBy("at"))).join(rows.agg(F.min(F.when(F.col("full") == 1, F.col("at"))).alias("stop")))
    shown = shown.filter(F.col("stop").isNull() | (F.col("at") <= F.col("stop")))
    head_rows = shown.select((F.col("at") * 2 - 1).alias("at"), "topic", F.concat(F.lit("\n["), F.col("topic"), F.lit("]")).alias("line"))
    body = rows.filter("full = 0").select((F.col("at") * 2).alias("at"), "topic", "line")
    cut = rows.filter("full = 1").agg(F.min("at").alias("at")).filter("at is not null").select((F.col("at") * 2).alias("at"), F.lit("").alias("topic"), F.lit(MORE).alias("line"))
    return head_rows.unionByName(body).unionByName(cut)


def story(chunks: DataFrame, most: int = 15, budget: int = 3200) -> DataFrame:
    """text: the essential story as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "line")))
    body = F.array_join(F.concat(F.array(F.lit(TITLE)), F.transform(ordered, lambda x: x["line"])), "\n")
    return story_lines(chunks, most, budget).agg(F.when(F.count("*") > 0, body).otherwise(F.lit(f"{TITLE}\nNothing stored yet.")).alias("text"))


def recall(chunks: DataFrame, domain: str | None = None, topic: str | None = None, limit: int = 10) -> DataFrame:
    """id, line of the first chunks by id of a domain and a topic."""
    source = F.nullif(F.coalesce("source_file", F.lit("")), F.lit(""))
    line = F.concat(F.lit("  ["), F.coalesce("topic", F.lit("?")), F.lit("] "), store.snippet(F.col("document"), 300), F.when(source.isNotNull(), F.concat(F.lit("  ("), store.basename(source), F.lit(")"))).otherwise(F.lit("")))
    return store.where(chunks, domain, topic).select("id", line.alias("line")).orderBy("id").limit(limit)


def search(chunks: DataFrame, query: str, domain: str | None = None, topic: str | None = None, limit: int = 5, embedder=embed.hashed) -> DataFrame:
    """rank, text, domain, topic, source_file, similarity of the chunks nearest to a text; filters go before ranking."""
    found = embed.nearest(store.where(chunks, domain, topic), query, limit, embedder)
    return store.projected(found)


def search_lines(chunks: DataFrame, query: str, domain: str | None = None, topic: str | None = None, limit: int = 5) -> DataFrame:
    """rank, lines: the hits of search() as text."""
    head = F.format_string("  [%d] %s/%s (sim=%s)", "rank", "domain", "topic", F.col("similarity").cast("string"))
    return search(chunks, query, domain, topic, limit).select("rank", F.concat_ws("\n", head, F.concat(F.lit("      "), store.snippet(F.col("text"), 300)), F.concat(F.lit("      src: "), F.col("source_file"))).alias("lines"))


class Stack:
    """The layers over one store of chunks(id, document, domain, topic, source_file, weight)."""

    def __init__(self, chunks: DataFrame, identity_lines: DataFrame) -> None:
        self.chunks, self.identity_lines = chunks, identity_lines

    def wake_up(self, domain: str | None = None) -> str:
        """The identity and the essential story, of one domain if it is given; the filter holds for this call alone."""
        return identity(self.identity_lines).first()["text"] + "\n\n" + story(store.where(self.chunks, domain)).first()["text"]

    def recall(self, domain: str | None = None, topic: str | None = None, limit: int = 10) -> DataFrame:
        return recall(self.chunks, domain, topic, limit)

    def search(self, query: str, domain: str | None = None, topic: str | None = None, limit: int = 5) -> DataFrame:
        return search(self.chunks, query, domain, topic, limit)

    def status(self) -> dict:
        text = identity(self.identity_lines).first()["text"]
        return {"identity_tokens": len(text) // 4, "chunks": self.chunks.count()}
