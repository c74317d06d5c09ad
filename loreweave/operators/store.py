"""Chunk tables: filters, paging, counts, merges by id, deletes, incremental skips, ids and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where(chunks: DataFrame, domain: str | None = None, topic: str | None = None) -> DataFrame:
    """Equality filters that reach the scan."""
    for name, value in (("domain", domain), ("topic", topic)):
        chunks = chunks.filter(F.col(name) == value) if value else chunks
    return chunks


def page(chunks: DataFrame, limit: int, offset: int = 0, order: str = "id") -> DataFrame:
    """Rows offset + 1 to offset + limit by order."""
    return chunks.orderBy(order).offset(offset).limit(limit)


def taxonomy(chunks: DataFrame) -> DataFrame:
    """domain, topic, n."""
    return chunks.groupBy("domain", "topic").agg(F.count("*").alias("n"))


def latest(new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """One row for each key of new: that of the greatest `order`, or of the greatest row where there is none or a tie."""
    rest = [c for c in new.columns if c != key and c != order]
    best = F.max(F.struct(*([order] if order else []), *rest)).alias("best")
    return new.groupBy(key).agg(best).select(key, "best.*").select(new.columns)


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """old with the rows of new, which replace those of equal key; a key that new repeats gives one row, as latest() says."""
    new = latest(new, key, order)
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """old with those rows of new whose key it lacks, one a key."""
    return old.unionByName(latest(new.join(old.select(key), key, "left_anti"), key, order))


def add_outcome(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """For each key of new whether insert_missing() adds it: key, outcome ('added' or 'already_exists')."""
    known = old.select(key, F.lit(True).alias("known")).distinct()
    status = F.when(F.col("known"), "already_exists").otherwise("added")
    return new.select(key).distinct().join(known, key, "left").select(key, status.alias("outcome"))


def by_ids(chunks: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is among ids."""
    return chunks.join(ids.select(key), key, "left_semi")


def replace_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with all chunks of new's files in the place of those it had of them, so that no stale chunk stays."""
    return old.join(new.select("source_file").distinct(), "source_file", "left_anti").unionByName(new)


def stale_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of old whose file is in new with fewer chunks: those that an upsert by (file, index) would leave behind."""
    last = new.groupBy("source_file").agg(F.max("chunk_index").alias("last_index"))
    return old.join(last, "source_file").filter(F.col("chunk_index") > F.col("last_index")).select(old.columns)


def audit_rows(operation: str, rows: DataFrame, id_col: str, text: str, most: int = 200) -> DataFrame:
    """What an audit log gets before a write: operation, target, content_length and a preview of the content."""
    body = F.coalesce(F.col(text), F.lit(""))
    return rows.select(F.lit(operation).alias("operation"), F.col(id_col).alias("target"), F.length(body).cast("long").alias("content_length"), F.substring(body, 1, most).alias("content_preview"))


def append_audit(entries: DataFrame, path: str) -> None:
    """Append entries with their time to a log of JSON lines."""
    entries.withColumn("timestamp", F.current_timestamp()).write.mode("append").json(path)


def diary_rows(entries: DataFrame) -> DataFrame:
    """Chunks of entries(agent, entry, topic, filed_at timestamp): a domain an agent, and an id of time and content."""
    domain = F.concat(F.lit("agent_"), F.replace(F.lower("agent"), F.lit(" "), F.lit("_")))
    tail = F.substring(F.sha2(F.substring("entry", 1, 50), 256), 1, 12)
    return entries.select(
        F.concat_ws("_", F.lit("diary"), domain, F.date_format("filed_at", "yyyyMMdd_HHmmss"), tail).alias("id"), F.col("entry").alias("document"), domain.alias("domain"),
        F.lit("diary").alias("topic"), F.lit("diary").alias("facet"), F.col("topic").alias("subject"), "agent", "filed_at", F.date_format("filed_at", "yyyy-MM-dd").alias("date"),
    )


def diary(chunks: DataFrame, agent: str, last: int = 10) -> DataFrame:
    """The newest diary entries of an agent."""
    own = where(chunks, "agent_" + agent.lower().replace(" ", "_"), "diary")
    return own.orderBy(F.desc("filed_at"), "id").limit(last)


def delete(old: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """old without the given keys."""
    return old.join(keys.select(key), key, "left_anti")


def changed_files(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of listing(source_file, mtime) that stored doesn't hold with the same mtime."""
    return listing.join(stored.groupBy("source_file").agg(F.max("mtime").alias("mtime")), ["source_file", "mtime"], "left_anti")


def chunk_id(source_file: Column, chunk_index: Column) -> Column:
    """24 hex digits of the SHA-256 of file and index."""
    return F.substring(F.sha2(F.concat(source_file, chunk_index.cast("string")), 256), 1, 24)


def snippet(text: Column, most: int = 200) -> Column:
    """One line of at most `most` characters, cut with three dots."""
    line = F.replace(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


def content_id(domain: Column, topic: Column, content: Column) -> Column:
    """The id of a chunk that was added by hand: domain, topic and the first 100 characters name it."""
    return F.concat_ws("_", F.lit("chunk"), domain, topic, F.substring(F.sha2(F.concat(domain, topic, F.substring(content, 1, 100)), 256), 1, 24))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def valid_name(name: Column) -> Column:
    """Non-empty, at most 128 characters, no '..', separators or NUL, of safe characters."""
    safe = name.rlike(r"^[A-Za-z0-9][A-Za-z0-9_ .'-]*$") & ~name.contains("..")
    return F.coalesce(safe & (F.length(name) <= 128), F.lit(False))


def valid_content(text: Column, most: int = 100_000) -> Column:
    """Not blank, at most `most` characters, no NUL."""
    return F.coalesce((F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) > 0) & (F.length(text) <= most) & ~text.contains("\x00"), F.lit(False))


def within_budget(rows: DataFrame, group: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """The leading rows of each group whose running cost stays within the budget, up to the first that doesn't fit."""
    run = F.sum(cost).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running_cost", run).filter(F.col("running_cost") <= budget)


def importance(*weights: Column) -> Column:
    """The first present weight as a number; 3 where none is present or it isn't a number."""
    return F.coalesce(F.coalesce(*[w.cast("string") for w in weights]).try_cast("double"), F.lit(3.0))


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def projected(hits: DataFrame) -> DataFrame:
    """Search hits as a caller sees them: text, domain, topic, source_file (its name), similarity."""
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    source = F.coalesce(basename(F.nullif(F.col("source_file"), F.lit(""))), F.lit("?"))
    return hits.select("rank", F.col("document").alias("text"), known("domain").alias("domain"), known("topic").alias("topic"), source.alias("source_file"), F.round("similarity", 3).alias("similarity"))
