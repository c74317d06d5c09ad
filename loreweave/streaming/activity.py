"""Event-time operators that run alike on tables and on streams of (event_id, user_id, event_type, ts, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need timestamps with a time zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """event_type, window_start, n, total of tumbling windows; rows later than the watermark are left out of streams."""
    seen = _watermarked(events, late) if events.isStreaming else events
    out = seen.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("w.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, session_start, n of runs of events less than the gap apart."""
    seen = _watermarked(events, late) if events.isStreaming else events
    out = seen.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event_id once; in a stream the state kept is bounded by the watermark."""
    if events.isStreaming:
        return _watermarked(events, late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def save_triggers(messages: DataFrame, every: int = 15) -> DataFrame:
    """session_id, n_human at each check at which `every` or more human messages came since the last save.

    messages(session_id, role) is a stream; a micro-batch is one check. The state of a session is its count and the count at its last save.
    """

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, saved = state.get if state.exists else (0, 0)
        count += sum(int((f["role"] == "user").sum()) for f in frames)
        due = count - saved >= every
        state.update((count, count if due else saved))
        if due:
            yield pd.DataFrame({"session_id": [key[0]], "n_human": [count]})

    return messages.groupBy("session_id").applyInPandasWithState(
        check, "session_id string, n_human long", "count long, saved long", "append", GroupStateTimeout.NoTimeout
    )
