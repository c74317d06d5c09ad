"""Transcripts of several sessions to one row a session. A file is one row and its lines an array, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.text import bound
from loreweave.operators.chunking import lines

# Month names, and how a time line of a transcript begins.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
TIME_LINE = r"⏺\s+(\d{1,2}:\d{2}\s+[AP]M)\s+\w+,\s+(\w+)\s+(\d{1,2}),\s+(\d{4})"


def session_starts(text: Column, header: str, restored: list[str], near: int = 6) -> Column:
    """Places (from 0) of the lines with the header that no mark of a restored session follows within `near` lines, itself included."""
    marked = lambda x: F.coalesce(*[F.when(x.contains(m), True) for m in restored], F.lit(False))

    def starts(rows: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: F.get(rows, i).contains(header) & ~F.exists(F.slice(rows, i + 1, F.lit(near)), marked))

    return bound(lines(text), starts)


def sessions(files: DataFrame, header: str, restored: list[str], least_starts: int = 2, least_lines: int = 10) -> DataFrame:
    """path, session (from 1), first_line, n_lines, content of files(path, content) that hold two sessions or more; short pieces are left out but counted.

    What comes before the first header belongs to no session.
    """
    found = files.filter(F.col("content").isNotNull()).select("path", lines(F.col("content")).alias("rows"), session_starts(F.col("content"), header, restored).alias("starts"))
    found = found.filter(F.size("starts") >= least_starts)
    piece = lambda s, k: F.struct(
        (k + 1).alias("session"), s.alias("first_line"), (F.coalesce(F.get("starts", k + 1), F.size("rows")) - s).alias("n_lines")
    )
    pieces = found.select("path", "rows", F.explode(F.transform("starts", piece)).alias("s")).select("path", "rows", "s.*").filter(F.col("n_lines") >= least_lines)
    return pieces.select("path", "session", "first_line", "n_lines", F.array_join(F.slice("rows", F.col("first_line") + 1, F.col("n_lines")), "\n").alias("content"))


def time_of(content: Column, first: int = 50) -> Column:
    """struct(day, stamp) of the first time line among the first lines: an ISO date, and that with the time of day; null where there is none."""
    line = F.get(F.filter(F.slice(lines(content), 1, first), lambda x: x.rlike(TIME_LINE)), F.lit(0))
    part = lambda i: F.regexp_extract(line, TIME_LINE, i)
    month = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), part(2)), F.lit(0)), F.lit(0))
    day = F.concat_ws("-", part(4), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(line.isNotNull(), F.struct(day.alias("day"), F.concat(day, F.lit("_"), F.regexp_replace(part(1), r"[:\s]", "")).alias("stamp")))


def people_in(content: Column, names: list[str], users: dict[str, str] | None = None, first: int = 100) -> Column:
    """The sorted known names that occur as whole words, in any case, in the first lines, and the name of the user whose home folder does."""
    text = F.array_join(F.slice(lines(content), 1, first), "\n")
    found = [F.when(text.rlike(rf"(?i)\b\Q{n}\E\b"), F.lit(n)) for n in names]
    home = F.regexp_extract(text, r"/Users/(\w+)/", 1)
    found += [F.when(home == u, F.lit(n)) for u, n in (users or {}).items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))) if found else F.array().cast("array<string>")


def subject_of(content: Column, commands: str = r"^(\./|cd |ls |python|bash|git |cat |source |export )", most: int = 60) -> Column:
    """A slug of the first quoted line of more than five characters that is no shell command; 'session' where there is none."""
    said = F.transform(F.filter(lines(content), lambda x: x.startswith("> ")), lambda x: F.regexp_replace(F.substring(x, F.lit(3), F.length(x)), r"^\s+|\s+$", ""))
    first = F.get(F.filter(said, lambda x: (F.length(x) > 5) & ~x.rlike(commands)), F.lit(0))
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(first, r"(?U)[^\w\s-]", ""), r"^\s+|\s+$", ""), r"\s+", "-")
    return F.coalesce(F.substring(slug, 1, most), F.lit("session"))


def file_name(rows: DataFrame, names: list[str]) -> Column:
    """The name of a session's file: source, time or number, up to three people, subject."""
    source = F.substring(F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", ""), r"(?U)[^\w-]", "_"), 1, 40)
    time = F.coalesce(time_of(F.col("content"))["stamp"], F.concat(F.lit("part"), F.lpad(F.col("session").cast("string"), 2, "0")))
    people = F.slice(people_in(F.col("content"), names), 1, 3)
    who = F.when(F.size(people) > 0, F.array_join(people, "-")).otherwise(F.lit("unknown"))
    name = F.concat(source, F.lit("__"), time, F.lit("_"), who, F.lit("_"), subject_of(F.col("content")), F.lit(".txt"))
    return F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w.\-]", "_"), "_+", "_")


def write_sessions(files: DataFrame, folder: str, header: str, restored: list[str], names: list[str]) -> DataFrame:
    """Write every session below its own folder session_file=<name>; the sources stay as they are. Returns what was written."""
    rows = sessions(files, header, restored)
    rows = rows.withColumn("session_file", file_name(rows, names))
    rows.select("content", "session_file").write.mode("overwrite").partitionBy("session_file").option("lineSep", "\n").text(folder)
    return rows.select("path", "session", "session_file", "n_lines")
