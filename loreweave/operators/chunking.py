"""Texts to chunks. Each function turns a text column into an array of chunks, so a row is cut where it lies, without a shuffle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.text import bound

BLANK = r"[ \t\r\f\x0B]*"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def longer(parts: Column, least: int) -> Column:
    """The parts of more than `least` characters."""
    return F.filter(parts, lambda p: F.length(p) > least)


def line_groups(text: Column, size: int = 25) -> Column:
    """Groups of so many lines, stripped."""
    starts = lambda rows: F.sequence(F.lit(1), F.size(rows), F.lit(size))
    return bound(lines(text), lambda rows: F.transform(starts(rows), lambda i: strip(F.array_join(F.slice(rows, i, F.lit(size)), "\n"))))


def paragraphs(text: Column, least: int = 30) -> Column:
    """Parts between blank lines; a text of one part and over 20 newlines is cut into groups of 25 lines."""
    parts = F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda p: p != "")
    flat = (F.size(parts) <= 1) & (F.size(lines(text)) > 21)
    return longer(F.when(flat, line_groups(text)).otherwise(parts), least)


def exchanges(text: Column, least: int = 30, answer_lines: int = 8) -> Column:
    """Each quoted line with the first lines of its answer, up to the next quote or rule; paragraphs where fewer than three lines are quoted."""
    blocks = F.split(text, rf"\n(?={BLANK}(?:>|---))", -1)

    def chunk(block: Column) -> Column:
        kept = F.filter(F.transform(lines(block), strip), lambda t: t != "")
        answer = F.array_join(F.slice(kept, 2, answer_lines), " ")
        return F.concat_ws("\n", F.element_at(kept, 1), F.when(answer != "", answer))

    quoted = F.filter(blocks, lambda b: strip(b).startswith(">"))
    own = longer(F.transform(quoted, chunk), least)
    return F.when(F.size(quoted) >= 3, own).otherwise(paragraphs(text, least))


def segments(text: Column, speakers: tuple[str, ...] = ("Human", "User", "Q", "Assistant", "AI", "A")) -> Column:
    """Speaker turns where three lines or more begin one; else paragraphs, else groups of 25 lines."""
    turn = rf"{BLANK}(?:>\s|(?i:{'|'.join(speakers)})\s*:)"
    turns = F.split(text, rf"\n(?={turn})", -1)
    parts = F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda p: p != "")
    flat = F.filter(line_groups(text), lambda g: g != "")
    rest = F.when((F.size(parts) <= 1) & (F.size(lines(text)) > 20), flat).otherwise(parts)
    return F.when(F.regexp_count(text, F.lit(rf"(?m)^{turn}")) >= 3, turns).otherwise(rest)


def windows(size: int = 800, overlap: int = 100, least: int = 50):
    """A function of a text column: windows of `size` characters that end at a paragraph or line break in their second half if there is one.

    The next window begins `overlap` characters before the end of the last, so each start depends on the cut before it: an Arrow batch at a time.
    """

    def cut(text: str | None) -> list[str]:
        body, at, out = (text or "").strip(), 0, []
        while at < len(body):
            end = at + size
            if end < len(body):
                breaks = (body.rfind(mark, at, end) for mark in ("\n\n", "\n"))
                end = next((b for b in breaks if b > at + size // 2), end)
            piece = body[at:end].strip()
            if len(piece) >= least:
                out.append(piece)
            at = end - overlap if end < len(body) else end
        return out

    @F.pandas_udf("array<string>")
    def cut_all(texts: pd.Series) -> pd.Series:
        return texts.map(cut)

    return cut_all


def chunk_rows(docs: DataFrame, chunks: Column, key: str = "id") -> DataFrame:
    """key, chunk_index (from 0, of the kept chunks), content."""
    return docs.select(key, F.posexplode(chunks).alias("chunk_index", "content"))
