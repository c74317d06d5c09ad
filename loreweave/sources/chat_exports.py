"""Chat exports to messages. A file's content becomes an array of (role, text), read by the first format that gives two messages."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

Message = tuple[str, str]
MESSAGES = ArrayType(StructType().add("role", "string").add("text", "string"))
# The names formats give the two roles.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant"}
EVENTS = {"user_message": "user", "agent_message": "assistant"}


def as_text(content: object) -> str:
    """The text of a string, of an object's text field, or of a list of strings and text blocks."""
    if isinstance(content, list):
        blocks = (c if isinstance(c, str) else c.get("text") if isinstance(c, dict) and c.get("type") == "text" else None for c in content)
        return " ".join(b for b in blocks if isinstance(b, str)).strip()
    if isinstance(content, dict):
        content = content.get("text")
    return content.strip() if isinstance(content, str) else ""


def _objects(content: str) -> Iterator[dict]:
    for line in content.split("\n"):
        try:
            found = json.loads(line)
        except (ValueError, RecursionError):
            continue
        if isinstance(found, dict):
            yield found


def _dicts(items: object) -> list[dict]:
    return [x for x in items if isinstance(x, dict)] if isinstance(items, list) else []


def _field(x: dict, name: str) -> dict:
    return x[name] if isinstance(x.get(name), dict) else {}


def _named(x: dict, field: str, among: dict[str, str]) -> str | None:
    """What a text field stands for; null for any other value."""
    value = x.get(field)
    return among.get(value) if isinstance(value, str) else None


def typed_lines(content: str) -> list[Message]:
    """JSON lines with a type that names the role, and message.content."""
    kinds = {k: v for k, v in ROLES.items() if k != "ai"}
    return [(role, as_text(_field(o, "message").get("content"))) for o in _objects(content) if (role := _named(o, "type", kinds))]


def event_lines(content: str) -> list[Message]:
    """JSON lines of events; only a log that holds a session header counts."""
    rows = list(_objects(content))
    if all(o.get("type") != "session_meta" for o in rows):
        return []
    loads = [_field(o, "payload") for o in rows if o.get("type") == "event_msg"]
    return [(role, p["message"].strip()) for p in loads if (role := _named(p, "type", EVENTS)) and isinstance(p.get("message"), str)]


def flat(data: object) -> list[Message]:
    """A list of messages, an object that holds one, or a list of conversations that each hold one."""
    if isinstance(data, dict):
        data = data.get("messages", data.get("chat_messages"))
    items = _dicts(data)
    if items and isinstance(data, list) and data[0] is items[0] and "chat_messages" in items[0]:
        items = [m for talk in items for m in _dicts(talk.get("chat_messages"))]
    return [(role, as_text(m.get("content"))) for m in items if (role := _named(m, "role", ROLES))]


def tree(data: object) -> list[Message]:
    """A map of nodes: from the root (an empty one if there is one) along first children, each node once."""
    found = _field(data, "mapping") if isinstance(data, dict) else {}
    nodes = {k: n for k, n in found.items() if isinstance(n, dict)}
    roots = sorted((k for k, n in nodes.items() if n.get("parent") is None), key=lambda k: nodes[k].get("message") is not None)
    at, seen, out = next(iter(roots), None), set(), []
    while at in nodes and at not in seen:
        seen.add(at)
        said = _field(nodes[at], "message")
        parts = _field(said, "content").get("parts")
        words = [p for p in parts if isinstance(p, str) and p] if isinstance(parts, list) else []
        out.append((_field(said, "author").get("role"), " ".join(words).strip()))
        children = nodes[at].get("children")
        first = children[0] if isinstance(children, list) and children else None
        at = first if isinstance(first, str) else None
    return [m for m in out if m[0] in ("user", "assistant")]


def channel(data: object) -> list[Message]:
    """Messages of named speakers: the first is the user, and each new one takes the role that didn't speak last."""
    roles, last, out = {}, "assistant", []
    for item in _dicts(data):
        who, text = item.get("user", item.get("username")), as_text(item.get("text"))
        if item.get("type") == "message" and isinstance(who, str) and who and text:
            last = roles.setdefault(who, "assistant" if last == "user" else "user")
            out.append((last, text))
    return out


def _parsed(reader: Callable[[object], list[Message]]) -> Callable[[str], list[Message]]:
    def read(content: str) -> list[Message]:
        try:
            return reader(json.loads(content))
        except (ValueError, RecursionError):
            return []

    return read


#: A larger file is passed through as it is.
MOST_CHARACTERS = 500 * 1024 * 1024

#: In the order of precedence.
FORMATS = (typed_lines, event_lines, _parsed(flat), _parsed(tree), _parsed(channel))


def messages_of(content: str | None) -> list[Message] | None:
    """The messages of a chat export; None where the content is none, or is a transcript with three quoted lines already."""
    if not content or len(content) > MOST_CHARACTERS or sum(x.strip().startswith(">") for x in content.split("\n")) >= 3 or content.strip()[:1] not in ("{", "["):
        return None
    for read in FORMATS:
        found = [m for m in read(content) if m[1]]
        if len(found) >= 2:
            return found
    return None


@F.pandas_udf(MESSAGES)
def parse_messages(contents: pd.Series) -> pd.Series:
    return contents.map(lambda c: None if (m := messages_of(c)) is None else [{"role": r, "text": t} for r, t in m])


def normalise(files: DataFrame, content: str = "content") -> DataFrame:
    """files with `transcript`: chat exports as '> question', answer, blank line; everything else as it is."""
    m = F.col("_messages")
    follows = lambda i: F.when(i > 0, F.get(m, i - 1)["role"]).otherwise("")
    piece = F.transform(
        m,
        lambda x, i: F.concat(
            F.when(i == 0, "").when((x["role"] == "assistant") & (follows(i) == "user"), "\n").otherwise("\n\n"),
            F.when(x["role"] == "user", F.concat(F.lit("> "), x["text"])).otherwise(x["text"]),
        ),
    )
    told = F.concat(F.array_join(piece, ""), F.lit("\n"))
    return files.withColumn("_messages", parse_messages(F.col(content))).withColumn("transcript", F.coalesce(told, F.col(content))).drop("_messages")
