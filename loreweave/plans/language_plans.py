"""Registered queries on files, transcripts of several sessions, chat exports, names, spelling, memories and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.operators import chunking, classify, digest, entities, files, spelling, splitting
from loreweave.plans.text_plans import DOCS, KEY_SENTENCE, STRIP, TOPICS, docs
from loreweave.runtime import table
from loreweave.sources import chat_exports

MSG = "conversations"


# Files: the documents as the files of a project, with ignore rules at its root and in one folder.
FOLDERS = ["app", "node_modules", "notes", "Backend Api", "build-x.egg-info", "keep"]
SUFFIXES = [".md", ".py", ".bin", ".TXT", ".log"]
IGNORE = [("", "# rules\n*.py\n!main*.py\n/notes/src1/\n"), ("keep", "*\n!*.md\n")]


def project(s, d):
    i = F.col("doc_id")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (i % n + 1).cast("int"))
    name = F.concat(F.when(i % 3 == 0, "main").otherwise("part"), i.cast("string"), pick(SUFFIXES, 5))
    return table(s, d, "documents").select(F.concat_ws("/", pick(FOLDERS, 6), "source", name).alias("path"), F.when(i % 97 == 0, 20_000_000).otherwise(F.length("text")).cast("long").alias("length"), F.col("text").alias("content"))


PROJECT = f"""SELECT ({FOLDERS})[doc_id % 6 + 1] || '/' || source || '/' || CASE WHEN doc_id % 3 = 0 THEN 'main' ELSE 'part' END || doc_id || ({SUFFIXES})[doc_id % 5 + 1] AS path,
 CASE WHEN doc_id % 97 = 0 THEN 20000000 ELSE length(text) END AS length, text AS content FROM documents"""


def rules(s):
    return files.rule_table(s.createDataFrame([(f"{b}/.gitignore" if b else ".gitignore", t) for b, t in IGNORE], "path string, content string"))


ROOMS = [("billing", ["invoice"]), ("backend", ["api", "the"]), ("src11", ["eau", "onthe"])]
KNOWN_ROOMS = {"app": "frontend", "notes": "documentation", "main": "core", "part": "pieces"}
_route = """CASE WHEN (contains(folder, 'billing') OR contains('billing', folder) OR contains(folder, 'invoice') OR contains('invoice', folder)) THEN 'billing' WHEN (contains(folder, 'backend') OR contains('backend', folder) OR contains(folder, 'api') OR contains('api', folder) OR contains(folder, 'the') OR contains('the', folder)) THEN 'backend'
 WHEN (contains(folder, 'src11') OR contains('src11', folder) OR contains(folder, 'eau') OR contains('eau', folder) OR contains(folder, 'onthe') OR contains('onthe', folder)) THEN 'src11' END"""
_times = lambda w: f"CAST((length(t) - length(replace(t, '{w}', ''))) / {len(w)} AS BIGINT)"
ROUTED = f"""WITH p AS (SELECT path, lower(path) AS low, lower(substr(content, 1, 2000)) AS t FROM ({PROJECT})), f AS (SELECT *, split_part(low, '/', 1) AS f1, split_part(low, '/', 2) AS f2, regexp_replace(split_part(low, '/', 3), '\\.[^.]*$', '') AS name,
 {_times('invoice')} + {_times('billing')} AS a, {_times('api')} + {_times('the')} + {_times('backend')} AS b, {_times('eau')} + {_times('onthe')} + {_times('src11')} AS c FROM p)
SELECT path, coalesce({_route.replace('folder', 'f1')}, {_route.replace('folder', 'f2')}, CASE WHEN contains(name, 'billing') OR contains('billing', name) THEN 'billing' WHEN contains(name, 'backend') OR contains('backend', name) THEN 'backend' WHEN contains(name, 'src11') OR contains('src11', name) THEN 'src11' END,
 CASE WHEN greatest(a, b, c) = 0 THEN 'general' WHEN a >= greatest(b, c) THEN 'billing' WHEN b >= c THEN 'backend' ELSE 'src11' END) AS room FROM f"""


# Transcripts of several sessions: a line with `The ` begins one, unless a mark follows.
HEADER, RESTORED = "The ", ["ingen", "onthe"]


def mega(s, d):
    return docs(s, d).select(F.col("id").cast("string").alias("path"), F.col("document").alias("content"))


SESSIONS = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
m AS (SELECT *, contains(line, 'The ') AND NOT bool_or(contains(line, 'ingen') OR contains(line, 'onthe')) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS start FROM l),
g AS (SELECT *, sum(CAST(start AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS session, sum(CAST(start AS INTEGER)) OVER (PARTITION BY doc_id) AS n FROM m)
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(session AS INTEGER) AS session, CAST(min(pos) AS INTEGER) AS first_line, CAST(count(*) AS INTEGER) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS content FROM g WHERE n >= 2 AND session > 0 GROUP BY doc_id, session HAVING count(*) >= 3"""


def timed(s, d):
    """Orders as transcripts with a time line of their own date."""
    o = F.col("o_orderdate")
    line = F.concat(F.lit("⏺ 3:"), F.date_format(o, "mm"), F.lit(" PM Monday, "), F.date_format(o, "MMMM"), F.lit(" "), F.dayofmonth(o).cast("string"), F.lit(", "), F.date_format(o, "yyyy"))
    body = F.concat_ws("\n", F.lit("head of "), F.when(F.col("o_orderkey") % 4 != 0, line), F.concat(F.lit("> cd x"), F.col("o_orderkey")), F.concat(F.lit("> Tell  me of: order #"), F.col("o_orderkey"), F.lit("!")), F.lit("seen by anna and BEN"), F.lit("/Users/jd/work"))
    return table(s, d, "orders").select("o_orderkey", body.alias("content"))


TIMED = """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d_3%MPM') END AS stamp,
 'Anna,Ben,Jo' AS people, 'Tell-me-of-order-' || o_orderkey AS subject FROM orders"""


# Chat exports made of the conversations, and what the transcripts of their messages are.
def exports(s, d, kind: str):
    m = table(s, d, MSG)
    text = F.col("text")
    made = {
        "flat": F.struct("role", text.alias("content")),
        "typed": F.struct(F.col("role").alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content")).alias("message")),
        "events": F.struct(F.lit("event_msg").alias("type"), F.struct(F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "agent_message").otherwise("note").alias("type"), text.alias("message")).alias("payload")),
        "channel": F.struct(F.lit("message").alias("type"), F.col("role").alias("user"), text.alias("text")),
        "tree": F.struct(F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent"), F.array((F.col("turn") + 1).cast("string")).alias("children"), F.struct(F.struct("role").alias("author"), F.struct(F.array(text).alias("parts")).alias("content")).alias("message")),
    }[kind]
    rows = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.to_json(made).alias("j")))).alias("rows"), F.array_sort(F.collect_list("turn")).alias("turns"))
    parts = F.transform("rows", lambda x: x["j"])
    whole = {
        "flat": F.concat(F.lit('{"messages": ['), F.array_join(parts, ", "), F.lit("]}")), "typed": F.array_join(F.concat(parts, F.array(F.lit("broken"))), "\n"),
        "events": F.concat(F.lit('{"type": "session_meta"}\n'), F.array_join(parts, "\n")), "channel": F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")),
        "tree": F.concat(F.lit('{"mapping": {"bad": 7, '), F.array_join(F.transform("rows", lambda x: F.concat(F.lit('"'), x["turn"].cast("string"), F.lit('": '), x["j"])), ", "), F.lit("}}")),
    }[kind]
    return chat_exports.normalise(rows.select("conv_id", whole.alias("content"))).filter(F.col("transcript") != F.col("content")).select("conv_id", "transcript")


def exports_sql(roles: str, source: str = "conversations") -> str:
    return f"""WITH r AS (SELECT conv_id, turn, {roles} AS role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM {source}), k AS (SELECT * FROM r WHERE role IN ('user', 'assistant') AND text <> ''),
b AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b, count(*) OVER (PARTITION BY conv_id) AS n FROM k)
SELECT conv_id, string_agg(CASE WHEN b IS NULL THEN '' WHEN role = 'assistant' AND b = 'user' THEN chr(10) ELSE chr(10) || chr(10) END || CASE WHEN role = 'user' THEN '> ' || text ELSE text END, '' ORDER BY turn) || chr(10) AS transcript FROM b WHERE n >= 2 GROUP BY conv_id"""


EXPORTED = exports_sql("role")
#: The first speaker is the user, the second the assistant, and a third takes the role that didn't speak last.
CHANNEL = exports_sql(
    "CASE dense WHEN 1 THEN 'user' WHEN 2 THEN 'assistant' ELSE CASE WHEN before = first THEN 'assistant' ELSE 'user' END END",
    """(SELECT c.*, f.dense, f.first, first_value(prev) OVER (PARTITION BY c.conv_id, c.role ORDER BY turn) AS before FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) c
 JOIN (SELECT conv_id, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS dense, first_value(role) OVER (PARTITION BY conv_id ORDER BY min(turn)) AS first FROM conversations GROUP BY conv_id, role) f ON f.conv_id = c.conv_id AND f.role = c.role)""",
)

# Names: English documents, with words that occur as the words around names.
SIGNALS = entities.Signals(dialogue=(r"(?m)^NAME\s",), action=(r"\bNAME\s+the\b", r"\bNAME\s+of\b"), addressed=(r"\band\s+NAME\b",), project=(r"\bthe\s+NAME\b",), versioned=(r"\bNAME,",), pronouns=("he", "in", "to"))
STOPS = ["the", "and", "in"]


def english(s, d):
    return table(s, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"), F.regexp_replace("text", r"[^\x00-\x7F]", "").alias("document"))


_en = "(SELECT doc_id AS id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS t FROM documents WHERE lang = 'en')"
CANDIDATES = f"""SELECT name, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(t, '\\b[A-Z][a-z]{{1,19}}\\b')) AS name FROM {_en}) WHERE lower(name) NOT IN ('the', 'and', 'in') GROUP BY 1 HAVING count(*) >= 3
UNION ALL SELECT name, count(*) FROM (SELECT unnest(regexp_extract_all(t, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b')) AS name FROM {_en}) WHERE NOT list_has_any(regexp_split_to_array(lower(name), '\\s+'), ['the', 'and', 'in']) GROUP BY 1 HAVING count(*) >= 3"""
_count = lambda p: "sum(len(regexp_extract_all(t, '(?i)' || " + " || name || ".join(f"'{x}'" for x in p.split("NAME")) + ")))"
SCORED = f"""WITH c AS (SELECT * FROM ({CANDIDATES}) WHERE frequency >= 30), d AS (SELECT id, t, string_split(lower(t), chr(10)) AS ls FROM {_en}),
p AS (SELECT name, {_count('(?m)^NAME\\s')} AS d0, {_count('\\bNAME\\s+the\\b')} AS a0, {_count('\\bNAME\\s+of\\b')} AS a1, {_count('\\band\\s+NAME\\b')} AS x0, {_count('\\bthe\\s+NAME\\b')} AS p0, {_count('\\bNAME,')} AS v0,
 sum(len(list_filter(range(1, len(ls) + 1), lambda i: contains(ls[i], lower(name)) AND regexp_matches(array_to_string(ls[greatest(i - 2, 1):i + 2], ' '), '\\b(?:he|in|to)\\b')))) AS n0
 FROM c JOIN d ON list_contains(regexp_extract_all(lower(t), '\\w+'), regexp_extract(lower(name), '\\w+')) GROUP BY name),
s AS (SELECT name, CAST(3 * d0 + 2 * (a0 + a1) + 2 * n0 + 4 * x0 AS BIGINT) AS person_score, CAST(2 * p0 + 3 * v0 AS BIGINT) AS project_score,
 list_sort(list_distinct(list_filter([CASE WHEN d0 > 0 THEN 'dialogue' END, CASE WHEN a0 > 0 THEN 'action' END, CASE WHEN a1 > 0 THEN 'action' END, CASE WHEN n0 > 0 THEN 'pronoun' END, CASE WHEN x0 > 0 THEN 'addressed' END], lambda k: k IS NOT NULL)[1:3])) AS kinds FROM p),
r AS (SELECT name, frequency, person_score AS ps, project_score AS pr, kinds, ps / CAST(ps + pr AS DOUBLE) AS ratio FROM c JOIN s USING (name)),
k AS (SELECT *, CASE WHEN ps + pr = 0 THEN 'uncertain' WHEN ratio >= 0.7 AND len(kinds) >= 2 AND ps >= 5 THEN 'person' WHEN ratio >= 0.7 THEN 'uncertain' WHEN ratio <= 0.3 THEN 'project' ELSE 'uncertain' END AS type,
 CASE WHEN ps + pr = 0 THEN round(least(0.4::DOUBLE, frequency / 50.0::DOUBLE), 2) WHEN ratio >= 0.7 AND len(kinds) >= 2 AND ps >= 5 THEN round(least(0.99::DOUBLE, 0.5::DOUBLE + ratio * 0.5::DOUBLE), 2) WHEN ratio >= 0.7 THEN 0.4::DOUBLE WHEN ratio <= 0.3 THEN round(least(0.99::DOUBLE, 0.5::DOUBLE + (1 - ratio) * 0.5::DOUBLE), 2) ELSE 0.5::DOUBLE END AS confidence FROM r)"""
CAPPED = f"{SCORED} SELECT name, type, confidence FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY CASE WHEN type = 'uncertain' THEN 0 ELSE confidence END DESC, frequency DESC, name) AS place FROM k) WHERE place <= CASE type WHEN 'person' THEN 15 WHEN 'project' THEN 10 ELSE 8 END"


def registry(s, d):
    """Customers as known people; every third has an alias that documents could hold."""
    k = F.col("c_custkey")
    return table(s, d, "customer").select(F.col("c_name").alias("name"), F.when(k % 3 == 0, F.concat(F.lit("Al"), k)).alias("alias"), F.lit(0.8).alias("confidence"))


def looked_up(s, d):
    k = F.col("o_custkey")
    words = table(s, d, "orders").select(F.when(k % 5 == 0, F.concat(F.lit("AL"), k)).when(k % 5 == 1, F.upper("o_orderpriority")).when(k % 5 == 2, F.concat(F.lit("w"), k % 7)).otherwise(F.concat(F.lit("customer#"), F.lpad(k.cast("string"), 9, "0"))).alias("word")).distinct()
    projects = table(s, d, "orders").select(F.col("o_orderpriority").alias("name")).distinct()
    seen = s.createDataFrame([("W1", "person", 0.6), ("w2", "place", 0.5)], "name string, type string, confidence double")
    return entities.lookup(words, registry(s, d), projects, seen)


LOOKED = """WITH w AS (SELECT DISTINCT CASE o_custkey % 5 WHEN 0 THEN 'AL' || o_custkey WHEN 1 THEN upper(o_orderpriority) WHEN 2 THEN 'w' || (o_custkey % 7) ELSE 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS word FROM orders),
k AS (SELECT lower(c_name) AS k, c_name AS name FROM customer UNION ALL SELECT 'al' || c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0), p AS (SELECT k, min(name) AS name FROM k GROUP BY 1), j AS (SELECT lower(o_orderpriority) AS k, min(o_orderpriority) AS project FROM orders GROUP BY 1)
SELECT word, CASE WHEN name IS NOT NULL THEN 'person' WHEN project IS NOT NULL THEN 'project' WHEN lower(word) = 'w1' THEN 'person' WHEN lower(word) = 'w2' THEN 'place' ELSE 'unknown' END AS type,
 CASE WHEN name IS NOT NULL THEN 0.8::DOUBLE WHEN project IS NOT NULL THEN 1.0::DOUBLE WHEN lower(word) = 'w1' THEN 0.6::DOUBLE WHEN lower(word) = 'w2' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS confidence, coalesce(name, project, word) AS name
FROM w LEFT JOIN p ON lower(word) = p.k LEFT JOIN j ON lower(word) = j.k"""


def mentioned_customers(s, d):
    """Order notes that mention customers by name or alias, some inside longer words."""
    k = F.col("o_custkey")
    note = F.concat(F.lit("asked "), F.when(k % 2 == 0, F.concat(F.lit("al"), k)).otherwise(F.concat(F.lit("AL"), k, F.lit("x"))), F.lit(" and Customer#"), F.lpad((k + 1).cast("string"), 9, "0"), F.lit("."))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), note.alias("document"))


NAMED = """SELECT DISTINCT o_orderkey AS id, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey + 1 UNION SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 = 0 WHERE o_custkey % 2 = 0"""

# Spelling: corrections of words that occur, some of them too far off or in the dictionary.
CORRECTIONS = [("tion", "tione"), ("thonre", "thorn"), ("eron", "aaaaaaaa"), ("then", "than"), ("that", "thwt"), ("leau", "leaux")]


def corrections(s):
    return s.createDataFrame(CORRECTIONS, "word string, correction string"), s.createDataFrame([("THAT",)], "word string")


_fixes = [(w, c) for w, c in CORRECTIONS if w not in ("eron", "that")]
_bare = "regexp_replace(p, '[.,!?;:''\")]+$', '')"
_skip = f"(length({_bare}) < 4 OR regexp_matches({_bare}, '\\d|[A-Z][a-z]+[A-Z]|^[A-Z_@#$%^&*()+=\\[\\]{{}}|<>?.:/\\\\]+$|[-_]|(?i)https?://|(?i)www\\.|/Users/|~/|\\.[a-zA-Z]{{2,4}}$|[`*_#{{}}\\[\\]\\\\]'))"
_fix = "CASE " + " ".join(f"WHEN NOT skip AND bare = '{w}' THEN '{c}' || substr(p, length(bare) + 1)" for w, c in _fixes) + " ELSE p END"
CORRECTED = f"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS ps FROM documents), e AS (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM t),
b AS (SELECT *, {_bare} AS bare, {_skip} AS skip FROM e) SELECT d.doc_id AS id, coalesce(x.text, '') AS text FROM documents d LEFT JOIN (SELECT id, string_agg({_fix}, '' ORDER BY i) AS text FROM b GROUP BY id) x ON x.id = d.doc_id"""

# Typed memories, with words that occur as markers.
MARKERS = {"decision": ["tion\\b", "\\bthe\\b"], "problem": ["\\bof\\b", "\\bund\\b"], "milestone": ["\\band\\b"], "emotional": ["\\bla\\b"]}
CODE = "|".join(f"(?:{p})" for p in classify.CODE_LINE).replace("'", "''")


def prose_sql(text: str) -> str:
    keep = f"list_filter(string_split({text}, chr(10)), lambda x: NOT (regexp_matches({STRIP.format('x')}, '{CODE}') OR (length({STRIP.format('x')}) > 10 AND length(regexp_replace({STRIP.format('x')}, '[^\\p{{L}}]', '', 'g')) < length({STRIP.format('x')}) * 0.4::DOUBLE)))"
    joined = STRIP.format(f"array_to_string({keep}, chr(10))")
    return f"CASE WHEN {joined} <> '' THEN {joined} ELSE {text} END"


SEGMENTS = f"""SELECT id, unnest(xs) AS content, generate_subscripts(xs, 1) AS place FROM (SELECT id, CASE WHEN len(parts) <= 1 AND len(ls) > 20 THEN list_filter(list_transform(range(0, (len(ls) + 24) // 25), lambda g: {STRIP.format('array_to_string(ls[g * 25 + 1:g * 25 + 25], chr(10))')}), lambda x: x <> '') ELSE parts END AS xs
 FROM (SELECT id, string_split(document, chr(10)) AS ls, list_filter(list_transform(string_split(document, chr(10) || chr(10)), lambda p: {STRIP.format('p')}), lambda p: p <> '') AS parts FROM ({DOCS})))"""
_n = {k: " + ".join(f"len(regexp_extract_all(lower(prose), '{p}'))" for p in ps) for k, ps in MARKERS.items()}
_ascii = f"SELECT id, place, content FROM ({SEGMENTS}) WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en')"
MEMORIES = f"""WITH p AS (SELECT id, place, content, {prose_sql('content')} AS prose FROM ({_ascii})), c AS (SELECT *, {_n['decision']} AS a, {_n['problem']} AS b, {_n['milestone']} AS m, {_n['emotional']} AS e, CASE WHEN length(content) > 500 THEN 2 WHEN length(content) > 200 THEN 1 ELSE 0 END AS bonus FROM p),
k AS (SELECT *, CASE WHEN greatest(a, b, m, e) <= 0 THEN NULL WHEN a >= greatest(b, m, e) THEN 'decision' WHEN b >= greatest(m, e) THEN 'problem' WHEN m >= e THEN 'milestone' ELSE 'emotional' END AS kind, least(1.0::DOUBLE, (greatest(a, b, m, e) + bonus) / 5.0::DOUBLE) AS confidence FROM c WHERE length(content) >= 20),
s AS (SELECT *, CASE WHEN kind = 'problem' AND contains(lower(prose), 'thth') THEN 'milestone' ELSE kind END AS final FROM k WHERE kind IS NOT NULL AND confidence >= 0.3)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS INTEGER) AS chunk_index, final AS kind, confidence FROM s"""

# Digests.
MOODS, FLAGS, DECIDED = [("tion", "hope"), ("eau", "calm")], [("the", "CORE"), ("und", "PIVOT")], ["the", "and"]
NAMED_CODES = {"Thth": "THX", "onthe": "ONT"}


def digests(s, d, keep=()):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"), F.col("lang").alias("domain"), F.col("source").alias("topic"), F.when(F.col("doc_id") % 2 == 0, "2026-01-01").alias("date"))
    return digest.digest(rows, ["the", "of", "and"], MOODS, FLAGS, DECIDED, NAMED_CODES, keep)


_codes = lambda pairs, t: "list_filter([" + ", ".join(f"CASE WHEN contains({t}, '{k.lower()}') THEN '{c}' END" for k, c in pairs) + "], lambda c: c IS NOT NULL)"
DIGESTS = f"""WITH w AS (SELECT doc_id AS id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
g AS (SELECT id, upper(substr(x, 1, 3)) AS code, min(i) AS i FROM (SELECT id, i, regexp_replace(w, '[^a-zA-Z]', '', 'g') AS x FROM w WHERE i > 1) WHERE regexp_matches(x, '^[A-Z][a-z]+$') AND lower(x) NOT IN ('the', 'of', 'and') GROUP BY 1, 2),
n AS (SELECT id, string_agg(code, '+' ORDER BY r) AS names FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM g) WHERE r <= 3 GROUP BY 1), t AS ({TOPICS}), q AS ({KEY_SENTENCE})
SELECT d.doc_id AS id, lang || '|' || source || '|' || CASE WHEN d.doc_id % 2 = 0 THEN '2026-01-01' ELSE '?' END || '|?' || chr(10) || concat_ws('|', '0:' || CASE WHEN len(known) > 0 THEN array_to_string(known, '+') ELSE coalesce(names, '???') END, coalesce(replace(topics, ' ', '_'), 'misc'),
 CASE WHEN quote <> '' THEN '"' || quote || '"' END, CASE WHEN len(moods) > 0 THEN array_to_string(moods, '+') END, CASE WHEN len(flags) > 0 THEN array_to_string(flags, '+') END) AS digest
FROM (SELECT *, {_codes(NAMED_CODES.items(), 'low')} AS known, {_codes(MOODS, 'low')} AS moods, {_codes(FLAGS, 'low')} AS flags FROM (SELECT *, lower(coalesce(text, '')) AS low FROM documents)) d LEFT JOIN n ON n.id = d.doc_id LEFT JOIN t ON t.id = d.doc_id LEFT JOIN q ON q.id = d.doc_id"""


def digest_table(s, d):
    return digest.sizes(digests(s, d, ("document",)))


_est = lambda c: f"greatest(1, CAST(floor(len(regexp_extract_all(coalesce({c}, ''), '[^\\x20\\x09-\\x0D]+')) * 1.3::DOUBLE) AS BIGINT))"
SIZED = f"SELECT id, {_est('text')} AS tokens, {_est('digest')} AS digest_tokens, length(coalesce(text, '')) AS characters, length(digest) AS digest_characters FROM ({DIGESTS}) JOIN documents ON doc_id = id"


def notes(s, d):
    """Orders as structured notes of their customer's file."""
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(
        F.col("o_custkey").alias("file"), k.alias("place"), F.concat(F.lit("note-"), k).alias("id"), F.array(F.concat(F.lit("Clerk"), k % 7), F.lit("Anna")).alias("people"), F.array(F.col("o_orderpriority"), F.col("o_orderstatus"), F.lit("x")).alias("topics"),
        (k % 10 / 10).alias("weight"), F.array(F.lit("joy"), F.lit("wonder")).alias("moods"), F.concat(F.lit('He said "order number '), k, F.lit('" and "we hope for '), k, F.lit('"')).alias("content"), F.lit(None).cast("string").alias("origin"),
        F.when(k % 3 == 0, "a core pivot").alias("notes"), F.lit("Note - title").alias("title"), F.when(k % 4 == 0, "MAXIMUM").alias("sensitivity"), (k % 5 == 0).alias("is_origin"),
    )


_flags = "array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'ORIGIN' END, CASE WHEN o_orderkey % 4 = 0 THEN 'SENSITIVE' END, CASE WHEN o_orderkey % 3 = 0 THEN 'CORE' END, CASE WHEN o_orderkey % 3 = 0 THEN 'PIVOT' END], lambda f: f IS NOT NULL), '+')"
NOTES = f"""SELECT o_custkey AS file, o_orderkey AS place, o_orderkey || ':ANN+CLE|' || o_orderpriority || '_' || o_orderstatus || '|"we hope for ' || o_orderkey || '"|' || CAST(o_orderkey % 10 / 10 AS VARCHAR) || '|joyful+wond' || CASE WHEN {_flags} <> '' THEN '|' || {_flags} ELSE '' END AS line FROM orders"""


def note_lines(s, d):
    return digest.note_lines(notes(s, d), {"anna": "ANN"}, {"joy": "joyful"}, ["hope"])


PLANS = {
    "s1_s2_scan": (lambda s, d: files.scan(project(s, d), rules(s)).select("path"), f"SELECT path FROM ({PROJECT}) WHERE length <= 10485760 AND regexp_matches(lower(path), '\\.(md|py|txt)$') AND NOT starts_with(path, 'node_modules/') AND NOT contains(path, '.egg-info/') AND NOT starts_with(path, 'notes/src1/') AND NOT (contains(path, '.py') AND NOT contains(path, '/main')) AND NOT starts_with(path, 'keep/')"),
    "s3_forced_scan": (lambda s, d: files.scan(project(s, d), rules(s), ["node_modules/src1", "notes/src1/"]).select("path"), f"SELECT path FROM ({PROJECT}) WHERE length <= 10485760 AND regexp_matches(lower(path), '\\.(md|py|txt)$') AND (starts_with(path, 'node_modules/src1/') OR starts_with(path, 'notes/src1/') OR (NOT contains(path, '.egg-info/') AND NOT (contains(path, '.py') AND NOT contains(path, '/main')) AND NOT starts_with(path, 'keep/')))"),
    "s4_chat_files": (lambda s, d: files.scan_chats(project(s, d)).select("path"), f"SELECT path FROM ({PROJECT}) WHERE length <= 10485760 AND regexp_matches(lower(path), '\\.(md|txt)$') AND NOT starts_with(path, 'node_modules/')"),
    "s5_samples": (lambda s, d: files.samples(project(s, d)).withColumn("sample", F.substring("sample", 1, 100)), f"SELECT path, substr(content, 1, 100) AS sample FROM ({PROJECT}) WHERE regexp_matches(lower(path), '\\.(md|txt)$') AND NOT starts_with(path, 'node_modules/') ORDER BY path LIMIT 10"),
    "c1_file_router": (lambda s, d: project(s, d).select("path", files.route(F.col("path"), F.col("content"), ROOMS).alias("room")), ROUTED),
    "c16_rooms_of_folders": (lambda s, d: files.rooms_of_folders(project(s, d), KNOWN_ROOMS), f"SELECT name, min(folder) AS folder FROM (SELECT CASE split_part(path, '/', 1) WHEN 'app' THEN 'frontend' WHEN 'notes' THEN 'documentation' ELSE regexp_replace(lower(split_part(path, '/', 1)), '[- ]', '_', 'g') END AS name, split_part(path, '/', 1) AS folder FROM ({PROJECT}) WHERE NOT starts_with(path, 'node_modules/')) GROUP BY 1 UNION ALL SELECT 'general', ''"),
    "c16_a14_rooms_of_names": (lambda s, d: files.rooms_of_names(project(s, d), KNOWN_ROOMS), "SELECT CASE WHEN doc_id % 3 = 0 THEN 'core' ELSE 'pieces' END AS name, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 2"),
    "n9_n13_w5_w6_sessions": (lambda s, d: splitting.sessions(mega(s, d), HEADER, RESTORED, 2, 3), SESSIONS),
    "n10_n11_n12_heads": (lambda s, d: timed(s, d).select("o_orderkey", splitting.time_of(F.col("content")).alias("t"), F.array_join(splitting.people_in(F.col("content"), ["Ben", "Anna", "Zoe"], {"jd": "Jo"}), ",").alias("people"), splitting.subject_of(F.col("content")).alias("subject")).select("o_orderkey", "t.day", "t.stamp", "people", "subject"), TIMED),
    "s13_session_files": (lambda s, d: splitting.sessions(mega(s, d), HEADER, RESTORED, 2, 3).transform(lambda r: r.select("path", "session", splitting.file_name(r, ["Anna"]).alias("name"))), f"SELECT path, session, path || '_part' || lpad(CAST(session AS VARCHAR), 2, '0') || '_unknown_session.txt' AS name FROM ({SESSIONS})"),
    "n1_n4_n7_flat_export": (lambda s, d: exports(s, d, "flat"), EXPORTED),
    "n2_typed_export": (lambda s, d: exports(s, d, "typed"), EXPORTED),
    "n3_event_export": (lambda s, d: exports(s, d, "events"), EXPORTED),
    "n5_tree_export": (lambda s, d: exports(s, d, "tree"), EXPORTED),
    "n6_channel_export": (lambda s, d: exports(s, d, "channel"), CHANNEL),
    "c9_a10_f9_candidates": (lambda s, d: entities.candidates(english(s, d), STOPS), CANDIDATES),
    "c10_w3_scores": (lambda s, d: entities.scores(english(s, d), entities.candidates(english(s, d), STOPS, 30), SIGNALS).withColumn("kinds", F.array_join("kinds", ",")), f"{SCORED} SELECT name, frequency, ps AS person_score, pr AS project_score, array_to_string(kinds, ',') AS kinds FROM k"),
    "c11_a11_classes": (lambda s, d: entities.classified(entities.scores(english(s, d), entities.candidates(english(s, d), STOPS, 30), SIGNALS)).select("name", "type", "confidence"), f"{SCORED} SELECT name, type, confidence FROM k"),
    "c12_o6_detect": (lambda s, d: entities.detect(english(s, d), STOPS, SIGNALS, least=30).select("name", "type", "confidence"), CAPPED),
    "c13_j14_lookup": (looked_up, LOOKED),
    "c13_sense": (lambda s, d: english_docs(s, d).select("id", entities.sense(F.lit("The"), F.col("document"), [r"\bNAME\s+on", r"of\s+NAME\b"], [r"\bNAME\s+of\b", r"and NAME", r"NAME in"], F.lit(0.8)).alias("s")).select("id", "s.type", "s.confidence"), "SELECT id, CASE WHEN c > p THEN 'concept' ELSE 'person' END AS type, round(CASE WHEN p > c THEN least(0.95::DOUBLE, 0.7::DOUBLE + p * 0.1::DOUBLE) WHEN c > p THEN least(0.9::DOUBLE, 0.7::DOUBLE + c * 0.1::DOUBLE) ELSE 0.8::DOUBLE END, 2) AS confidence FROM (SELECT doc_id AS id, CAST(regexp_matches(t, '\\bthe\\s+on') AS INTEGER) + CAST(regexp_matches(t, 'of\\s+the\\b') AS INTEGER) AS p, CAST(regexp_matches(t, '\\bthe\\s+of\\b') AS INTEGER) + CAST(regexp_matches(t, 'and the') AS INTEGER) + CAST(regexp_matches(t, 'the in') AS INTEGER) AS c FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents WHERE lang = 'en'))"),
    "c14_names_in_texts": (lambda s, d: entities.names_in(mentioned_customers(s, d), registry(s, d)), NAMED),
    "c14_unknown_words": (lambda s, d: entities.unknown_words(english(s, d), registry(s, d).unionByName(s.createDataFrame([("Thth", None, 1.0)], "name string, alias string, confidence double")), ["the"]), f"SELECT DISTINCT id, w AS word FROM (SELECT id, unnest(regexp_extract_all(t, '\\b[A-Z][a-z]{{2,15}}\\b')) AS w FROM {_en}) WHERE lower(w) NOT IN ('the', 'thth')"),
    "c15_learned": (lambda s, d: entities.learned(registry(s, d).withColumn("source", F.lit("seed")), entities.detect(english(s, d), STOPS, SIGNALS, least=30)).select("name", "confidence", "source"), f"SELECT c_name AS name, 0.8::DOUBLE AS confidence, 'seed' AS source FROM customer UNION ALL SELECT name, confidence, 'learned' FROM ({CAPPED}) WHERE type = 'person' AND confidence >= 0.75"),
    "c18_codes": (lambda s, d: entities.codes(s.createDataFrame([("Alice",), ("Alina",), ("Alison",), ("Alicia",), ("Bo",)], "name string")), "SELECT * FROM (VALUES ('Alice', 'ALI'), ('Alicia', 'ALIC'), ('Alina', 'ALIN'), ('Alison', 'ALIS'), ('Bo', 'BO')) AS t(name, code)"),
    "f14_x22_left_alone": (lambda s, d: table(s, d, "customer").select("c_custkey", spelling.left_alone(F.col("c_name")).alias("name"), spelling.left_alone(F.lower("c_mktsegment"), ["machinery"]).alias("segment"), spelling.bare(F.concat("c_mktsegment", F.lit("!?."))).alias("bare"), spelling.ending(F.concat("c_mktsegment", F.lit("!?."))).alias("ending")), "SELECT c_custkey, true AS name, lower(c_mktsegment) = 'machinery' AS segment, c_mktsegment AS bare, '!?.' AS ending FROM customer"),
    "x8_close_enough": (lambda s, d: table(s, d, "part").select("p_partkey", F.levenshtein("p_brand", "p_type").alias("distance"), spelling.close_enough(F.col("p_brand"), F.col("p_type")).alias("close")), "SELECT p_partkey, CAST(levenshtein(p_brand, p_type) AS INTEGER) AS distance, levenshtein(p_brand, p_type) <= CASE WHEN length(p_brand) <= 7 THEN 2 ELSE 3 END AS close FROM part"),
    "c17_spelling": (lambda s, d: spelling.corrected(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), *corrections(s)), CORRECTED),
    "p5_segments": (lambda s, d: docs(s, d).select("id", F.posexplode(chunking.segments(F.col("document"))).alias("place", "content")).select("id", "content"), f"SELECT id, content FROM ({SEGMENTS})"),
    "c6_f11_prose": (lambda s, d: docs(s, d).select("id", classify.prose(F.col("document")).alias("prose")), f"SELECT id, {prose_sql('document')} AS prose FROM ({DOCS})"),
    "c4_c5_x3_memories": (lambda s, d: classify.memories(english_docs(s, d), chunking.segments(F.col("document")), MARKERS, [], [], ["thth"]).drop("content"), MEMORIES),
    "d1_d2_digests": (digests, DIGESTS),
    "d10_x10_digest_sizes": (lambda s, d: digest_table(s, d).select("id", "tokens", "digest_tokens", "characters", "digest_characters"), SIZED),
    "d11_a16_total_ratio": (lambda s, d: digest.total_ratio(digest_table(s, d)), f"SELECT CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(digest_tokens) AS BIGINT) AS digest_tokens, round(sum(tokens) / CAST(sum(digest_tokens) AS DOUBLE), 4) AS ratio FROM ({SIZED})"),
    "d9_decoded": (lambda s, d: digest.decoded(digests(s, d)).select("id", "line_no", "kind", F.element_at("fields", 1).alias("first")), f"SELECT id, CAST(0 AS INTEGER) AS line_no, 'header' AS kind, split_part(digest, '|', 1) AS first FROM ({DIGESTS}) UNION ALL SELECT id, 1, 'note', split_part(split_part(digest, chr(10), 2), '|', 1) FROM ({DIGESTS})"),
    "d7_notes": (note_lines, NOTES),
    "d8_file_texts": (lambda s, d: digest.file_texts(note_lines(s, d)), f"SELECT file, string_agg(line, chr(10) ORDER BY place) AS text FROM ({NOTES}) GROUP BY 1"),
    "d8_key_notes": (lambda s, d: digest.key_notes(notes(s, d)).select("id"), "SELECT 'note-' || o_orderkey AS id FROM orders WHERE o_orderkey % 10 / 10 >= 0.85 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0"),
    "d7_bridge_lines": (lambda s, d: table(s, d, "nation").select("n_nationkey", digest.bridge_line(F.concat(F.lit("a-"), "n_nationkey"), F.concat(F.lit("b-"), "n_regionkey"), F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, ": more").otherwise(""))).alias("line")), "SELECT n_nationkey, 'T:' || n_nationkey || '<->' || n_regionkey || '|' || substr(n_name, 1, 30) AS line FROM nation"),
}


def english_docs(s, d):
    return table(s, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"), F.col("text").alias("document"))
