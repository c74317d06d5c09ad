"""Registered queries on texts, chunks, digests, re-ranking and event time, with the DuckDB SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.functions import text as T
from loreweave.operators import chunking, classify, digest, rerank, retrieval_metrics, transcripts, vectors
from loreweave.plans.store_plans import PLANS as STORE_PLANS
from loreweave.runtime import table
from loreweave.streaming import activity

WORD = T.WORD
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
STOP = ["the", "of", "and"]
LEXICON = {"alpha": ["the", "of", "und"], "beta": ["and", "to", "der"], "gamma": ["in", "is", "les"]}
SIGNALS = [("the", "T"), ("of", "O"), ("and", "A"), ("to", "T")]
KEYS = ["the", "of", "and", "und"]


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"))


def talks(spark, sf_dir):
    return transcripts.transcript(table(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("id"), F.col("transcript").alias("document"))


def paragraphs_sql(source: str) -> str:
    strip = STRIP.format("p")
    return f"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INTEGER) AS chunk_index, content FROM (
 SELECT id, i, {STRIP.format('x')} AS content FROM (SELECT id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (
  SELECT id, CASE WHEN len(parts) <= 1 AND len(ls) > 21 THEN list_transform(range(0, (len(ls) + 24) // 25), lambda g: array_to_string(ls[g * 25 + 1:g * 25 + 25], chr(10))) ELSE parts END AS xs
  FROM (SELECT id, string_split(document, chr(10)) AS ls, list_filter(list_transform(string_split(document, chr(10) || chr(10)), lambda p: {strip}), lambda p: p <> '') AS parts FROM ({source})))))
WHERE length(content) > 30"""


DOCS = "SELECT doc_id AS id, text AS document FROM documents"
TALKS = f"SELECT conv_id AS id, transcript AS document FROM ({STORE_PLANS['n8_transcripts'][1]})"
EXCHANGES = f"""WITH l AS (SELECT id, {STRIP.format('line')} AS s, pos FROM (SELECT id, unnest(string_split(document, chr(10))) AS line, generate_subscripts(string_split(document, chr(10)), 1) AS pos FROM ({TALKS}))),
b AS (SELECT *, sum(CAST(starts_with(s, '>') OR starts_with(s, '---') AS INTEGER)) OVER (PARTITION BY id ORDER BY pos) AS blk FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY id, blk ORDER BY pos) AS r FROM b WHERE s <> ''),
e AS (SELECT id, blk, min(s) FILTER (r = 1) AS u, string_agg(s, ' ' ORDER BY pos) FILTER (r BETWEEN 2 AND 9) AS a FROM k GROUP BY id, blk),
x AS (SELECT id, blk, u || coalesce(chr(10) || a, '') AS content, count(*) OVER (PARTITION BY id) AS q FROM e WHERE starts_with(u, '>'))
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY blk) - 1 AS INTEGER) AS chunk_index, content FROM x WHERE q >= 3 AND length(content) > 30
UNION ALL SELECT * FROM ({paragraphs_sql(TALKS)}) WHERE id NOT IN (SELECT id FROM x WHERE q >= 3)"""

_cut = lambda at: f"CASE WHEN {at} + 800 >= length(t) THEN length(t) WHEN length(regexp_extract(substr(t, {at} + 1, 800), '(?s)^(.*)\\n\\n', 1)) > 400 THEN {at} + length(regexp_extract(substr(t, {at} + 1, 800), '(?s)^(.*)\\n\\n', 1)) WHEN length(regexp_extract(substr(t, {at} + 1, 800), '(?s)^(.*)\\n', 1)) > 400 THEN {at} + length(regexp_extract(substr(t, {at} + 1, 800), '(?s)^(.*)\\n', 1)) ELSE {at} + 800 END"
WINDOWS = f"""WITH RECURSIVE w AS (SELECT id, t, CAST(0 AS BIGINT) AS start_at, CAST({_cut('0')} AS BIGINT) AS stop FROM (SELECT id, {STRIP.format('document')} AS t FROM ({DOCS})) WHERE t <> ''
 UNION ALL SELECT id, t, stop - 100, CAST({_cut('(stop - 100)')} AS BIGINT) FROM w WHERE stop < length(t))
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY start_at) - 1 AS INTEGER) AS chunk_index, content FROM (SELECT id, start_at, {STRIP.format('substr(t, start_at + 1, stop - start_at)')} AS content FROM w) WHERE length(content) >= 50"""


def pairs(spark, sf_dir):
    """Each turn with the next: texts are joined, which are smaller than their words."""
    m = table(spark, sf_dir, "conversations")
    answer = m.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    both = m.select("conv_id", "turn", "text").join(answer, ["conv_id", "turn"])
    return both.select("conv_id", "turn", T.answer_words(F.col("text")).alias("a"), T.answer_words(F.col("answer")).alias("b"))


_answer = f"list_filter(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\\[-`{{-~]', '', 'g'), '{WORD}'), lambda w: w NOT IN ('a', 'an', 'the', 'and'))"
TOKEN_F1 = f"""WITH m AS (SELECT conv_id, turn, {_answer} AS ws FROM conversations), p AS (SELECT x.conv_id, x.turn, x.ws AS a, y.ws AS b FROM m x JOIN m y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1),
c AS (SELECT conv_id, turn, w, sum(l) AS l, sum(r) AS r FROM (SELECT conv_id, turn, unnest(a) AS w, 1 AS l, 0 AS r FROM p UNION ALL SELECT conv_id, turn, unnest(b), 0, 1 FROM p) GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN sum(least(l, r)) > 0 THEN 2.0::DOUBLE * sum(least(l, r)) / (sum(l) + sum(r)) ELSE 0.0::DOUBLE END, 6) AS f1 FROM c GROUP BY ALL"""


def pool(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("want"))
    hits = vectors.knn_many(e, q, 50).select("query_id", "vec_id", "rank", "label", "want", (1 - F.col("similarity")).alias("distance"))
    return hits.join(docs(spark, sf_dir), F.col("vec_id") == F.col("id"), "left")


POOL = """SELECT p.*, 1 - sim AS distance, text AS document FROM (SELECT q.vec_id AS query_id, q.label AS want, e.vec_id, e.label, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) /
 (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS s, round(s, 3) AS sim,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id) AS r FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) p LEFT JOIN documents ON doc_id = vec_id WHERE r <= 50"""


def top(hits):
    return hits.select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"))


def fused_sql(boost: str) -> str:
    return f"SELECT query_id, vec_id, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance * (1 - {boost}), vec_id) AS k FROM ({POOL})) WHERE k <= 10"


_overlap = "(" + " + ".join(f"CAST(contains(lower(coalesce(document, '')), '{k}') AS INTEGER)" for k in KEYS) + ") / 4.0::DOUBLE"
_days = "abs(vec_id % 28 - query_id % 28)"


def sessions_of_hits(spark, sf_dir):
    hits = pool(spark, sf_dir).filter("rank <= 10").withColumn("session", F.col("vec_id") % 25)
    corpus = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 25).alias("session")).distinct().withColumn("position", F.col("session"))
    return rerank.by_session(hits, corpus, 10)


SESSIONS_OF_HITS = f"""WITH f AS (SELECT query_id, vec_id % 25 AS session, min(r) AS best FROM ({POOL}) WHERE r <= 10 GROUP BY ALL), c AS (SELECT DISTINCT vec_id % 25 AS session FROM embeddings),
g AS (SELECT q.query_id, c.session, best FROM (SELECT DISTINCT query_id FROM f) q CROSS JOIN c LEFT JOIN f USING (query_id, session))
SELECT query_id, session, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best NULLS LAST, session) AS k FROM g) WHERE k <= 10"""

TOPICS = f"""WITH w AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id AS id, regexp_extract_all(text, '[a-zA-Z][a-zA-Z_-]{{2,}}') AS ws FROM documents)),
c AS (SELECT id, lower(w) AS word, sum(1 + 2 * CAST(regexp_matches(w, '^[A-Z]') AS INTEGER) + 2 * CAST(regexp_matches(w, '^.+[A-Z]|[_-]') AS INTEGER)) AS n, min(pos) AS pos FROM w WHERE lower(w) NOT IN ('the', 'of', 'and') GROUP BY ALL)
SELECT id, string_agg(word, ' ' ORDER BY r) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, pos) AS r FROM c) WHERE r <= 3 GROUP BY id"""
KEY_SENTENCE = f"""WITH s AS (SELECT id, {STRIP.format('x')} AS s, i FROM (SELECT id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (SELECT doc_id AS id, string_split_regex(text, '[.!?\\n]+') AS xs FROM documents))),
k AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY 2 * CAST(contains(lower(s), 'the') AS INTEGER) + 2 * CAST(contains(lower(s), 'and') AS INTEGER) + CASE WHEN length(s) < 40 THEN 2 WHEN length(s) < 80 THEN 1 WHEN length(s) > 150 THEN -2 ELSE 0 END DESC, i) AS r FROM s WHERE length(s) > 10)
SELECT doc_id AS id, CASE WHEN s IS NULL THEN '' WHEN length(s) > 55 THEN substr(s, 1, 52) || '...' ELSE s END AS quote FROM documents LEFT JOIN (SELECT * FROM k WHERE r = 1) ON id = doc_id"""
_hits = {n: " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{k}') AS INTEGER)" for k in ks) for n, ks in LEXICON.items()}

PLANS = {
    "x1_occurrences": (lambda s, d: docs(s, d).select("id", T.occurrences(F.col("document"), "the").alias("n")), "SELECT doc_id AS id, coalesce(CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT), 0) AS n FROM documents"),
    "x9_token_estimate": (lambda s, d: docs(s, d).select("id", T.token_estimate(F.col("document")).alias("n")), f"SELECT doc_id AS id, greatest(1, CAST(floor(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) * 1.3::DOUBLE) AS BIGINT)) AS n FROM documents"),
    "x17_m3_sessions": (lambda s, d: table(s, d, "conversations").select("conv_id", "turn", T.session_of(F.concat(F.col("conv_id").cast("string"), F.lit("_turn_"), F.col("turn").cast("string"))).alias("session")), "SELECT conv_id, turn, CAST(conv_id AS VARCHAR) AS session FROM conversations"),
    "x21_safe_sessions": (lambda s, d: table(s, d, "customer").select("c_custkey", T.safe_session(F.col("c_name")).alias("session")), "SELECT c_custkey, coalesce(nullif(regexp_replace(c_name, '[^a-zA-Z0-9_-]', '', 'g'), ''), 'unknown') AS session FROM customer"),
    "a17_m5_x16_token_f1": (lambda s, d: retrieval_metrics.token_f1(pairs(s, d), ["conv_id", "turn"]).withColumn("f1", F.round("f1", 6)), TOKEN_F1),
    "p1_windows": (lambda s, d: chunking.chunk_rows(docs(s, d), chunking.windows()(F.col("document"))), WINDOWS),
    "p3_exchanges": (lambda s, d: chunking.chunk_rows(talks(s, d), chunking.exchanges(F.col("document"))), EXCHANGES),
    "p4_paragraphs": (lambda s, d: chunking.chunk_rows(docs(s, d), chunking.paragraphs(F.col("document"))), paragraphs_sql(DOCS)),
    "c2_c3_o7_topic_router": (lambda s, d: docs(s, d).select("id", classify.topic(F.col("document"), LEXICON, None).alias("topic")), f"SELECT id, CASE WHEN greatest(a, b, c) = 0 THEN 'general' WHEN a >= greatest(b, c) THEN 'alpha' WHEN b >= c THEN 'beta' ELSE 'gamma' END AS topic FROM (SELECT doc_id AS id, {_hits['alpha']} AS a, {_hits['beta']} AS b, {_hits['gamma']} AS c FROM documents)"),
    "d3_a9_topics": (lambda s, d: digest.topics(docs(s, d), STOP).withColumn("topics", F.array_join("topics", " ")), TOPICS),
    "d4_key_sentence": (lambda s, d: docs(s, d).select("id", digest.key_sentence(F.col("document"), ["the", "and"]).alias("quote")), KEY_SENTENCE),
    "d5_d6_signals": (lambda s, d: docs(s, d).select("id", F.array_join(digest.signals(F.col("document"), SIGNALS), "+").alias("codes")), "SELECT id, array_to_string(list_filter([CASE WHEN contains(t, 'the') THEN 'T' END, CASE WHEN contains(t, 'of') THEN 'O' END, CASE WHEN contains(t, 'and') THEN 'A' END, CASE WHEN contains(t, 'to') AND NOT contains(t, 'the') THEN 'T' END], lambda c: c IS NOT NULL)[1:3], '+') AS codes FROM (SELECT doc_id AS id, lower(coalesce(text, '')) AS t FROM documents)"),
    "r3_topic_boost": (lambda s, d: top(rerank.fuse(pool(s, d), F.when(F.col("label") == F.col("want"), 0.2).otherwise(0.0), k=10)), fused_sql("CASE WHEN label = want THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END")),
    "r4_keyword_boost": (lambda s, d: top(rerank.fuse(pool(s, d), F.lit(0.3) * rerank.overlap(F.col("document"), KEYS), k=10)), fused_sql(f"0.3::DOUBLE * ({_overlap})")),
    "r6_x13_day_boost": (lambda s, d: top(rerank.fuse(pool(s, d), rerank.day_boost(F.abs(F.col("vec_id") % 28 - F.col("query_id") % 28), 3), k=10)), fused_sql(f"CASE WHEN {_days} <= 3 THEN 0.4::DOUBLE WHEN {_days} <= 9 THEN 0.4::DOUBLE * (1 - ({_days} - 3.0::DOUBLE) / 6.0::DOUBLE) ELSE 0.0::DOUBLE END")),
    "r11_promote": (lambda s, d: top(rerank.promote(pool(s, d).filter("rank <= 10"), pool(s, d).filter("rank = 3"))), f"SELECT query_id, vec_id, CAST(CASE WHEN r = 3 THEN 1 WHEN r < 3 THEN r + 1 ELSE r END AS INTEGER) AS rank FROM ({POOL}) WHERE r <= 10"),
    "w2_u5_sessions_of_hits": (lambda s, d: sessions_of_hits(s, d).withColumn("rank", F.col("rank").cast("int")), SESSIONS_OF_HITS),
    "st_windowed_counts": (lambda s, d: activity.windowed_counts(table(s, d, "events")).select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n", F.round("total", 4).alias("total")), "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "st_sessions": (lambda s, d: activity.sessions(table(s, d, "events")).select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n"), "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, g"),
}
