"""Registered queries on evaluation: documents of sessions, re-ranking modes, and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.functions import text as T
from loreweave.operators import classify, embed, rerank, retrieval_metrics, transcripts, vectors
from loreweave.plans.text_plans import POOL, TOPICS, docs, pool, top
from loreweave.runtime import table

MSG = "conversations"


def asked(s, d):
    """The pool with the question of each query: the beginning of the document of its number."""
    q = table(s, d, "documents").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 60).alias("question"))
    return pool(s, d).join(q, "query_id", "left").withColumn("question", F.coalesce("question", F.lit("")))


ASKED = f"""SELECT p.*, coalesce(substr(q.text, 1, 60), '') AS question, regexp_extract_all(lower(coalesce(substr(q.text, 1, 60), '')), '[a-z]{{3,}}') AS kws,
 list_filter(regexp_extract_all(coalesce(substr(q.text, 1, 60), ''), '[A-Z][a-z]{{2,15}}'), lambda x: true) AS names, lower(coalesce(p.document, '')) AS low FROM ({POOL}) p LEFT JOIN documents q ON q.doc_id = query_id"""


def share_sql(parts: str) -> str:
    return f"(CASE WHEN len({parts}) > 0 THEN len(list_filter({parts}, lambda x: contains(low, lower(x)))) / CAST(len({parts}) AS DOUBLE) ELSE 0.0::DOUBLE END)"


def fused(*boosts: str, k: int = 10, rows: str = ASKED) -> str:
    product = " * ".join(["distance", *[f"(1 - {b})" for b in boosts]])
    return f"SELECT query_id, vec_id, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {product}, vec_id) AS k FROM ({rows})) WHERE k <= {k}"




def kws():
    return rerank.keywords(F.col("question"))


def names():
    return T.capitalised(F.col("question"))


def quotes():
    return F.array(F.substring("question", 1, 9), F.substring("question", 12, 6))


def days():
    return rerank.day_boost(F.abs(F.col("vec_id") % 28 - F.col("query_id") % 28), 3)


def facets():
    facet = lambda label: F.element_at(F.array(*map(F.lit, FACETS)), (F.col(label) % 4 + 1).cast("int"))
    return rerank.facet_boost(facet("label"), F.array(facet("want"), F.lit("general")), F.col("rank") <= 10)


def hybrid():
    text = F.col("document")
    return (0.5 * rerank.share(text, rerank.without_names(kws(), names())), 0.6 * rerank.share(text, quotes()), 0.2 * rerank.share(text, names()))


def said():
    counted = F.when(F.col("conv_id") % 13 % 4 == 1, (F.col("turn") + 2).cast("string")).otherwise("")
    return F.concat(F.lit("I did it "), counted, F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("conv_id") % 13 + 2).cast("int")))


_quotes = "[substr(question, 1, 9), substr(question, 12, 6)]"
_quoted = "(CASE WHEN question <> '' THEN len(list_filter(list_filter([substr(question, 1, 9), substr(question, 12, 6)], lambda x: x <> ''), lambda x: contains(low, lower(x)))) / CAST(len(list_filter([substr(question, 1, 9), substr(question, 12, 6)], lambda x: x <> '')) AS DOUBLE) ELSE 0.0::DOUBLE END)"
_names_distinct = "list_distinct(names)"
_rest = "list_filter(kws, lambda x: NOT list_contains(list_transform(names, lambda n: lower(n)), x))"
_day = "abs(vec_id % 28 - query_id % 28)"
_days = f"(CASE WHEN {_day} <= 3 THEN 0.4::DOUBLE WHEN {_day} <= 9 THEN 0.4::DOUBLE * (1 - ({_day} - 3.0::DOUBLE) / 6.0::DOUBLE) ELSE 0.0::DOUBLE END)"
FACETS = ["events", "facts", "advice", "general"]
_facet = "(['events', 'facts', 'advice', 'general'])[label % 4 + 1]"
_want = "(['events', 'facts', 'advice', 'general'])[want % 4 + 1]"
_boost = f"(1 - CASE WHEN {_facet} = {_want} AND {_want} <> 'general' THEN 0.75::DOUBLE WHEN {_facet} IN ({_want}, 'general') THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN r <= 10 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END)"
_hybrid = (f"0.5::DOUBLE * {share_sql(_rest)}", f"0.6::DOUBLE * {_quoted}", f"0.2::DOUBLE * {share_sql(_names_distinct)}")


def layered(s, d):
    """Hits of two layers: every third row is a summary of its session."""
    hits = rerank.fuse(asked(s, d), 0.3 * rerank.share(F.col("document"), kws()), F.when(F.col("vec_id") % 3 == 0, 0.2).otherwise(0.0))
    return rerank.sessions_only(hits.withColumn("session", F.floor(F.col("vec_id") / 3)))


_layered = f"SELECT query_id, session, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best) AS INTEGER) AS rank FROM (SELECT query_id, vec_id // 3 AS session, min(rank) AS best FROM ({fused(f'0.3::DOUBLE * {share_sql('kws')}', 'CASE WHEN vec_id % 3 = 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END', k=1000)}) GROUP BY 1, 2)"


def sections(s, d):
    """The hits of each query as sections of ten labels, with their texts put together."""
    ordered = F.array_sort(F.collect_list(F.struct("vec_id", F.coalesce("document", F.lit("")).alias("t"))))
    rows = asked(s, d).groupBy("query_id", "question", F.col("label").alias("section"))
    return rows.agg(F.array_join(F.transform(ordered, lambda x: F.substring(x["t"], 1, 300)), " ").alias("summary"))


SECTIONS = f"SELECT query_id, question, label AS section, kws, names, lower(string_agg(substr(coalesce(document, ''), 1, 300), ' ' ORDER BY vec_id)) AS low FROM ({ASKED}) GROUP BY query_id, question, label, kws, names"


def in_sections(s, d, chosen):
    hits = asked(s, d).withColumn("section", F.col("label"))
    return top(rerank.fuse(hits.join(chosen.select("query_id", "section"), ["query_id", "section"], "left_semi"), *hybrid(), k=10))


def routed(s, d):
    return in_sections(s, d, rerank.routed(sections(s, d), F.col("summary"), rerank.without_names(kws(), names()), F.lit(4)))


def by_rooms(s, d):
    return in_sections(s, d, rerank.rooms(sections(s, d), F.col("summary"), rerank.without_names(kws(), names())))


def chosen_sql(keep: str) -> str:
    rows = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, section DESC) AS place, max(o) OVER (PARTITION BY query_id) AS best FROM (SELECT *, {share_sql(_rest)} AS o FROM ({SECTIONS}))"
    return fused(*_hybrid, rows=f"SELECT a.* FROM ({ASKED}) a JOIN (SELECT query_id, section FROM ({rows}) WHERE {keep}) c ON c.query_id = a.query_id AND c.section = a.label")


def truth(s, d):
    """Rows of the query's own label with a near number."""
    e = table(s, d, "embeddings").select("vec_id", "label")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"))
    near = e.withColumn("query_id", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda i: (F.floor(F.col("vec_id") / 20) + i) * 20)))
    return near.join(q, "query_id").filter((F.col("label") == F.col("want")) & (F.col("vec_id") != F.col("query_id")) & (F.abs(F.col("vec_id") - F.col("query_id")) < 30)).select("query_id", F.col("vec_id").alias("item"))


TRUTH = "SELECT q.vec_id AS query_id, e.vec_id AS item FROM embeddings q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id AND abs(e.vec_id - q.vec_id) < 30 WHERE q.vec_id % 20 = 0"


def queries_of(s, d):
    return table(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))


def found(s, d):
    """The 50 nearest rows of each query."""
    e = table(s, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.knn_many(e, q, 50).select("query_id", F.col("vec_id").alias("item"), "rank")


def measured(s, d):
    return retrieval_metrics.at_ks(found(s, d), truth(s, d), queries_of(s, d))


METRICS = f"""WITH t AS ({TRUTH}), h AS (SELECT query_id, vec_id AS item, r FROM ({POOL})), q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0),
g AS (SELECT q.query_id, k, count(DISTINCT t.item) AS wanted, count(DISTINCT CASE WHEN h.r <= k THEN t.item END) AS found, coalesce(sum(CASE WHEN h.r <= k THEN 1 / log2(h.r + 1) END), 0) AS dcg
 FROM q CROSS JOIN (SELECT unnest([1, 3, 5, 10, 30, 50]) AS k) LEFT JOIN t ON t.query_id = q.query_id LEFT JOIN h ON h.query_id = t.query_id AND h.item = t.item GROUP BY 1, 2),
m AS (SELECT query_id, k, CAST(found > 0 AS DOUBLE) AS recall_any, CASE WHEN wanted > 0 THEN found / CAST(wanted AS DOUBLE) ELSE 1.0::DOUBLE END AS recall,
 CASE WHEN found > 0 THEN dcg / list_sum(list_transform(range(1, found + 1), lambda i: 1 / log2(i + 1))) ELSE 0.0::DOUBLE END AS ndcg FROM g)"""


def items(s, d):
    """Every query as an item of its label; those of label 3 were not indexed."""
    return table(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("category"), (F.col("label") != 3).alias("indexed"))


def by_category(s, d):
    hits = found(s, d).withColumn("place", F.col("item") + 1)
    out = retrieval_metrics.hits_by_category(hits, truth(s, d), items(s, d), 5, "place")
    return out.withColumn("rate", F.round("rate", 6))


BY_CATEGORY = f"""WITH t AS ({TRUTH}), h AS (SELECT query_id, vec_id AS item FROM ({POOL}) WHERE r <= 5), hit AS (SELECT DISTINCT t.query_id FROM t JOIN h ON h.query_id = t.query_id AND (h.item = t.item OR h.item + 1 = t.item)),
i AS (SELECT vec_id, label, CAST(vec_id IN (SELECT query_id FROM hit) AS BIGINT) AS hit FROM embeddings WHERE vec_id % 20 = 0)
SELECT label AS category, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS total, round(sum(hit) / CAST(count(*) AS DOUBLE), 6) AS rate FROM i WHERE label <> 3 GROUP BY 1
UNION ALL SELECT NULL, CAST(sum(hit) AS BIGINT), count(*), round(sum(hit) / CAST(count(*) AS DOUBLE), 6) FROM i"""


def evidence(s, d):
    """Of each conversation the user's turns as evidence, in parts, and the texts of its first four turns as retrieved."""
    m = table(s, d, MSG)
    wanted = m.filter("role = 'user'").select(F.col("conv_id").alias("query_id"), F.substring("text", 3, 25).alias("text"))
    return m.filter("turn < 4").select(F.col("conv_id").alias("query_id"), "text"), wanted


_strip = "regexp_replace(lower(coalesce({}, '')), '^\\s+|\\s+$', '', 'g')"
EVIDENCE = f"""WITH w AS (SELECT DISTINCT conv_id AS query_id, {_strip.format('substr(text, 3, 25)')} AS e FROM conversations WHERE role = 'user'), r AS (SELECT conv_id AS query_id, {_strip.format('text')} AS r FROM conversations WHERE turn < 4),
f AS (SELECT w.query_id, count(DISTINCT e) AS found FROM w JOIN r ON r.query_id = w.query_id AND (contains(r, e) OR contains(e, r)) GROUP BY 1)
SELECT w.query_id, coalesce(any_value(found), 0) AS found, count(*) AS wanted, round(coalesce(any_value(found), 0) / CAST(count(*) AS DOUBLE), 6) AS recall FROM w LEFT JOIN f ON f.query_id = w.query_id GROUP BY w.query_id"""

PHRASES = ["I did it ", " days ago", "a couple of days ago", "yesterday", "a week ago", " weeks ago", "last week", "a month ago", " months ago", "last month", "last year", "a year ago", "recently", "never"]
_said_sql = "'I did it ' || CASE WHEN conv_id % 13 % 4 = 1 THEN CAST(turn + 2 AS VARCHAR) ELSE '' END || (" + str(PHRASES) + ")[conv_id % 13 + 2]"
TIMES = f"""SELECT conv_id, turn, days, tolerance FROM (SELECT conv_id, turn, CASE WHEN regexp_matches(q, '\\d+\\s+days?\\s+ago') THEN [CAST(regexp_extract(q, '(\\d+)\\s+days?\\s+ago', 1) AS INTEGER), 2]
 WHEN regexp_matches(q, 'a\\s+couple\\s+(of\\s+)?days?\\s+ago') THEN [2, 2] WHEN contains(q, 'yesterday') THEN [1, 1] WHEN regexp_matches(q, 'a\\s+week\\s+ago') THEN [7, 3]
 WHEN regexp_matches(q, '\\d+\\s+weeks?\\s+ago') THEN [7 * CAST(regexp_extract(q, '(\\d+)\\s+weeks?', 1) AS INTEGER), 5] WHEN contains(q, 'last week') THEN [7, 3] WHEN contains(q, 'a month ago') THEN [30, 7]
 WHEN regexp_matches(q, '\\d+\\s+months?\\s+ago') THEN [30 * CAST(regexp_extract(q, '(\\d+)\\s+months?', 1) AS INTEGER), 10] WHEN contains(q, 'last month') THEN [30, 7] WHEN contains(q, 'last year') THEN [365, 30]
 WHEN contains(q, 'a year ago') THEN [365, 30] WHEN contains(q, 'recently') THEN [14, 14] END AS t, t[1] AS days, t[2] AS tolerance FROM (SELECT conv_id, turn, lower({_said_sql}) AS q FROM conversations))"""

MENTIONS = [r"the ([^,.!?\n]{5,60})", r"of ([^,.!?\n]{5,80})"]
_ment = r"regexp_extract_all(lower(text), '{}', 1)"
MENTIONED = f"""WITH f AS (SELECT conv_id, turn, list_concat({_ment.format(MENTIONS[0])}, {_ment.format(MENTIONS[1])}) AS ms FROM conversations WHERE role = 'user'),
e AS (SELECT conv_id, turn, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM f), c AS (SELECT conv_id, turn, i, regexp_replace(regexp_replace(m, '^\\s+|\\s+$', '', 'g'), '[.,;!? ]+$', '') AS m FROM e),
k AS (SELECT conv_id, m, min(turn * 100000 + i) AS p FROM c WHERE length(m) BETWEEN 5 AND 80 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS n FROM k)
SELECT conv_id, 'User has mentioned: ' || string_agg(m, '; ' ORDER BY n) AS document FROM r WHERE n <= 12 GROUP BY 1"""


def metric_tables(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_orderpriority")).agg(F.sum("o_totalprice").alias("value"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)).alias("half"))
    name = F.concat(F.when(F.col("o_orderpriority") < "3", "recall_").otherwise("latency_"), "o_orderpriority").alias("metric")
    return o.select(name, F.col("half").alias("value")), o.select(name, "value")


REGRESSED = """SELECT metric, round(half, 2) AS value, round(value, 2) AS before, round((half - value) / abs(value), 6) AS change FROM (SELECT CASE WHEN o_orderpriority < '3' THEN 'recall_' ELSE 'latency_' END || o_orderpriority AS metric,
 sum(o_totalprice) AS value, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END) AS half FROM orders GROUP BY o_orderpriority) WHERE CASE WHEN contains(metric, 'recall') THEN (half - value) / abs(value) < -0.2 ELSE (half - value) / abs(value) > 0.2 END"""

RULES = [("preferences", 1, ["onthe", "eauier"]), ("advice", 2, ["the", "des", "und"]), ("facts", 1, ["tion"])]
QUESTION_RULES = [(["events", "facts"], ["onthe"]), (["facts"], ["tion", "des"])]
_has = lambda ws: "(" + " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{w}') AS INTEGER)" for w in ws) + ")"


def digest_search(s, d):
    """Nearest digests: each text is stood for by its topics."""
    from loreweave.operators import digest

    t = digest.topics(docs(s, d), ["the", "of", "and"]).select("id", F.array_join("topics", " ").alias("document"))
    return embed.nearest(t, "then this that with", 10).select("rank", "id")


_h = "CAST('0x' || substr(md5(w), 1, 7) AS BIGINT)"
DIGEST_SEARCH = f"""WITH t AS ({TOPICS}), e AS (SELECT id, h % 64 AS slot, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM (SELECT id, {_h} AS h FROM (SELECT id, unnest(string_split(topics, ' ')) AS w FROM t)) GROUP BY 1, 2),
q AS (SELECT h % 64 AS slot, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS q FROM (SELECT {_h} AS h FROM (SELECT unnest(['then', 'this', 'that', 'with']) AS w)) GROUP BY 1), n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM e GROUP BY 1),
s AS (SELECT e.id, round(sum(v * q) / (any_value(norm) * (SELECT sqrt(sum(q * q)) FROM q)), 12) AS s FROM e JOIN q USING (slot) JOIN n ON n.id = e.id WHERE norm > 0 GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY coalesce(s, 0) DESC, id) AS INTEGER) AS rank, id FROM t LEFT JOIN s USING (id) ORDER BY 1 LIMIT 10"""

PLANS = {
    "p6_full_documents": (lambda s, d: transcripts.full_document(table(s, d, MSG)), "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS document FROM conversations GROUP BY 1"),
    "p6_turn_documents": (lambda s, d: transcripts.turn_documents(table(s, d, MSG)), "SELECT conv_id || '_turn_' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS id, text AS document FROM conversations WHERE role = 'user'"),
    "p7_said_documents": (lambda s, d: transcripts.said_document(table(s, d, MSG)), "SELECT conv_id, string_agg(role || ' said, \"' || coalesce(text, '') || '\"', chr(10) ORDER BY turn) AS document FROM conversations GROUP BY 1"),
    "p8_turn_texts": (lambda s, d: table(s, d, MSG).select("conv_id", "turn", transcripts.turn_text(F.col("text"), F.col("role"), F.when(F.col("turn") > 1, F.concat(F.lit("day "), "turn"))).alias("text")), "SELECT conv_id, turn, CASE WHEN turn > 1 THEN '[day ' || turn || '] ' ELSE '' END || '[User] ' || coalesce(text, '') || ' [Assistant] ' || role AS text FROM conversations"),
    "p9_mentions": (lambda s, d: transcripts.mentions(table(s, d, MSG), MENTIONS), MENTIONED),
    "f15_a15_human_messages": (lambda s, d: transcripts.human_messages(table(s, d, MSG), "tion"), "SELECT conv_id, count(*) FILTER (role = 'user' AND NOT contains(coalesce(text, ''), 'tion')) AS n FROM conversations GROUP BY 1"),
    "r2_digest_search": (digest_search, DIGEST_SEARCH),
    "r5_full_turn_search": (lambda s, d: embed.nearest(transcripts.full_document(table(s, d, MSG)).select(F.col("conv_id").alias("id"), "document"), "the of and to", 10).select("rank", "id"), f"WITH t AS (SELECT conv_id AS id, string_agg(text, chr(10) ORDER BY turn) AS topics FROM conversations GROUP BY 1), w AS (SELECT id, {_h} AS h FROM (SELECT id, unnest(regexp_extract_all(lower(topics), '[^\\x20\\x09-\\x0D]+')) AS w FROM t)), e AS (SELECT id, h % 64 AS slot, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM w GROUP BY 1, 2), q AS (SELECT h % 64 AS slot, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS q FROM (SELECT {_h} AS h FROM (SELECT unnest(['the', 'of', 'and', 'to']) AS w)) GROUP BY 1), n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM e GROUP BY 1), s AS (SELECT e.id, round(sum(v * q) / (any_value(norm) * (SELECT sqrt(sum(q * q)) FROM q)), 12) AS s FROM e JOIN q USING (slot) JOIN n ON n.id = e.id WHERE norm > 0 GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY coalesce(s, 0) DESC, id) AS INTEGER) AS rank, id FROM t LEFT JOIN s USING (id) ORDER BY 1 LIMIT 10"),
    "r6_hybrid_v2": (lambda s, d: top(rerank.fuse(asked(s, d), 0.3 * rerank.share(F.col("document"), kws()), days(), k=10)), fused(f"0.3::DOUBLE * {share_sql('kws')}", _days)),
    "r8_hybrid_v4": (lambda s, d: top(rerank.fuse(asked(s, d), 0.3 * rerank.share(F.col("document"), kws()), days(), 0.4 * rerank.share(F.col("document"), names()), k=10)), fused(f"0.3::DOUBLE * {share_sql('kws')}", _days, f"0.4::DOUBLE * {share_sql(_names_distinct)}")),
    "r8_assistant_branch": (lambda s, d: top(rerank.fuse(asked(s, d), 0.3 * rerank.share(F.col("document"), kws()), 0.6 * rerank.share(F.col("document"), quotes()), k=10)), fused(f"0.3::DOUBLE * {share_sql('kws')}", f"0.6::DOUBLE * {_quoted}")),
    "r9_facets": (lambda s, d: top(rerank.fuse(asked(s, d), 0.3 * rerank.share(F.col("document"), kws()), facets(), days(), k=10)), fused(f"0.3::DOUBLE * {share_sql('kws')}", _boost, _days)),
    "r7_r10_layers": (lambda s, d: layered(s, d).withColumn("rank", F.col("rank").cast("int")), _layered),
    "r12_hybrid_v5": (lambda s, d: top(rerank.fuse(asked(s, d).filter("rank <= 30"), *hybrid(), k=10)), fused(*_hybrid, rows=f"SELECT * FROM ({ASKED}) WHERE r <= 30")),
    "r13_routed": (routed, chosen_sql("place <= 4")),
    "r14_rooms": (by_rooms, chosen_sql("best = 0 OR place <= 3")),
    "r15_m6_hits_by_category": (by_category, BY_CATEGORY),
    "r16_j11_evidence_recall": (lambda s, d: retrieval_metrics.evidence_recall(*evidence(s, d)).withColumn("recall", F.round("recall", 6)), EVIDENCE),
    "m1_m2_m4_at_six_k": (lambda s, d: measured(s, d).select("query_id", "k", "recall_any", "recall_all", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg")), f"{METRICS} SELECT query_id, k, recall_any, CAST(recall >= 1 AS DOUBLE) AS recall_all, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM m"),
    "m7_a13_recall_distribution": (lambda s, d: retrieval_metrics.summary(measured(s, d)).select("k", *[F.round(c, 4).alias(c) for c in ("recall_any", "recall", "ndcg")], "perfect", "partial", "zero"), f"{METRICS} SELECT k, round(avg(recall_any), 4) AS recall_any, round(avg(recall), 4) AS recall, round(avg(ndcg), 4) AS ndcg, count(*) FILTER (recall >= 1) AS perfect, count(*) FILTER (recall > 0 AND recall < 1) AS partial, count(*) FILTER (recall = 0) AS zero FROM m GROUP BY k"),
    "x12_relative_times": (lambda s, d: table(s, d, MSG).select("conv_id", "turn", T.relative_time(said()).alias("t")).select("conv_id", "turn", "t.days", "t.tolerance"), TIMES),
    "x9_character_estimate": (lambda s, d: docs(s, d).select("id", T.character_estimate(F.col("document")).alias("n")), "SELECT doc_id AS id, length(coalesce(text, '')) // 4 AS n FROM documents"),
    "x4_lowercase_words": (lambda s, d: docs(s, d).select("id", F.size(T.lowercase_words(F.col("document"))).alias("n")), "SELECT doc_id AS id, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}')) AS INTEGER) AS n FROM documents"),
    "x6_quoted": (lambda s, d: docs(s, d).select("id", F.array_join(T.quoted(F.translate("document", ".", '"')), "|").alias("phrases")), "SELECT doc_id AS id, array_to_string(list_concat(regexp_extract_all(t, '\"([^\"]{3,60})\"', 1), regexp_extract_all(t, '''([^'']{3,60})''', 1)), '|') AS phrases FROM (SELECT doc_id, coalesce(translate(text, '.', '\"'), '') AS t FROM documents)"),
    "x7_capitalised": (lambda s, d: docs(s, d).select("id", F.array_join(F.array_sort(T.capitalised(F.col("document"), ["The", "And"])), " ").alias("names")), "SELECT doc_id AS id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{2,15}'), lambda w: w NOT IN ('The', 'And')))), ' ') AS names FROM documents"),
    "x11_chat_days": (lambda s, d: table(s, d, "orders").select("o_orderkey", F.date_format(T.chat_day(F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" (Sat) 02:21"))), "yyyy-MM-dd").alias("day")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"),
    "a18_regressions": (lambda s, d: retrieval_metrics.regressions(*metric_tables(s, d)).select("metric", F.round("value", 2).alias("value"), F.round("before", 2).alias("before"), F.round("change", 6).alias("change")), REGRESSED),
    "o10_split": (lambda s, d: retrieval_metrics.split(docs(s, d).select("id"), 50, 42), "SELECT doc_id AS id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= 50 THEN 'dev' ELSE 'held_out' END AS part FROM documents"),
    "c7_session_facets": (lambda s, d: docs(s, d).select("id", classify.first_rule(F.col("document"), RULES).alias("facet")), f"SELECT doc_id AS id, CASE WHEN {_has(RULES[0][2])} >= 1 THEN 'preferences' WHEN {_has(RULES[1][2])} >= 2 THEN 'advice' WHEN {_has(RULES[2][2])} >= 1 THEN 'facts' ELSE 'general' END AS facet FROM documents"),
    "c8_question_facets": (lambda s, d: docs(s, d).select("id", F.array_join(classify.question_facets(F.col("document"), QUESTION_RULES), ",").alias("facets")), f"SELECT doc_id AS id, CASE WHEN {_has(['onthe'])} >= 1 THEN 'events,facts,general' WHEN {_has(['tion', 'des'])} >= 1 THEN 'facts,general' ELSE 'general' END AS facets FROM documents"),
    "v5_l2sq_similarity": (lambda s, d: table(s, d, "embeddings").join(F.broadcast(table(s, d, "embeddings").filter("vec_id = 7").select(F.col("embedding").alias("q")))).select("vec_id", F.round(vectors.similarity(vectors.l2sq(F.col("embedding"), F.col("q")), "l2sq"), 4).alias("similarity")), "SELECT e.vec_id, round(greatest(0.0::DOUBLE, 1 - list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 2), 4) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q"),
}
