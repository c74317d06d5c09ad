"""Registered queries on writing facts, graph statistics, store writes, layers and text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.operators import embed, facts, layers, store, topics
from loreweave.plans.store_plans import CHUNKS, ENTITIES, FACTS, NODES, chunks, entity_rows, fact_rows
from loreweave.runtime import table


def order_topics(s, d):
    """Orders as topics in the domains of their suppliers: a graph of several hops."""
    rows = table(s, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("topic"), F.concat(F.lit("s"), "l_suppkey").alias("domain"), F.lit("").alias("facet"), F.lit("").alias("date"))
    return topics.nodes(rows)


ORDERS = "SELECT 'o' || l_orderkey AS topic, 's' || l_suppkey AS domain, count(*) AS n FROM lineitem GROUP BY 1, 2"
TRAVERSE = f"""WITH e AS ({ORDERS}), c AS (SELECT topic, sum(n) AS n FROM e GROUP BY 1),
h1 AS (SELECT DISTINCT b.topic, 'o1' AS parent FROM e a JOIN e b USING (domain) WHERE a.topic = 'o1' AND b.topic <> 'o1'),
h2 AS (SELECT b.topic, min(a.topic) AS parent FROM e a JOIN h1 ON a.topic = h1.topic JOIN e b USING (domain) WHERE b.topic <> 'o1' AND b.topic NOT IN (SELECT topic FROM h1) GROUP BY 1),
r AS (SELECT 'o1' AS topic, 0 AS hop, NULL AS parent UNION ALL SELECT topic, 1, parent FROM h1 UNION ALL SELECT topic, 2, parent FROM h2),
v AS (SELECT r.topic, string_agg(x.domain, ',' ORDER BY x.domain) AS via FROM r JOIN e x ON x.topic = r.topic JOIN e y ON y.topic = r.parent AND y.domain = x.domain GROUP BY 1)
SELECT r.topic, CAST(hop AS INTEGER) AS hop, CAST(n AS BIGINT) AS n, via AS connected_via FROM r JOIN c USING (topic) LEFT JOIN v USING (topic) ORDER BY hop, n DESC, topic LIMIT 50"""


def filed(s, d):
    """Documents as chunks with a file and a weight that is a number, no number, or absent."""
    i = F.col("doc_id")
    weight = F.when(i % 5 == 0, "5").when(i % 5 == 1, "high").when(i % 5 == 3, (i % 100 / 10).cast("string")).when(i % 5 == 4, "2.5")
    return table(s, d, "documents").select(
        i.alias("id"), F.col("text").alias("document"), F.col("lang").alias("domain"), F.col("source").alias("topic"),
        F.concat(F.lit("in/"), "source", F.lit("/"), i.cast("string"), F.lit(".md")).alias("source_file"), weight.alias("weight"),
    )


FILED = """SELECT doc_id AS id, text AS document, lang AS domain, source AS topic, 'in/' || source || '/' || doc_id || '.md' AS source_file,
 CASE doc_id % 5 WHEN 0 THEN '5' WHEN 1 THEN 'high' WHEN 3 THEN CAST(doc_id % 100 / 10 AS VARCHAR) WHEN 4 THEN '2.5' END AS weight FROM documents"""


def snip(most: int) -> str:
    return f"CASE WHEN length(t) > {most} THEN substr(t, 1, {most - 3}) || '...' ELSE t END"


CLEAN = "replace(regexp_replace(document, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS t"
STORY = f"""WITH top AS (SELECT *, coalesce(try_cast(weight AS DOUBLE), 3.0::DOUBLE) AS w, {CLEAN} FROM ({FILED}) ORDER BY w DESC, id LIMIT 15),
r AS (SELECT topic, w, id, '  - ' || {snip(200)} || '  (' || id || '.md)' AS line FROM top),
o AS (SELECT *, row_number() OVER (ORDER BY topic, w DESC, id) AS place, row_number() OVER (PARTITION BY topic ORDER BY w DESC, id) AS first FROM r),
u AS (SELECT *, sum(length(line) + CASE WHEN first = 1 THEN length(topic) + 3 ELSE 0 END) OVER (ORDER BY place) AS used FROM o),
s AS (SELECT coalesce(min(place) FILTER (used > 3200), 1000) AS stop FROM u)
SELECT CAST(place * 2 - 1 AS INTEGER) AS "at", topic, chr(10) || '[' || topic || ']' AS line FROM u, s WHERE first = 1 AND place <= stop
UNION ALL SELECT CAST(place * 2 AS INTEGER), topic, line FROM u, s WHERE place < stop UNION ALL SELECT CAST(stop * 2 AS INTEGER), '', '  ... (more by search)' FROM s WHERE stop < 1000"""

QUESTION = "the of and to in"
_words = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
EMBEDDED = f"""SELECT id, CAST(h % 64 AS INTEGER) AS slot, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM (
 SELECT id, CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) AS h FROM (SELECT doc_id AS id, unnest({_words.format('lower(text)')}) AS w FROM documents)) GROUP BY ALL"""
ASKED = f"""SELECT CAST(h % 64 AS INTEGER) AS slot, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS q FROM (
 SELECT CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) AS h FROM (SELECT unnest({_words.format(f"'{QUESTION}'")}) AS w)) GROUP BY ALL"""
SEARCHED = f"""WITH e AS ({EMBEDDED}), q AS ({ASKED}), n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM e GROUP BY 1),
s AS (SELECT e.id, sum(v * q) / (any_value(norm) * (SELECT sqrt(sum(q * q)) FROM q)) AS s FROM e JOIN q USING (slot) JOIN n ON n.id = e.id WHERE norm > 0 GROUP BY 1),
r AS (SELECT row_number() OVER (ORDER BY round(coalesce(s, 0), 12) DESC, d.doc_id) AS rank, d.*, round(coalesce(s, 0), 3) AS similarity FROM documents d LEFT JOIN s ON s.id = d.doc_id WHERE lang = 'en')"""


def messages_as_entries(s, d):
    m = table(s, d, "conversations")
    at = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("conv_id") * 600 + F.col("turn") * 60)
    return m.select(F.col("role").alias("agent"), F.coalesce("text", F.lit("")).alias("entry"), F.concat(F.lit("t"), F.col("conv_id") % 3).alias("topic"), at.alias("filed_at"))


DIARY = """SELECT 'diary_agent_' || role || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || substr(sha256(substr(coalesce(text, ''), 1, 50)), 1, 12) AS id,
 coalesce(text, '') AS document, 'agent_' || role AS domain, 't' || (conv_id % 3) AS subject, strftime(ts, '%Y-%m-%d') AS date, ts FROM (SELECT *, make_timestamp((1767225600 + conv_id * 600 + turn * 60) * 1000000) AS ts FROM conversations)"""


def named_customers(s, d):
    return table(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"))


def known_entities(s, d):
    """Customers of every second key, as entities."""
    return facts.add_entities(s.createDataFrame([], "id string, name string, type string"), table(s, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), F.lit("known").alias("type")))


_eid = "replace(replace(lower({}), ' ', '_'), '''', '')"
KNOWN = f"SELECT {_eid.format('c_name')} AS id, c_name AS name, 'known' AS type FROM customer WHERE c_custkey % 2 = 0"


def order_facts(s, d):
    """Facts of customers and order states, with display names, some of them repeated and some closed."""
    o = table(s, d, "orders").join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return o.select(
        F.col("c_name").alias("subject"), F.concat(F.lit("Has Order "), "o_orderstatus").alias("predicate"), F.col("o_orderpriority").alias("object"),
        day("o_orderdate").alias("valid_from"), F.when(F.col("o_orderstatus") == "F", day(F.date_add("o_orderdate", 30))).alias("valid_to"),
    )


ORDER_FACTS = """SELECT c_name AS subject, 'Has Order ' || o_orderstatus AS predicate, o_orderpriority AS object, strftime(o_orderdate, '%Y-%m-%d') AS valid_from,
 CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS valid_to FROM orders JOIN customer ON o_custkey = c_custkey"""
KEYED = f"SELECT {_eid.format('subject')} AS subject, replace(lower(predicate), ' ', '_') AS predicate, {_eid.format('object')} AS object, valid_from, valid_to FROM ({ORDER_FACTS})"


def people(s, d):
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    name = lambda x: F.concat(F.lit("P"), x.cast("string"))
    return c.select(
        name(k).alias("name"), F.lower("c_mktsegment").alias("type"), F.when(k % 3 == 0, name(k + 1)).alias("parent"), F.when(k % 5 == 0, name(k + 2)).alias("partner"),
        F.when(k % 2 == 0, F.array(name(k + 3), name(k + 4))).alias("siblings"), F.array(F.lit("chess")).alias("interests"), F.when(k % 6 == 0, F.lit("2015-04-01")).alias("born"),
    )


SEEDED = """SELECT 'P' || c_custkey AS subject, 'child_of' AS predicate, 'P' || (c_custkey + 1) AS object, CASE WHEN c_custkey % 6 = 0 THEN '2015-04-01' END AS valid_from FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'P' || c_custkey, 'married_to', 'P' || (c_custkey + 2), NULL FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 'P' || c_custkey, 'sibling_of', 'P' || (c_custkey + unnest([3, 4])), NULL FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'P' || c_custkey, 'loves', 'chess', NULL FROM customer UNION ALL SELECT 'P' || c_custkey, 'is_a', lower(c_mktsegment), NULL FROM customer"""


def file_chunks(s, d, new: bool):
    """The lines of orders as the chunks of files; the newer listing lacks the last line of every third order."""
    li = table(s, d, "lineitem").select(F.concat(F.lit("f"), "l_orderkey").alias("source_file"), (F.col("l_linenumber") - 1).alias("chunk_index"), "l_orderkey", F.col("l_partkey").alias("content"))
    if not new:
        return li.drop("l_orderkey")
    return li.filter("l_orderkey % 3 = 0 and chunk_index < 2").select("source_file", "chunk_index", (F.col("content") + 1).alias("content"))


_FILES = "SELECT 'f' || l_orderkey AS source_file, CAST(l_linenumber - 1 AS INTEGER) AS chunk_index, l_orderkey, l_partkey AS content FROM lineitem"
_NEW = f"SELECT source_file, chunk_index, content + 1 AS content FROM ({_FILES}) WHERE l_orderkey % 3 = 0 AND chunk_index < 2"

PLANS = {
    "g2_j8_connected_via": (lambda s, d: topics.traverse(order_topics(s, d), "o1", 2).withColumn("connected_via", F.array_join("connected_via", ",")), TRAVERSE),
    "g4_a7_graph_stats": (lambda s, d: topics.stats(topics.nodes(chunks(s, d))), f"SELECT count(*) AS topics, count(*) FILTER (len(domains) >= 2) AS bridges, CAST(sum(len(domains) * (len(domains) - 1) / 2) AS BIGINT) AS edges FROM ({NODES})"),
    "g4_a7_topics_by_domain": (lambda s, d: topics.topics_by_domain(topics.nodes(chunks(s, d))), f"SELECT unnest(domains) AS domain, count(*) AS topics FROM ({NODES}) GROUP BY 1"),
    "g4_a7_widest": (lambda s, d: topics.widest(topics.nodes(chunks(s, d))), f"SELECT topic, CAST(len(domains) AS INTEGER) AS n_domains, n FROM ({NODES}) WHERE len(domains) >= 2 ORDER BY 2 DESC, n DESC, topic LIMIT 10"),
    "k1_add_entities": (lambda s, d: facts.add_entities(known_entities(s, d), named_customers(s, d)), f"SELECT {_eid.format('c_name')} AS id, c_name AS name, c_mktsegment AS type FROM customer"),
    "j5_missing_entities": (lambda s, d: facts.add_missing_entities(known_entities(s, d), order_facts(s, d)), f"SELECT * FROM ({KNOWN}) UNION ALL SELECT {_eid.format('name')} AS id, min(name) AS name, 'unknown' AS type FROM (SELECT subject AS name FROM ({ORDER_FACTS}) UNION SELECT object FROM ({ORDER_FACTS})) WHERE {_eid.format('name')} NOT IN (SELECT id FROM ({KNOWN})) GROUP BY 1"),
    "k2_j6_add_facts": (lambda s, d: facts.add_facts(facts.named_facts(order_facts(s, d)).filter("valid_from < '1995-01-01'"), facts.named_facts(order_facts(s, d)).filter("valid_from >= '1995-01-01'")).groupBy("subject", "predicate", "object").agg(F.count("*").alias("n"), F.max("valid_from").alias("last"), F.count_if(F.col("valid_to").isNull()).alias("open")), f"WITH k AS ({KEYED}), old AS (SELECT * FROM k WHERE valid_from < '1995-01-01'), new AS (SELECT *, count(*) FILTER (valid_to IS NULL) OVER (PARTITION BY subject, predicate, object ORDER BY valid_from, valid_to NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM k WHERE valid_from >= '1995-01-01'), every AS (SELECT * FROM old UNION ALL SELECT subject, predicate, object, valid_from, valid_to FROM new WHERE b = 0 AND NOT EXISTS (SELECT 1 FROM old WHERE old.subject = new.subject AND old.predicate = new.predicate AND old.object = new.object AND old.valid_to IS NULL)) SELECT subject, predicate, object, count(*) AS n, max(valid_from) AS last, count(*) FILTER (valid_to IS NULL) AS open FROM every GROUP BY 1, 2, 3"),
    "k2_fact_ids": (lambda s, d: facts.named_facts(order_facts(s, d)).select("fact_id").distinct(), f"SELECT DISTINCT 't_' || subject || '_' || predicate || '_' || object || '_' || substr(sha256(coalesce(valid_from, '')), 1, 12) AS fact_id FROM ({KEYED})"),
    "k8_seed": (lambda s, d: facts.seed(people(s, d)).drop("valid_to"), SEEDED),
    "f3_by_ids": (lambda s, d: store.by_ids(chunks(s, d).select("id", "topic"), table(s, d, "labels").select(F.col("doc_id").alias("id"))), f"SELECT id, topic FROM ({CHUNKS}) WHERE id IN (SELECT doc_id FROM labels)"),
    "t3_add_outcome": (lambda s, d: store.add_outcome(table(s, d, "labels").select(F.col("doc_id").alias("id")), chunks(s, d).select("id")), f"SELECT id, CASE WHEN id IN (SELECT doc_id FROM labels) THEN 'already_exists' ELSE 'added' END AS outcome FROM ({CHUNKS})"),
    "p12_content_ids": (lambda s, d: chunks(s, d).select("id", store.content_id(F.col("domain"), F.col("topic"), F.col("document")).alias("chunk_id")), f"SELECT id, 'chunk_' || domain || '_' || topic || '_' || substr(sha256(domain || topic || substr(document, 1, 100)), 1, 24) AS chunk_id FROM ({CHUNKS})"),
    "t5_audit": (lambda s, d: store.audit_rows("add_chunk", chunks(s, d), "id", "document"), f"SELECT 'add_chunk' AS operation, id AS target, length(coalesce(document, '')) AS content_length, substr(coalesce(document, ''), 1, 200) AS content_preview FROM ({CHUNKS})"),
    "t6_diary_write": (lambda s, d: store.diary_rows(messages_as_entries(s, d)).select("id", "document", "domain", "subject", "date"), f"SELECT id, document, domain, subject, date FROM ({DIARY})"),
    "t6_o5_diary_read": (lambda s, d: store.diary(store.diary_rows(messages_as_entries(s, d)), "Assistant", 20).select("id", "document"), f"SELECT id, document FROM ({DIARY}) WHERE domain = 'agent_assistant' ORDER BY ts DESC, id LIMIT 20"),
    "t7_stale_chunks": (lambda s, d: store.stale_chunks(file_chunks(s, d, False), file_chunks(s, d, True)), f"SELECT source_file, chunk_index, content FROM ({_FILES}) f JOIN (SELECT source_file, max(chunk_index) AS m FROM ({_NEW}) GROUP BY 1) USING (source_file) WHERE chunk_index > m"),
    "t7_replace_files": (lambda s, d: store.replace_files(file_chunks(s, d, False), file_chunks(s, d, True)), f"SELECT source_file, chunk_index, content FROM ({_FILES}) WHERE source_file NOT IN (SELECT source_file FROM ({_NEW})) UNION ALL SELECT * FROM ({_NEW})"),
    "t1_upsert_repeats": (lambda s, d: store.upsert(table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.lit(0.0).alias("price")).distinct(), table(s, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"))), "SELECT o_custkey AS id, coalesce(max(o_totalprice) FILTER (o_orderkey % 2 = 0), 0.0::DOUBLE) AS price FROM orders GROUP BY 1"),
    "o1_importance": (lambda s, d: filed(s, d).select("id", store.importance(F.lit(None), F.col("weight")).alias("weight")).orderBy(F.desc("weight"), "id").limit(15), f"SELECT id, coalesce(try_cast(weight AS DOUBLE), 3.0::DOUBLE) AS weight FROM ({FILED}) ORDER BY weight DESC, id LIMIT 15"),
    "x18_names": (lambda s, d: filed(s, d).select("id", store.basename(F.col("source_file")).alias("name"), store.stem(F.col("source_file")).alias("stem")), f"SELECT id, id || '.md' AS name, CAST(id AS VARCHAR) AS stem FROM ({FILED})"),
    "l1_story_lines": (lambda s, d: layers.story_lines(filed(s, d)), STORY),
    "l2_recall": (lambda s, d: layers.recall(filed(s, d), "en", "src2"), f"SELECT id, '  [src2] ' || {snip(300)} || '  (' || id || '.md)' AS line FROM (SELECT *, {CLEAN} FROM ({FILED})) WHERE domain = 'en' AND topic = 'src2' ORDER BY id LIMIT 10"),
    "l3_p10_search": (lambda s, d: layers.search(filed(s, d), QUESTION, "en"), f"{SEARCHED} SELECT CAST(rank AS INTEGER) AS rank, text, lang AS domain, source AS topic, doc_id || '.md' AS source_file, similarity FROM r WHERE rank <= 5"),
    "l3_search_lines": (lambda s, d: layers.search_lines(filed(s, d), QUESTION, "en"), f"{SEARCHED} SELECT CAST(rank AS INTEGER) AS rank, '  [' || rank || '] en/' || source || ' (sim=' || similarity || ')' || chr(10) || '      ' || {snip(300)} || chr(10) || '      src: ' || doc_id || '.md' AS lines FROM (SELECT *, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS t FROM r) WHERE rank <= 5"),
    "v1_hashed_embeddings": (lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(embed.hashed(F.col("text"))).alias("at", "value")).filter("value <> 0").select("doc_id", "at", F.round("value", 5).alias("value")), f"WITH e AS ({EMBEDDED}) SELECT id AS doc_id, slot AS \"at\", round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 5) AS value FROM e WHERE v <> 0"),
    "f5_open_facts": (lambda s, d: facts.open_facts(fact_rows(s, d)).select("subject", "predicate", "object", "valid_from"), f"SELECT subject, predicate, object, valid_from FROM ({FACTS}) WHERE valid_to IS NULL"),
    "k1_entities_of_facts": (lambda s, d: entity_rows(s, d), ENTITIES),
}
