"""Registered queries over documents, events and conversations read as chunks, facts and messages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loreweave.operators import facts, store, topics, transcripts, vectors
from loreweave.runtime import table


def chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("document"), F.col("lang").alias("domain"), F.col("source").alias("topic"),
        F.lit("").alias("facet"), F.concat(F.lit("2026-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("date"),
    )


CHUNKS = "SELECT doc_id AS id, text AS document, lang AS domain, source AS topic, '' AS facet, '2026-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS date FROM documents"


def fact_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    nxt = F.lead("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return e.select(
        F.concat(F.lit("user_"), F.col("user_id")).alias("subject"), F.col("event_type").alias("predicate"),
        F.concat(F.lit("k_"), F.get_json_object("props", "$.k")).alias("object"), day(F.col("ts")).alias("valid_from"), day(nxt).alias("valid_to"),
    )


FACTS = """SELECT 'user_' || user_id AS subject, event_type AS predicate, 'k_' || json_extract_string(props, '$.k') AS object,
 strftime(ts, '%Y-%m-%d') AS valid_from, strftime(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), '%Y-%m-%d') AS valid_to FROM events"""


def entity_rows(spark, sf_dir):
    f = fact_rows(spark, sf_dir)
    ids = f.select(F.col("subject").alias("id")).unionByName(f.select(F.col("object").alias("id"))).distinct()
    return ids.select("id", F.upper("id").alias("name"))


ENTITIES = f"SELECT id, upper(id) AS name FROM (SELECT subject AS id FROM ({FACTS}) UNION SELECT object FROM ({FACTS}))"


def ranked(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("want"))
    return vectors.knn_many(e, q, 10).withColumn("hit", (F.col("label") == F.col("want")).cast("int"))


RANKED = """SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, hit, s FROM (
 SELECT q.vec_id AS query_id, e.vec_id, CAST(e.label = q.label AS INTEGER) AS hit, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) /
   (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS s,
   row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id) AS r
 FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) WHERE r <= 10"""
NODES = f"""SELECT topic, list_sort(list(DISTINCT domain)) AS domains, count(*) AS n, list_sort(list_reverse_sort(list(DISTINCT date))[1:5]) AS dates
 FROM ({CHUNKS}) WHERE topic <> '' AND topic <> 'general' AND domain <> '' GROUP BY topic"""
MSG = "conversations"

PLANS = {
    "a1_count": (lambda s, d: chunks(s, d).agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM ({CHUNKS})"),
    "a2_taxonomy": (lambda s, d: store.taxonomy(chunks(s, d)), f"SELECT domain, topic, count(*) AS n FROM ({CHUNKS}) GROUP BY 1, 2"),
    "a3_topics_of_domain": (lambda s, d: store.where(chunks(s, d), "en").groupBy("topic").agg(F.count("*").alias("n")), f"SELECT topic, count(*) AS n FROM ({CHUNKS}) WHERE domain = 'en' GROUP BY 1"),
    "a4_a5_g1_topic_nodes": (lambda s, d: topics.nodes(chunks(s, d)).select("topic", F.array_join("domains", ",").alias("domains"), "n", F.array_join("dates", ",").alias("dates")), f"SELECT topic, array_to_string(domains, ',') AS domains, n, array_to_string(dates, ',') AS dates FROM ({NODES})"),
    "g1_j7_topic_edges": (lambda s, d: topics.edges(topics.nodes(chunks(s, d))), f"SELECT topic, a AS domain_a, b AS domain_b, '' AS facet, n FROM ({NODES}), unnest(domains) AS x(a), unnest(domains) AS y(b) WHERE a < b"),
    "g2_traverse": (lambda s, d: topics.traverse(topics.nodes(chunks(s, d)), "src1", 2).drop("connected_via"), f"WITH n AS ({NODES}), h1 AS (SELECT DISTINCT b.topic FROM n a, n b WHERE a.topic = 'src1' AND list_has_any(a.domains, b.domains)), h2 AS (SELECT DISTINCT b.topic FROM n a JOIN h1 USING (topic), n b WHERE list_has_any(a.domains, b.domains)) SELECT topic, CAST(CASE WHEN topic = 'src1' THEN 0 WHEN topic IN (SELECT topic FROM h1) THEN 1 ELSE 2 END AS INTEGER) AS hop, n FROM n WHERE topic = 'src1' OR topic IN (SELECT topic FROM h1) OR topic IN (SELECT topic FROM h2) ORDER BY hop, n DESC, topic LIMIT 50"),
    "g3_o4_bridges": (lambda s, d: topics.bridges(topics.nodes(chunks(s, d)), "de", "en").select("topic", "n"), f"SELECT topic, n FROM ({NODES}) WHERE len(domains) >= 2 AND list_contains(domains, 'de') AND list_contains(domains, 'en') ORDER BY n DESC, topic LIMIT 50"),
    "g5_suggest": (lambda s, d: topics.suggest(topics.nodes(chunks(s, d)), "src1-9"), f"SELECT topic, score FROM (SELECT topic, CASE WHEN contains(topic, 'src1-9') THEN 1.0::DOUBLE WHEN contains(topic, 'src1') OR contains(topic, '9') THEN 0.5::DOUBLE END AS score FROM ({NODES})) WHERE score IS NOT NULL ORDER BY score DESC, topic LIMIT 5"),
    "f1_s7_page": (lambda s, d: store.page(store.where(chunks(s, d), "en", "src3").select("id", "date"), 10, 5), f"SELECT id, date FROM ({CHUNKS}) WHERE domain = 'en' AND topic = 'src3' ORDER BY id LIMIT 10 OFFSET 5"),
    "f2_in_list": (lambda s, d: chunks(s, d).filter(F.col("topic").isin("src1", "src2")).select("id", "topic"), f"SELECT id, topic FROM ({CHUNKS}) WHERE topic IN ('src1', 'src2')"),
    "f12_valid_names": (lambda s, d: table(s, d, "part").select("p_partkey", store.valid_name(F.col("p_name")).alias("ok")), "SELECT p_partkey, coalesce(regexp_full_match(p_name, '[A-Za-z0-9][A-Za-z0-9_ .''-]*') AND NOT contains(p_name, '..') AND length(p_name) <= 128, false) AS ok FROM part"),
    "f13_valid_content": (lambda s, d: chunks(s, d).select("id", store.valid_content(F.col("document"), 5000).alias("ok")), f"SELECT id, coalesce(length(trim(document, E' \\n\\t')) > 0 AND length(document) <= 5000, false) AS ok FROM ({CHUNKS})"),
    "p11_snippets": (lambda s, d: chunks(s, d).select("id", store.snippet(F.col("document")).alias("snippet")), f"SELECT id, CASE WHEN length(t) > 200 THEN substr(t, 1, 197) || '...' ELSE t END AS snippet FROM (SELECT id, replace(regexp_replace(document, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS t FROM ({CHUNKS}))"),
    "p12_chunk_ids": (lambda s, d: chunks(s, d).select("id", store.chunk_id(F.col("topic"), F.col("id")).alias("chunk_id")), f"SELECT id, substr(sha256(topic || CAST(id AS VARCHAR)), 1, 24) AS chunk_id FROM ({CHUNKS})"),
    "p13_entity_ids": (lambda s, d: table(s, d, "customer").select("c_custkey", facts.entity_id(F.col("c_name")).alias("entity")), "SELECT c_custkey, replace(replace(lower(c_name), ' ', '_'), '''', '') AS entity FROM customer"),
    "o8_budget_cut": (lambda s, d: store.within_budget(chunks(s, d).withColumn("cost", F.length("document")), ["topic"], ["id"], "cost", 3200).select("topic", "id", F.col("running_cost").cast("long").alias("running_cost")), f"SELECT topic, id, CAST(c AS BIGINT) AS running_cost FROM (SELECT topic, id, sum(length(document)) OVER (PARTITION BY topic ORDER BY id) AS c FROM ({CHUNKS})) WHERE c <= 3200"),
    "t1_upsert": (lambda s, d: store.upsert(table(s, d, "orders").filter("o_orderkey % 3 <> 0").select("o_orderkey", "o_totalprice"), table(s, d, "orders").filter("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice")), "o_orderkey"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0 UNION ALL SELECT o_orderkey, o_totalprice * 2 FROM orders WHERE o_orderkey % 2 = 0"),
    "t2_insert_missing": (lambda s, d: store.insert_missing(table(s, d, "orders").filter("o_orderkey % 3 <> 0").select("o_orderkey", "o_custkey"), table(s, d, "orders").select("o_orderkey", F.lit(0).cast("long").alias("o_custkey")), "o_orderkey"), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey ELSE 0 END AS o_custkey FROM orders"),
    "t4_delete": (lambda s, d: store.delete(table(s, d, "orders").select("o_orderkey"), table(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "s6_a8_changed_files": (lambda s, d: store.changed_files(table(s, d, "orders").select(F.col("o_orderkey").alias("source_file"), F.col("o_orderdate").alias("mtime")), table(s, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("source_file"), F.col("o_orderdate").alias("mtime"))).select("source_file"), "SELECT o_orderkey AS source_file FROM orders WHERE o_orderkey % 2 <> 0"),
    "k4_f4_about_entity": (lambda s, d: facts.about(fact_rows(s, d), entity_rows(s, d), "user 7", "both", "2024-01-15"), f"WITH f AS (SELECT * FROM ({FACTS}) WHERE valid_from <= '2024-01-15' AND (valid_to IS NULL OR valid_to >= '2024-01-15')), e AS ({ENTITIES}) SELECT 'outgoing' AS direction, 'user 7' AS subject, predicate, name AS object, valid_from, valid_to, valid_to IS NULL AS current FROM f JOIN e ON object = id WHERE subject = 'user_7' UNION ALL SELECT 'incoming', name, predicate, 'user 7', valid_from, valid_to, valid_to IS NULL FROM f JOIN e ON subject = id WHERE object = 'user_7'"),
    "k5_j3_relation": (lambda s, d: facts.relation(fact_rows(s, d), entity_rows(s, d), "click", "2024-01-10"), f"SELECT a.name AS subject, predicate, b.name AS object, valid_from, valid_to FROM ({FACTS}) f JOIN ({ENTITIES}) a ON subject = a.id JOIN ({ENTITIES}) b ON object = b.id WHERE predicate = 'click' AND valid_from <= '2024-01-10' AND (valid_to IS NULL OR valid_to >= '2024-01-10')"),
    "k6_o2_timeline": (lambda s, d: facts.timeline(fact_rows(s, d).filter("subject = 'user_3'")).select("subject", "predicate", "object", "valid_from"), f"SELECT subject, predicate, object, valid_from FROM ({FACTS}) WHERE subject = 'user_3' ORDER BY valid_from NULLS LAST, subject, predicate, object LIMIT 100"),
    "k3_invalidate": (lambda s, d: facts.invalidate(fact_rows(s, d), "user_3", "click", "k_1", "2024-02-01"), f"SELECT subject, predicate, object, valid_from, CASE WHEN subject = 'user_3' AND predicate = 'click' AND object = 'k_1' AND valid_to IS NULL THEN '2024-02-01' ELSE valid_to END AS valid_to FROM ({FACTS})"),
    "k7_a6_fact_stats": (lambda s, d: facts.stats(fact_rows(s, d), entity_rows(s, d)).withColumn("predicates", F.array_join("predicates", ",")), f"SELECT (SELECT count(*) FROM ({ENTITIES})) AS entities, count(*) AS facts, count(*) FILTER (valid_to IS NULL) AS current, count(*) FILTER (valid_to IS NOT NULL) AS expired, array_to_string(list_sort(list(DISTINCT predicate)), ',') AS predicates FROM ({FACTS})"),
    "n8_transcripts": (lambda s, d: transcripts.transcript(table(s, d, MSG)), "SELECT conv_id, string_agg(CASE WHEN b IS NULL THEN '' WHEN role = 'assistant' AND b = 'user' THEN chr(10) ELSE chr(10) || chr(10) END || CASE WHEN role = 'user' THEN '> ' || text ELSE text END, '' ORDER BY turn) AS transcript FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) GROUP BY conv_id"),
    "p6_user_documents": (lambda s, d: transcripts.user_document(table(s, d, MSG)), "SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS document FROM conversations GROUP BY conv_id"),
    "w4_next_role": (lambda s, d: transcripts.next_role(table(s, d, MSG)).select("conv_id", "turn", "next_role"), "SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations"),
    "st1_save_points": (lambda s, d: transcripts.save_points(table(s, d, MSG), 2).select("conv_id", "turn", F.col("n_human").cast("int").alias("n_human")), "SELECT conv_id, turn, CAST(n AS INTEGER) AS n_human FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') WHERE n % 2 = 0"),
    "a15_human_messages": (lambda s, d: table(s, d, MSG).groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n")), "SELECT conv_id, count(*) FILTER (role = 'user') AS n FROM conversations GROUP BY 1"),
    "v3_w1_batched_knn": (lambda s, d: ranked(s, d).select("query_id", "rank", "vec_id", "similarity"), f"SELECT query_id, rank, vec_id, round(s, 3) AS similarity FROM ({RANKED})"),
    "v6_f6_near_duplicates": (lambda s, d: ranked(s, d).filter("rank <= 5 and similarity >= 0.4").select("query_id", "vec_id"), f"SELECT query_id, vec_id FROM ({RANKED}) WHERE rank <= 5 AND round(s, 3) >= 0.4"),
}
