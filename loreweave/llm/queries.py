"""The registered queries of this subpackage and the SQL that some can be held against.

Each query applies its operator to the whole of its table with production
parameters and derives the digest columns that its contract names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm import decontamination, jaccard_join, lm_scoring, mixing, quality_classifier, quality_rules, sharding, substring_dedup, token_count, toxicity
from loreweave.runtime import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """vocabulary: the tokenizer file; the public word vocabulary where none is given."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return token_count.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).drop("text")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_token_counts": op3_token_counts,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_mixing": op5_mixing,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_toxicity": op8_toxicity,
        "op9_quality_rules": op9_quality_rules,
        "op10_sharding": op10_sharding,
    }


_OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(ws[s : s + 9], ' ') AS k, least(len(ws), 10) AS n
  FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(s) WHERE len(ws) > 0
), lens AS (SELECT DISTINCT n FROM win
), occ AS (
  SELECT d.doc_id, win.item_id, d.s, d.n FROM (
    SELECT doc_id, n, s, array_to_string(ws[s : s + n - 1], ' ') AS k
    FROM w, lens, unnest(range(1, len(ws) - n + 2)) AS t(s) WHERE len(ws) >= n
  ) d JOIN win ON d.k = win.k AND d.n = win.n
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(s, s + n)) AS t(p) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), win AS (SELECT doc_id, s, array_to_string(ws[s : s + 49], ' ') AS k FROM w, unnest(range(1, len(ws) - 48)) AS t(s) WHERE len(ws) >= 50
), least AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k
), gone AS (SELECT DISTINCT doc_id, p FROM win JOIN least USING (k), unnest(range(s, s + 50)) AS t(p) WHERE first < doc_id
), each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w
), kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM each e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_OP7_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents
), s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS k FROM w, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS t(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(r.b, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": _OP1_SQL, "op4_substring_dedup": _OP4_SQL, "op7_jaccard_join": _OP7_SQL}
