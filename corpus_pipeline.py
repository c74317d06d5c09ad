"""A corpus pipeline of five stages, each applying one operator to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.decontamination import decontaminate
from loreweave.llm.jaccard_join import near_components
from loreweave.llm.mixing import mixed_documents
from loreweave.llm.sharding import shard_documents
from loreweave.llm.toxicity import toxicity_scores
from loreweave.runtime import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    whole = docs.select("doc_id", "text", F.struct("*").alias("row"))  # a column of documents may have the name of a result
    scored = toxicity_scores(whole, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 0").select("row.*")


def with_row_key(docs: DataFrame) -> DataFrame:
    """Append row_key, a number for each row of stored Parquet files that is the same in every scan."""
    rows = docs.select("*", F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_index"))
    files = sorted(r["row_file"] for r in rows.select("row_file").distinct().collect())
    numbers = docs.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], "row_file string, file_number long")
    key = F.shiftleft("file_number", 40).bitwiseOR(F.col("row_index")).alias("row_key")
    return rows.join(F.broadcast(numbers), "row_file").select(*docs.columns, key)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that of the smallest doc_id: shingles of five words, a similarity of 0.8 or more."""
    keyed = with_row_key(docs)
    found = near_components(keyed.select(F.col("row_key").alias("doc_id"), "text"), width=5, percent=80).filter("doc_id <> component_id")
    linked = found.select(F.col("doc_id").alias("row_key"), "component_id")
    members = materialize(linked.unionByName(linked.select(F.col("component_id").alias("row_key"), "component_id").distinct()), "members")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_key")
    stays = members.join(keyed.select("row_key", "doc_id"), "row_key").groupBy("component_id").agg(F.min(order).alias("least")).select(F.col("least.row_key").alias("row_key"))
    gone = members.join(stays, "row_key", "left_anti").select("row_key")
    return keyed.join(gone, "row_key", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    hit = decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_hash"))
    return docs.join(hit, same, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix."""
    return shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL can't express the learned lexicon of the first stage; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of sf_dir, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
