"""The functions a caller of the engine has, over a store of chunks, entities and facts in snapshot tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators import chunking, classify, digest, embed, entities, facts, layers, store, topics
from loreweave.sources.snapshots import SnapshotTable

CHUNKS = "id string, document string, domain string, topic string, facet string, source_file string, chunk_index int, added_by string, filed_at timestamp, date string, subject string, agent string, weight string"
ENTITIES = "id string, name string, type string"
FACTS = "subject string, predicate string, object string, valid_from string, valid_to string, fact_id string"


class Memory:
    """Every write is checked, noted in the audit log, and makes a new version of its table; every read is a DataFrame."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.chunks, self.entities, self.facts = (SnapshotTable(spark, f"{self.path}/{n}", s) for n, s in (("chunks", CHUNKS), ("entities", ENTITIES), ("facts", FACTS)))

    def _nodes(self) -> DataFrame:
        return topics.nodes(self.chunks.read())

    def _note(self, operation: str, rows: DataFrame, id_col: str, text: str) -> None:
        store.append_audit(store.audit_rows(operation, rows, id_col, text), f"{self.path}/audit")

    def _row(self, schema: str, **values: object) -> DataFrame:
        return self.spark.createDataFrame([tuple(values.get(c.split()[0]) for c in schema.split(", "))], schema)

    def _valid(self, names: list[str], content: str | None = None) -> bool:
        checks = [store.valid_name(F.lit(n)) for n in names] + ([store.valid_content(F.lit(content))] if content is not None else [])
        return all(self.spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(checks)]).first())

    # reads on chunks
    def status(self) -> DataFrame:
        """domain, topic, n of all chunks."""
        return store.taxonomy(self.chunks.read())

    taxonomy = status

    def list_domains(self) -> DataFrame:
        return self.chunks.read().groupBy("domain").agg(F.count("*").alias("n"))

    def list_topics(self, domain: str | None = None) -> DataFrame:
        return store.where(self.chunks.read(), domain).groupBy("topic").agg(F.count("*").alias("n"))

    def search(self, query: str, domain: str | None = None, topic: str | None = None, limit: int = 5) -> DataFrame:
        return layers.search(self.chunks.read(), query, domain, topic, limit)

    def check_duplicate(self, content: str, threshold: float = 0.9) -> DataFrame:
        return embed.near_copies(self.chunks.read(), content, threshold).select("id", "domain", "topic", F.round("similarity", 3).alias("similarity"), store.snippet(F.col("document"), 203).alias("content"))

    def codec_spec(self) -> str:
        return 'domain|topic|date|file, then 0:NAMES|topics|"key sentence"|moods|flags; names are codes of three letters, parts are joined by + or _'

    # the topic graph
    def traverse(self, start: str, max_hops: int = 2) -> DataFrame:
        return topics.traverse(self._nodes(), start, max_hops)

    def suggest(self, query: str) -> DataFrame:
        return topics.suggest(self._nodes(), query)

    def find_bridges(self, domain_a: str | None = None, domain_b: str | None = None) -> DataFrame:
        return topics.bridges(self._nodes(), domain_a, domain_b)

    def graph_stats(self) -> DataFrame:
        return topics.stats(self._nodes())

    # writes on chunks
    def add(self, domain: str, topic: str, content: str, source_file: str = "", added_by: str = "api") -> dict:
        """Store a text word for word; a text that is there already is left as it is."""
        if not self._valid([domain, topic], content):
            return {"success": False, "error": "a name or the content is not valid"}
        row = self._row(CHUNKS, document=content, domain=domain, topic=topic, facet="", source_file=source_file, chunk_index=0, added_by=added_by, filed_at=datetime.datetime.now())
        row = row.withColumn("id", store.content_id(F.col("domain"), F.col("topic"), F.col("document")))
        self._note("add", row, "id", "document")
        outcome = store.add_outcome(self.chunks.read(), row).first()
        if outcome["outcome"] == "added":
            self.chunks.write(store.insert_missing(self.chunks.read(), row))
        return {"success": True, "id": outcome["id"], "outcome": outcome["outcome"]}

    def delete(self, chunk_id: str) -> dict:
        found = self.chunks.read().filter(F.col("id") == chunk_id)
        if found.isEmpty():
            return {"success": False, "error": f"not found: {chunk_id}"}
        self._note("delete", found, "id", "document")
        self.chunks.delete(found.select("id"))
        return {"success": True, "id": chunk_id}

    def diary_write(self, agent: str, entry: str, topic: str = "general") -> dict:
        if not self._valid([agent], entry):
            return {"success": False, "error": "the name or the entry is not valid"}
        row = store.diary_rows(self._row("agent string, entry string, topic string, filed_at timestamp", agent=agent, entry=entry, topic=topic, filed_at=datetime.datetime.now()))
        row = row.select(*[(F.col(c) if c in row.columns else F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in CHUNKS.split(", "))])
        self._note("diary_write", row, "id", "document")
        self.chunks.write(store.insert_missing(self.chunks.read(), row))
        return {"success": True, "id": row.first()["id"]}

    def diary_read(self, agent: str, last: int = 10) -> DataFrame:
        return store.diary(self.chunks.read(), agent, last).select("date", "filed_at", F.col("subject").alias("topic"), F.col("document").alias("content"))

    # facts
    def kg_query(self, entity: str, as_of: str | None = None, direction: str = "both") -> DataFrame:
        return facts.about(self.facts.read(), self.entities.read(), entity, direction, as_of)

    def kg_add(self, subject: str, predicate: str, object_: str, valid_from: str | None = None) -> dict:
        if not self._valid([subject, predicate, object_]):
            return {"success": False, "error": "a name is not valid"}
        said = self._row("subject string, predicate string, object string, valid_from string, valid_to string", subject=subject, predicate=predicate, object=object_, valid_from=valid_from)
        row = facts.named_facts(said)
        self._note("kg_add", row, "fact_id", "fact_id")
        self.entities.write(facts.add_missing_entities(self.entities.read(), said))
        self.facts.write(facts.add_facts(self.facts.read(), row))
        return {"success": True, "fact_id": row.first()["fact_id"]}

    def kg_invalidate(self, subject: str, predicate: str, object_: str, ended: str | None = None) -> dict:
        """Close an open fact, today by default."""
        ended = ended or datetime.date.today().isoformat()
        key = facts.named_facts(self._row("subject string, predicate string, object string, valid_from string, valid_to string", subject=subject, predicate=predicate, object=object_)).first()
        self._note("kg_invalidate", self._row("fact string", fact=key["fact_id"]), "fact", "fact")
        self.facts.write(facts.invalidate(self.facts.read(), key["subject"], key["predicate"], key["object"], ended))
        return {"success": True, "ended": ended}

    def kg_timeline(self, entity: str | None = None) -> DataFrame:
        rows = self.facts.read()
        if entity:
            key = facts.entity_id(F.lit(entity))
            rows = rows.filter((F.col("subject") == key) | (F.col("object") == key))
        return facts.timeline(rows)

    def kg_stats(self) -> DataFrame:
        return facts.stats(self.facts.read(), self.entities.read())

    # texts
    def extract_memories(self, texts: DataFrame, markers: dict[str, list[str]], least: float = 0.3) -> DataFrame:
        return classify.memories(texts, chunking.segments(F.col("document")), markers, [], [], [], least)

    def detect_entities(self, texts: DataFrame, stop: list[str]) -> DataFrame:
        return entities.detect(texts, stop)

    def compress(self, stop: list[str], moods: list[tuple[str, str]], flags: list[tuple[str, str]], decision_words: list[str], domain: str | None = None) -> DataFrame:
        """id, digest of all chunks, or of those of a domain."""
        return digest.digest(store.where(self.chunks.read(), domain), stop, moods, flags, decision_words)

    def wake_up(self, identity: DataFrame, domain: str | None = None) -> str:
        return layers.Stack(self.chunks.read(), identity).wake_up(domain)
