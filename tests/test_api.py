"""The caller's functions on a small store."""

from loreweave.api import Memory


def test_memory(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "memory"))
    assert m.status().count() == 0 and m.search("anything").count() == 0
    first = m.add("work", "billing", "the invoice was late again")
    assert first["outcome"] == "added" and m.add("work", "billing", "the invoice was late again")["outcome"] == "already_exists"
    assert not m.add("../x", "billing", "text")["success"] and not m.add("work", "billing", "  ")["success"]
    second = m.add("home", "billing", "the garden is green")
    assert {tuple(r) for r in m.taxonomy().collect()} == {("work", "billing", 1), ("home", "billing", 1)}
    assert m.search("invoice late", limit=1).first()["text"] == "the invoice was late again"
    assert m.check_duplicate("the invoice was late again").count() == 1
    assert m.find_bridges().first()["topic"] == "billing" and m.graph_stats().first()["bridges"] == 1
    assert m.delete(second["id"])["success"] and not m.delete("none")["success"]
    assert m.diary_write("Old Bee", "learned a lot")["success"] and m.diary_read("old bee").first()["content"] == "learned a lot"
    assert spark.read.json(str(tmp_path / "memory" / "audit")).count() == 5


def test_facts_of_memory(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "memory"))
    m.kg_add("Max O'Neil", "Works At", "Acme Corp", "2020-01-01")
    again = m.kg_add("max o'neil", "works at", "acme corp", "2021-01-01")
    assert again["success"] and m.facts.read().count() == 1 and m.entities.read().count() == 2
    m.kg_invalidate("Max O'Neil", "works at", "Acme Corp", "2024-12-31")
    m.kg_add("Max O'Neil", "works at", "Bolt", "2025-01-01")
    assert [r["object"] for r in m.kg_query("Max O'Neil", "2023-05-01").collect()] == ["Acme Corp"]
    assert [r["object"] for r in m.kg_query("Max O'Neil", "2025-05-01").collect()] == ["Bolt"]
    assert m.kg_query("Acme Corp", direction="incoming").first()["subject"] == "Max O'Neil"
    assert [r["object"] for r in m.kg_timeline().collect()] == ["acme_corp", "bolt"]
    assert m.kg_stats().first().asDict() == {"entities": 3, "facts": 2, "current": 1, "expired": 1, "predicates": ["works_at"]}
    assert m.facts.rebuild("fact_id") == m.facts.version() and m.facts.read().count() == 2
