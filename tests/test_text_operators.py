"""Chunkers, classes, chat exports and streams on small cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave import registry
from loreweave.operators import chunking, classify, digest
from loreweave.sources import chat_exports
from loreweave.streaming import activity


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("text", [None, "", "  \n "])
def test_blank_texts_give_no_chunks(spark, text):
    for column in (chunking.paragraphs(F.col("t")), chunking.exchanges(F.col("t")), chunking.segments(F.col("t")), chunking.windows()(F.col("t"))):
        assert not one(spark, column, text)


def test_windows_overlap_and_cover(spark):
    got = one(spark, chunking.windows()(F.col("t")), "x" * 1700)
    assert [len(c) for c in got] == [800, 800, 300]
    assert one(spark, chunking.windows()(F.col("t")), "a" * 500 + "\n" + "b" * 500) == ["a" * 500, "a" * 100 + "\n" + "b" * 500]


def test_exchanges_end_at_quotes_and_rules(spark):
    text = "> first question here\nan answer that is long enough\n---\nnot part of it\n> second\nshort\n> third question\n\nyes, with a longer answer"
    assert one(spark, chunking.exchanges(F.col("t")), text) == [
        "> first question here\nan answer that is long enough",
        "> third question\nyes, with a longer answer",
    ]


def test_segments_by_speaker(spark):
    assert one(spark, chunking.segments(F.col("t")), "Human: a\nmore\nAI: b\nuser: c") == ["Human: a\nmore", "AI: b", "user: c"]


def test_prose_leaves_code_out(spark):
    text = "We met on Monday.\n```\nx = 1\n```\nimport os\nIt went well."
    assert one(spark, classify.prose(F.col("t")), text) == "We met on Monday.\nIt went well."
    assert one(spark, classify.prose(F.col("t")), "import os") == "import os"


def test_memory_kind_and_confidence(spark):
    markers = {"decision": [r"\bwe chose\b"], "problem": [r"\bbroken\b", r"\bbug\b"]}
    got = one(spark, classify.memory(F.col("t"), markers), "The bug is back and the build is broken.")
    assert (got["kind"], got["confidence"]) == ("problem", 0.4)
    assert one(spark, classify.memory(F.col("t"), markers), "Nothing of the kind is told here.") is None
    scores = {"emotional": F.lit(0), "milestone": F.lit(0)}
    assert one(spark, classify.resolve(F.lit("problem"), F.col("t"), scores, ["glad"], ["sad"], [r"\bfixed\b"]), "it is fixed") == "milestone"


def test_digest_line(spark):
    row = [(1, "Today we met Anna. We chose glass because it is clear.", "en", "shop", "2026-01-01")]
    docs = spark.createDataFrame(row, "id long, document string, domain string, topic string, date string")
    got = digest.digest(docs, ["the"], [("clear", "calm")], [("chose", "DECISION")], ["because"]).first()["digest"]
    assert got.startswith("en|shop|2026-01-01|?\n0:ANN+WE|") and got.endswith('|"We chose glass because it is clear"|calm|DECISION')


EXPORTS = {
    "typed": "\n".join(json.dumps({"type": t, "message": {"content": c}}) for t, c in (("human", "q"), ("assistant", [{"type": "text", "text": "a"}]))) + "\nbad",
    "events": "\n".join(map(json.dumps, [{"type": "session_meta"}, {"type": "event_msg", "payload": {"type": "user_message", "message": " q "}}, {"type": "event_msg", "payload": {"type": "agent_message", "message": "a"}}])),
    "flat": json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "ai", "content": {"text": "a"}}]}),
    "talks": json.dumps([{"chat_messages": [{"role": "human", "content": "q"}]}, {"chat_messages": [{"role": "assistant", "content": "a"}]}]),
    "tree": json.dumps({"mapping": {"r": {"parent": None, "message": None, "children": ["1"]}, "1": {"parent": "r", "message": {"author": {"role": "user"}, "content": {"parts": ["q"]}}, "children": ["2", "3"]}, "2": {"parent": "1", "message": {"author": {"role": "assistant"}, "content": {"parts": ["a"]}}, "children": ["1"]}, "3": {"parent": "1"}}}),
    "channel": json.dumps([{"type": "message", "user": "x", "text": "q"}, {"type": "message", "user": "y", "text": "a"}]),
}


@pytest.mark.parametrize("name", sorted(EXPORTS))
def test_chat_exports(spark, name):
    assert chat_exports.messages_of(EXPORTS[name]) == [("user", "q"), ("assistant", "a")]
    got = chat_exports.normalise(spark.createDataFrame([(EXPORTS[name],), ("plain",)], "content string")).collect()
    assert [r["transcript"] for r in got] == ["> q\na\n", "plain"]


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    table = spark.read.parquet(source)
    stream = spark.readStream.schema(table.schema).parquet(source + "*")
    run = activity.windowed_counts(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    run.awaitTermination(120)
    pick = lambda df: sorted(df.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("w"), "n").collect())
    assert pick(spark.table("hourly")) == pick(activity.windowed_counts(table))


DATA = "/root/testdata/sf0.01"


def query_ids(spark):
    return {r["vec_id"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect() if r["vec_id"] % 20 == 0}


def test_batched_knn_takes_every_query(spark):
    """Brute force over all rows for every row whose id is divisible by 20."""
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in rows}
    cosine = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    got = {}
    for r in registry.queries()["v3_w1_batched_knn"](spark, DATA).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["similarity"])
    assert set(got) == query_ids(spark)
    for q, found in got.items():
        want = sorted((cosine(vectors[q], v) for i, v in vectors.items() if i != q), reverse=True)[:10]
        assert sorted(found) == list(range(1, 11)) and len({i for i, _ in found.values()}) == 10
        for rank, s in enumerate(want, 1):
            i, similarity = found[rank]
            assert i != q and abs(cosine(vectors[q], vectors[i]) - s) < 1e-9 and abs(similarity - s) < 0.00051


@pytest.mark.parametrize("name", ["m1_m2_m4_at_six_k", "r3_topic_boost", "r4_keyword_boost", "r6_x13_day_boost", "r11_promote", "w2_u5_sessions_of_hits"])
def test_every_query_is_ranked(spark, name):
    assert {r["query_id"] for r in registry.queries()[name](spark, DATA).select("query_id").distinct().collect()} == query_ids(spark)


def test_distribution_counts_every_query(spark):
    for r in registry.queries()["m7_a13_recall_distribution"](spark, DATA).collect():
        assert r["perfect"] + r["partial"] + r["zero"] == len(query_ids(spark))


def test_invalidate_returns_all_facts(spark):
    """Only the open facts of the triple are closed; those of every other subject stay as they are."""
    from collections import Counter

    from loreweave.plans.store_plans import fact_rows

    names = ["subject", "predicate", "object", "valid_from", "valid_to"]
    facts = [tuple(r) for r in fact_rows(spark, DATA).select(*names).collect()]
    want = Counter((*f[:4], "2024-02-01") if f[:3] == ("user_3", "click", "k_1") and f[4] is None else f for f in facts)
    assert Counter(tuple(r) for r in registry.queries()["k3_invalidate"](spark, DATA).select(*names).collect()) == want


def test_odd_chat_exports_are_passed_through():
    """Values of other types than a format has, and line breaks that aren't the JSON lines' own."""
    for odd in ('{"type": ["user"]}\n{"type": {}}', '[{"role": ["user"], "content": "x"}]', '{"mapping": {"a": 3, "b": {"parent": null, "message": 4, "children": 5}}}', '[{"type": "message", "user": ["x"], "text": "q"}]', "[" * 100_000):
        assert chat_exports.messages_of(odd) is None
    lines = [json.dumps({"type": t, "message": {"content": f"a\u2028b {t}"}}, ensure_ascii=False) for t in ("user", "assistant")]
    assert [t for _, t in chat_exports.messages_of("\n".join(lines))] == ["a\u2028b user", "a\u2028b assistant"]


def test_ignore_rules(spark):
    from loreweave.operators import files

    rules = files.rule_table(spark.createDataFrame([(".gitignore", "*.log\n/out/\n!keep.log\ndocs/**/x.md\n# no\n\\#odd.md"), ("a/.gitignore", "!b.log\n[cd].md")], "path string, content string"))
    paths = ["q.log", "keep.log", "a/b.log", "a/c.md", "a/e.md", "out/x.md", "z/out/x.md", "docs/p/q/x.md", "docs/x.md", "#odd.md", "p.log/in.md", "a/d.md/x.md"]
    rows = spark.createDataFrame([(p, 10) for p in paths], "path string, length long")
    assert {r["path"] for r in files.scan(rows, rules, suffixes=[".md", ".log"]).collect()} == {"keep.log", "a/b.log", "a/e.md", "z/out/x.md"}
    assert "out/x.md" in {r["path"] for r in files.scan(rows, rules, ["out"], [".md"]).collect()}


def test_stack(spark):
    from loreweave.operators import layers

    rows = [(i, f"text number {i} " + "word " * 60, "en" if i % 2 else "de", f"t{i % 3}", f"in/f{i}.md", str(i)) for i in range(30)]
    stack = layers.Stack(spark.createDataFrame(rows, "id long, document string, domain string, topic string, source_file string, weight string"), spark.createDataFrame([(0, "I am here.")], "at int, line string"))
    text = stack.wake_up("en")
    assert text.startswith("I am here.\n\n## ESSENTIAL STORY\n\n[t0]\n  - text number 27 ") and "number 28" not in text and text.count("(f") <= 15
    assert "number 28" in stack.wake_up() and stack.status() == {"identity_tokens": 2, "chunks": 30}
    assert stack.search("text number 7", limit=3).first()["similarity"] > 0 and stack.recall("de", "t0", 2).count() == 2


def test_save_triggers_follow_batches(spark, tmp_path):
    """A micro-batch is one check; the count at a save is where the next fifteen begin."""
    schema = "session_id string, role string"
    folder = tmp_path / "in"
    for n in range(3):
        spark.createDataFrame([("s", "user")] * 10 + [("s", "assistant")], schema).coalesce(1).write.mode("append").json(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    run = activity.save_triggers(stream).writeStream.format("memory").queryName("saves").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(120)
    assert [r["n_human"] for r in spark.table("saves").collect()] == [20]


def test_names_are_counted_by_scans(spark):
    """A scan finds the matches of all names of one word; patterns whose names may stand at several places are looked at one by one."""
    from loreweave.operators import entities

    signals = entities.Signals(dialogue=(r"(?m)^NAME:\s",), action=(r"\bNAME\s+said\b",), addressed=(r"\bhey\s+NAME\b|\bhi\s+NAME\b",), project=(r"\bthe\s+(?:\w+\s+)?NAME\b",), versioned=(r"\bNAME[-v]\w+",), pronouns=("she",))
    assert all(entities._scans(p) for p in (*signals.dialogue, *signals.action, *signals.addressed, *signals.versioned))
    assert entities._scans(signals.project[0]) is None
    text = "Ann: hey ann, she said\nANN said ann said hi Ann\n\n\nthe old Ann and the Annv2 of Joannas and Ann Lee said"
    docs = spark.createDataFrame([(1, text), (2, "nothing of Anns"), (3, None)], "id long, document string")
    names = spark.createDataFrame([("Ann", 9), ("Ann Lee", 5), ("Bo", 4)], "name string, frequency long")
    got = {r["name"]: (r["person_score"], r["project_score"], r["kinds"]) for r in entities.scores(docs, names, signals).collect()}
    assert got == {"Ann": (3 + 2 * 2 + 2 * 2 + 4 * 2, 2 + 3, ["action", "dialogue", "pronoun"]), "Ann Lee": (2, 0, ["action"]), "Bo": (0, 0, [])}


def test_counting_names_is_linear_in_a_text(spark):
    """A text of many different names, each in many lines, takes no step for each name and occurrence."""
    import time

    import pandas as pd

    from loreweave.operators import entities

    words = ["".join(chr(97 + (i // 26**j) % 26) for j in range(3)) + "x" for i in range(3000)]
    text = "\n".join("he saw the " + " the ".join(words[i : i + 60]) for i in range(0, 2940, 3))
    began = time.process_time()
    counts = entities._counter([r"\bthe\s+NAME\b", None, r"\bNAME\s+the\b"], ("he",)).func(iter([(pd.Series([text]), pd.Series([[w.title() for w in words]]))]))
    rows = {r["name"]: r["counts"] for r in next(counts)[0]}
    assert rows[words[100].title()] == [20, 20, 20]
    assert time.process_time() - began < 4


def test_marker_bounds_are_those_of_ascii_words(spark):
    """A marker's word ends before a letter that isn't ASCII, as in the SQL; Java 17 alone would read on."""
    markers = {"decision": [r"tion\b", r"\bla\b"], "problem": [r"\bof\b"]}
    got = one(spark, classify.memory(F.col("t"), markers), "tion\u00e9 \u00e9la \u00fcof of and no more is told")
    assert (got["kind"], got["confidence"]) == ("decision", 0.4)


def test_neighbours_of_a_task_are_found_in_bounded_memory():
    """The best rows of many queries, ties by the smaller id, with a peak far under one matrix of all queries and a batch's rows."""
    import tracemalloc

    import pandas as pd

    from loreweave.operators import vectors

    rng = np.random.default_rng(1)
    rows, asked = rng.integers(-2, 3, (6000, 8)).astype(float), rng.integers(-2, 3, (1000, 8)).astype(float)
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-9)[:, None]
    frame = pd.DataFrame({"row_id": rng.permutation(6000), "v": list(rows)})
    tracemalloc.start()
    got = pd.concat(vectors._best(3)((list(range(1000)), unit(asked)))(iter([frame[:4000], frame[4000:]])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # one matrix of 1,000 by 4,000 has 32 MB
    s = np.round(unit(asked) @ unit(rows).T, 12)
    for q in range(0, 1000, 50):
        order = np.lexsort((frame["row_id"], -s[q]))[:4]
        mine = got[got["query_id"] == q]
        assert list(mine["row_id"]) == list(frame["row_id"].to_numpy()[order]) and np.allclose(mine["s"], s[q][order])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_token_f1_compares_lists_where_they_lie(spark):
    from loreweave.operators import retrieval_metrics

    rows = [(1, ["x", "x", "y"], ["x", "z", "x", "x"]), (2, [], []), (3, ["a"], ["b"]), (4, None, ["a"]), (5, ["p"], ["p"]), (5, ["q"], ["p"])]
    f1 = retrieval_metrics.token_f1(spark.createDataFrame(rows, "k long, a array<string>, b array<string>"), ["k"])
    assert {r["k"]: round(r["f1"], 6) for r in f1.collect()} == {1: round(4 / 7, 6), 3: 0.0, 4: 0.0, 5: 0.5}
    assert "Generate" not in plan_of(f1)


def test_spelling_moves_found_words_alone(spark):
    from loreweave.operators import spelling

    texts = spark.createDataFrame([(1, "then  thay went,\nthay!  Thay"), (2, None), (3, " as it is "), (4, "thay2 thay-x thay'")], "id long, text string")
    fixes, words = spark.createDataFrame([("thay", "they"), ("went", "want")], "word string, correction string"), spark.createDataFrame([("WENT",)], "word string")
    out = spelling.corrected(texts, fixes, words)
    assert dict(out.collect()) == {1: "then  they went,\nthey!  Thay", 2: "", 3: " as it is ", 4: "thay2 thay-x they'"}
    assert "posexplode" not in plan_of(out)


def test_digests_move_no_rows(spark):
    docs = spark.createDataFrame([(1, "Today The Glass broke. glass GLASS my-own it", "en", "shop", None), (2, "", "en", "x", None), (3, None, "en", "x", None)], "id long, document string, domain string, topic string, date string")
    got = digest.digest(docs, ["it"], [], [], ["broke"], None, ("document",))
    assert "Exchange" not in plan_of(got)
    lines = {r["id"]: r["digest"].split("\n")[1] for r in got.collect()}
    assert lines == {1: '0:THE+GLA|glass_today_the|"Today The Glass broke"', 2: "0:???|misc", 3: "0:???|misc"}
    assert {r["id"]: r["topics"] for r in digest.topics(docs, ["it"]).collect()} == {1: ["glass", "today", "the"]}
