"""The text operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from loreweave.llm import decontamination, jaccard_join, lm_scoring, mixing, quality_classifier, quality_rules, sharding, substring_dedup, token_count, toxicity
from loreweave.llm.fm_index import FmIndex, WaveletMatrix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, window string, size string"


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    passage = text(70)
    base = text(200)
    texts = [None, "", "   \n\t", "a", "A a", "one two", "x" * 30_000, text(6000), base, base, base.upper(), base + " tail", passage + " " + text(30), text(30) + " " + passage, passage]
    for _ in range(40):
        words = base.split()
        words[rng.integers(200)] = "changed"
        texts.append(" ".join(words))
    texts += [text(rng.integers(1, 150)) for _ in range(40)]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "B", None][i % 4], None, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return (text or "").encode().lower().split()


def sets_of(rows, width):
    out = {}
    for i, t, *_ in rows:
        w = lowered(t)
        out[i] = frozenset(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))) if w else frozenset()
    return out


def components_of(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent", "pivots"), [(3, 90, 64), (5, 80, 64), (3, 90, 1)])
def test_jaccard_components(docs, monkeypatch, width, percent, pivots):
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    got = {tuple(r) for r in jaccard_join.near_components(docs, width, percent).collect()}
    assert got == components_of(sets_of(corpus(), width), percent)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_of_wide_sets_at_the_threshold(spark, width, percent):
    """Sets of 700 to 900 shingles that differ in as many as a linked pair may, and in one more, at one place or many."""
    rows, made = [], 0
    for n in (700, 900):
        base = [f"b{n}_{i}" for i in range(n + width - 1)]
        # k new words at the end make k new shingles, of n old ones each
        most = n * (100 - percent) // percent
        for extra in (most, most + 1):
            rows += [(made, " ".join(base)), (made + 1, " ".join(base + [f"x{made}_{i}" for i in range(extra)]))]
            made += 2
            base = [f"{w}_{extra}" for w in base]
        # changed words far apart change `width` shingles each on either side
        for changes in range(n * (100 - percent) // (100 + percent) // width, n * (100 - percent) // (100 + percent) // width + 2):
            own = [f"{w}_{changes}" for w in base]
            other = list(own)
            for c in range(changes):
                other[width + c * (n // (changes + 1))] = f"y{made}_{c}"
            rows += [(made, " ".join(own)), (made + 1, " ".join(other))]
            made += 2
    want = components_of(sets_of([(i, t) for i, t in rows], width), percent)
    got = {tuple(r) for r in jaccard_join.near_components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()}
    assert got == want and len({c for _, _, c in want}) == made - 4


def test_ids_stay_as_they_are(spark):
    """Ids above 2^53 beside a null id, text ids, and two texts under one id."""
    words = " ".join(f"w{i}" for i in range(120))
    big = [(2**60 + 3, words), (2**60 + 1, words), (None, words), (5, words + " tail"), (5, "other text"), (None, "")]
    got = Counter(tuple(r) for r in jaccard_join.near_components(spark.createDataFrame(big, "doc_id long, text string")).collect())
    assert got == Counter([(2**60 + 3, 118, 5), (2**60 + 1, 118, 5), (None, 118, None), (5, 119, 5), (5, 1, 5), (None, 0, None)])
    cut = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(spark.createDataFrame(big[:3], "doc_id long, text string")).collect()}
    assert cut == {2**60 + 1: 0, 2**60 + 3: 120, None: 0}
    named = [("b", words), ("a", words), ("c", "x y z w"), (None, words)]
    got = {tuple(r) for r in jaccard_join.near_components(spark.createDataFrame(named, "doc_id string, text string")).collect()}
    assert got == {("b", 118, "a"), ("a", 118, "a"), ("c", 2, "c"), (None, 118, None)}


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring_dedup(docs, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_REGIONS", hot)
    words = {i: (t or "").encode().split() for i, t, *_ in corpus()}
    first = {}
    for i, w in sorted(words.items()):
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    want = set()
    for i, w in words.items():
        keep = [True] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                keep[j : j + 50] = [False] * 50
        want.add((i, len(w), len(w) - sum(keep), hashlib.sha256(b" ".join(x for x, k in zip(w, keep, strict=True) if k)).hexdigest()))
    assert {tuple(r) for r in substring_dedup.remove_repeats(docs).collect()} == want


def test_wavelet_and_index():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 11, 500)
    w = WaveletMatrix(values, 4)
    lo, hi = w.ranks(np.array([3, 10]), np.array([0, 77]), np.array([500, 301]))
    assert (hi - lo).tolist() == [(values == 3).sum(), (values[77:301] == 10).sum()]
    strings = [rng.integers(1, 3, n) for n in (5, 40, 9, 30)]
    got = FmIndex(strings, np.array([4, 3, 2, 1]), 5).least_values()
    for s, g in zip(strings, got, strict=True):
        for j in range(len(s) - 4):
            assert g[j] == min(v for v, t in zip((4, 3, 2, 1), strings, strict=True) if any((t[k : k + 5] == s[j : j + 5]).all() for k in range(len(t) - 4)))


def test_decontamination(spark, docs, monkeypatch):
    rows = corpus()
    base, passage = rows[8][1].split(), rows[14][1]
    items = [(1, " ".join(base[20:45])), (2, passage), (10, "One"), (3, None), (4, "!!"), (5, "absent words never seen anywhere in these texts at all now"), (6, passage)]
    monkeypatch.setattr(decontamination, "BLOCK_ROWS", 20)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = fold(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(str(i))
    want = set()
    for i, t, *_ in rows:
        w, ids = fold(t), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if found := windows.get(tuple(w[j : j + n])):
                    ids |= found
                    hit[j : j + n] = [True] * n
        want.add((i, len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), any(hit)))
    got = decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.drop("text_hash").collect()} == want


def test_mixing(docs):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert r["size"] == len((corpus()[r["doc_id"]][1] or "").split()) and r["taken"] <= 2 * r["size"]
    target = {r["source"]: (r["target"], r["source_size"]) for r in got}
    total = sum(s for _, s in target.values())
    assert abs(sum(t for t, _ in target.values()) - 1.5 * total) < 1e-6 * total
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=repr)


def test_mixing_targets_and_counts(docs):
    """Targets by sharing and capping in turns; each source's taken words within a document of its target."""
    sizes, most = Counter(), Counter()
    for i, t, _, source, *_ in corpus():
        sizes[source] += len((t or "").split())
        most[source] = max(most[source], len((t or "").split()))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_sources, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_sources:
        share = left / sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if share * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_sources}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_sources -= full
    taken = Counter()
    for r in mixing.mix_sources(docs).collect():
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= most[s] for s in order)


def test_sharding(docs):
    got = sharding.shard_documents(docs, 4).collect()
    texts = [t or "" for _, t, *_ in corpus()]
    by_text = defaultdict(set)
    for r in got:
        by_text[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    import zlib

    load = Counter()
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None) and 0 <= r["shard"] < 4
        load[r["shard"]] += r["size"]
    groups = Counter()
    for t in texts:
        groups[t] += len(t.encode()) + 1
    rest = [load[k] for k in range(4) if load[k] != max(groups.values())]
    assert max(rest) - min(rest) <= 0.02 * sum(rest)
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_best_fit_decreasing():
    out, bins = sharding.best_fit_decreasing([4, 8, 1, 4, 2, 1], 10)
    assert bins == 2 and sorted(Counter(out).values()) == [2, 4]
    load = Counter()
    for size, b in zip([90] + [1] * 100, sharding.pack([90] + [1] * 100, 5), strict=True):
        load[b] += size
    assert load[0] == 90 and {load[b] for b in range(1, 5)} == {25}


def test_token_counts(docs):
    P, T = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    lib = T.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in token_count.token_counts(docs, P.path("word_bpe_49k.json")).collect():
        assert r["n_tokens"] == len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
        assert r["n_bytes"] == len((r["text"] or "").encode())
    counter = token_count.BpeCounter(token_count.load_vocabulary(P.path("word_bpe_49k.json")))
    for odd in ("a<|endoftext|>B", "ΑΣ İ é é ①② 👩‍👧 don't", "x\x1cy\x85z", "''s''t"):
        assert counter.count(odd) == len(lib.encode(odd, add_special_tokens=False).ids)


def test_language_model(docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 50)
    import math
    import zlib

    counts = Counter()
    for i, t, *_ in corpus():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*lowered(t), b" "])
    total = sum(counts.values())
    for r in lm_scoring.lm_scores(docs).collect():
        tokens = [*lowered(corpus()[r["doc_id"]][1]), b" "]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0


def plain_tree(texts):
    """Context-tree weighting by recursion over dictionaries: log10 P of a text after training on texts."""
    from math import exp, lgamma, log, log10

    depth, counts = lm_scoring.DEPTH, defaultdict(lambda: [0, 0])
    steps = lambda t: [((b"\0" * depth + t + b"\xff")[i : i + depth], x) for i, x in enumerate(t + b"\xff")]
    children = defaultdict(set)
    for t in texts:
        for context, x in steps(t):
            for k in range(8):
                bits = (k, x >> (8 - k))
                for d in range(depth + 1):
                    own = context[depth - d :]
                    counts[own, bits][x >> (7 - k) & 1] += 1
                    if d:
                        children[own[1:], bits].add(own)
    totals = {}

    def kt(node):
        a, b = counts[node]
        return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(3.141592653589793)

    def total(context, bits):
        node = (context, bits)
        if node not in totals:
            own = kt(node)
            if len(context) < depth:
                below = sum(total(c, bits) for c in children[node])
                top = max(own, below)
                own = top + log(0.5 * exp(own - top) + 0.5 * exp(below - top))
            totals[node] = own
        return totals[node]

    def probability(context, bits, one):
        p = None
        for d in range(depth, -1, -1):
            node = (context[depth - d :], bits)
            if node in counts:
                a, b = counts[node]
                own = ((b if one else a) + 0.5) / (a + b + 1)
                w = exp(kt(node) - log(2) - total(*node))
                p = own if p is None else w * own + (1 - w) * p
        return 0.5 if p is None else p

    return lambda t: sum(log10(probability(c, (k, x >> (8 - k)), x >> (7 - k) & 1)) for c, x in steps(t) for k in range(8))


@pytest.mark.parametrize("head", [None, 100, 0])
def test_language_model_is_a_context_tree(spark, monkeypatch, head):
    """Scores are those of a plain recursive tree, whatever part of the grams is broadcast; a distribution sums to 1."""
    import zlib

    if head is not None:
        monkeypatch.setattr(lm_scoring, "HEAD_GRAMS", head)
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["ab", "abc", "ba", "é", "cab"], n)) for n in (30, 3, 1, 12, 40, 8, 25, 17)] + ["", None, "abab" * 30]
    rows = [(2**60 + i if i else None, t) for i, t in enumerate(texts)]
    score = plain_tree([(t or "").encode() for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1])
    got = {r["doc_id"]: r for r in lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        want = score((t or "").encode())
        assert abs(got[i]["score"] - want) < 1e-7 * max(1, abs(want))
        assert abs(got[i]["bits_per_byte"] + want / np.log10(2) / (len((t or "").encode()) + 1)) < 1e-7


def test_language_model_beats_words(spark):
    """On held-out documents the tree gives the texts a higher probability than word frequencies do, given enough to learn from."""
    got = lm_scoring.lm_scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out").groupBy().sum("score", "base_score").first()
    assert got[0] > got[1]


def test_quality_rules(docs):
    for r in quality_rules.quality_rules(docs).collect():
        text = corpus()[r["doc_id"]][1] or ""
        words = text.encode().split()
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(repeated))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def plain_kneser_ney(texts):
    """Modified Kneser-Ney over running characters by dictionaries: log P a character of a text."""
    from math import log

    order = quality_rules.ORDER
    run = lambda t: "\x02" * (order - 1) + re.sub(r"([!-/:-@\[-`{-~])\1+", r"\1", " ".join((t or "").split())) + "\x03"
    level = {order: Counter()}
    for t in texts:
        s = run(t)
        level[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    raw = {order: level[order]}
    for n in range(order - 1, 0, -1):
        left, raw[n] = Counter(), Counter()
        for g, c in raw[n + 1].items():
            left[g[1:]] += 1
            raw[n][g[1:]] += c
        level[n] = Counter({g: raw[n][g] if n > 1 and g[0] == "\x02" else left[g] for g in left})

    def discounts(c):
        n1, n2, n3, n4 = (sum(1 for v in c.values() if v == k) for k in (1, 2, 3, 4))
        if not (n1 and n2 and n3 and n4):
            return [0, 0.5, 0.5, 0.5]
        y = n1 / (n1 + 2 * n2)
        return [0, *(min(max(k - (k + 1) * y * b / a, 0.05), k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]

    d = {n: discounts(c) for n, c in level.items()}
    sums = {n: Counter() for n in level}
    kept = {n: Counter() for n in level}
    for n, c in level.items():
        for g, v in c.items():
            sums[n][g[:-1]] += v
            kept[n][g[:-1]] += min(d[n][min(v, 3)], v)

    def p(g):
        n = len(g)
        if not n:
            return 1 / (len(level[1]) + 1)
        if not sums[n][g[:-1]]:
            return p(g[1:])
        return (max(level[n][g] - d[n][min(level[n][g], 3)], 0) + kept[n][g[:-1]] * p(g[1:])) / sums[n][g[:-1]]

    def score(t):
        s = run(t)
        grams = [s[i : i + order] for i in range(len(s) - order + 1)]
        return sum(log(p(g)) for g in grams) / len(grams)

    return score


@pytest.mark.parametrize("head", [2_000_000, 50, 0])
def test_perplexities_are_kneser_ney(docs, monkeypatch, head):
    """Perplexities are those of a plain model of the document's own language, whatever part of it is broadcast."""
    monkeypatch.setattr(quality_rules, "HEAD_GRAMS", head)
    rows = {r[0]: r for r in corpus()}
    models = {lang: plain_kneser_ney([r[1] for r in rows.values() if r[2] == lang]) for lang in ("en", "de", None)}
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(rows) and any(r["kept"] for r in got)
    for r in got:
        _, text, lang, *_ = rows[r["doc_id"]]
        if r["n_words"]:
            assert abs(np.log(r["perplexity"]) + models[lang](text)) < 1e-9
        else:
            assert r["perplexity"] is None and not r["kept"]
        assert r["n_symbols"] == sum((text or "").count(x) for x in "#*$%&|<>")
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\v\f\r")]
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["kept"] == (not r["base_failed"] and r["low"] <= r["perplexity"] <= r["high"])


def test_word_order_counts():
    """A model of running characters finds a text with shuffled words less likely."""
    rng = np.random.default_rng(2)
    order = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    texts = [" ".join(order[(s + i) % 25] for i in range(200)) for s in range(20)]
    score, words = plain_kneser_ney(texts), texts[0].split()
    assert score(" ".join(rng.permutation(words))) < score(texts[0]) - 0.1


@pytest.mark.parametrize(("scores", "label", "name"), [(quality_classifier.quality_scores, "quality", "sf0.01"), (toxicity.toxicity_scores, "toxic", "sf0.01")])
def test_held_out_accuracy(spark, scores, label, name):
    docs, labels = (spark.read.parquet(f"/root/testdata/{name}/{t}.parquet") for t in ("documents", "labels"))
    got = scores(docs, labels).select("doc_id", "held_out", "score", "predicted").join(labels, "doc_id").filter("held_out").collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == r[label] for r in got) >= 0.93 * len(got)


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " lowei": 4.0}, [" village idiot "])
    matcher = toxicity.Matcher(lexicon)
    assert matcher.load("an 1d\u0456ot, here") > 0 and matcher.load("the LOWEIxyz") > 0
    assert matcher.load("the village idiot fell") == 0 and matcher.load("") == 0


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for got in (
        decontamination.decontaminate(empty, items), quality_classifier.quality_scores(empty, labels), substring_dedup.remove_repeats(empty),
        mixing.mix_sources(empty), mixing.mixed_documents(empty), lm_scoring.lm_scores(empty), jaccard_join.near_components(empty),
        toxicity.toxicity_scores(empty, labels), quality_rules.quality_rules(empty), sharding.shard_documents(empty),
    ):
        assert got.count() == 0


def test_pipeline_stages(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    clean = {r["doc_id"] for r in toxicity.toxicity_scores(docs, labels).filter("predicted = 0").collect()}
    out = corpus_pipeline.run(spark, path)
    assert {r["doc_id"] for r in out.collect()} <= clean
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_pipeline_is_its_stages_done_plainly(spark, tmp_path):
    """What each stage keeps of a small table with nulls, copies, benchmark passages, toxic texts and columns named as results."""
    import zlib

    rng = np.random.default_rng(8)
    text = lambda n=60: " ".join(f"v{i}" for i in rng.integers(0, 3_000, n))
    passage, base = text(12), text()
    toxic = [text(30) + " vilefoul " + text(30) for _ in range(30)]
    near = base.replace(base.split()[30], "other", 1)
    texts = [base, base, near, None, "", passage + " " + text(), *toxic, *[text() for _ in range(60)]]
    rows = [(i, t, "en", ["a", "b", None][i % 3], 1, 777) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(6 <= i < 36)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        kept[name] = sorted(r["doc_id"] for r in docs.collect())
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"] and {r["score"] for r in docs.collect()} == {777}
    assert kept["toxicity"] == [i for i in range(len(texts)) if not 6 <= i < 36]
    assert kept["near_duplicates"] == [i for i in kept["toxicity"] if i not in (1, 2)]
    assert kept["decontamination"] == [i for i in kept["near_duplicates"] if i != 5]
    mixed = corpus_pipeline.mix(spark, docs, str(tmp_path))
    want = Counter({r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs).collect()})
    assert Counter(r["doc_id"] for r in mixed.collect()) == +want
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in out) == +want
    for r in out:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))


def test_one_row_of_each_group_stays(spark, tmp_path):
    """Repeated rows, two texts that share a doc_id, and copies without a doc_id."""
    rng = np.random.default_rng(5)
    a, b, c, d = (" ".join(f"{k}{i}" for i in rng.integers(0, 10_000, 60)) for k in "abcd")
    rows = [(1, a), (1, a), (2, a), (7, b), (3, b), (7, c), (None, d), (None, d), (None, d), (9, ""), (9, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    assert got == Counter([(1, a), (3, b), (7, c), (None, d), (9, ""), (9, "")])
