"""Language-model scoring by context-tree weighting over bytes, beside a unigram base.

A byte is eight binary decisions. Each decision has a counter pair in every
context of 0 to DEPTH preceding bytes; the Krichevsky-Trofimov estimates of all
depths are mixed with the weights that the training text gives them. Spark
counts the byte (DEPTH+1)-grams of the training texts, from which the counters
of all depths follow by summation, so the trained mixture is a table of sorted
arrays. The tree is cut by the two bytes before a byte: below depth 2 such parts
share no node, so each is weighed by itself and only the nodes of depths 0 and
1, of which there are under 66,000, are put together on the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.gram_table import GramCounts, frame, head_values, least_of_head, tail_rows, text_parts
from loreweave.llm.labelled import held_out
from loreweave.runtime import materialize, on_executors

#: Bytes of context; a gram of them and the byte itself takes 48 bits.
DEPTH = 5
#: The byte that ends a text; UTF-8 has none like it.
END = 0xFF
#: Frequent grams whose values are broadcast at most; the values of the others are joined.
HEAD_GRAMS = 500_000
#: Parts of the tree are dealt over so many buckets at least, and over more from so many grams a bucket on.
BUCKETS, BUCKET_GRAMS = 32, 500_000
#: Frequent words whose counts are broadcast at most; the counts of the others are joined.
HEAD_WORDS = 200_000
#: The token that ends a text, which no word is equal to.
END_TOKEN = " "
_HALF = np.log(2)


def text_grams(text: bytes) -> np.ndarray:
    """A packed gram for each byte of a text and for its end: the DEPTH bytes before it and itself."""
    data = np.frombuffer(bytes(DEPTH) + text + bytes([END]), np.uint8)
    out = np.zeros(len(text) + 1, np.uint64)
    for i in range(DEPTH + 1):
        out <<= np.uint64(8)
        out |= data[i : len(text) + 1 + i]
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x >= 0.5, by Stirling's series above 8."""
    x, shift = x.astype(np.float64).copy(), np.zeros(len(x))
    for _ in range(8):
        low = x < 8
        shift[low] -= np.log(x[low])
        x[low] += 1
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


_SMALL = 1 << 14
_HALVES, _WHOLES = log_gamma(np.arange(_SMALL) + 0.5), log_gamma(np.arange(_SMALL) + 1.0)


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""

    def of(n: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
        out = table[np.minimum(n, _SMALL - 1).astype(np.int64)]
        large = np.flatnonzero(n >= _SMALL)
        out[large] = log_gamma(n[large] + more)
        return out

    return of(zeros, _HALVES, 0.5) + of(ones, _HALVES, 0.5) - of(zeros + ones, _WHOLES, 1.0) - np.log(np.pi)


class Nodes:
    """The nodes of one depth after k bits of a byte: sorted keys (context and those bits), estimates and weights."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, k: int) -> None:
        prefix = grams >> np.uint64(8 - k)
        change = np.append(True, prefix[1:] != prefix[:-1])
        self.first = np.flatnonzero(change)
        self.of = np.cumsum(change) - 1
        self.keys = prefix[self.first]
        bit = (grams >> np.uint64(7 - k) & np.uint64(1)).astype(np.float64)
        self.ones = np.add.reduceat(counts * bit, self.first)
        self.zeros = np.add.reduceat(counts, self.first) - self.ones
        self.p1 = (self.ones + 0.5) / (self.zeros + self.ones + 1)  # the estimate of a 1 at this depth alone
        self.total = kt_log(self.zeros, self.ones)
        self.weight = np.ones(len(self.keys))  # of this depth against the deeper ones

    def mix(self, below: Nodes, parent: np.ndarray) -> None:
        """Weigh this depth against the next one, whose nodes have these parents."""
        kt, children = self.total, np.bincount(parent, weights=below.total, minlength=len(self.keys))
        self.total = np.logaddexp(kt, children) - _HALF
        self.weight = np.exp(kt - _HALF - self.total)


class Upper:
    """The nodes of depths 0 and 1 of all training texts, by sorted keys context << 8 | bits so far, led by a 1."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> None:
        self.levels = []
        for shift in (0xFFFF, 0xFF):
            own, at = np.unique(keys & shift, return_inverse=True)
            zeros, ones, children = (np.bincount(at, weights=x) for x in (zeros, ones, children))
            kt, keys = kt_log(zeros, ones), own
            total = np.logaddexp(kt, children) - _HALF
            self.levels.append((own, (ones + 0.5) / (zeros + ones + 1), np.exp(kt - _HALF - total)))
            children = total

    def find(self, depth: int, grams: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each gram whether its node of this depth after k bits is known, its estimate and its weight."""
        keys, p1, weight = self.levels[1 - depth]
        byte, context = (grams & np.uint64(0xFF)).astype(np.int64), (grams >> np.uint64(8) & np.uint64(0xFF if depth else 0)).astype(np.int64)
        key = context << 8 | 1 << k | byte >> (8 - k)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return keys[at] == key, p1[at], weight[at]


class ContextTree:
    """Depths 2 to DEPTH of the trained mixture over sorted distinct grams, which may be those of some parts of the tree."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        at = np.argsort(grams)
        self.grams = grams[at]
        own, n = self.grams, counts[at].astype(np.float64)
        self.up: dict[int, np.ndarray] = {}  # where a gram of the next depth lies in this one
        self.nodes: dict[int, list[Nodes]] = {}
        for d in range(DEPTH, 1, -1):
            if d < DEPTH:
                own, self.up[d] = np.unique(own & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
                n = np.bincount(self.up[d], weights=n)
            self.nodes[d] = [Nodes(own, n, k) for k in range(8)] if len(own) else []
            if d < DEPTH:
                for here, below in zip(self.nodes[d], self.nodes[d + 1], strict=True):
                    here.mix(below, here.of[self.up[d][below.first]])
        self.pairs = own  # the grams of depth 2

    def tops(self) -> pd.DataFrame:
        """What the nodes of depth 1 need of this part: node, zeros, ones and the sum of ln of its children's probabilities."""
        parts = []
        for k, nodes in enumerate(self.nodes[2]):
            node = (nodes.keys >> np.uint64(k) & np.uint64(0xFF)).astype(np.int64) << 8 | 1 << k | (nodes.keys & np.uint64((1 << k) - 1)).astype(np.int64)
            parts.append(pd.DataFrame({"node": node, "zeros": nodes.zeros, "ones": nodes.ones, "total": nodes.total}))
        return pd.concat(parts).groupby("node", as_index=False).sum() if parts else pd.DataFrame({"node": [], "zeros": [], "ones": [], "total": []})

    def own_log10(self, upper: Upper) -> np.ndarray:
        """log10 P(byte | its context) of each of the tree's grams, in their order."""
        out = np.zeros(len(self.grams))
        for k in range(8):
            at = np.arange(len(self.grams))
            p = self.nodes[DEPTH][k].p1[self.nodes[DEPTH][k].of]
            for d in range(DEPTH - 1, 1, -1):
                at = self.up[d][at]
                nodes = self.nodes[d][k]
                node = nodes.of[at]
                p = nodes.weight[node] * nodes.p1[node] + (1 - nodes.weight[node]) * p
            for d in (1, 0):
                _, p1, weight = upper.find(d, self.pairs, k)
                p = weight[at] * p1[at] + (1 - weight[at]) * p
            one = self.grams >> np.uint64(7 - k) & np.uint64(1)
            out += np.log10(np.where(one == 1, p, 1 - p))
        return out

    def other_log10(self, grams: np.ndarray, upper: Upper) -> np.ndarray:
        """log10 P of any grams; a context that training lacks defers to the shorter one."""
        out = np.zeros(len(grams))
        for k in range(8):
            p, deeper = np.full(len(grams), 0.5), np.zeros(len(grams), bool)
            for d in range(DEPTH, -1, -1):
                if d < 2:
                    here, p1, weight = upper.find(d, grams, k)
                elif not self.nodes[d]:
                    continue
                else:
                    nodes = self.nodes[d][k]
                    key = (grams & np.uint64((1 << 8 * (d + 1)) - 1)) >> np.uint64(8 - k)
                    at = np.minimum(np.searchsorted(nodes.keys, key), len(nodes.keys) - 1)
                    here, p1, weight = nodes.keys[at] == key, nodes.p1[at], nodes.weight[at]
                p = np.where(here, np.where(deeper, weight * p1 + (1 - weight) * p, p1), p)
                deeper |= here
            one = grams >> np.uint64(7 - k) & np.uint64(1)
            out += np.log10(np.where(one == 1, p, 1 - p))
        return out

    def log10(self, grams: np.ndarray, upper: Upper) -> np.ndarray:
        if not len(self.grams):
            return self.other_log10(grams, upper)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        known = self.grams[at] == grams
        out = self.own_log10(upper)[at]
        out[~known] = self.other_log10(grams[~known], upper)
        return out


def packed(grams: pd.Series) -> np.ndarray:
    return grams.to_numpy(np.int64).view(np.uint64)


def tree_of(part: pd.DataFrame) -> ContextTree:
    return ContextTree(packed(part["gram"]), part["n"].to_numpy(np.float64))


def upper_levels(bucketed: DataFrame) -> Upper:
    """Depths 0 and 1 of all grams, from the parts of the tree below them."""
    found = bucketed.groupBy("bucket").applyInPandas(lambda part: tree_of(part).tops(), "node long, zeros double, ones double, total double").groupBy("node")
    ordered = F.aggregate(F.array_sort(F.collect_list("total")), F.lit(0.0), lambda x, y: x + y)  # the same sum in every run
    nodes = found.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), ordered.alias("total")).toPandas().sort_values("node")
    return Upper(*(nodes[c].to_numpy() for c in ("node", "zeros", "ones", "total")))


def gram_values(bucketed: DataFrame, upper: Upper, wanted: DataFrame | None = None) -> DataFrame:
    """gram, n and value (log10 P) of every gram of bucketed, or gram and value of those of wanted, which has the same columns."""
    shared = on_executors(bucketed.sparkSession, upper)

    def own(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("gram")
        return pd.DataFrame({"gram": part["gram"], "n": part["n"], "value": tree_of(part).own_log10(shared())})

    def other(part: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"gram": want["gram"], "value": tree_of(part).log10(packed(want["gram"]), shared())})

    if wanted is None:
        return bucketed.groupBy("bucket").applyInPandas(own, "gram long, n long, value double")
    return bucketed.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInPandas(other, "gram long, value double")


def raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = GramCounts()

    def sent() -> Iterator[pd.DataFrame]:
        grams, n = counts.merged()
        for i in range(0, len(grams), 500_000):
            yield pd.DataFrame({"gram": grams[i : i + 500_000].view(np.int64), "n": n[i : i + 500_000]})

    for batch in batches:
        texts = [t or "" for t in batch["text"]]
        for a, b in text_parts(texts, 8_000_000):
            if counts.add(np.concatenate([text_grams(raw(t)) for t in texts[a:b]])):
                yield from sent()
                counts.__init__()
    yield from sent()


def word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def flush(counts: Counter) -> Iterator[pd.DataFrame]:
        words = list(counts)
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            yield pd.DataFrame({"word": [w.decode("utf-8", "surrogatepass") for w in part], "n": [counts[w] for w in part]})

    counts: Counter = Counter()
    for batch in batches:
        for text in batch["text"]:
            counts.update(raw(text).lower().split())
            counts[END_TOKEN.encode()] += 1
            if len(counts) > 300_000:
                yield from flush(counts)
                counts = Counter()
    yield from flush(counts)


SCORED = "n_tokens long, n_bytes long, head_known long, head_base double, score double, words array<struct<word:string,n:long>>, tail array<long>, tail_n array<long>"


def lm_scores(docs: DataFrame, folds: int = 5, fold: int = 1, training: DataFrame | None = None) -> DataFrame:
    """Score every row of docs(doc_id, text).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (the
    unigram log10 probability of the lower-cased words and the end), score (the
    context tree's log10 probability of the text) and bits_per_byte (the code
    length of the text and its end over their number of bytes). Training
    texts are the rows of docs whose fold is not held out, or `training`.

    Counts cover all training texts and are summed in Spark, and the model has
    all their grams at DEPTH, however many. The HEAD_GRAMS most frequent grams'
    values and the HEAD_WORDS most frequent words' counts are broadcast; a
    text's other grams and words are joined with tables that have a row a gram
    or a word and so no hot key. doc_id may have any type and is never changed.
    A null or empty text is its end alone; very long texts are scored in whole;
    repeated rows are scored alike and each trains; with no training text every
    byte has 1/256; an empty table gives an empty table; other columns are not
    read.
    """
    texts = docs.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "text")
    train = (texts.filter(~F.col("held_out")) if training is None else training).select("text")
    words = materialize(train.mapInPandas(word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, distinct = words.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    grams = materialize(train.mapInPandas(gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    n_grams = grams.count()
    upper = head_grams = None
    bucket = F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(0xFFFF)), F.lit(max(BUCKETS, n_grams // BUCKET_GRAMS))).alias("bucket")
    bucketed = grams.select("gram", "n", bucket)
    if n_grams:
        upper = upper_levels(bucketed)
        head_grams = head_values(materialize(gram_values(bucketed, upper), "gram_values"), HEAD_GRAMS)

    least = least_of_head(words, HEAD_WORDS)
    denominator = total + 0.5 * (distinct + 1)
    head = words.filter(F.col("n") >= least).toPandas()
    spark = docs.sparkSession
    logs = dict(zip(map(raw, head["word"]), np.log10((head["n"].to_numpy(float) + 0.5) / denominator).tolist(), strict=True))
    shared = on_executors(spark, (head_grams, logs))

    @F.pandas_udf(SCORED)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        head_grams, logs = shared()
        for batch in batches:
            texts = [t or "" for t in batch]
            out: dict[str, list] = {x.split()[0]: [] for x in SCORED.split(", ")}
            for a, b in text_parts(texts):
                own = [raw(t) for t in texts[a:b]]
                if head_grams:
                    grams = [text_grams(t) for t in own]
                    score, tail, tail_n = head_grams.sums(np.concatenate(grams), np.cumsum([0, *map(len, grams)])[:-1])
                else:
                    score, tail, tail_n = [-(len(t) + 1) * np.log10(256) for t in own], [np.empty(0, np.int64)] * len(own), [np.empty(0, np.int64)] * len(own)
                for t in own:
                    tokens = t.lower().split()
                    tokens.append(END_TOKEN.encode())
                    got = [logs.get(w) for w in tokens]
                    known = [x for x in got if x is not None]
                    rest = Counter(w for w, x in zip(tokens, got, strict=True) if x is None) if len(known) < len(got) else {}
                    for name, value in (("n_tokens", len(tokens)), ("n_bytes", len(t)), ("head_known", len(known)), ("head_base", float(sum(known)))):
                        out[name].append(value)
                    out["words"].append([{"word": w.decode("utf-8", "surrogatepass"), "n": n} for w, n in rest.items()])
                out["score"] += list(map(float, score))
                out["tail"] += tail
                out["tail_n"] += tail_n
            yield frame(out)

    rows = texts.withColumn("g", scored("text")).select("doc_id", "held_out", "g.*").withColumn("row", F.monotonically_increasing_id())
    table = materialize(rows, "scored")
    rare = table.select("row", F.explode("words").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.n").alias("times"))
    c = F.coalesce("n", F.lit(0))
    base = F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(float(denominator)))).alias("rest_base")
    known = F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rest_known")
    out = table.drop("words", "tail", "tail_n").join(rare.join(words.filter(F.col("n") < least), "word", "left").groupBy("row").agg(base, known), "row", "left")
    score = F.col("score")
    if n_grams:
        used = tail_rows(table)
        wanted = used.select("gram").distinct().select("gram", bucket)
        priced = used.join(gram_values(bucketed, upper, wanted), "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("rest_score"))
        out, score = out.join(priced, "row", "left"), F.col("score") + F.coalesce("rest_score", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("rest_base", F.lit(0.0))).alias("base_score"), score.alias("score"),
        (-score / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
