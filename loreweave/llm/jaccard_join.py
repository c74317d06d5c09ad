"""N-gram Jaccard join by parity sketches.

A document is the set of its hashed word shingles. A shingle toggles one bit of
a sketch, so two sketches differ in no more bits than their sets differ in
shingles: the Hamming distance is a lower bound of the symmetric difference.
The sketch of a band of sizes is cut into more blocks than a linked pair can
differ in, so some block agrees (pigeonhole), and joining on blocks loses no
link. For the join a block has 2^64 bits and is kept as its Zobrist digest, the
XOR of one 64-bit code a set bit, as narrow blocks of a few shingles would
agree by chance. A set also has the blocks of the band below if a smaller
partner can lie there; of its blocks it uses those that the fewest sets have,
as many as the argument needs. For the verification the same sketch is folded to
8 to 16 bits for each shingle that a linked pair of that size can differ in, so
that the Hamming bound rejects near misses at every size; what passes is tested
on the exact sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.llm.components import connected_components, relabelled
from loreweave.llm.words import WordHashes, mix, window_hashes
from loreweave.runtime import drop_table, materialize

#: Sets of a group that all others are compared with in the first round after the stars; four times as many in each later one.
PIVOTS = 256
#: Rows whose sets and keys a Python worker holds at once.
PART_ROWS = 256
#: The bits of a key that name its band.
BAND = np.uint64(31)
#: Bits of the folded sketch for each shingle that a linked pair can differ in, at least; and of the part that is compared first.
SKETCH_BITS, FIRST_BITS = 8, 256


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text; fewer words than `width` are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(window_hashes(hashes.of(words), min(width, len(words)))) if words else np.empty(0, np.uint64)


def differing(n: int, percent: int) -> int:
    """The most shingles that a linked pair can differ in if its smaller set has n."""
    return n * (100 - percent) // percent


def band(n: int, percent: int) -> int:
    """log2 of the number of blocks for a smaller set of n: a third more than it may differ in, 16 at least, so that few sets lie in one block."""
    return max(4, int(np.ceil(np.log2(1.3 * (differing(n, percent) + 2)))))


def block_keys(items: np.ndarray, percent: int) -> tuple[int, list[int], list[int], np.ndarray]:
    """The lowest band that a set is joined in, how many of its keys lie in each band and how many of these the argument needs, and the keys.

    The low bits of a key are its band. Blocks without a shingle come last in
    the order of keys, so of them only as many are keys as are needed.
    """
    n, sizes, needs, out = len(items), [], [], []
    if not n or not differing(n, percent):
        return 0, [], [], np.empty(0, np.uint64)
    low = band(-(-n * percent // 100), percent)
    for b in range(low, band(n, percent) + 1):
        blocks = 1 << b
        need = min(differing(n, percent), int(blocks / 1.3) - 2) + 1
        at = (items >> np.uint64(64 - b)).astype(np.int64)
        count = np.bincount(at, minlength=blocks)
        filled = np.flatnonzero(count)
        values = np.bitwise_xor.reduceat(items, (np.cumsum(count) - count)[filled])
        bare = np.flatnonzero(count == 0)[: max(0, need - len(filled))]
        place = np.concatenate([filled, bare])
        values = np.concatenate([values, np.zeros(len(bare), np.uint64)])
        out.append(mix(values + mix(place.astype(np.uint64) + np.uint64(1))) & ~BAND | np.uint64(b))
        sizes.append(len(place))
        needs.append(need)
    return low, sizes, needs, np.concatenate(out)


def sketch_bits(n: int, percent: int) -> int:
    """The size of the folded sketch of a set of n, a power of two."""
    return max(FIRST_BITS, 1 << (SKETCH_BITS * (differing(n, percent) + 1) - 1).bit_length())


def parity_sketch(items: np.ndarray, bits: int) -> np.ndarray:
    """`bits` parity bits, by the low bits of each hash."""
    at = (items & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The batches in parts of so few rows that what is made of a part is small."""
    for batch in batches:
        for first in range(0, len(batch), PART_ROWS):
            yield batch.iloc[first : first + PART_ROWS]


SIGNED = "n long, x long, s long, first array<long>, sketch array<long>, low int, sizes array<int>, needs array<int>, keys array<long>"


def signed_sets(width: int, percent: int):
    @F.pandas_udf(SIGNED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for texts in pieces(batches):
            rows = []
            for text in texts:
                items = shingles(text, width, hashes)
                x = np.bitwise_xor.reduce(items).view(np.int64) if len(items) else 0
                bits = sketch_bits(len(items), percent)
                first, whole = parity_sketch(items, FIRST_BITS), parity_sketch(items, bits) if bits > FIRST_BITS else np.empty(0, np.int64)
                low, sizes, needs, keys = block_keys(items, percent)
                rows.append((len(items), x, mix(items).sum(dtype=np.uint64).view(np.int64), first, whole, low, sizes, needs, keys.view(np.int64)))
            yield pd.DataFrame(rows, columns=["n", "x", "s", "first", "sketch", "low", "sizes", "needs", "keys"])

    return run


def full_sets(width: int):
    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for texts in pieces(batches):
            yield pd.Series([shingles(t, width, hashes).view(np.int64) for t in texts])

    return run


def apart(a: Column, b: Column) -> Column:
    """The Hamming distance of two folded sketches, the longer one folded to the shorter one's size."""
    size = F.least(F.size(a), F.size(b))
    folded = lambda s, i: F.aggregate(F.sequence(F.lit(0), F.floor(F.size(s) / size).cast("int") - 1), F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(F.get(s, i + k * size)))
    differ = lambda n, i: n + F.bit_count(folded(a, i).bitwiseXOR(folded(b, i)))
    return F.when(size > 0, F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), differ)).otherwise(F.lit(0))


def may_link(percent: int) -> Column:
    """Sizes and sketches that a linked pair can have, over columns n, first and sketch of sides a and b."""
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    first = sum((F.bit_count(F.col("first_a")[i].bitwiseXOR(F.col("first_b")[i])) for i in range(FIRST_BITS // 64)), F.lit(0))
    within = lambda bits: (100 + percent) * bits <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    return (100 * small >= percent * large) & within(first) & within(apart(F.col("sketch_a"), F.col("sketch_b")))


def named(t: DataFrame, x: str, *names: str) -> DataFrame:
    """The nodes of a table as column x, and its columns `names` with _x after them."""
    return t.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in names])


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs(a, b, ...) whose sets link, exactly."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("items_a", "items_b"))
    return both.filter(100 * common >= percent * (F.size("items_a") + F.size("items_b") - common)).select(pairs.columns)


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, pivot): the prefix keys of nodes(node, low, sizes, needs, keys) that another node has too, with the key's pivot.

    Of the keys of a set in a band, in the order of how many sets have them,
    only the first `need` can be all that a linked pair shares (prefix filter).
    A key of one set alone comes first and joins with nothing, so a set that
    differs from all others in more blocks than linked sets may has no key left.
    The pivot is the node with the most shared keys, the least on a tie: what
    the others of a group were copied from shares more of them than they do.
    """
    rows = nodes.select(F.explode("keys").alias("key"), "node")
    often = rows.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1")
    shared = materialize(rows.join(often, "key").withColumn("band", F.col("key").bitwiseAND(int(BAND)).cast("int")), "shared")
    held = shared.groupBy("node", "band").agg(F.count("*").alias("held")).join(nodes.select("node", "low", "sizes", "needs"), "node")
    of_band = lambda c: F.get(c, F.col("band") - F.col("low"))
    held = held.select("node", "band", (of_band("needs") - of_band("sizes") + F.col("held")).alias("left")).filter("left > 0")
    # the first keys by how many sets have them; blocks without a shingle were left out by the map where they aren't needed
    order = F.row_number().over(Window.partitionBy("node", "band").orderBy("many", "key"))
    prefix = shared.join(held, ["node", "band"]).withColumn("place", order).filter("place <= left").select("key", "node")
    prefix = materialize(prefix, "prefix")
    drop_table(shared)
    again = prefix.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key")
    groups = materialize(prefix.join(again, "key"), "groups")
    drop_table(prefix)
    degree = groups.groupBy("node").agg(F.count("*").alias("degree"))
    best = groups.join(degree, "node").groupBy("key").agg(F.max(F.struct(F.col("degree"), (-F.col("node")).alias("least"))).alias("best"))
    out = materialize(groups.join(best.select("key", (-F.col("best.least")).alias("pivot")), "key"), "groups")
    drop_table(groups)
    return out


FIELDS = ("component", "n", "first", "sketch")


def near_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_shingles and component_id.

    Two documents link when 100 x intersection >= percent x union of their
    sets; the component is the smallest doc_id reachable by links.

    Documents with equal sets form a class that is joined once, so copies are
    never paired. Sets that share a block are first compared with the one of
    them that shares the most (a star a group). From then on only sets of
    different components are compared: in each round some PIVOTS sets of a
    group, by hash, meet all the others of the group that are still apart from
    them, and leave it; the next round takes four times as many. A group is
    done when one component holds it or every set was a pivot, so no link is
    lost whatever the sizes. Sizes and sketches are compared inside the joins,
    so only pairs that may link become rows, and components only grow by the
    links of a round. What is quadratic in the worst case, a group of which
    most sets differ from most others by a little more than the threshold, is
    the number of sketch comparisons inside the join, not that of rows.

    doc_id may have any type that has an order and is never changed. A null or
    empty text has 0 shingles and links with nothing; a text below `width` words
    is one shingle; very long texts are read whole; rows that repeat a doc_id
    are judged by their own texts; a null doc_id links with nothing and has a
    null component; an empty table gives an empty table; other columns are not
    read.
    """
    texts = docs.select("doc_id", "text")
    signed = materialize(texts.withColumn("g", signed_sets(width, percent)("text")).select("doc_id", "g.*"), "signed")
    usable = signed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = usable.groupBy("n", "x", "s").agg(F.min("doc_id").alias("least"), F.first("first").alias("first"), F.first("sketch").alias("sketch"), F.first("low").alias("low"), F.first("sizes").alias("sizes"), F.first("needs").alias("needs"), F.first("keys").alias("keys"))
    nodes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    del classes, usable
    members = materialize(signed.select("doc_id", "n", "x", "s"), "members")
    drop_table(signed)
    groups = shared_keys(nodes)
    component = materialize(groups.select("node").distinct().withColumn("component", F.col("node")), "component")
    owners = nodes.join(component.select("node"), "node").select("node", F.col("least").alias("doc_id"), "n", "x", "s")
    brief = materialize(nodes.join(component.select("node"), "node", "left_semi").select("node", "n", "first", "sketch"), "brief")
    wanted = texts.join(owners.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("items", full_sets(width)("text"))
    # a doc_id may be repeated with other texts, so the set itself names its node
    digest = [F.size("items").cast("long").alias("n"), F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x)).alias("x")]
    sets = wanted.select("doc_id", "items", *digest).join(owners, ["doc_id", "n", "x"]).groupBy("node").agg(F.first("items").alias("items"))
    sets = materialize(sets, "sets")

    stars = groups.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(named(brief, "a", "n", "first", "sketch"), "a").join(named(brief, "b", "n", "first", "sketch"), "b").filter(may_link(percent))
    tested = materialize(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    component = relabelled(component, linked(tested, sets, percent))
    groups, turn = groups.select("key", "node"), 0
    while True:
        turn += 1
        now = groups.join(component, "node")
        mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("left")).filter("lo < hi")
        old, open_groups = groups, materialize(now.join(mixed.select("key", "left"), "key").join(brief, "node"), "open")
        if open_groups.isEmpty():
            break
        most = PIVOTS * 4 ** (turn - 1)
        chosen = F.pmod(F.xxhash64("node", F.lit(turn)), F.greatest(F.floor(F.col("left") / most), F.lit(1))) == 0
        pivots = materialize(open_groups.filter(chosen).select("key", "node", *FIELDS), "pivots")
        meet = (F.col("key_a") == F.col("key_b")) & (F.col("component_a") != F.col("component_b")) & may_link(percent)
        pairs = named(open_groups, "a", "key", *FIELDS).join(named(pivots, "b", "key", *FIELDS), meet)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        tested = tested.unionByName(pairs)
        component = relabelled(component, linked(pairs, sets, percent))
        # a pivot has met every set of its group that it could still be joined to
        groups = materialize(open_groups.select("key", "node").join(pivots.select("key", "node"), ["key", "node"], "left_anti"), "groups")
        for done in (old, open_groups, pivots):
            drop_table(done)
    lowest = component.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("reached"))
    reached = component.join(lowest, "component").select("node", "reached")
    out = members.join(nodes.select("n", "x", "s", "node", "least"), ["n", "x", "s"], "left").join(reached, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("reached", "least", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
