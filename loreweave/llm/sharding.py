"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups sorted by size enter the bin with the tightest remaining capacity, which
a balanced tree finds. Large groups are packed one by one; the many small ones
are first put together by hash into bundles, so that the packer's input has a
bound whatever the size of the corpus. The capacity is the smallest at which
the packing needs no more than the wanted bins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.runtime import materialize

#: A group of more than 1 / LARGE of all bytes, a thousandth of one of 16 shards, is packed by itself; the others share BUNDLES bundles.
LARGE, BUNDLES = 16_000, 16_384
#: Rows of a piece of a shard, about, in which slots are numbered; pieces depend on the rows alone.
PIECE_ROWS = 50_000


@dataclass
class _Node:
    key: tuple[int, int]
    left: _Node | None = None
    right: _Node | None = None
    height: int = 1


def _height(t: _Node | None) -> int:
    return t.height if t else 0


def _rotate(t: _Node, left: bool) -> _Node:
    up = t.right if left else t.left
    if left:
        t.right, up.left = up.left, t
    else:
        t.left, up.right = up.right, t
    for x in (t, up):
        x.height = 1 + max(_height(x.left), _height(x.right))
    return up


def _balanced(t: _Node) -> _Node:
    t.height = 1 + max(_height(t.left), _height(t.right))
    lean = _height(t.left) - _height(t.right)
    if lean > 1:
        if _height(t.left.left) < _height(t.left.right):
            t.left = _rotate(t.left, True)
        return _rotate(t, False)
    if lean < -1:
        if _height(t.right.right) < _height(t.right.left):
            t.right = _rotate(t.right, False)
        return _rotate(t, True)
    return t


class CapacityTree:
    """A balanced tree of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def add(self, key: tuple[int, int]) -> None:
        def go(t: _Node | None) -> _Node:
            if t is None:
                return _Node(key)
            if key < t.key:
                t.left = go(t.left)
            else:
                t.right = go(t.right)
            return _balanced(t)

        self.root = go(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def go(t: _Node | None, key: tuple[int, int]) -> _Node | None:
            if t is None:
                return None
            if key < t.key:
                t.left = go(t.left, key)
            elif key > t.key:
                t.right = go(t.right, key)
            elif t.left is None or t.right is None:
                return t.left or t.right
            else:
                low = t.right
                while low.left:
                    low = low.left
                t.key, t.right = low.key, go(t.right, low.key)
            return _balanced(t)

        self.root = go(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least entry with a remaining capacity of at least size."""
        t, best = self.root, None
        while t:
            if t.key >= (size, -1):
                best, t = t.key, t.left
            else:
                t = t.right
        return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """The bin of each item and the number of bins; an item above the capacity gets a bin of its own."""
    tree, bins, out = CapacityTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.tightest(sizes[i])
        if found:
            tree.remove(found)
        else:
            found, bins = (max(capacity, sizes[i]), bins), bins + 1
        tree.add((found[0] - sizes[i], found[1]))
        out[i] = found[1]
    return out, bins


def pack(sizes: list[int], shards: int) -> list[int]:
    """Bins 0 to shards - 1 of nearly equal load.

    A group above the mean of what is left takes a bin of its own; the others
    get the smallest capacity at which best fit decreasing needs no more bins
    than are left.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out, alone, left = [0] * len(sizes), 0, sum(sizes)
    while alone < shards - 1 and alone < len(order) and sizes[order[alone]] * (shards - alone) > left:
        out[order[alone]] = alone
        left -= sizes[order[alone]]
        alone += 1
    rest = order[alone:]
    if not rest:
        return out
    bins, own = shards - alone, [sizes[i] for i in rest]
    low, high = max(max(own), -(-left // bins)), max(own) + -(-left // bins) + 1
    while best_fit_decreasing(own, high)[1] > bins:
        high *= 2
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if best_fit_decreasing(own, middle)[1] <= bins else (middle + 1, high)
    for i, b in zip(rest, best_fit_decreasing(own, high)[0], strict=True):
        out[i] = alone + b
    return out


def shard_documents(docs: DataFrame, shards: int = 16, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Put every row of docs(doc_id, text) into a shard of nearly equal bytes, equal texts together.

    Returns the columns `keep`, size (UTF-8 bytes plus 1), text_crc32, law
    ('bytes'), shard, slot (gapless from 0 in each shard) and grown_shard (null).

    Groups of equal texts (by a 128-bit digest) are never divided. At most
    LARGE large groups and BUNDLES bundles of small ones go to the packer on the
    driver; both have that bound at any input size. Sizes are summed before the
    shuffle, so a hot group is one row a task. Slots are numbered within pieces
    of a shard, whose counts give each piece its first slot, so no task numbers
    a whole shard. Null and empty texts are one group of size-1 rows; a group of
    more than a shard's even share gets a shard of its own; repeated rows get
    slots of their own; an empty table gives an empty table.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        *keep, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("group"), F.xxhash64(F.lit(1), *keep, text).alias("tie"),
    )
    narrow = materialize(narrow.withColumn("bundle", F.pmod(F.xxhash64("group"), F.lit(BUNDLES)).cast("int")), "shard")
    total, n_rows = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    groups = narrow.groupBy("group", "bundle").agg(F.sum("size").alias("bytes"))
    large = materialize(groups.filter(F.col("bytes") * LARGE > total), "large")
    bundles = narrow.join(F.broadcast(large.select("group")), "group", "left_anti").groupBy("bundle").agg(F.sum("size").alias("bytes"))
    items = [(bytes(r["group"]), -1, r["bytes"]) for r in large.collect()] + [(None, r["bundle"], r["bytes"]) for r in bundles.collect()]
    items.sort(key=lambda x: (-x[2], x[1], x[0] or b""))
    spark = docs.sparkSession
    placed = list(zip(items, pack([x[2] for x in items], shards), strict=True))
    own = spark.createDataFrame([(bytearray(g), s) for (g, _, _), s in placed if g is not None], "large_group binary, own_shard int")
    by_bundle = [0] * BUNDLES
    for (g, b, _), s in placed:
        if g is None:
            by_bundle[b] = s
    shared = spark.createDataFrame(list(enumerate(by_bundle)), "in_bundle int, bundle_shard int")
    sharded = (
        narrow.join(F.broadcast(own), F.col("group") == F.col("large_group"), "left")
        .join(F.broadcast(shared), F.col("bundle") == F.col("in_bundle"), "left")
        .withColumn("shard", F.coalesce("own_shard", "bundle_shard"))
        .withColumn("piece", F.pmod(F.col("tie"), F.lit(max(16, n_rows // (shards * PIECE_ROWS)))).cast("int"))
        .select(*keep, "size", "text_crc32", "shard", "piece", "tie")
    )
    counts = sharded.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")
    counts = counts.select(F.col("shard").alias("s"), F.col("piece").alias("p"), first.alias("first_slot"))
    within = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("tie", *keep, "size", "text_crc32"))
    numbered = sharded.withColumn("within", within)
    # one row for each shard and piece: their number is fixed by the settings
    return numbered.join(F.broadcast(counts), (F.col("shard") == F.col("s")) & (F.col("piece") == F.col("p"))).select(
        *keep, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first_slot") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
