"""Exact vector search: cosine scores as column expressions, then a bounded top-k."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a norm is below 1e-9 or the dimensions differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.sqrt(dot(a, a)) >= 1e-9) & (F.sqrt(dot(b, b)) >= 1e-9)
    return F.when(usable, dot(a, b) / norms).otherwise(F.lit(0.0))


def knn(rows: DataFrame, query: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows most similar to the one vector `q` of query, which is broadcast; filters go before ranking."""
    scored = rows.crossJoin(F.broadcast(query.limit(1))).withColumn("s", cosine(F.col(vector), F.col("q")))
    top = scored.orderBy(F.desc("s"), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), id_col))).withColumn("similarity", F.round("s", 3))


#: Queries that are broadcast at once; more of them take further passes over the rows.
BLOCK_QUERIES = 2_000


def similarity(distance: Column, metric: str = "cosine") -> Column:
    """A similarity of a distance: 1 - d of cosine distances, 1 - d / 2 of squared L2 ones between unit vectors, never below 0 for the latter."""
    return {"cosine": 1 - distance, "l2sq": F.greatest(F.lit(0.0), 1 - distance / 2)}[metric]


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; null where the dimensions differ."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


#: Queries and rows of one matrix product, which with its copies is all that a task holds beside the best rows.
TILE_QUERIES, TILE_ROWS = 250, 1_000


def _best(k: int, tile: tuple[int, int] = (TILE_QUERIES, TILE_ROWS)):
    """A function of Arrow batches: each task keeps, for each query of a block, its k best rows, by matrix products of tiles."""

    def of(block: tuple[list, np.ndarray]):
        ids, matrix = block

        def add(best: tuple[np.ndarray, np.ndarray, np.ndarray], s: np.ndarray, row_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The best rows (query, s, row id, by query), those of a tile with them."""
            kth = np.full((2, len(s)), -np.inf)  # similarity of the last of the best where there are as many as it takes
            full = np.flatnonzero(np.bincount(best[0], minlength=len(s)) > k)
            last = np.searchsorted(best[0], full, side="right") - 1
            kth[0, full] = best[1][last]
            if s.shape[1] > k + 1:
                kth[1] = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1]
            query, at = np.nonzero(s >= kth.max(axis=0)[:, None])
            merged = np.concatenate([best[0], query]), np.concatenate([best[1], s[query, at]]), np.concatenate([best[2], row_ids[at]])
            order = np.lexsort((merged[2], -merged[1], merged[0]))
            by_query = merged[0][order]
            place = np.arange(len(order)) - np.searchsorted(by_query, by_query)
            order = order[place <= k]
            return tuple(x[order] for x in merged)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: list = [None] * len(range(0, len(ids), tile[0]))
            for batch in batches:
                sizes = batch["v"].map(len).to_numpy()
                for size in np.unique(sizes):
                    places = np.flatnonzero(sizes == size)
                    for part in (places[i : i + tile[1]] for i in range(0, len(places), tile[1])):
                        row_ids = batch["row_id"].to_numpy()[part]
                        if size == matrix.shape[1]:
                            rows = np.stack(batch["v"].to_numpy()[part]).astype(np.float64)
                            norm = np.sqrt((rows * rows).sum(axis=1))
                            unit = np.where(norm[:, None] >= 1e-9, rows / np.maximum(norm, 1e-300)[:, None], 0.0).T
                        for n in range(len(best)):
                            asked = matrix[n * tile[0] : (n + 1) * tile[0]]
                            # equal vectors stay equal, whatever the order of the sums
                            s = np.round(asked @ unit, 12) if size == matrix.shape[1] else np.zeros((len(asked), len(part)))
                            best[n] = add(best[n] or (np.zeros(0, np.int64), np.zeros(0), row_ids[:0]), s, row_ids)
            for n, found in enumerate(best):
                if found is not None:
                    yield pd.DataFrame({"query_id": [ids[n * tile[0] + i] for i in found[0]], "row_id": found[2], "s": found[1]})

        return run

    return of


def knn_many(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows most similar to each stated query(query_id, q, ...), itself left out, with s, rank and similarity.

    Queries go to the tasks in blocks of BLOCK_QUERIES, with unit length; a task keeps the best k of its own rows for each, so
    only k rows a query and task are shuffled, whatever the number of rows, and holds a tile of similarities at a time, whatever
    the number of queries. Ties go to the smaller id. Vectors without length, and of another dimension than the query's, have similarity 0.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col(id_col).alias("row_id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    types = f"query_id {queries.schema['query_id'].dataType.simpleString()}, row_id {rows.schema[id_col].dataType.simpleString()}, s double"
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).orderBy("query_id").toLocalIterator(prefetchPartitions=True)
    found, block = [], []

    def add() -> None:
        for size in sorted({len(v) for _, v in block}):
            part = [(i, v) for i, v in block if len(v) == size]
            matrix = np.array([v for _, v in part], np.float64)
            norm = np.sqrt((matrix * matrix).sum(axis=1))
            matrix = np.where(norm[:, None] >= 1e-9, matrix / np.maximum(norm, 1e-300)[:, None], 0.0)
            found.append(kept.mapInPandas(_best(k)(([i for i, _ in part], matrix)), types))

    for r in asked:
        block.append((r["query_id"], r["q"] or []))
        if len(block) == BLOCK_QUERIES:
            add()
            block = []
    if block:
        add()
    if not found:
        found = [spark.createDataFrame([], types)]
    near = reduce(DataFrame.unionByName, found).filter("row_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "row_id"))
    top = near.withColumn("rank", rank).filter(F.col("rank") <= k)
    out = top.join(queries, "query_id").join(rows.withColumnRenamed(id_col, "row_id"), "row_id").withColumnRenamed("row_id", id_col)
    return out.withColumn("similarity", F.round("s", 3))
