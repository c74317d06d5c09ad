"""Vector search over the `embeddings` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.operators import vectors
from loreweave.runtime import table


def v2_filtered_knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    query = e.filter("vec_id = 7").select(F.col("embedding").alias("q"))
    return vectors.knn(e.filter("label in (1, 3, 5)"), query, 10).select("rank", "vec_id", "label", "similarity")


V2 = """
SELECT CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS INTEGER) AS rank, vec_id, label, round(s, 3) AS similarity
FROM (SELECT e.vec_id, e.label, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) /
        (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS s
      FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.label IN (1, 3, 5))
ORDER BY s DESC, vec_id LIMIT 10
"""

PLANS = {"v2_filtered_knn": (v2_filtered_knn, V2)}
