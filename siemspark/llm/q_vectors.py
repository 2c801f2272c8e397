"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from siemspark.llm import bitslice
from siemspark.llm.common import table
from siemspark.llm.registry import query


@query("op10_exact_top_k", """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op10(spark, sf_dir):
    """The 20 best rows by integer inner product for every vector whose id is divisible by 20."""
    vectors = bitslice.quantised(table(spark, sf_dir, "embeddings"))
    return bitslice.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)
