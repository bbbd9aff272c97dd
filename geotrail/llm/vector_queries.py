"""Queries over ``embeddings`` (operators 8 and 10)."""

from __future__ import annotations

from geotrail.llm.embed_dedup import link_vectors
from geotrail.llm.registry import query, table
from geotrail.llm.topk import exact_top_k

# components need recursion over links: tested against brute force
@query("op8_embedding_dedup")
def op8_embedding_dedup(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return link_vectors(vectors, threshold=0.95).drop("embedding")


@query("op10_topk_search", r"""
WITH v AS (SELECT vec_id, [floor(64.0::DOUBLE * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20""")
def op10_topk_search(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return exact_top_k(vectors.filter("vec_id % 20 = 0"), vectors, k=20, scale=64.0)
