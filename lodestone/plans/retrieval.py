"""The retrieval query: route, top-k, fuse, rerank, diversify, expand, merge, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import dense_top_k, rerank, rrf, sparse_top_k, top_k
from ..operators.windows import cap_per_group, keep_first


def fused(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score): the k best of each of the dense and sparse lists, fused by rank."""
    dense, sparse = dense_top_k(queries, chunks, k), sparse_top_k(queries, chunks, k)
    return rrf(dense.select("query_id", "chunk_id", "rank").unionByName(sparse.select("query_id", "chunk_id", "rank")))


def hybrid(queries: DataFrame, chunks: DataFrame, k: int = 12, cap: int = 2) -> DataFrame:
    """(query_id, chunk_id, file, score, pick).

    queries (query_id, q, text), chunks (chunk_id, v, text, file). Dense and sparse lists are fused, then reranked with the
    keywords and capped per file.
    """
    best = top_k(fused(queries, chunks, 4 * k), ["query_id"], "score", "chunk_id", 4 * k)
    hits = best.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id").join(chunks.select("chunk_id", "text", "file"), "chunk_id")
    ranked = rerank(keep_first(hits, ["query_id", "chunk_id"], ["rank"]), 2 * k)
    return cap_per_group(ranked, "query_id", "file", "rank", cap, k).select("query_id", "chunk_id", "file", "score", "pick")
