"""Hybrid retrieval: rank fusion, confidence, and the two batch search reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, word_tokens
from ..session import settle
from ..sizes import BROADCAST_ROWS, broadcast_if, fits
from .dense import knn_topk
from .lexical import TextIndex, bm25_topk, topic_filter

PER_SIDE = 30
RRF_K = 60
MIN_FUSION = 0.022
MAX_BM25 = -5.0
MAX_LIMIT = 50
DEFAULT_LIMIT = 5
MAX_INPUT_CHARS = 32_000


def rrf_fuse(sparse: DataFrame, dense: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, chunk_id, bm25_score, rank) and (.., vec_distance, rank).

    Ties follow the keyword order, then the vector order. A query that only one side answers keeps that side's
    order and has no fusion score.
    """
    left = sparse.select("query_id", "chunk_id", "bm25_score", F.col("rank").alias("sparse_rank"))
    right = dense.select("query_id", "chunk_id", "vec_distance", F.col("rank").alias("dense_rank"))
    both = left.join(right, ["query_id", "chunk_id"], "full_outer")
    by_query = Window.partitionBy("query_id")
    part = lambda rank: F.coalesce(1.0 / (rrf_k + F.col(rank)), F.lit(0.0))
    two_sided = (F.count("sparse_rank").over(by_query) > 0) & (F.count("dense_rank").over(by_query) > 0)
    scored = both.withColumn("fusion_score", F.when(two_sided, part("sparse_rank") + part("dense_rank")))
    order = by_query.orderBy(
        F.round("fusion_score", 12).desc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), F.col("dense_rank")
    )
    return scored.withColumn("rank", F.row_number().over(order))


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    query_vectors: DataFrame,
    limit: int = DEFAULT_LIMIT,
    per_side: int = PER_SIDE,
    index: TextIndex | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Keyword top-30 and vector top-30 per query, fused; the first ``limit`` (or the query's own limit) stay.

    ``vectors`` has chunk_id, embedding, md_id, status; ``query_vectors`` has query_id, embedding. ``small`` tells
    that the number of queries has been checked already.
    """
    carry = [c for c in ("filter_md_id", "include_withdrawn") if c in queries.columns]
    sparse = bm25_topk(queries, chunks, per_side, index=index, small=small)
    asked = queries.select("query_id", *carry).join(query_vectors.select("query_id", "embedding"), "query_id")
    dense = knn_topk(vectors, asked, per_side, include_withdrawn=False)
    fused = rrf_fuse(sparse, dense)
    if "limit" in queries.columns:
        return fused.join(queries.select("query_id", "limit"), "query_id").filter(F.col("rank") <= F.col("limit")).drop("limit")
    return fused.filter(F.col("rank") <= limit)


def few_queries(queries: DataFrame) -> bool:
    """Are there so few queries that even fifty hits for each of them may be broadcast?"""
    return fits(queries, BROADCAST_ROWS // MAX_LIMIT)


def cite(hits: DataFrame, chunks: DataFrame, registry: DataFrame, small: bool) -> DataFrame:
    """Add citation columns after the ranking, so wide text is read for the hits only.

    ``small`` says that the hits come from :func:`few_queries`; they are then broadcast to the chunk scan.
    """
    hits = broadcast_if(small, hits)
    columns = ["document_id", "ref_no", "section", "paragraph_anchor", "page", "text", "pdf_url"]
    present = [c for c in columns if c in chunks.columns]
    found = chunks.select("chunk_id", *present).join(hits, "chunk_id")
    wanted = broadcast_if(small, found.select("document_id").distinct())
    documents = registry.select(
        "document_id", F.col("title").alias("document_title"), F.col("detail_url").alias("document_url"),
        "last_updated_at", "status",
    ).join(wanted, "document_id", "left_semi")
    return found.join(broadcast_if(small, documents), "document_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("current"))
    )


def clamp_limit(value: Column, default: int = DEFAULT_LIMIT) -> Column:
    """Whole number in [1, 50]; anything unreadable is the default."""
    number = F.coalesce(value.try_cast("bigint"), F.lit(default))
    return F.least(F.greatest(number, F.lit(1)), F.lit(MAX_LIMIT))


def split_oversized(inputs: DataFrame, max_chars: int = MAX_INPUT_CHARS, col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): too long inputs are refused whole, with reason and length, never cut."""
    length = F.length(F.coalesce(F.col(col), F.lit("")))
    rejected = inputs.filter(length > max_chars).withColumn("reason", F.lit("input_too_large")).withColumn(
        "length", length
    ).withColumn("max_length", F.lit(max_chars))
    return inputs.filter(length <= max_chars), rejected


def confidence(hits: DataFrame, queries: DataFrame, small: bool) -> DataFrame:
    """One row per query with low_confidence; ``queries`` has query_id and retrieval (NULL: nothing was searched)."""
    top = hits.filter(F.col("rank") == 1).select(
        "query_id", "fusion_score", "sparse_rank", "dense_rank", "bm25_score", F.lit(True).alias("answered")
    )
    agree = F.col("sparse_rank").isNotNull() & F.col("dense_rank").isNotNull()
    low = (
        F.when(F.col("answered").isNull(), True)
        .when(F.col("retrieval") == "hybrid", (F.coalesce("fusion_score", F.lit(0.0)) < MIN_FUSION) | ~agree)
        .otherwise(F.col("bm25_score").isNull() | (F.col("bm25_score") > MAX_BM25))
    )
    joined = queries.join(broadcast_if(small, top), "query_id", "left")
    return joined.withColumn("low_confidence", low).drop(
        "fusion_score", "sparse_rank", "dense_rank", "bm25_score", "answered"
    )


def _prepare(queries: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """Strip the texts and note how each query can be answered."""
    raw = strip(F.coalesce("text", F.lit("")))
    has_vector = query_vectors.select("query_id").distinct().withColumn("has_vector", F.lit(True))
    searchable = F.size(word_tokens(F.col("text"))) > 0
    return (
        queries.withColumn("text", raw)
        .join(has_vector, "query_id", "left")
        .withColumn(
            "retrieval",
            F.when(~searchable, F.lit(None)).when(F.col("has_vector"), "hybrid").otherwise("sparse_only"),
        )
        .withColumn(
            "message",
            F.when(F.col("text") == "", "empty_input").when(~searchable, "no_searchable_tokens"),
        )
        .drop("has_vector")
    )


def check_compliance(
    queries: DataFrame,
    chunks: DataFrame,
    registry: DataFrame,
    vectors: DataFrame,
    query_vectors: DataFrame,
    aliases: DataFrame,
    limit: int = DEFAULT_LIMIT,
    index: TextIndex | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Clauses (query_id, text, topic_hint) to ranked provisions with citation, status and confidence.

    Every clause yields at least one row; a clause without provisions has a NULL rank.
    """
    small = few_queries(queries) if small is None else small
    prepared = topic_filter(_prepare(queries, query_vectors), aliases)
    searched = prepared.filter(F.col("retrieval").isNotNull())
    carry = ["filter_md_id"] + (["limit"] if "limit" in queries.columns else [])
    hits = hybrid_search(searched.select("query_id", "text", *carry), chunks, vectors, query_vectors, limit, index=index, small=small)
    hits = settle(hits)  # ranked once, then used for the flags, the citations and the report
    flags = confidence(hits, prepared, small)
    provisions = cite(hits, chunks, registry, small).withColumnRenamed("text", "quoted_text")
    report = flags.select(
        "query_id", "topic_hint", "retrieval", "low_confidence", "message", F.substring("text", 1, 120).alias("input_text_preview")
    )
    return report.join(provisions, "query_id", "left").withColumn(
        "message", F.coalesce("message", F.when(F.col("rank").isNull(), "no_provisions_matched"))
    )


def search(
    queries: DataFrame,
    chunks: DataFrame,
    registry: DataFrame,
    vectors: DataFrame,
    query_vectors: DataFrame,
    aliases: DataFrame,
    limit: int = DEFAULT_LIMIT,
    index: TextIndex | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Queries (query_id, text, topic, include_withdrawn, regulated_entity, as_of_date) to ranked results.

    The last two filters are accepted but not applied; filter_warning names them when given.
    """
    small = few_queries(queries) if small is None else small
    prepared = topic_filter(_prepare(queries, query_vectors), aliases, "topic")
    searched = prepared.filter(F.col("retrieval").isNotNull())
    hits = hybrid_search(
        searched.select("query_id", "text", "filter_md_id", "include_withdrawn"), chunks, vectors, query_vectors, limit, index=index, small=small
    )
    hits = settle(hits)
    given = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.lit(c))
    ignored = F.array_compact(F.array(given("regulated_entity"), given("as_of_date")))
    report = prepared.select(
        "query_id", F.col("text").alias("query"), "retrieval", "message",
        F.when(F.size(ignored) > 0, F.array_join(ignored, ", ")).alias("filter_warning"),
    )
    return report.join(cite(hits, chunks, registry, small), "query_id", "left")
