"""Registered queries over the test tables."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from .bindings import ORACLES, QUERIES

_MODULES = ("chunk_queries", "retrieval_queries", "maintain_queries", "record_queries", "report_queries")


def load():
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Documents are chunked, indexed and searched with every benchmark clause; hits carry their citation."""
    from ..operators.chunking import outline_chunks
    from ..operators.fusion import cite, few_queries
    from ..operators.lexical import bm25_topk
    from .bindings import clauses, outlined, registry

    reg = registry(spark, sf)
    chunks = outline_chunks(outlined(spark, sf)).join(reg.select("document_id", "status"), "document_id", "left")
    asked = clauses(spark, sf)
    small = few_queries(asked)
    hits = bm25_topk(asked, chunks, 5, small=small)
    return cite(hits, chunks.drop("status"), reg, small).select(
        "query_id", "rank", "chunk_id", "bm25_score", "document_id", "document_title", "document_url", "section",
        "paragraph_anchor", "page", "status", "text",
    )
