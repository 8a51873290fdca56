"""Document views: table of contents and assembled text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_toc(requests: DataFrame, registry: DataFrame, chunks: DataFrame, preview_chars: int = 80) -> DataFrame:
    """One row per requested document and chunk, to be read in char_start order; unknown ids give a status row.

    The long form keeps any number of chunks per document apart, so no row and no task has to hold them all.
    """
    asked = requests.select("document_id").distinct()
    chunks = chunks.join(asked, "document_id", "left_semi")
    registry = registry.join(asked, "document_id", "left_semi")
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    documents = registry.select(
        "document_id", "title", F.col("detail_url").alias("official_url"), "last_updated_at",
        F.coalesce("status", F.lit("current")).alias("status"), F.lit(True).alias("known"),
    )
    contents = chunks.select(
        "document_id", "chunk_id", "section", "paragraph_anchor", "page", "char_start",
        F.substring("text", 1, preview_chars).alias("preview"),
    )
    return (
        asked.join(documents, "document_id", "left")
        .join(counts, "document_id", "left")
        .join(contents, "document_id", "left")
        .withColumn("status", F.coalesce("status", F.lit("unknown")))
        .withColumn("error", F.when(F.col("known").isNull(), "document_not_in_corpus"))
        .withColumn("chunk_count", F.when(F.col("known"), F.coalesce("chunk_count", F.lit(0))))
        .drop("known")
    )


def assemble_text(chunks: DataFrame, joiner: str = "\n\n") -> DataFrame:
    """(document_id, text): the chunk texts of a document in order, joined by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct("char_start", "chunk_id", "text")))
    return chunks.groupBy("document_id").agg(
        F.array_join(F.transform(ordered, lambda c: c["text"]), joiner).alias("text")
    )
