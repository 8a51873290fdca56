"""Queries over sources and chunking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators.records import payload_check
from ..schema import TABLES
from ..session import shared_dir
from ..sources.tables import load_corpus, page_source, text_pages, write_table
from .bindings import chunks as whole_chunks
from .bindings import outlined, query, registry, split_cte, sql, table, vectors


@query(
    "load_corpus",
    sql(
        """SELECT r.document_id, r.md_id, r.status, sha256(r.text) AS text_sha256, len(r.text) AS chars, CAST(CASE WHEN e.vec_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS vectors
FROM registry r LEFT JOIN embeddings e ON e.vec_id = r.doc_id WHERE r.text IS NOT NULL""",
        "registry",
    ),
)
def corpus(spark, sf):
    """A corpus is stored as tables of the fixed schemas and loaded again, the tables that have no rows included."""
    seen = F.lit("2025-01-01 00:00:00").cast("timestamp")
    made = {
        "documents": registry(spark, sf),
        "chunks": whole_chunks(spark, sf).where("text IS NOT NULL").select(
            "*", F.sha2("text", 256).alias("text_sha256"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), seen.alias("indexed_at")
        ),
        "vectors": vectors(spark, sf),
    }
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, schema in TABLES.items():
        rows = made[name] if name in made else spark.createDataFrame([], schema)
        write_table(rows.select(*(F.col(f.name).cast(f.dataType) for f in schema)), f"{folder}/{name}")
    tables = load_corpus(spark, folder)
    have = tables["vectors"].groupBy("chunk_id").agg(F.count(F.lit(1)).alias("vectors"))
    found = tables["chunks"].join(tables["documents"].select("document_id", "status"), "document_id").join(have, "chunk_id", "left")
    return found.select("document_id", "md_id", "status", "text_sha256", F.col("char_end").cast("bigint").alias("chars"), F.coalesce("vectors", F.lit(0)).alias("vectors"))


@query("page_source", "SELECT page_id, url, sha256(html) AS raw_html_sha256, strlen(html) AS html_bytes FROM pages")
def pages(spark, sf):
    return page_source(table(spark, sf, "pages")).select("page_id", "url", "raw_html_sha256", F.col("html_bytes").cast("bigint").alias("html_bytes"))


@query("paged_text_source", sql("SELECT document_id, CAST(page AS BIGINT) AS page, body AS page_text FROM pages_of", "pages_of"))
def paged_text(spark, sf):
    return text_pages(outlined(spark, sf), "document_id").withColumn("page", F.col("page").cast("bigint"))


@query(
    "payload_check",
    """SELECT page_id, is_valid, CASE WHEN NOT is_valid THEN 'unexpected payload (content-type=' || content_type || ')' END AS error,
  sha256(html) AS payload_sha256, strlen(html) AS bytes
FROM (SELECT *, starts_with(content_type, 'text/html') AND starts_with(html, '<!DOCTYPE') AS is_valid FROM (
  SELECT *, CASE WHEN contains(url, '.html') THEN 'text/plain' ELSE 'text/html; charset=utf-8' END AS content_type FROM pages))""",
)
def payloads(spark, sf):
    typed = table(spark, sf, "pages").withColumn(
        "content_type", F.when(F.contains("url", F.lit(".html")), "text/plain").otherwise("text/html; charset=utf-8")
    )
    out = payload_check(typed, "html", "content_type", "<!DOCTYPE", "text/html")
    return out.select("page_id", "is_valid", "error", "payload_sha256", F.col("bytes").cast("bigint").alias("bytes"))


@query(
    "extraction_quality",
    sql(
        """SELECT document_id, page_count, pages_with_text, round(pages_with_text / page_count, 6) AS quality,
  trim(text) <> '' AND pages_with_text / page_count >= 0.8 AS passes
FROM (SELECT document_id, text, greatest(len(string_split(text, chr(12))) - 1, 1) AS page_count,
  CAST(len(list_filter(string_split(text, chr(12)), lambda p: trim(p, ' ' || chr(9) || chr(10)) <> '')) AS BIGINT) AS pages_with_text FROM outlined)""",
        "outlined",
    ),
)
def extraction_quality(spark, sf):
    q = outlined(spark, sf).select("document_id", C.extraction_quality(F.col("text")).alias("q"))
    return q.select(
        "document_id", F.col("q.page_count").cast("bigint").alias("page_count"),
        F.col("q.pages_with_text").cast("bigint").alias("pages_with_text"), F.round("q.quality", 6).alias("quality"), "q.passes",
    )


@query(
    "lines_with_offsets",
    sql("SELECT document_id, line_no, page, CAST(char_offset AS BIGINT) AS char_offset, replace(line, chr(12), '') AS line FROM kept_lines", "kept_lines"),
)
def lines(spark, sf):
    return C.lines_with_offsets(outlined(spark, sf)).select(
        "document_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("page").cast("bigint").alias("page"),
        F.col("char_offset").cast("bigint").alias("char_offset"), "line",
    )


@query("outline_anchors", sql("SELECT document_id, line_no, page, anchor, CASE WHEN base IS NOT NULL THEN section END AS section FROM anchored", "anchored"))
def anchors(spark, sf):
    return C.outline_anchors(outlined(spark, sf)).select(
        "document_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("page").cast("bigint").alias("page"), "anchor", "section"
    )


@query("outline_chunks", sql("SELECT * FROM outline_chunks", "outline_chunks"))
def chunks(spark, sf):
    out = C.outline_chunks(outlined(spark, sf), carry=())
    return out.select(*[F.col(c).cast("bigint").alias(c) if c in ("page", "char_start", "char_end") else c for c in out.columns])


split_cte("long_parts", "SELECT CAST(doc_id AS VARCHAR) AS key, 0 AS start, trim(text, ' ' || chr(9) || chr(10)) AS body FROM documents", "clauses", 2000)


@query("split_long", sql("SELECT key AS md_id, text AS part, CAST(offset_at AS BIGINT) AS part_offset FROM long_parts", "long_parts"))
def split_long(spark, sf):
    body = C.strip(F.col("text"))
    parts = registry(spark, sf).select("md_id", F.inline(C.split_long(body)))
    return parts.select("md_id", F.col("text").alias("part"), F.col("offset").cast("bigint").alias("part_offset"))


@query(
    "chunk_ids",
    """SELECT CAST(doc_id AS VARCHAR) AS md_id, 'ns:' || source || ':' || doc_id || '#p=' || CASE WHEN lang = 'en' THEN substr(sha1(text), 1, 8) ELSE lang END || '@' || n_chars AS chunk_id,
  sha256(text) AS text_sha256 FROM documents""",
)
def chunk_ids(spark, sf):
    anchor = F.when(F.col("lang") != "en", F.col("lang"))
    return registry(spark, sf).select(
        "md_id", C.chunk_id(F.col("document_id"), anchor, F.col("text"), F.col("n_chars")).alias("chunk_id"), F.sha2("text", 256).alias("text_sha256")
    )
