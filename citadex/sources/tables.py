"""Reading corpus tables, page snapshots and paged text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES


def load_corpus(spark: SparkSession, folder: str, views: bool = False) -> dict[str, DataFrame]:
    """All corpus tables of a folder with their fixed schemas, optionally as temporary views."""
    tables = {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()}
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A new table folder; an existing one is never overwritten."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def page_source(pages: DataFrame) -> DataFrame:
    """Fetched pages with the hash and size of their raw body, kept for the audit."""
    return pages.withColumn("raw_html_sha256", F.sha2("html", 256)).withColumn("html_bytes", F.octet_length("html"))


def paged_text_source(spark: SparkSession, path: str) -> DataFrame:
    """One row per extracted-text file: (path, text), form feeds between pages."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def text_pages(texts: DataFrame, id_col: str) -> DataFrame:
    """(id, page, page_text) of texts with form feeds between pages, pages counted from 1."""
    return texts.select(id_col, F.posexplode(F.split("text", "\f")).alias("pos", "page_text")).select(
        id_col, (F.col("pos") + 1).alias("page"), "page_text"
    )


def binary_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of fetched binary files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
