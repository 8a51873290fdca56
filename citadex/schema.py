"""Corpus tables as StructTypes."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
    "ARRAY<FLOAT>": T.ArrayType(T.FloatType()),
}


def _struct(ddl: str) -> T.StructType:
    """A schema in DDL, read without a session."""
    columns = [column.split(maxsplit=2) for column in ddl.strip().split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind], not rest) for name, kind, *rest in columns])


DOCUMENTS = _struct(
    """
    document_id STRING NOT NULL,
    md_id STRING NOT NULL,
    title STRING NOT NULL,
    detail_url STRING NOT NULL,
    last_updated_at DATE,
    issued_date DATE,
    ref_no STRING,
    department STRING,
    document_family STRING NOT NULL,
    pdf_urls ARRAY<STRING> NOT NULL,
    status STRING NOT NULL,
    first_seen_at TIMESTAMP NOT NULL,
    last_seen_at TIMESTAMP NOT NULL,
    raw_list_sha256 STRING
    """
)
WITHDRAWN = _struct(
    """
    original_ref STRING,
    original_id STRING,
    title STRING NOT NULL,
    issued_date DATE,
    withdrawn_date DATE,
    replacement_ref STRING,
    detail_url STRING,
    first_seen_at TIMESTAMP NOT NULL,
    last_seen_at TIMESTAMP NOT NULL
    """
)
CRAWL_RUNS = _struct(
    """
    started_at TIMESTAMP NOT NULL,
    finished_at TIMESTAMP,
    source STRING NOT NULL,
    source_url STRING,
    status_code INT,
    raw_html_sha256 STRING,
    items_seen INT,
    items_added INT,
    items_changed INT,
    items_removed INT,
    error STRING
    """
)
CHUNKS = _struct(
    """
    chunk_id STRING NOT NULL,
    document_id STRING NOT NULL,
    md_id STRING NOT NULL,
    ref_no STRING,
    section STRING,
    paragraph_anchor STRING,
    page INT,
    text STRING NOT NULL,
    text_sha256 STRING NOT NULL,
    char_start INT NOT NULL,
    char_end INT NOT NULL,
    pdf_url STRING,
    indexed_at TIMESTAMP
    """
)
VECTORS = _struct(
    """
    chunk_id STRING NOT NULL,
    embedding ARRAY<FLOAT> NOT NULL
    """
)
ARTIFACTS = _struct(
    """
    pdf_url STRING NOT NULL,
    document_id STRING NOT NULL,
    md_id STRING NOT NULL,
    pdf_sha256 STRING,
    text_sha256 STRING,
    bytes INT,
    page_count INT,
    extraction_quality DOUBLE,
    is_indexed BOOLEAN NOT NULL,
    fetched_at TIMESTAMP,
    extracted_at TIMESTAMP,
    error STRING
    """
)
META = _struct(
    """
    key STRING NOT NULL,
    value STRING,
    updated_at TIMESTAMP
    """
)

TABLES = {
    "documents": DOCUMENTS,
    "withdrawn": WITHDRAWN,
    "crawl_runs": CRAWL_RUNS,
    "chunks": CHUNKS,
    "vectors": VECTORS,
    "artifacts": ARTIFACTS,
    "meta": META,
}

# Fixed values.
FAMILIES = ("master_direction", "standalone_circular", "notification", "master_circular", "press_release", "faq")
STATUSES = ("current", "withdrawn", "superseded", "draft", "unknown")
