"""Evaluation dumps as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVISIONS = (
    "array<struct<document_id:string,paragraph_anchor:string,quoted_text:string,fusion_score:double,"
    "sparse_rank:int,dense_rank:int>>"
)
DUMP = (
    "case_name string, clause string, expected_md_id string, passed boolean, low_confidence boolean, "
    f"retrieval_mode string, detail string, latency_ms double, top_provisions {PROVISIONS}"
)


def write_dump(lines: DataFrame, path: str) -> None:
    """Write (case_name, line) as JSON lines."""
    lines.select("line").write.mode("errorifexists").text(path)


def load_dump(spark: SparkSession, path: str, run: str) -> DataFrame:
    """(run, case_name, passed, keys, ..) of a dump; the last line of a repeated case name counts."""
    rows = spark.read.schema(DUMP).json(path).withColumn("_at", F.struct("_metadata.file_path", F.monotonically_increasing_id()))
    keys = F.transform(
        F.coalesce("top_provisions", F.array().cast(PROVISIONS)),
        lambda p: F.concat(F.coalesce(p["document_id"], F.lit("")), F.lit("::"), F.coalesce(p["paragraph_anchor"], F.lit(""))),
    )
    last = rows.groupBy("case_name").agg(
        F.max_by(F.struct("passed", keys.alias("keys"), "low_confidence", "retrieval_mode", "latency_ms"), F.col("_at")).alias("r")
    )
    return last.select(F.lit(run).alias("run"), "case_name", "r.*")
