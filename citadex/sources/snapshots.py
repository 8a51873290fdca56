"""Whole-or-nothing publication of corpus builds.

A build is written to its own ``snapshot=<id>`` folder and becomes visible only when a manifest entry names it.
Every entry is a file named by its number, which only one publisher can create. Readers take the newest entry, so they see
the old build or the new one and never a half-written one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .claims import claim, entries
from .tables import write_table


class PublishRefused(RuntimeError):
    """The gate or the compatibility check did not accept the build."""


MANIFEST = "snapshot string, seq bigint, published_at timestamp"


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    return entries(spark, f"{root}/manifest", MANIFEST)


def current_snapshot(spark: SparkSession, root: str) -> str | None:
    """Id of the newest published build; the manifest has one row per build."""
    row = _manifest(spark, root).orderBy(F.col("seq").desc()).limit(1).collect()
    return row[0]["snapshot"] if row else None


def publish_snapshot(
    spark: SparkSession,
    root: str,
    snapshot: str,
    tables: Mapping[str, DataFrame],
    gate: DataFrame | None = None,
    compatibility: DataFrame | None = None,
) -> None:
    """Write all tables of a build, then commit it; refuses before writing when a verdict row says no."""
    for verdict, column in ((gate, "gate_passed"), (compatibility, "accepted")):
        if verdict is not None and not verdict.select(column).first()[0]:
            raise PublishRefused(f"{column} is false for build {snapshot}")
    for name, df in tables.items():
        write_table(df, f"{root}/snapshot={snapshot}/{name}")
    _commit(spark, root, snapshot)


def _commit(spark: SparkSession, root: str, snapshot: str, attempts: int = 100) -> int:
    """Add the manifest entry under the next free number; whoever finds the number taken draws another."""
    for _ in range(attempts):
        last = _manifest(spark, root).agg(F.coalesce(F.max("seq"), F.lit(0)), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).first()
        number = last[0] + 1
        if claim(spark, f"{root}/manifest/{number:09d}.json", {"snapshot": snapshot, "seq": number, "published_at": last[1]}):
            return number
    raise PublishRefused(f"no free manifest number for build {snapshot}")


def read_snapshot(spark: SparkSession, root: str, table: str, snapshot: str | None = None) -> DataFrame:
    """A table of the given build, or of the newest published one."""
    chosen = snapshot or current_snapshot(spark, root)
    if chosen is None:
        raise FileNotFoundError(f"nothing published under {root}")
    return spark.read.parquet(f"{root}/snapshot={chosen}/{table}")
