"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import pathlib
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citadex import session
from citadex.session import settle

__all__ = ["arrow_map", "fold", "grouped", "held_out", "settle", "ship", "table", "text_bytes"]

ROOT = pathlib.Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "citadex_llm.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((ROOT / "citadex").rglob("*.py")):
            out.write(path, path.relative_to(ROOT))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; an id that is null counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds


def held_out(doc_id: Column | str, folds: int, which: int) -> Column:
    return fold(doc_id, folds) == which


def text_bytes(name: str = "text") -> Column:
    """A text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand in the workers, and batches of few rows, as texts may be long."""
    ship(df.sparkSession)
    return session.arrow_map(df, fn, schema)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of a partition that is ordered by ``keys``, one held at a time."""
    now, held = None, []
    for b in batches:
        spots = list(zip(*(b.column(n).to_pylist() for n in keys)))
        bounds = [0, *(i for i in range(1, len(spots)) if spots[i] != spots[i - 1]), len(spots)]
        for first, last in zip(bounds, bounds[1:]):
            if first == last:
                continue
            if held and spots[first] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = spots[first]
            held.append(b.slice(first, last - first))
    if held:
        yield now, pa.Table.from_batches(held)
