"""Awkward documents that every operator has to stand."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, row string, key string, shard int, label int"
BASE = "The quick brown fox jumps over the lazy dog while seven wizards brew a potion of night shade and honey. "


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns that clash with inner names."""
    rows = [
        (1, BASE * 3, "en", "a", 1, "x", "y", "z", 1, 1),
        (2, None, None, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, "", "", "", 0, 0),
        (4, "!!! 123 ...", "en", None, 11, None, None, None, None, None),
        (5, BASE * 3, "en", "b", 1, "x", "y", "z", 1, 1),
        (5, BASE * 3, "en", "b", 1, "x", "y", "z", 1, 1),
        (None, "ein Text ohne Nummer über Bäume und Häuser", "de", "c", 3, "q", "q", "q", 2, 2),
        (None, None, None, None, None, None, None, None, None, None),
        (8, "langer Satz über Straßen und Gärten " * 9000, "de", "c", 9, "q", "q", "q", 2, 2),
        (9, "\x00\x01 \U0001f600 tab\tline\nend", "en", "", 9, "q", "q", "q", 2, 2),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def sample(spark: SparkSession, sf: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")
