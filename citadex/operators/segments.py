"""A stored term index that changes at the cost of the change: segments, tombstones, merges.

Postings lie in ``postings/segment=<id>/bucket=<n>``, where the bucket is the chunk's hash; every file of a bucket is in term
order, so a batch of queries reads the pages of its terms. Each chunk, also one without terms, has a posting of the pseudo
term ``EVERY``, so that its length is known when it leaves. Texts are read once: what a segment is made of is kept as a row a
chunk until the segment is committed. A refresh writes one segment: the postings of the fresh chunks,
the ids of those that left, and the difference of the statistics, for which it reads the buckets of the leaving chunks
alone. A merge rewrites the buckets that have gathered too many segments and no others. What a version of the index
consists of is one line in ``log``, whose number only one writer can take; readers of earlier versions are not disturbed.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from ..sizes import BROADCAST_ROWS, broadcast_if, fits
from ..sources.claims import claim, entries
from .lexical import EVERY, LENGTH, TextIndex, all_postings, hot_terms, index_of, term_stats

LOG = "version int, segment string, kind string, buckets int, stem boolean, whole_stats boolean, merged array<int>, filled array<int>"
POSTINGS = "chunk_id string, dl int, term string, tf bigint"
#: Segments in which a bucket may lie before ``refresh`` merges it.
MOST_SEGMENTS = 8


class RefreshRefused(RuntimeError):
    """Somebody else changed the index meanwhile."""


@dataclass
class _State:
    """The log of an index, at most one line a refresh or merge since it was created."""

    folder: str
    lines: list

    @property
    def version(self) -> int:
        return self.lines[-1].version

    @property
    def buckets(self) -> int:
        return self.lines[0].buckets

    def oldest(self) -> dict[int, int]:
        """The version of its last merge, for every bucket that was merged: earlier segments of the bucket are dead."""
        return {b: line.version for line in self.lines for b in line.merged or []}

    def living(self, bucket: int) -> int:
        """Segments in which a bucket has postings."""
        first = self.oldest().get(bucket, 0)
        return sum(line.version >= first and bucket in (line.filled or []) for line in self.lines)


def _state(spark: SparkSession, folder: str) -> _State:
    lines = entries(spark, f"{folder}/log", LOG).orderBy("version").collect()
    if not lines:
        raise FileNotFoundError(f"no index under {folder}")
    return _State(folder, lines)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int")


def _write(state_folder: str, segment: str, postings: DataFrame, stats: DataFrame, buckets: int) -> list[int]:
    """Write the postings (with those of ``EVERY``) and statistics of a segment; the buckets it fills."""
    spark = postings.sparkSession
    pieces = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
    rows = postings.select(F.col("chunk_id").cast("string"), F.col("dl").cast("int"), "term", F.col("tf").cast("long"), _bucket(buckets).alias("bucket"))
    # Pieces by chunk: no word of many chunks weighs on one of them, and no rows are looked at first to find bounds.
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("chunk_id", F.lit("piece")), F.lit(pieces))).sortWithinPartitions("bucket", "term", "chunk_id")
    path = f"{state_folder}/postings/segment={segment}"
    dealt.write.mode("errorifexists").partitionBy("bucket").parquet(path)
    stats.select("term", F.col("df").cast("long")).write.mode("errorifexists").parquet(f"{state_folder}/stats/segment={segment}")
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in home.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(home)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("bucket="))  # at most ``buckets`` numbers


@contextlib.contextmanager
def _kept(index: TextIndex, folder: str, segment: str) -> Iterator[TextIndex]:
    """The index with its counted terms in files, so that texts are read once; the files go at the end."""
    if index.rows is None:
        raise ValueError("an index that is stored already cannot be stored again")
    spark, path = index.postings.sparkSession, f"{folder}/draft/segment={segment}"
    index.rows.write.mode("errorifexists").parquet(path)
    yield index_of(spark.read.schema(index.rows.schema).parquet(path), index.stem)
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    home.getFileSystem(spark._jsc.hadoopConfiguration()).delete(home, True)


def _commit(spark: SparkSession, folder: str, line: dict) -> None:
    if not claim(spark, f"{folder}/log/{line['version']:09d}.json", line):
        raise RefreshRefused(f"version {line['version']} of {folder} is taken")


def create(index: TextIndex, folder: str, buckets: int = 64) -> None:
    """Store an index under ``folder``. ``buckets`` stays for its life: the share of it that the smallest change rewrites."""
    spark, segment = index.postings.sparkSession, uuid.uuid4().hex
    with _kept(index, folder, segment) as kept:
        filled = _write(folder, segment, all_postings(kept.rows), kept.stats, buckets)
    _commit(spark, folder, {"version": 1, "segment": segment, "kind": "create", "buckets": buckets, "stem": index.stem, "whole_stats": True, "merged": [], "filled": filled})


def _live(spark: SparkSession, state: _State, only: list[int] | None = None) -> DataFrame:
    """chunk_id, dl, term, tf, bucket of the postings that live; ``only`` names the buckets to read."""
    lines = [x for x in state.lines if x.filled]
    if not lines:
        return spark.createDataFrame([], f"{POSTINGS}, bucket int")
    paths = [f"{state.folder}/postings/segment={x.segment}" for x in lines]
    rows = spark.read.schema(f"{POSTINGS}, segment string, bucket int").option("basePath", f"{state.folder}/postings").parquet(*paths)
    if only is not None:
        rows = rows.where(F.col("bucket").isin(only))
    for bucket, version in state.oldest().items():  # segments before a bucket's merge: pruned as folders
        dead = [x.segment for x in lines if x.version < version]
        if dead and (only is None or bucket in only):
            rows = rows.where((F.col("bucket") != bucket) | ~F.col("segment").isin(dead))
    version = F.create_map(*(F.lit(v) for x in lines for v in (x.segment, x.version)))[F.col("segment")]
    gone = _gone(spark, state)
    if gone is not None:
        small = broadcast_if(fits(gone, BROADCAST_ROWS), gone)
        rows = rows.withColumn("version", version).join(small, (F.col("chunk_id") == F.col("gone_id")) & (F.col("version") < F.col("gone_at")), "left_anti")
    return rows.select("chunk_id", "dl", "term", "tf", "bucket")


def _gone(spark: SparkSession, state: _State) -> DataFrame | None:
    """gone_id, gone_at: chunks that left, with the last version that says so."""
    lines = [x for x in state.lines if x.kind == "refresh"]
    if not lines:
        return None
    paths = [f"{state.folder}/gone/segment={x.segment}" for x in lines]
    rows = spark.read.schema("chunk_id string, segment string").option("basePath", f"{state.folder}/gone").parquet(*paths)
    version = F.create_map(*(F.lit(v) for x in lines for v in (x.segment, x.version)))[F.col("segment")]
    return rows.groupBy(F.col("chunk_id").alias("gone_id")).agg(F.max(version).alias("gone_at"))


def _stats(spark: SparkSession, state: _State) -> DataFrame:
    """term, df: the last whole statistics and the differences after them."""
    first = max(i for i, x in enumerate(state.lines) if x.whole_stats)
    paths = [f"{state.folder}/stats/segment={x.segment}" for x in state.lines[first:] if x.whole_stats or x.kind == "refresh"]
    rows = spark.read.schema("term string, df bigint").parquet(*paths)
    return rows.groupBy("term").agg(F.sum("df").alias("df")).where((F.col("df") > 0) | F.col("term").isin(EVERY, LENGTH))


def load(spark: SparkSession, folder: str) -> TextIndex:
    """The newest version of a stored index."""
    state = _state(spark, folder)
    stats = _stats(spark, state)
    return TextIndex(_live(spark, state).drop("bucket").where(F.col("term") != EVERY), stats, hot_terms(stats), stored=True, stem=state.lines[0].stem)


def refresh(spark: SparkSession, folder: str, gone: DataFrame, fresh: TextIndex, most: int = MOST_SEGMENTS) -> int:
    """Let the chunks of ``gone`` (chunk_id) leave and those of ``fresh`` join; the new version.

    A chunk that changes is in both. Buckets that now lie in more than ``most`` segments are merged. An id that the index does not
    hold may be among those gone. Of two writers at once the later one is refused and leaves the index as it was.
    """
    state = _state(spark, folder)
    if state.lines[0].stem != fresh.stem:
        raise ValueError("both indexes have to be built alike")
    segment, version = uuid.uuid4().hex, state.version + 1
    leaving = settle(gone.select(F.col("chunk_id").cast("string").alias("chunk_id")).where("chunk_id IS NOT NULL").distinct())
    dirty = sorted(r.bucket for r in leaving.select(_bucket(state.buckets).alias("bucket")).distinct().collect())
    dropped = _live(spark, state, dirty).join(broadcast_if(fits(leaving, BROADCAST_ROWS), leaving), "chunk_id", "left_semi")
    lost = term_stats(dropped).select("term", (-F.col("df")).alias("df"))
    leaving.write.mode("errorifexists").parquet(f"{folder}/gone/segment={segment}")
    with _kept(fresh, folder, segment) as kept:
        change = kept.stats.select("term", "df").unionByName(lost).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        filled = _write(folder, segment, all_postings(kept.rows), change, state.buckets)
    _commit(spark, folder, {"version": version, "segment": segment, "kind": "refresh", "buckets": state.buckets, "stem": fresh.stem, "whole_stats": False, "merged": [], "filled": filled})
    after = _state(spark, folder)
    crowded = [b for b in range(state.buckets) if after.living(b) > most]
    return merge(spark, folder, crowded) if crowded else version


def merge(spark: SparkSession, folder: str, buckets: list[int]) -> int:
    """Rewrite some buckets as one segment, without what has left, and sum the statistics up; the new version."""
    state = _state(spark, folder)
    segment, version = uuid.uuid4().hex, state.version + 1
    filled = _write(folder, segment, _live(spark, state, buckets), _stats(spark, state), state.buckets)
    _commit(spark, folder, {"version": version, "segment": segment, "kind": "merge", "buckets": state.buckets, "stem": state.lines[0].stem, "whole_stats": True, "merged": buckets, "filled": filled})
    return version
