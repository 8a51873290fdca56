"""Keyed state of a stream as a table: what is known of a key before a micro-batch, without holding a key's rows anywhere.

Every micro-batch writes the new state of its own keys, a row each, in buckets by hashed key; every ``every`` batches the state
of all keys is written as a base. A batch reads the last base and the batches since, of these only the buckets of its keys, so
its work does not grow with the number of batches. It never reads its own folder or later ones, so a batch that runs
again finds what it found and replaces what it wrote. Folders before the last base but one are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from ..sizes import BROADCAST_ROWS, broadcast_if, fits


class KeyedTable:
    """State rows ``schema``, the key first, one row a key."""

    def __init__(self, spark: SparkSession, root: str, schema: str, buckets: int = 64, every: int = 8) -> None:
        self.spark, self.root, self.schema, self.buckets, self.every = spark, root, schema, buckets, every
        self.key = schema.split()[0]

    def _folders(self, kind: str) -> list[int]:
        """Numbers of the finished folders of a kind."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName().split("-")[1]) for p in names if p.getName().startswith(f"{kind}-") and fs.exists(done(p, "_SUCCESS")))

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def before(self, batch_id: int, keys: DataFrame | None = None) -> DataFrame:
        """The state before a batch: of all keys, or of those in ``keys`` (one column)."""
        bases = [n for n in self._folders("base") if n < batch_id]
        first = bases[-1] if bases else -1
        paths = [f"{self.root}/base-{first}"] * bool(bases) + [f"{self.root}/batch-{n}" for n in self._folders("batch") if first < n < batch_id]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(f"{self.schema}, batch_id bigint, bucket int").parquet(p) for p in paths]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if keys is not None:
            asked = settle(keys.select(F.col(keys.columns[0]).alias("_key")).distinct())
            dirty = [r[0] for r in asked.select(self._bucket("_key")).distinct().collect()]  # at most ``buckets`` numbers
            rows = rows.where(F.col("bucket").isin(dirty)).join(broadcast_if(fits(asked, BROADCAST_ROWS), asked), F.col(self.key).eqNullSafe(F.col("_key")), "left_semi")
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (self.key, "batch_id", "bucket")]), "batch_id").alias("s"))
        return last.select(self.key, "s.*")

    def _write(self, rows: DataFrame, batch_id: int, kind: str) -> None:
        out = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).withColumn("bucket", self._bucket(self.key))
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{kind}-{batch_id}")

    def write(self, batch_id: int, rows: DataFrame, keep: Column | None = None) -> None:
        """Store the state of a batch's keys; now and then also that of all keys, without those that ``keep`` lets go."""
        self._write(rows, batch_id, "batch")
        if (batch_id + 1) % self.every == 0:
            known = self.before(batch_id + 1)
            self._write(known if keep is None else known.where(keep), batch_id, "base")
            bases = self._folders("base")
            if len(bases) > 1:
                self._drop(bases[-2])

    def _drop(self, number: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for kind in ("base", "batch"):
            for n in self._folders(kind):
                if n < number or (kind == "batch" and n == number):
                    fs.delete(path(f"{self.root}/{kind}-{n}"), True)
