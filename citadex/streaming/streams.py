"""Structured Streaming forms of the batch operators.

Sinks write one folder per micro-batch, named by its id, so a replayed batch replaces its own output and nothing
else. Keyed state lies in tables (:mod:`citadex.streaming.keyed`), so a key of any size is worked on in joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.chunking import outline_chunks
from ..operators.lexical import TextIndex, bm25_topk
from ..operators.quality import RATE_LIMIT, RATE_WINDOW_SECONDS, window_numbers
from ..session import settle
from ..sizes import BROADCAST_ROWS, broadcast_if, fits
from .keyed import KeyedTable


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int | None = None, pattern: str | None = None) -> DataFrame:
    """Parquet files arriving in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def run_available(writer, checkpoint: str) -> None:
    """Run a stream over everything that is there and stop."""
    query: StreamingQuery = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def batch_folders(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """All micro-batch outputs below ``root``; an empty table before the first."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(root)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


# --- ingest ---------------------------------------------------------------------------------------------------

HASHES = "document_id string, text_sha256 string, batch_id bigint"
FAILED = f"{HASHES}, error string"


def stream_ingest(bodies: DataFrame, root: str, checkpoint: str, min_chars: int = 80) -> None:
    """Arriving bodies (document_id, md_id, ref_no, text) to chunk folders; unchanged bodies are skipped by hash.

    A body without any chunk is noted in the ``failed`` folder and does not replace what was there.
    """

    def ingest(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = KeyedTable(spark, f"{root}/state", "document_id string, known_sha256 string")
        known = state.before(batch_id, batch.select("document_id"))
        # The same document twice in one batch: any copy of the largest hash, so that a replay decides alike.
        one = batch.groupBy("document_id").agg(F.max_by(F.struct("md_id", "ref_no", "text"), F.sha2("text", 256)).alias("r"))
        fresh = (
            one.select("document_id", "r.*")
            .withColumn("text_sha256", F.sha2("text", 256))
            .join(known, "document_id", "left")
            .filter(~F.col("text_sha256").eqNullSafe(F.col("known_sha256")))
        )
        stamp = F.lit(batch_id).cast("bigint").alias("batch_id")
        chunk_folder = f"{root}/chunks/batch-{batch_id}"
        outline_chunks(fresh, min_chars=min_chars).select("*", stamp).write.mode("overwrite").parquet(chunk_folder)
        # Only what has chunks becomes the known version; a body that yields none leaves the former chunks visible.
        done = spark.read.parquet(chunk_folder).select("document_id").distinct()
        seen = fresh.select("document_id", "text_sha256", stamp)
        failed = seen.join(done, "document_id", "left_anti").withColumn("error", F.lit("no_chunks"))
        failed.write.mode("overwrite").parquet(f"{root}/failed/batch-{batch_id}")
        seen.join(done, "document_id", "left_semi").write.mode("overwrite").parquet(f"{root}/hashes/batch-{batch_id}")
        stored = spark.read.schema(HASHES).parquet(f"{root}/hashes/batch-{batch_id}")
        state.write(batch_id, stored.select("document_id", F.col("text_sha256").alias("known_sha256")))

    run_available(bodies.writeStream.foreachBatch(ingest), checkpoint)


def ingested_chunks(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Chunks of the newest version of every document."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    newest = batch_folders(spark, f"{root}/hashes", HASHES).groupBy("document_id").agg(F.max("batch_id").alias("batch_id"))
    return batch_folders(spark, f"{root}/chunks", full).join(newest, ["document_id", "batch_id"]).drop("batch_id")


# --- changed only ---------------------------------------------------------------------------------------------

#: Versions of a document that are put in order together; a document with more in one micro-batch is ordered in pieces.
PIECE = 10_000
CHANGED = "document_id string, seq bigint, text_sha256 string"


def _with_former(rows: DataFrame, held: DataFrame) -> DataFrame:
    """``rows`` (document_id, seq, text_sha256) with former, the hash before each in order of seq and hash; ``held`` knows the one
    before the first. A document's rows are cut at equal steps of seq, so that no task orders all of a hot one.
    """
    spans = rows.groupBy("document_id").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces"))
    same = lambda side: F.col("r.document_id").eqNullSafe(F.col(f"{side}.document_id"))
    piece = F.coalesce(F.floor((F.col("seq") - F.col("low")) * F.col("pieces") / (F.col("high") - F.col("low") + 1)), F.lit(-1)).alias("piece")
    spans = broadcast_if(fits(spans, BROADCAST_ROWS), spans)
    cut = rows.alias("r").join(spans.alias("p"), same("p")).select("r.*", piece)
    order, sha = F.struct("seq", "text_sha256"), F.struct("text_sha256")  # a struct is there even if the hash is null
    lasts = cut.groupBy("document_id", "piece").agg(F.max_by(sha, order).alias("last"))
    lasts = lasts.withColumn("earlier", F.lag("last").over(Window.partitionBy("document_id").orderBy("piece"))).drop("last")
    inside = cut.withColumn("before", F.lag(sha).over(Window.partitionBy("document_id", "piece").orderBy("seq", "text_sha256")))
    met = inside.alias("r").join(lasts.alias("l"), same("l") & (F.col("r.piece") == F.col("l.piece"))).select("r.*", "l.earlier")
    met = met.alias("r").join(held.alias("h"), same("h"), "left")
    former = F.coalesce("r.before", "r.earlier", F.struct(F.col("h.known_sha256").alias("text_sha256")))
    return met.select("r.document_id", "r.seq", "r.text_sha256", former["text_sha256"].alias("former"))


def stream_changed_only(bodies: DataFrame, root: str, checkpoint: str, expire_batches: int | None = None) -> None:
    """Rows (document_id, seq, text_sha256) whose content hash differs from the document's previous one, a folder per batch.

    ``seq`` orders versions inside a micro-batch. Of a document only its last hash is kept, in a keyed table, and none of
    its rows; with ``expire_batches`` the hash of a document that has not come for so many batches may be forgotten.
    """
    slim = bodies.select("document_id", F.col("seq").cast("bigint").alias("seq"), F.sha2("text", 256).alias("text_sha256"))

    def pass_on(batch: DataFrame, batch_id: int) -> None:
        state = KeyedTable(batch.sparkSession, f"{root}/state", "document_id string, known_sha256 string, seen bigint")
        rows = settle(batch)
        held = state.before(batch_id, rows.select("document_id"))
        changed = _with_former(rows, held).where("text_sha256 IS DISTINCT FROM former").select("document_id", "seq", "text_sha256")
        changed.write.mode("overwrite").parquet(f"{root}/rows/batch-{batch_id}")
        last = rows.groupBy("document_id").agg(F.max_by("text_sha256", F.struct("seq", "text_sha256")).alias("known_sha256"), F.lit(batch_id).cast("bigint").alias("seen"))
        state.write(batch_id, last, None if expire_batches is None else F.col("seen") > batch_id - expire_batches)

    run_available(slim.writeStream.foreachBatch(pass_on), checkpoint)


# --- dedupe, search, telemetry --------------------------------------------------------------------------------


def stream_dedupe(rows: DataFrame, keys: list[str], event_time: str = "ts", horizon: str = "1 day") -> DataFrame:
    """Drop repeats of a key that arrive within the horizon."""
    return rows.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(keys)


def stream_search(clauses: DataFrame, chunks: DataFrame, root: str, checkpoint: str, index: TextIndex, k: int = 5) -> None:
    """Arriving clauses (query_id, text) against a stored index; ranked hits per micro-batch folder.

    The index is built and loaded once, outside the stream, so that a micro-batch never reads the corpus' texts.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        bm25_topk(batch, chunks, k, index=index).write.mode("overwrite").parquet(f"{root}/batch-{batch_id}")

    run_available(clauses.writeStream.foreachBatch(answer), checkpoint)


def stream_telemetry(calls: DataFrame, every: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Calls, errors and latency sums per time window and tool; rows later than the watermark are dropped."""
    window = F.window("ts", every, slide) if slide else F.window("ts", every)
    return (
        calls.withWatermark("ts", late)
        .groupBy(window.alias("w"), "tool")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if(F.col("status") == "error").alias("errors"),
            F.sum("latency_ms").alias("latency_sum"),
            F.max("latency_ms").alias("latency_max"),
        )
        .select(F.col("w.start").alias("window_start"), "tool", "calls", "errors", "latency_sum", "latency_max")
    )


# --- rate limit -----------------------------------------------------------------------------------------------


LIMITED = "request_id bigint, client bigint, start_us bigint, request_no bigint, limited boolean"


def stream_rate_limit(
    requests: DataFrame,
    root: str,
    checkpoint: str,
    limit: int = RATE_LIMIT,
    window_seconds: float = RATE_WINDOW_SECONDS,
    late_seconds: float | None = None,
    client_type: str = "bigint",
) -> None:
    """Requests (request_id, client, ts) with their window, number and verdict, a folder per batch under ``root``/rows.

    A micro-batch is audited as a batch is, in joins, from the windows that were open before it: of a client only the start
    and count of its last window is kept, in a keyed table, and none of its requests. A request from before the open window counts
    into it. With ``late_seconds`` windows that ended so long before the latest request may be forgotten.
    """
    width = int(window_seconds * 1_000_000)

    def audit(batch: DataFrame, batch_id: int) -> None:
        state = KeyedTable(batch.sparkSession, f"{root}/state", f"client {client_type}, held_start bigint, held_n bigint")
        rows = settle(batch.select("request_id", "client", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).where("us IS NOT NULL"))
        who = F.struct("client", F.lit("main").alias("bucket")).alias("who")
        held = state.before(batch_id, rows.select("client")).select(who, "held_start", "held_n")
        found = settle(window_numbers(rows.select("request_id", who, "us"), width, held))
        out = found.select("request_id", "who.client", F.col("start").alias("start_us"), F.col("n").alias("request_no"), (F.col("n") > limit).alias("limited"))
        out.write.mode("overwrite").parquet(f"{root}/rows/batch-{batch_id}")
        last = found.groupBy("who.client").agg(F.max(F.struct(F.col("start").alias("held_start"), F.col("n").cast("bigint").alias("held_n"))).alias("s")).select("client", "s.*")
        keep = None
        if late_seconds is not None and (latest := rows.agg(F.max("us")).first()[0]) is not None:
            keep = F.col("held_start") + width > latest - int(late_seconds * 1_000_000)
        state.write(batch_id, last, keep)

    run_available(requests.writeStream.foreachBatch(audit), checkpoint)
