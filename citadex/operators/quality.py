"""Corpus checks and request telemetry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FAMILIES, STATUSES
from ..session import settle
from ..sizes import BROADCAST_ROWS, broadcast_if, fits
from .evaluate import latency_stats

RATE_LIMIT = 60
RATE_WINDOW_SECONDS = 60.0


def corpus_profile(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_family, documents, chunks): per family and, with NULL family, in total."""
    per_document = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    totals = per_document.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return (
        registry.select("document_id", "document_family")
        .join(per_document, "document_id", "left")
        .rollup("document_family")
        .agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))
        .withColumn("chunks", F.when(F.col("document_family").isNull(), totals).otherwise(F.col("chunks")))
    )


def corpus_health(registry: DataFrame, chunks: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """One row: status ok, degraded (no vectors) or unhealthy (no documents), with counts."""
    count = lambda df: F.lit(0) if df is None else df.agg(F.count(F.lit(1))).scalar()
    return (
        registry.agg(F.count(F.lit(1)).alias("documents"))
        .withColumn("chunks", count(chunks))
        .withColumn("vectors", count(vectors))
        .withColumn(
            "status",
            F.when(F.col("documents") == 0, "unhealthy").when(F.col("vectors") == 0, "degraded").otherwise("ok"),
        )
        .withColumn(
            "reason",
            F.when(F.col("documents") == 0, "corpus_empty").when(F.col("vectors") == 0, "vectors_unavailable"),
        )
    )


def compatibility_check(meta: DataFrame, expected_schema: str, runtime_dim: int, vectors: DataFrame | None = None) -> DataFrame:
    """One row: may a reader with this schema version and dimension open the corpus?

    A missing or other schema version refuses; a different dimension refuses, an absent or unreadable one warns.
    With ``vectors`` the stored dimensions must also all equal the runtime's.
    """
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    row = meta.agg(value("schema_version").alias("schema_version"), value("embedding_dim").alias("embedding_dim"))
    if vectors is not None:
        sizes = vectors.agg(F.struct(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"))).scalar()
        row = row.withColumn("min_dim", sizes["low"]).withColumn("max_dim", sizes["high"])
        mixed = F.coalesce((F.col("min_dim") != runtime_dim) | (F.col("max_dim") != runtime_dim), F.lit(False))
    else:
        mixed = F.lit(False)
    dim = F.col("embedding_dim").try_cast("int")
    return row.withColumn(
        "schema_check",
        F.when(F.col("schema_version").isNull(), "missing").when(F.col("schema_version") != expected_schema, "mismatch").otherwise("ok"),
    ).withColumn(
        "dim_check", F.when(mixed | (dim != runtime_dim), "mismatch").when(dim.isNull(), "warn").otherwise("ok")
    ).withColumn("accepted", (F.col("schema_check") == "ok") & (F.col("dim_check") != "mismatch"))


def orphan_chunks(chunks: DataFrame, registry: DataFrame, key: str = "document_id", sample: int = 3) -> DataFrame:
    """One row: how many chunks have no document, and the first few ids of them."""
    orphans = chunks.join(registry.select(key), key, "left_anti")
    shown = (
        orphans.select("chunk_id").orderBy("chunk_id").limit(sample).agg(F.array_join(F.array_sort(F.collect_list("chunk_id")), ",")).scalar()
    )
    return orphans.agg(F.count(F.lit(1)).alias("orphans")).withColumn("sample", shown)


def key_violations(registry: DataFrame, families: Sequence[str] = FAMILIES, statuses: Sequence[str] = STATUSES) -> DataFrame:
    """(violation, key, n): repeated (md_id, family), families and statuses outside the allowed sets."""
    repeated = (
        registry.groupBy("md_id", "document_family")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.lit("duplicate_key").alias("violation"), F.concat_ws("/", "document_family", "md_id").alias("key"), "n")
    )
    outside = lambda name, col, allowed: (
        registry.filter(~F.coalesce(F.col(col).isin(*allowed), F.lit(False)))
        .groupBy(F.lit(name).alias("violation"), F.col(col).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return repeated.unionByName(outside("unknown_family", "document_family", families)).unionByName(
        outside("unknown_status", "status", statuses)
    )


def evolve_schema(old: DataFrame, schema: T.StructType, defaults: Mapping[str, Column]) -> DataFrame:
    """Rows of an older table in the present schema: missing columns get their default, every row stays."""
    def column(field: T.StructField) -> Column:
        fallback = defaults.get(field.name, F.lit(None))
        value = F.coalesce(F.col(field.name), fallback) if field.name in old.columns else fallback
        return value.cast(field.dataType).alias(field.name)

    return old.select(*[column(f) for f in schema.fields])


def length_bucket(n: Column, small: bool = False) -> Column:
    """Coarse length class, lower bounds inclusive; ``small`` is for query-like fields."""
    edges = ((50, "0-50"), (200, "50-200"), (500, "200-500")) if small else ((500, "0-500"), (2000, "500-2000"), (10_000, "2000-10000"))
    out = F.when(n < edges[0][0], edges[0][1])
    for edge, name in edges[1:]:
        out = out.when(n < edge, name)
    return out.otherwise("500+" if small else "10000+")


def hint_label(calls: DataFrame, aliases: DataFrame, hint: str = "topic_hint") -> DataFrame:
    """Known hints lower-cased, all others "other": telemetry never carries free text."""
    known = aliases.select(F.col("alias").alias("_alias")).distinct()
    return calls.join(known, F.lower(F.col(hint)) == F.col("_alias"), "left").withColumn(
        "hint_label", F.when(F.coalesce(F.col(hint), F.lit("")) != "", F.coalesce("_alias", F.lit("other")))
    ).drop("_alias")


def tool_telemetry(calls: DataFrame, every: str = "1 day") -> DataFrame:
    """Calls (ts, tool, status, latency_ms) per time window, tool and status: shape only, no content."""
    windowed = calls.withColumn("window_start", F.window("ts", every)["start"])
    return latency_stats(windowed, ["window_start", "tool", "status"], "latency_ms")


# --- rate limit -----------------------------------------------------------------------------------------------


#: Parts of a window that its requests are numbered in, so that a burst is not numbered by one task.
PARTS = 64


def rate_limit_audit(
    requests: DataFrame,
    limit: int = RATE_LIMIT,
    window_seconds: float = RATE_WINDOW_SECONDS,
    excluded: Column | None = None,
    bucket: Column | None = None,
    bucket_limits: Mapping[str, int] | None = None,
) -> DataFrame:
    """Every request (request_id, client, ts) with its window's start, its number in it and the verdict.

    A window starts at a client's first request and again at the first request ``window_seconds`` or more after the
    last start. Requests without a time are left out; those without a client form a client of their own.

    Time is cut into cells as long as a window, so a cell holds one start at most, and what follows a request by a window
    or more is found in the next cell or at the head of a later one. Each moment points at the start that would follow it;
    from the moments after a pause, which are starts for certain, the pointers are followed by doubling, in joins. No
    client's requests are ever brought together: rows meet by client and cell, and a burst is numbered in parts.
    """
    rows = requests if excluded is None else requests.filter(~excluded)
    width = int(window_seconds * 1_000_000)
    rows = rows.withColumn("bucket", F.lit("main") if bucket is None else bucket).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    # A struct, as nulls in it are equal.
    numbered = window_numbers(rows.where("us IS NOT NULL").select("request_id", F.struct("client", "bucket").alias("who"), "us"), width)
    cap = F.lit(limit)
    for name, value in (bucket_limits or {}).items():
        cap = F.when(F.col("who.bucket") == name, value).otherwise(cap)
    elapsed = (F.col("us") - F.col("start")) / 1_000_000
    over = F.col("n") > cap
    return numbered.select(
        "request_id", "who.client", "who.bucket", F.timestamp_micros("start").alias("window_start"),
        F.col("n").alias("request_no"), over.alias("limited"),
        F.when(over, F.greatest(F.lit(1), (F.lit(float(window_seconds)) - elapsed).cast("int"))).alias("retry_after"),
    )


def window_numbers(rows: DataFrame, width: int, held: DataFrame | None = None) -> DataFrame:
    """request_id, who, us, start, n: the window of each of ``rows`` (request_id, who, us) and its number in it.

    ``held`` (who, held_start, held_n; one row a client at most) is the window that is open from before, with the requests it
    has; what arrives from before its start counts into it.
    """
    seeds = None
    if held is not None:
        held = settle(held)
        rows = rows.join(broadcast_if(fits(held, BROADCAST_ROWS), held), "who", "left").withColumn("us", F.greatest("us", "held_start"))
        seeds = held.select("who", F.col("held_start").alias("us"))
    rows = rows.withColumn("cell", F.floor(F.col("us") / F.lit(width)))
    starts = settle(_window_starts(rows, width, seeds))
    # The start in a cell and that of the cell before, side by side, so that the rows meet them in one join.
    nothing = F.lit(None).cast("bigint")
    own = starts.select("who", "cell", F.col("start").alias("own"), nothing.alias("earlier"))
    earlier = starts.select("who", (F.col("cell") + 1).alias("cell"), nothing.alias("own"), F.col("start").alias("earlier"))
    around = own.unionByName(earlier).groupBy("who", "cell").agg(F.max("own").alias("own"), F.max("earlier").alias("earlier"))
    placed = rows.join(around, ["who", "cell"], "left")
    placed = placed.withColumn("start", F.when(F.col("own") <= F.col("us"), F.col("own")).otherwise(F.col("earlier"))).drop("own", "earlier", "cell")
    numbered = _numbered(settle(placed.withColumn("part", F.floor((F.col("us") - F.col("start")) * PARTS / F.lit(width)))))
    if held is not None:
        numbered = numbered.withColumn("n", F.col("n") + F.when(F.col("start") == F.col("held_start"), F.col("held_n")).otherwise(0))
    return numbered.select("request_id", "who", "us", "start", "n")


def _numbered(placed: DataFrame) -> DataFrame:
    """``placed`` (request_id, who, us, start, part) with n, the number of the request in its window."""
    counts = placed.groupBy("who", "start", "part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("who", "start").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    within = Window.partitionBy("who", "start", "part").orderBy("us", "request_id")
    return placed.join(counts, ["who", "start", "part"]).withColumn("n", F.row_number().over(within) + F.col("before"))


def _window_starts(rows: DataFrame, width: int, seeds: DataFrame | None = None) -> DataFrame:
    """who, cell, start of every window; ``rows``: who, us, cell; ``seeds`` (who, us): starts before all of a client's rows."""
    moments = rows.select("who", "us", "cell")
    if seeds is not None:
        moments = moments.unionByName(seeds.withColumn("cell", F.floor(F.col("us") / F.lit(width))))
    moments = settle(moments.distinct())
    in_order = Window.partitionBy("who").orderBy("cell")
    cells = moments.groupBy("who", "cell").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    following = F.lead("first").over(in_order)
    cells = settle(
        cells.select(
            "who", "cell", "first",
            F.coalesce(F.col("first") - F.lag("last").over(in_order) >= width, F.lit(True)).alias("pause"),
            F.when(F.lead("cell").over(in_order) == F.col("cell") + 1, F.lead("first", 2).over(in_order)).otherwise(following).alias("beyond"),
        )
    )
    heads = cells.where("pause").select("who", F.col("first").alias("us"))
    # Candidates of a cell and the moments of the cell before, a window later, in falling order of time.
    asked = moments.select("who", (F.col("cell") + 1).alias("cell"), (F.col("us") + width).alias("at"), F.lit(0).alias("there"), F.col("us"))
    there = moments.select("who", "cell", F.col("us").alias("at"), F.lit(1).alias("there"), F.col("us"))
    falling = Window.partitionBy("who", "cell").orderBy(F.desc("at"), F.desc("there")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = there.unionByName(asked).withColumn("near", F.min(F.when(F.col("there") == 1, F.col("us"))).over(falling)).where("there = 0")
    links = met.select("who", "us", (F.col("cell") - 1).alias("cell"), "near").join(cells.select("who", "cell", "beyond"), ["who", "cell"])
    links = links.select("who", "us", F.coalesce("near", "beyond").alias("next")).where("next IS NOT NULL")
    # What leads to a head says nothing new.
    jump = settle(links.join(heads.withColumnRenamed("us", "next"), ["who", "next"], "left_anti").select("who", "us", "next"))
    reached = heads
    while jump.limit(1).count():
        found = settle(reached.join(jump, ["who", "us"]).select("who", F.col("next").alias("us")))
        if not found.limit(1).count():
            break
        reached = reached.unionByName(found)
        onward = jump.select("who", F.col("us").alias("next"), F.col("next").alias("then"))
        jump = settle(jump.join(onward, ["who", "next"]).select("who", "us", F.col("then").alias("next")))
    return reached.distinct().select("who", F.floor(F.col("us") / F.lit(width)).alias("cell"), F.col("us").alias("start"))
