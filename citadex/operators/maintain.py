"""Incremental upkeep: snapshot diff, guarded retirement, upserts, skips, audit.

Every function takes table snapshots and returns the next one; nothing is rewritten in place. Duplicates inside one
batch are folded with ``max_by``, which combines on the map side, so one key with very many rows costs no more than
any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..profile import HEADER_LABELS
from ..session import settle

SANE_FRACTION = 0.8
KEY = ("md_id", "document_family")

# Column policies of an upsert.
NEW = "new"  # the incoming value, NULL included
FILL = "fill"  # the incoming value unless NULL
KEEP = "keep"  # the stored value once there is one

LISTING_POLICY = {
    "title": NEW, "detail_url": NEW, "last_updated_at": FILL, "department": FILL, "pdf_urls": NEW, "status": NEW,
    "last_seen_at": NEW, "raw_list_sha256": NEW, "first_seen_at": KEEP, "document_id": KEEP, "issued_date": KEEP,
    "ref_no": KEEP,
}
INDEX_POLICY = {
    "document_id": NEW, "title": NEW, "detail_url": NEW, "last_updated_at": FILL, "issued_date": FILL, "ref_no": FILL,
    "department": FILL, "pdf_urls": NEW, "status": NEW, "last_seen_at": NEW, "raw_list_sha256": KEEP,
    "first_seen_at": KEEP,
}
WITHDRAWN_POLICY = {
    "original_ref": FILL, "original_id": FILL, "title": NEW, "issued_date": FILL, "withdrawn_date": FILL,
    "replacement_ref": FILL, "detail_url": FILL, "last_seen_at": NEW, "first_seen_at": KEEP,
}
ARTIFACT_POLICY = {
    "document_id": KEEP, "md_id": KEEP, "pdf_sha256": NEW, "text_sha256": NEW, "bytes": NEW, "page_count": NEW,
    "extraction_quality": NEW, "fetched_at": NEW, "extracted_at": NEW, "is_indexed": NEW, "error": NEW,
}


def last_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the largest ``order`` per key."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.col(order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")


def upsert(
    stored: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    policy: Mapping[str, str],
    touched: Column | None = None,
) -> DataFrame:
    """Next snapshot of ``stored``: insert new keys, merge known ones column by column.

    Columns missing from ``incoming`` keep their stored value. ``incoming`` must be unique by key; ``touched``
    limits the merge to some incoming rows.
    """
    if touched is not None:
        incoming = incoming.filter(touched)
    new = incoming.select(*keys, F.struct(*[c for c in incoming.columns if c not in keys]).alias("_new"))
    joined = stored.select(*keys, F.struct(*[c for c in stored.columns if c not in keys]).alias("_old")).join(
        new, list(keys), "full_outer"
    )
    out: list[Column] = []
    for c in stored.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        old = F.col(f"_old.{c}")
        if c not in incoming.columns:
            out.append(old.alias(c))
            continue
        fresh = F.col(f"_new.{c}")
        rule = policy[c]
        if rule == FILL:
            value = F.coalesce(fresh, old)
        elif rule == KEEP:
            value = F.when(F.col("_old").isNull(), fresh).otherwise(old)
        else:
            value = F.when(F.col("_new").isNull(), old).otherwise(fresh)
        out.append(value.alias(c))
    return joined.select(*out)


# --- listings -------------------------------------------------------------------------------------------------


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str = "md_id", order: str | None = None) -> DataFrame:
    """(key, change) for added, removed and changed records; a change is another title or another set of links.

    A listing with the ``order`` column may repeat a key: its last row counts.
    """
    facts = lambda df, name: (last_per_key(df, [key], order) if order in df.columns else df).select(
        key, F.struct("title", F.array_sort("pdf_urls").alias("urls")).alias(name)
    )
    both = facts(previous, "p").join(facts(current, "c"), key, "full_outer")
    change = (
        F.when(F.col("p").isNull(), "added")
        .when(F.col("c").isNull(), "removed")
        .when(~F.col("p").eqNullSafe(F.col("c")), "changed")
    )
    return both.select(key, change.alias("change")).filter(F.col("change").isNotNull())


def refresh_counts(previous: DataFrame, current: DataFrame, diff: DataFrame) -> DataFrame:
    """One row: seen, previous, added, changed, removed (0 when the guard trips) and the guard itself.

    The guard compares with every stored row of the family, retired ones included.
    """
    tally = lambda name: F.count_if(F.col("change") == name).alias(name)
    return (
        diff.agg(tally("added"), tally("changed"), tally("removed"))
        .withColumn("seen", current.agg(F.count(F.lit(1))).scalar())
        .withColumn("previous", previous.agg(F.count(F.lit(1))).scalar())
        .withColumn("listing_complete", F.col("seen") >= SANE_FRACTION * F.col("previous"))
        .withColumn("removed", F.when(F.col("listing_complete"), F.col("removed")).otherwise(0))
    )


def guarded_supersede(stored: DataFrame, previous: DataFrame, current: DataFrame, now: Column, key: str = "md_id") -> DataFrame:
    """Mark current records that vanished from a listing as superseded, unless the listing looks cut short.

    Returns ``stored`` with status and last_seen_at brought up to date. ``previous`` is the family before the run.
    """
    seen = current.agg(F.count(F.lit(1))).scalar()
    known = previous.agg(F.count(F.lit(1))).scalar()
    listed = current.select(key).distinct().withColumn("_listed", F.lit(True))
    was_known = previous.select(key).distinct().withColumn("_known", F.lit(True))
    joined = stored.join(listed, key, "left").join(was_known, key, "left")
    retire = (
        F.col("_known").isNotNull()
        & F.col("_listed").isNull()
        & (F.col("status") == "current")
        & (seen >= SANE_FRACTION * known)
    )
    return joined.select(
        *[
            F.when(retire, "superseded").otherwise(F.col(c)).alias(c)
            if c == "status"
            else F.when(retire, now).otherwise(F.col(c)).alias(c)
            if c == "last_seen_at"
            else F.col(c)
            for c in stored.columns
        ]
    )


def upsert_listing(stored: DataFrame, listing: DataFrame, order: str | None = None) -> DataFrame:
    """Merge a parsed listing into the registry; with ``order`` a listing may repeat keys and its last row counts."""
    if order is not None:
        listing = last_per_key(listing, KEY, order).drop(order)
    return upsert(stored, listing, KEY, LISTING_POLICY)


def upsert_indexed(stored: DataFrame, indexed: DataFrame) -> DataFrame:
    """Merge indexed documents into the registry, titles chosen by :func:`choose_title`."""
    old = stored.select(*KEY, F.col("title").alias("_old_title"))
    chosen = choose_title(F.col("title"), F.col("_old_title"), F.col("document_family"), F.col("ref_no"), F.col("md_id"))
    return upsert(
        stored, indexed.join(old, list(KEY), "left").withColumn("title", chosen).drop("_old_title"), KEY, INDEX_POLICY
    )


# Fixed value: a title that is only a date.
_DATE_TITLE = (
    r"(?U)^\s*([A-Z][a-z]+\s+\d{1,2},?\s*\d{4}|\d{1,2}\s+[A-Z][a-z]+\s+\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})\s*$"
)


def is_date_or_header(title: Column) -> Column:
    """No title, a bare date, or a column label."""
    return (
        title.isNull()
        | (title == "")
        | F.lower(strip(title)).isin(*HEADER_LABELS)
        | strip(title).rlike(_DATE_TITLE)
    )


def choose_title(new: Column, stored: Column, family: Column, ref_no: Column, md_id: Column) -> Column:
    """The new title unless it is poor, else a good stored one, else the poor one, else "Family Reference"."""
    label = F.concat_ws(" ", F.initcap(F.replace(family, F.lit("_"), F.lit(" "))), F.coalesce(ref_no, md_id))
    return (
        F.when(~is_date_or_header(new), new)
        .when(~is_date_or_header(stored), stored)
        .otherwise(F.coalesce(F.when(new != "", new), label))
    )


# --- withdrawals ----------------------------------------------------------------------------------------------


def withdrawal_identity(original_id: Column, original_ref: Column, title: Column) -> Column:
    """Identity of a withdrawal by tier: id; else reference and title; else title alone."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(some(original_id), F.concat_ws("\u0001", F.lit("id"), original_id))
        .when(some(original_ref), F.concat_ws("\u0001", F.lit("ref"), original_ref, title))
        .otherwise(F.concat_ws("\u0001", F.lit("title"), title))
    )


def upsert_withdrawn(stored: DataFrame, batch: DataFrame, order: str = "pos") -> DataFrame:
    """Merge withdrawals; rows of one batch with the same identity are merged in order first.

    A row known only by reference and title also meets a stored row that has an id beside the same pair.
    """
    key = withdrawal_identity(F.col("original_id"), F.col("original_ref"), F.col("title"))
    keyed = batch.withColumn("_id", key)
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    columns = [c for c in batch.columns if c != order]
    folded = keyed.groupBy("_id").agg(*[latest(c) for c in columns], F.max(order).alias(order))
    # A stored row answers to its own identity and, when it has both id and reference, to (reference, title).
    pair = F.when(
        F.col("original_ref").isNotNull() & F.col("original_id").isNotNull(),
        F.concat_ws("\u0001", F.lit("ref"), "original_ref", "title"),
    )
    old = stored.withColumn("_own", key).withColumn("_pair", pair)
    by_pair = old.filter(F.col("_pair").isNotNull()).groupBy("_pair").agg(F.min("_own").alias("_own"))
    target = (
        folded.join(by_pair.withColumnRenamed("_own", "_via"), folded["_id"] == by_pair["_pair"], "left")
        .groupBy(F.coalesce("_via", "_id").alias("_own"))
        .agg(*[latest(c) for c in columns])
    )
    merged = upsert(old.drop("_pair"), target, ["_own"], WITHDRAWN_POLICY)
    return merged.select(*stored.columns)


# --- what to (re)index ----------------------------------------------------------------------------------------


def content_hash_skip(
    bodies: DataFrame,
    artifacts: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame | None,
    force: bool = False,
) -> DataFrame:
    """(document_id, body_sha256, chunk_count, vector_count, skip) per incoming body.

    Skipped: same text hash as the latest artifact, chunks present, and every chunk embedded. Documents without an
    artifact are never skipped. Without a vector table the last condition holds.
    """
    # Prune before counting: only what belongs to the incoming bodies.
    incoming = bodies.select("document_id").distinct()
    artifacts = artifacts.join(incoming, "document_id", "left_semi")
    chunks = chunks.select("chunk_id", "document_id").join(incoming, "document_id", "left_semi")
    latest = artifacts.groupBy("document_id").agg(F.max_by("text_sha256", "fetched_at").alias("prior_sha256"))
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    out = (
        bodies.select("document_id", F.sha2("text", 256).alias("body_sha256"))
        .join(latest, "document_id", "left")
        .join(counts, "document_id", "left")
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    )
    if vectors is None:
        out = out.withColumn("vector_count", F.col("chunk_count"))
    else:
        embedded = (
            chunks.select("chunk_id", "document_id")
            .join(vectors.select("chunk_id"), "chunk_id")
            .groupBy("document_id")
            .agg(F.count(F.lit(1)).alias("vector_count"))
        )
        out = out.join(embedded, "document_id", "left").withColumn("vector_count", F.coalesce("vector_count", F.lit(0)))
    same = F.col("body_sha256").eqNullSafe(F.col("prior_sha256"))
    skip = same & (F.col("chunk_count") > 0) & (F.col("vector_count") >= F.col("chunk_count"))
    return out.withColumn("skip", F.lit(False) if force else skip).drop("prior_sha256")


def _of_families(registry: DataFrame, families: Iterable[str] | None) -> DataFrame:
    return registry if families is None else registry.filter(F.col("document_family").isin(*families))


def fresh_ids(registry: DataFrame, artifacts: DataFrame, families: Iterable[str] | None = None) -> DataFrame:
    """(md_id, document_family) already indexed with no newer date announced since the fetch; of all families if none are named."""
    indexed = artifacts.filter("is_indexed").groupBy("document_id").agg(F.max(F.to_date("fetched_at")).alias("fetched_on"))
    return (
        _of_families(registry, families)
        .join(indexed, "document_id")
        .filter(F.col("last_updated_at").isNull() | (F.col("fetched_on") >= F.col("last_updated_at")))
        .select("md_id", "document_family")
    )


def stale_selection(registry: DataFrame, artifacts: DataFrame, families: Sequence[str] | None = None) -> DataFrame:
    """Registry rows that must be indexed (again): of the families, or of all, those without a family included."""
    fresh = fresh_ids(registry, artifacts, families).toDF("_md_id", "_family")
    same = F.col("md_id").eqNullSafe(F.col("_md_id")) & F.col("document_family").eqNullSafe(F.col("_family"))
    return _of_families(registry, families).join(fresh, same, "left_anti")


def existing_skip(listing: DataFrame, registry: DataFrame, family: str) -> DataFrame:
    """Listed ids a family without change dates does not hold yet."""
    held = registry.filter(F.col("document_family") == family).select("md_id")
    return listing.join(held, "md_id", "left_anti")


def select_targets(
    registry: DataFrame,
    family: str,
    skip: DataFrame | None = None,
    limit: int | None = None,
    only: str | None = None,
    force: bool = False,
) -> DataFrame:
    """(md_id, skip): the work list of a family in id order, capped before skipping as a bulk run does."""
    work = registry.filter(F.col("document_family") == family).select("md_id").distinct()
    if only is not None:
        work = work.filter(F.col("md_id") == only)
    if limit is not None:
        work = work.orderBy("md_id").limit(limit)
    if skip is None or force:
        return work.withColumn("skip", F.lit(False))
    known = skip.select("md_id").distinct().withColumn("skip", F.lit(True))
    return work.join(known, "md_id", "left").withColumn("skip", F.coalesce("skip", F.lit(False)))


def replace_by_document(stored: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """Stored rows with those of the re-indexed documents replaced; a document without fresh rows keeps its own."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def _bucketed(rows: DataFrame, buckets: int, key: str) -> DataFrame:
    """``rows`` with ``bucket``, the hashed share of documents a row belongs to; rows without a key form bucket -1."""
    return rows.withColumn("bucket", F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(buckets))).otherwise(-1).cast("int"))


def write_by_document(rows: DataFrame, folder: str, buckets: int = 256, key: str = "document_id") -> None:
    """Store ``rows`` in folders by hashed document, so that a later change of a few documents rewrites their folders alone.

    A range over (bucket, key, hash of the row) deals rows out evenly, however many a document has.
    """
    spread = F.xxhash64(*rows.columns)
    dealt = _bucketed(rows, buckets, key).repartitionByRange(F.col("bucket"), F.col(key), spread)
    dealt.write.mode("errorifexists").partitionBy("bucket").parquet(folder)


def replace_stored(spark: SparkSession, folder: str, fresh: DataFrame, buckets: int = 256, key: str = "document_id") -> list[int]:
    """Replace the stored rows of the documents that ``fresh`` holds; returns the buckets written, all others stay as they are.

    ``buckets`` is the number the table was written with. Only the buckets of the fresh documents are read and written;
    Spark exchanges a bucket's files as a whole when the write commits, so a reader sees the old rows or the new ones.
    """
    incoming = settle(_bucketed(fresh, buckets, key))
    dirty = sorted(r.bucket for r in incoming.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    if not dirty:
        return []
    stored = spark.read.parquet(folder).where(F.col("bucket").isin(dirty))
    merged = settle(replace_by_document(stored, incoming.drop("bucket"), key).transform(lambda d: _bucketed(d, buckets, key)))
    merged.repartitionByRange(F.col("bucket"), F.col(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    return dirty


def upsert_artifacts(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Merge attachments by URL; a fresh extraction clears the error and marks the row indexed."""
    incoming = fetched.withColumn("is_indexed", F.lit(True)).withColumn("error", F.lit(None).cast("string"))
    return upsert(stored, incoming, ["pdf_url"], ARTIFACT_POLICY)


# --- bookkeeping ----------------------------------------------------------------------------------------------


def audit_run(
    counts: DataFrame,
    source: str,
    source_url: str,
    started_at: Column,
    finished_at: Column,
    status_code: int | None = 200,
    page_sha256: Column | None = None,
    error: str | None = None,
) -> DataFrame:
    """One audit row from :func:`refresh_counts`, ready to append."""
    return counts.select(
        started_at.alias("started_at"), finished_at.alias("finished_at"), F.lit(source).alias("source"),
        F.lit(source_url).alias("source_url"), F.lit(status_code).cast("int").alias("status_code"),
        (F.lit(None).cast("string") if page_sha256 is None else page_sha256).alias("raw_html_sha256"),
        F.col("seen").alias("items_seen"), F.col("added").alias("items_added"),
        F.col("changed").alias("items_changed"), F.col("removed").alias("items_removed"),
        F.lit(error).cast("string").alias("error"),
    )


def refresh_verdict(runs: DataFrame) -> DataFrame:
    """Exit verdict of a refresh: 0 all sources read, 1 none, 2 some."""
    failed, total = F.count_if(F.col("error").isNotNull()), F.count(F.lit(1))
    return runs.agg(F.when(failed == 0, 0).when(failed == total, 1).otherwise(2).alias("exit_code"))


def run_summary(attempts: DataFrame, retry: DataFrame | None = None) -> DataFrame:
    """Counts per family of (document_family, md_id, outcome); a retry's outcome replaces a failure."""
    final = attempts
    if retry is not None:
        again = retry.select("document_family", "md_id", F.col("outcome").alias("_again"))
        final = attempts.join(again, ["document_family", "md_id"], "left").withColumn(
            "outcome",
            F.when((F.col("outcome") == "failed") & F.col("_again").isNotNull(), F.col("_again")).otherwise(F.col("outcome")),
        )
    tally = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return final.groupBy("document_family").agg(
        tally("success"), tally("skipped"), tally("failed"), F.count(F.lit(1)).alias("total")
    )


def meta_upsert(stored: DataFrame, updates: DataFrame, only_missing: Sequence[str] = ()) -> DataFrame:
    """Key-value table after updates (key, value, updated_at); keys in ``only_missing`` never replace a value."""
    if only_missing:
        held = stored.filter(F.col("key").isin(*only_missing)).select("key")
        updates = updates.join(held, "key", "left_anti")
    both = stored.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    newest = F.max_by(F.struct("value", "updated_at"), F.struct("_new", "updated_at")).alias("_row")
    return both.groupBy("key").agg(newest).select("key", "_row.*")
