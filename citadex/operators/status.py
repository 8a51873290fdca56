"""Status lookup: is a referenced document current, withdrawn, superseded or unknown?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extract, strip
from ..functions.urls import query_value
from ..profile import REGULATOR, SiteProfile

ENVELOPE = (
    "status", "document_id", "title", "official_url", "ref_no", "issued_date", "document_family", "last_updated_at",
    "withdrawn_date", "replacement_ref", "as_of", "source_url", "note",
)
UNSUPPORTED = "unsupported_at_v0.1"  # fixed value


def classify_reference(raw: Column, profile: SiteProfile = REGULATOR) -> Column:
    """struct(kind, record_id, reason): the first kind that fits wins."""
    text = strip(F.coalesce(raw, F.lit("")))
    notification_id = (
        query_value(text, *profile.notification_params)
        if profile.notification_params
        else extract(text, profile.notification_url, 1)
    )
    kind = (
        F.when(text == "", "empty")
        .when(text.rlike(profile.direction_url), "direction")
        .when(text.contains(profile.withdrawn_page), "withdrawn_list")
        .when(text.rlike(profile.notification_url), F.when(notification_id.isNotNull(), "notification").otherwise("no_id"))
        .when(text.rlike(profile.faq_url), "faq")
        .when(text.rlike(profile.reference), "textual_ref")
        .otherwise("unknown")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "direction", extract(text, profile.direction_url, 1))
        .when(kind == "notification", notification_id)
        .alias("record_id"),
        F.when(kind == "faq", "faq_url")
        .when(kind == "textual_ref", "textual_ref")
        .when(kind.isin("empty", "no_id", "unknown"), "unknown")
        .alias("reason"),
    )


def withdrawn_latest(withdrawn: DataFrame, key: str = "original_id") -> DataFrame:
    """The most recently first-seen withdrawal per id (or per reference)."""
    newest = Window.partitionBy(key).orderBy(F.col("first_seen_at").desc(), F.col("title"))
    return (
        withdrawn.filter(F.col(key).isNotNull())
        .withColumn("_n", F.row_number().over(newest))
        .filter("_n = 1")
        .drop("_n")
    )


def find_document(ids: DataFrame, registry: DataFrame, family: str | None = "master_direction") -> DataFrame:
    """Registry rows for (md_id[, document_family]); ids are unique only within a family."""
    if "document_family" not in ids.columns:
        ids = ids.withColumn("document_family", F.lit(family))
    return ids.select("md_id", "document_family").distinct().join(registry, ["md_id", "document_family"])


def check_current(
    inputs: DataFrame,
    registry: DataFrame,
    withdrawn: DataFrame,
    as_of: Column,
    profile: SiteProfile = REGULATOR,
    direction_family: str = "master_direction",
    circular_families: tuple[str, ...] = ("standalone_circular", "notification"),
) -> DataFrame:
    """One row with all envelope columns (plus reason) per input (input_id, reference)."""
    raw = strip(F.coalesce("reference", F.lit("")))
    asked = inputs.select("input_id", raw.alias("source_url"), classify_reference(F.col("reference"), profile).alias("c")).select(
        "input_id", "source_url", "c.kind", "c.record_id", "c.reason"
    )
    # Only ids that are asked for, in each of the sources, before anything is joined.
    wanted = asked.select("record_id").filter("record_id IS NOT NULL").distinct()
    registry = registry.join(wanted.withColumnRenamed("record_id", "md_id"), "md_id", "left_semi")
    withdrawn = withdrawn.join(wanted.withColumnRenamed("record_id", "original_id"), "original_id", "left_semi")
    # One lookup table: per id the direction, the withdrawal and the active circular, each already unique.
    circular = Window.partitionBy("md_id").orderBy("document_id")
    directions = registry.filter(F.col("document_family") == direction_family).select(
        F.col("md_id").alias("record_id"),
        F.struct("status", "document_id", "title", "detail_url", "last_updated_at").alias("d"),
    )
    active = (
        registry.filter(F.col("document_family").isin(*circular_families) & (F.col("status") == "current"))
        .withColumn("_n", F.row_number().over(circular))
        .filter("_n = 1")
        .select(
            F.col("md_id").alias("record_id"),
            F.struct("document_id", "title", "detail_url", "ref_no", "issued_date", "document_family", "last_seen_at").alias("a"),
        )
    )
    gone = withdrawn_latest(withdrawn).select(
        F.col("original_id").alias("record_id"),
        F.struct("title", "detail_url", "original_ref", "issued_date", "withdrawn_date", "replacement_ref").alias("w"),
    )
    facts = wanted.join(directions, "record_id", "left").join(gone, "record_id", "left").join(active, "record_id", "left")
    # Inputs without an id get scattered keys, so they do not pile up in one task.
    scattered = F.concat(F.lit("-"), F.pmod(F.xxhash64("input_id"), F.lit(4096)))
    asked = asked.withColumn("lookup", F.coalesce("record_id", scattered))
    joined = asked.join(facts.withColumnRenamed("record_id", "lookup"), "lookup", "left")
    is_direction = F.col("kind") == "direction"
    is_notification = F.col("kind") == "notification"
    known = is_direction & F.col("d").isNotNull()
    retired = is_notification & F.col("w").isNotNull()
    live = is_notification & F.col("w").isNull() & F.col("a").isNotNull()
    status = (
        F.when(known, F.col("d.status"))
        .when(is_direction, "unknown")
        .when(F.col("kind") == "withdrawn_list", "list_page")
        .when(retired, "withdrawn")
        .when(live, "current")
        .when(is_notification, "not_withdrawn")
        .otherwise(UNSUPPORTED)
    )
    supported = F.col("reason").isNull()
    note = (
        F.when(is_direction & ~known, "direction_not_in_corpus")
        .when(F.col("kind") == "withdrawn_list", "list_page_not_a_record")
        .when(retired, "in_withdrawn_list")
        .when(live, F.concat(F.lit("active_last_seen "), F.date_format(F.col("a.last_seen_at"), "yyyy-MM-dd")))
        .when(is_notification, "not_in_corpus")
    )
    return joined.select(
        "input_id",
        status.alias("status"),
        F.when(known, F.col("d.document_id"))
        .when(is_direction, F.concat_ws(":", F.lit(profile.namespace), F.lit(direction_family), F.col("record_id")))
        .when(live, F.col("a.document_id"))
        .alias("document_id"),
        F.when(known, F.col("d.title")).when(retired, F.col("w.title")).when(live, F.col("a.title")).alias("title"),
        F.when(known, F.col("d.detail_url"))
        .when(retired, F.coalesce("w.detail_url", "source_url"))
        .when(live, F.col("a.detail_url"))
        .when(supported, F.col("source_url"))
        .alias("official_url"),
        F.when(retired, F.col("w.original_ref")).when(live, F.col("a.ref_no")).alias("ref_no"),
        F.when(retired, F.col("w.issued_date")).when(live, F.col("a.issued_date")).alias("issued_date"),
        F.when(is_direction, F.lit(direction_family))
        .when(retired, F.lit("notification"))
        .when(live, F.col("a.document_family"))
        .alias("document_family"),
        F.when(known, F.col("d.last_updated_at")).alias("last_updated_at"),
        F.when(retired, F.col("w.withdrawn_date")).alias("withdrawn_date"),
        F.when(retired, F.col("w.replacement_ref")).alias("replacement_ref"),
        F.when(supported, as_of).alias("as_of"),
        "source_url",
        note.alias("note"),
        "reason",
    )
