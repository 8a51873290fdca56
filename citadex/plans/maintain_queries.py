"""Queries over incremental maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import maintain as M
from ..session import shared_dir
from .bindings import cte, current_listing, previous_listing, query, registry, sql, table, withdrawn_view
from .retrieval_queries import LONG

NOW = lambda: F.lit("2025-06-01 00:00:00").cast("timestamp")
DAY = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
TEXT = lambda c: F.col(c).cast("string").alias(c)

STORED = (
    "document_id", "md_id", "title", "detail_url", "last_updated_at", "issued_date", "ref_no", "department", "document_family",
    "pdf_urls", "status", "first_seen_at", "last_seen_at", "raw_list_sha256",
)


def _stored(spark, sf):
    return previous_listing(spark, sf).select(*STORED)


def _shape(df):
    """Registry columns as plain text."""
    return df.select(
        "document_id", "md_id", "title", "detail_url", TEXT("last_updated_at"), TEXT("issued_date"), "ref_no", "department",
        "document_family", F.array_join("pdf_urls", " ").alias("pdf_urls"), "status", DAY("first_seen_at"), DAY("last_seen_at"), "raw_list_sha256",
    )


cte(
    "diff",
    """SELECT md_id, CASE WHEN p.md_id IS NULL THEN 'added' WHEN c.md_id IS NULL THEN 'removed'
    WHEN p.title IS DISTINCT FROM c.title OR list_sort(p.pdf_urls) IS DISTINCT FROM list_sort(c.pdf_urls) THEN 'changed' END AS change
FROM prev p FULL OUTER JOIN curr c USING (md_id)""",
    "prev", "curr",
)


@query("snapshot_diff", sql("SELECT * FROM diff WHERE change IS NOT NULL", "diff"))
def snapshot_diff(spark, sf):
    return M.snapshot_diff(previous_listing(spark, sf), current_listing(spark, sf))


def _supersede_sql(listing: str) -> str:
    return sql(
        f"""SELECT p.md_id, CASE WHEN c.md_id IS NULL AND p.status = 'current' AND g.ok THEN 'superseded' ELSE p.status END AS status,
  CASE WHEN c.md_id IS NULL AND p.status = 'current' AND g.ok THEN '2025-06-01' ELSE '2025-01-01' END AS last_seen_at
FROM prev p LEFT JOIN {listing} c USING (md_id),
(SELECT (SELECT count(*) FROM {listing}) >= 0.8 * (SELECT count(*) FROM prev) AS ok) g""",
        "prev", listing,
    )


def _supersede(spark, sf, partial):
    prev = previous_listing(spark, sf)
    out = M.guarded_supersede(_stored(spark, sf), prev, current_listing(spark, sf, partial), NOW())
    return out.select("md_id", "status", DAY("last_seen_at"))


@query("guarded_supersede", _supersede_sql("curr"))
def supersede(spark, sf):
    return _supersede(spark, sf, False)


@query("guarded_supersede_partial", _supersede_sql("curr_partial"))
def supersede_partial(spark, sf):
    return _supersede(spark, sf, True)


@query(
    "upsert_documents",
    sql(
        """SELECT coalesce(p.document_id, c.document_id) AS document_id, md_id, coalesce(c.title, p.title) AS title,
  coalesce(c.detail_url, p.detail_url) AS detail_url, strftime(coalesce(c.last_updated_at, p.last_updated_at), '%Y-%m-%d') AS last_updated_at,
  strftime(CASE WHEN p.md_id IS NULL THEN c.issued_date ELSE p.issued_date END, '%Y-%m-%d') AS issued_date,
  CASE WHEN p.md_id IS NULL THEN c.ref_no ELSE p.ref_no END AS ref_no, coalesce(c.department, p.department) AS department,
  document_family, array_to_string(coalesce(c.pdf_urls, p.pdf_urls), ' ') AS pdf_urls, coalesce(c.status, p.status) AS status,
  '2025-01-01' AS first_seen_at, CASE WHEN c.md_id IS NULL THEN '2025-01-01' ELSE '2025-06-01' END AS last_seen_at,
  CASE WHEN c.md_id IS NULL THEN '0' ELSE '1' END AS raw_list_sha256
FROM prev p FULL OUTER JOIN (SELECT * REPLACE (CASE WHEN lang = 'es' THEN NULL ELSE department END AS department) FROM curr) c USING (md_id, document_family)""",
        "prev", "curr",
    ),
)
def upsert_documents(spark, sf):
    listing = (
        current_listing(spark, sf).select("lang", *STORED).withColumn("last_seen_at", NOW()).withColumn("raw_list_sha256", F.lit("1"))
        .withColumn("department", F.when(F.col("lang") != "es", F.col("department"))).drop("lang")
    )
    return _shape(M.upsert_listing(_stored(spark, sf), listing))


cte(
    "bad_titles",
    """SELECT *, CASE WHEN lang = 'en' THEN title WHEN lang = 'fr' THEN strftime(issued_date, '%-d %B %Y') WHEN lang = 'es' THEN 'Subject' ELSE '' END AS new_title,
  CASE WHEN n_chars % 2 = 0 THEN title ELSE '12-3-2020' END AS old_title FROM registry""",
    "registry",
)


@query(
    "title_fallback",
    sql(
        """SELECT md_id, CASE WHEN NOT new_bad THEN new_title WHEN NOT old_bad THEN old_title WHEN new_title <> '' THEN new_title
  ELSE upper(document_family[1]) || document_family[2:] || ' ' || coalesce(ref_no, md_id) END AS title, new_bad, old_bad
FROM (SELECT *, new_title = '' OR lower(trim(new_title)) IN ('circular name/title', 'subject', 'notifications', 'circular number', 'ref no.')
    OR regexp_full_match(trim(new_title), '[A-Z][a-z]+\\s+\\d{1,2},?\\s*\\d{4}|\\d{1,2}\\s+[A-Z][a-z]+\\s+\\d{4}|\\d{1,2}/\\d{1,2}/\\d{4}|\\d{1,2}-\\d{1,2}-\\d{4}') AS new_bad,
  old_title = '' OR old_title = '12-3-2020' AS old_bad FROM bad_titles)""",
        "bad_titles",
    ),
)
def title_fallback(spark, sf):
    rows = registry(spark, sf).withColumn(
        "new_title",
        F.when(F.col("lang") == "en", F.col("title")).when(F.col("lang") == "fr", F.date_format("issued_date", "d MMMM yyyy"))
        .when(F.col("lang") == "es", "Subject").otherwise(""),
    ).withColumn("old_title", F.when(F.col("n_chars") % 2 == 0, F.col("title")).otherwise("12-3-2020"))
    new, old = F.col("new_title"), F.col("old_title")
    return rows.select(
        "md_id", M.choose_title(new, old, F.col("document_family"), F.col("ref_no"), F.col("md_id")).alias("title"),
        M.is_date_or_header(new).alias("new_bad"), M.is_date_or_header(old).alias("old_bad"),
    )


cte(
    "wd_batch",
    """SELECT doc_id AS pos, CASE WHEN lang = 'en' THEN md_id END AS original_id, CASE WHEN lang <> 'de' THEN ref_no END AS original_ref,
  title || CASE WHEN lang = 'en' THEN ' (2)' ELSE '' END AS title, CASE WHEN n_chars % 2 = 0 THEN issued_date END AS issued_date, issued_date + 60 AS withdrawn_date
FROM registry WHERE ref_no IS NOT NULL""",
    "registry",
)
cte(
    "wd_keyed",
    """SELECT *, CASE WHEN original_id IS NOT NULL THEN 'id' || chr(1) || original_id WHEN original_ref IS NOT NULL THEN 'ref' || chr(1) || original_ref || chr(1) || title
  ELSE 'title' || chr(1) || title END AS k FROM wd_batch""",
    "wd_batch",
)
cte(
    "wd_folded",
    """SELECT k, arg_max(original_id, pos) FILTER (WHERE original_id IS NOT NULL) AS original_id, arg_max(original_ref, pos) FILTER (WHERE original_ref IS NOT NULL) AS original_ref,
  arg_max(title, pos) AS title, arg_max(issued_date, pos) FILTER (WHERE issued_date IS NOT NULL) AS issued_date, arg_max(withdrawn_date, pos) AS withdrawn_date
FROM wd_keyed GROUP BY k""",
    "wd_keyed",
)


@query(
    "upsert_withdrawn",
    sql(
        """SELECT coalesce(b.original_ref, s.original_ref) AS original_ref, coalesce(b.original_id, s.original_id) AS original_id, coalesce(b.title, s.title) AS title,
  strftime(coalesce(b.issued_date, s.issued_date), '%Y-%m-%d') AS issued_date, strftime(coalesce(b.withdrawn_date, s.withdrawn_date), '%Y-%m-%d') AS withdrawn_date,
  CASE WHEN s.original_id IS NULL THEN '2025-06-01' ELSE '2025-01-01' END AS first_seen_at, CASE WHEN b.k IS NULL THEN '2025-01-01' ELSE '2025-06-01' END AS last_seen_at
FROM withdrawn_v s FULL OUTER JOIN wd_folded b ON b.k = 'id' || chr(1) || s.original_id OR b.k = 'ref' || chr(1) || s.original_ref || chr(1) || s.title""",
        "withdrawn_v", "wd_folded",
    ),
)
def upsert_withdrawn(spark, sf):
    batch = registry(spark, sf).filter(F.col("ref_no").isNotNull()).select(
        F.col("doc_id").alias("pos"), F.when(F.col("lang") == "en", F.col("md_id")).alias("original_id"),
        F.when(F.col("lang") != "de", F.col("ref_no")).alias("original_ref"),
        F.concat("title", F.when(F.col("lang") == "en", " (2)").otherwise("")).alias("title"),
        F.when(F.col("n_chars") % 2 == 0, F.col("issued_date")).alias("issued_date"), F.date_add("issued_date", 60).alias("withdrawn_date"),
        NOW().alias("first_seen_at"), NOW().alias("last_seen_at"),
    )
    out = M.upsert_withdrawn(withdrawn_view(spark, sf), batch)
    return out.select("original_ref", "original_id", "title", TEXT("issued_date"), TEXT("withdrawn_date"), DAY("first_seen_at"), DAY("last_seen_at"))


# --- skips ----------------------------------------------------------------------------------------------------


def bodies(spark, sf):
    """New texts: the short documents have gained a line."""
    return registry(spark, sf).withColumn("text", F.when(F.col("n_chars") < 400, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text")))


def artifacts(spark, sf):
    """Attachments of the labelled documents, fetched thirty days into the year for French ones, later for others."""
    reg = registry(spark, sf).filter(F.col("ref_no").isNotNull())
    fetched = F.when(F.col("lang") == "fr", F.lit("2024-01-31 12:00:00")).otherwise(F.lit("2024-09-30 12:00:00")).cast("timestamp")
    return reg.select(
        F.col("pdf_urls")[0].alias("pdf_url"), "document_id", "md_id", F.sha1("text").alias("pdf_sha256"), F.sha2("text", 256).alias("text_sha256"),
        F.col("n_chars").cast("int").alias("bytes"), F.lit(1).alias("page_count"), F.lit(1.0).alias("extraction_quality"),
        (F.col("status") != "superseded").alias("is_indexed"), fetched.alias("fetched_at"), fetched.alias("extracted_at"),
        F.when(F.col("status") == "superseded", "timeout").alias("error"),
    )


cte(
    "artifacts",
    """SELECT pdf_url, document_id, md_id, sha1(text) AS pdf_sha256, sha256(text) AS text_sha256, n_chars AS bytes, status <> 'superseded' AS is_indexed,
  CASE WHEN lang = 'fr' THEN DATE '2024-01-31' ELSE DATE '2024-09-30' END AS fetched_on, CASE WHEN status = 'superseded' THEN 'timeout' END AS error, document_family, last_updated_at
FROM registry WHERE ref_no IS NOT NULL""",
    "registry",
)


@query(
    "content_hash_skip",
    sql(
        """SELECT r.document_id, sha256(CASE WHEN n_chars < 400 THEN r.text || chr(10) || 'more' ELSE r.text END) AS body_sha256, 1 AS chunk_count,
  CASE WHEN e.vec_id IS NULL THEN 0 ELSE 1 END AS vector_count, coalesce(n_chars >= 400 AND a.document_id IS NOT NULL AND e.vec_id IS NOT NULL, false) AS skip
FROM registry r LEFT JOIN artifacts a USING (document_id) LEFT JOIN embeddings e ON e.vec_id = r.doc_id""",
        "registry", "artifacts",
    ),
)
def content_hash_skip(spark, sf):
    from .bindings import chunks, vectors

    return M.content_hash_skip(bodies(spark, sf), artifacts(spark, sf), chunks(spark, sf), vectors(spark, sf)).select(
        "document_id", "body_sha256", *LONG("chunk_count", "vector_count"), "skip"
    )


@query(
    "stale_selection",
    sql(
        """SELECT document_id, md_id, document_family FROM registry r WHERE NOT EXISTS (SELECT 1 FROM artifacts a
  WHERE a.document_id = r.document_id AND a.is_indexed AND (a.last_updated_at IS NULL OR a.fetched_on >= a.last_updated_at))""",
        "registry", "artifacts",
    ),
)
def stale_selection(spark, sf):
    return M.stale_selection(registry(spark, sf), artifacts(spark, sf)).select("document_id", "md_id", "document_family")


@query(
    "existing_skip",
    sql(
        "SELECT page_id FROM pages WHERE CAST(page_id AS VARCHAR) NOT IN (SELECT md_id FROM registry WHERE document_family = 'src3')", "registry"
    ),
)
def existing_skip(spark, sf):
    listing = table(spark, sf, "pages").select("page_id", F.col("page_id").cast("string").alias("md_id"))
    return M.existing_skip(listing, registry(spark, sf), "src3").select("page_id")


@query(
    "select_targets",
    sql(
        """SELECT md_id, md_id IN (SELECT md_id FROM artifacts WHERE is_indexed AND (last_updated_at IS NULL OR fetched_on >= last_updated_at) AND document_family = 'src7') AS skip
FROM registry WHERE document_family = 'src7' ORDER BY md_id LIMIT 100""",
        "registry", "artifacts",
    ),
)
def select_targets(spark, sf):
    reg = registry(spark, sf)
    return M.select_targets(reg, "src7", M.fresh_ids(reg, artifacts(spark, sf), ["src7"]), limit=100)


@query(
    "replace_chunks",
    sql(
        """SELECT document_id, chunk_id, paragraph_anchor, sha256(text) AS text_sha256 FROM outline_chunks
WHERE document_id NOT IN (SELECT document_id FROM registry WHERE lang = 'fr' AND length(text) > 0)
UNION  ALL SELECT document_id, md_id || '-new', 'new', sha256(text) FROM registry WHERE lang = 'fr'""",
        "outline_chunks", "registry",
    ),
)
def replace_chunks(spark, sf):
    from ..operators.chunking import outline_chunks
    from .bindings import outlined

    stored = outline_chunks(outlined(spark, sf), carry=()).select("document_id", "chunk_id", "paragraph_anchor", "text_sha256")
    fresh = registry(spark, sf).filter(F.col("lang") == "fr").select(
        "document_id", F.concat("md_id", F.lit("-new")).alias("chunk_id"), F.lit("new").alias("paragraph_anchor"), F.sha2("text", 256).alias("text_sha256")
    )
    folder = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    M.write_by_document(stored, folder, buckets=16)
    M.replace_stored(spark, folder, fresh, buckets=16)
    return spark.read.parquet(folder).select(*stored.columns)


@query(
    "upsert_artifacts",
    sql(
        """SELECT pdf_url, coalesce(a.document_id, n.document_id) AS document_id, coalesce(n.pdf_sha256, a.pdf_sha256) AS pdf_sha256,
  coalesce(n.bytes, a.bytes) AS bytes, CASE WHEN n.pdf_url IS NULL THEN a.is_indexed ELSE true END AS is_indexed,
  CASE WHEN n.pdf_url IS NULL THEN a.error END AS error, CASE WHEN n.pdf_url IS NULL THEN strftime(a.fetched_on, '%Y-%m-%d') ELSE '2025-06-01' END AS fetched_at
FROM artifacts a FULL OUTER JOIN (SELECT pdf_url, 'other:' || md_id AS document_id, sha1(text || 'x') AS pdf_sha256, n_chars + 1 AS bytes FROM registry WHERE lang <> 'en') n USING (pdf_url)""",
        "artifacts", "registry",
    ),
)
def upsert_artifacts(spark, sf):
    fetched = registry(spark, sf).filter(F.col("lang") != "en").select(
        F.col("pdf_urls")[0].alias("pdf_url"), F.concat(F.lit("other:"), "md_id").alias("document_id"), F.sha1(F.concat("text", F.lit("x"))).alias("pdf_sha256"),
        (F.col("n_chars") + 1).cast("int").alias("bytes"), NOW().alias("fetched_at"),
    )
    out = M.upsert_artifacts(artifacts(spark, sf), fetched)
    return out.select("pdf_url", "document_id", "pdf_sha256", *LONG("bytes"), "is_indexed", "error", DAY("fetched_at"))


# --- bookkeeping ----------------------------------------------------------------------------------------------


def _audit(spark, sf, partial, source):
    prev, cur = previous_listing(spark, sf), current_listing(spark, sf, partial)
    counts = M.refresh_counts(prev, cur, M.snapshot_diff(prev, cur))
    return M.audit_run(counts, source, "https://docs.example.org/list", NOW(), NOW())


@query(
    "audit_run",
    sql(
        """SELECT 'full' AS source, (SELECT count(*) FROM curr) AS items_seen, count(*) FILTER (change = 'added') AS items_added,
  count(*) FILTER (change = 'changed') AS items_changed, count(*) FILTER (change = 'removed') AS items_removed, 200 AS status_code, NULL::VARCHAR AS error FROM diff
UNION  ALL SELECT 'partial', (SELECT count(*) FROM curr_partial), (SELECT count(*) FROM curr_partial c WHERE md_id NOT IN (SELECT md_id FROM prev)),
  (SELECT count(*) FROM curr_partial c JOIN prev p USING (md_id) WHERE c.title <> p.title OR list_sort(c.pdf_urls) <> list_sort(p.pdf_urls)),
  CASE WHEN (SELECT count(*) FROM curr_partial) >= 0.8 * (SELECT count(*) FROM prev) THEN (SELECT count(*) FROM prev WHERE md_id NOT IN (SELECT md_id FROM curr_partial)) ELSE 0 END, 200, NULL""",
        "diff", "curr_partial",
    ),
)
def audit_run(spark, sf):
    runs = _audit(spark, sf, False, "full").unionByName(_audit(spark, sf, True, "partial"))
    return runs.select("source", *LONG("items_seen", "items_added", "items_changed", "items_removed", "status_code"), "error")


@query(
    "run_summary",
    sql(
        """SELECT document_family, count(*) FILTER (o = 'success') AS success, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o = 'failed') AS failed, count(*) AS total
FROM (SELECT document_family, CASE WHEN status = 'superseded' THEN CASE WHEN n_chars < 1000 THEN 'success' ELSE 'failed' END WHEN ref_no IS NOT NULL THEN 'skipped' ELSE 'success' END AS o FROM registry)
GROUP BY document_family""",
        "registry",
    ),
)
def run_summary(spark, sf):
    first = registry(spark, sf).select(
        "document_family", "md_id", "n_chars",
        F.when(F.col("status") == "superseded", "failed").when(F.col("ref_no").isNotNull(), "skipped").otherwise("success").alias("outcome"),
    )
    retry = first.filter(F.col("outcome") == "failed").select(
        "document_family", "md_id", F.when(F.col("n_chars") < 1000, "success").otherwise("failed").alias("outcome")
    )
    return M.run_summary(first.drop("n_chars"), retry)


@query(
    "meta_upsert",
    """WITH facts AS (SELECT source AS key, CAST(count(*) AS VARCHAR) AS value FROM documents GROUP BY 1),
new AS (SELECT 'lang_' || lang AS key, CAST(count(*) AS VARCHAR) AS value FROM documents GROUP BY 1
  UNION ALL SELECT source, CAST(max(n_chars) AS VARCHAR) FROM documents WHERE source <> 'src3' GROUP BY 1 UNION ALL SELECT 'src3', 'not taken')
SELECT key, CASE WHEN key = 'src3' THEN f.value ELSE coalesce(n.value, f.value) END AS value FROM facts f FULL OUTER JOIN new n USING (key)""",
)
def meta_upsert(spark, sf):
    docs = table(spark, sf, "documents")
    old = F.lit("2025-01-01 00:00:00").cast("timestamp")
    text = lambda c: c.cast("string").alias("value")
    stored = docs.groupBy(F.col("source").alias("key")).agg(text(F.count(F.lit(1)))).withColumn("updated_at", old)
    langs = docs.groupBy(F.concat(F.lit("lang_"), "lang").alias("key")).agg(text(F.count(F.lit(1))))
    sizes = docs.groupBy(F.col("source").alias("key")).agg(text(F.max("n_chars"))).withColumn(
        "value", F.when(F.col("key") == "src3", "not taken").otherwise(F.col("value"))
    )
    return M.meta_upsert(stored, langs.unionByName(sizes).withColumn("updated_at", NOW()), only_missing=("src3",)).select("key", "value")
