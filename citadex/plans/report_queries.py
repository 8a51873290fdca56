"""Queries over evaluation, corpus quality, telemetry and the streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import evaluate as E
from ..operators import quality as Q
from ..operators import fusion, lexical, segments
from ..schema import DOCUMENTS
from ..session import settle, shared_dir
from ..sources.dumps import load_dump, write_dump
from ..sources.snapshots import publish_snapshot, read_snapshot
from ..sources.tables import write_table
from ..streaming import streams as S
from .bindings import (
    aliases, chunks, clause_vectors, clauses, cte, labelled_cases, query, registry, split_cte, sql, table, vectors,
)
from .retrieval_queries import LONG

# --- evaluation -----------------------------------------------------------------------------------------------

cte(
    "plain_flags",
    """SELECT c.query_id, CASE WHEN c.query_id IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings) THEN 'hybrid' ELSE 'sparse_only' END AS retrieval,
  CASE WHEN t.query_id IS NULL THEN true WHEN c.query_id IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings) THEN coalesce(t.fusion_score, 0) < 0.022 OR t.sparse_rank IS NULL OR t.dense_rank IS NULL
    ELSE t.bm25_score IS NULL OR t.bm25_score > -5.0 END AS low_confidence
FROM clauses c LEFT JOIN (SELECT * FROM fused WHERE rank = 1) t USING (query_id)""",
    "clauses", "fused",
)
cte(
    "verdicts",
    """SELECT case_name, enabled, retrieval AS retrieval_mode, low_confidence, provisions, hit_anchor, present, seen, expected_md_id, hit,
  CASE WHEN NOT enabled THEN true WHEN expected_md_id = '' THEN low_confidence ELSE hit END AS passed,
  CASE WHEN NOT enabled THEN 'skipped (disabled)' WHEN expected_md_id = '' AND low_confidence THEN 'low confidence as expected'
    WHEN expected_md_id = '' THEN 'expected low confidence, got ' || provisions || ' provisions' WHEN hit THEN 'matched at ' || hit_anchor
    WHEN provisions = 0 THEN 'no provisions returned' WHEN NOT present THEN 'expected ' || expected_md_id || ' not among ' || seen
    ELSE 'expected ' || expected_md_id || ' present but unmatched' END AS detail
FROM (SELECT c.case_name, any_value(c.enabled) AS enabled, any_value(c.expected_md_id) AS expected_md_id, any_value(f.retrieval) AS retrieval,
    any_value(f.low_confidence) AS low_confidence, count(h.rank) AS provisions,
    coalesce(bool_or(ok AND k.document_id IS NOT DISTINCT FROM c.expected_document_id), false) AS hit,
    arg_min(coalesce(k.paragraph_anchor, ''), h.rank) FILTER (WHERE ok AND k.document_id IS NOT DISTINCT FROM c.expected_document_id) AS hit_anchor,
    coalesce(bool_or(k.document_id IS NOT DISTINCT FROM c.expected_document_id), false) AS present,
    array_to_string(list_sort(list_distinct(list(k.md_id) FILTER (WHERE k.md_id IS NOT NULL))), ',') AS seen
  FROM cases c LEFT JOIN plain_flags f ON f.query_id = c.case_name LEFT JOIN (SELECT * FROM fused WHERE rank <= 5) h ON h.query_id = c.case_name
  LEFT JOIN (SELECT k.*, true AS dummy FROM chunks k) k ON k.chunk_id = h.chunk_id,
  LATERAL (SELECT h.rank IS NOT NULL AND (starts_with(coalesce(k.paragraph_anchor, ''), c.expected_anchor_prefix)
    OR contains(lower(coalesce(k.text, '')), c.expected_text_contains)) AS ok) GROUP BY c.case_name)""",
    "cases", "plain_flags", "fused", "chunks",
)


def _report(spark, sf, cases):
    asked = cases.select(F.col("case_name").alias("query_id"), F.col("clause").alias("text"), "topic_hint")
    return fusion.check_compliance(
        asked, chunks(spark, sf), registry(spark, sf), vectors(spark, sf), clause_vectors(spark, sf), aliases(spark, sf),
    )


def _evaluated(spark, sf):
    cases = settle(labelled_cases(spark, sf))
    report = _report(spark, sf, cases)
    return cases, report, E.evaluate_cases(cases, report)


@query(
    "evaluate_cases",
    sql("SELECT case_name, enabled, passed, low_confidence, retrieval_mode, provisions FROM verdicts", "verdicts"),
)
def evaluate_cases(spark, sf):
    return _evaluated(spark, sf)[2].select("case_name", "enabled", "passed", "low_confidence", "retrieval_mode", "provisions")


@query("case_detail", sql("SELECT case_name, detail FROM verdicts", "verdicts"))
def case_detail(spark, sf):
    return _evaluated(spark, sf)[2].select("case_name", "detail")


@query(
    "eval_gate",
    sql(
        """SELECT *, gate_passed AND round(0.85 - hit_rate, 9) < 0.05 AS release_ok FROM (SELECT total, passed, total - passed AS failed, round(passed / total, 6) AS hit_rate, passed / total >= 0.8 AS gate_passed
FROM (SELECT count(*) AS total, count(*) FILTER (passed) AS passed FROM verdicts))""",
        "verdicts",
    ),
)
def eval_gate(spark, sf):
    return E.eval_gate(_evaluated(spark, sf)[2], F.lit(0.85)).withColumn("hit_rate", F.round("hit_rate", 6))


@query(
    "locked_regressions",
    sql(
        "SELECT count(*) AS locked, count(*) FILTER (NOT passed) AS broken, count(*) FILTER (NOT passed) = 0 AS ok FROM verdicts WHERE retrieval_mode = 'hybrid'",
        "verdicts",
    ),
)
def locked_regressions(spark, sf):
    results = _evaluated(spark, sf)[2]
    return E.locked_regressions(results, results.filter(F.col("retrieval_mode") == "hybrid"))


@query(
    "eval_dump",
    sql(
        """SELECT v.case_name, CASE WHEN v.passed THEN 'true' ELSE 'false' END AS passed, v.detail, count(f.rank) AS provisions, max(k.document_id) FILTER (WHERE f.rank = 1) AS first_document,
  max(substr(k.text, 1, 200)) FILTER (WHERE f.rank = 1) AS first_text
FROM verdicts v LEFT JOIN (SELECT * FROM fused WHERE rank <= 5) f ON f.query_id = v.case_name LEFT JOIN chunks k USING (chunk_id) GROUP BY v.case_name, v.passed, v.detail""",
        "verdicts", "fused", "chunks",
    ),
)
def eval_dump(spark, sf):
    cases, report, results = _evaluated(spark, sf)
    field = lambda path: F.get_json_object("line", path)
    docs = F.from_json("line", "top_provisions array<struct<document_id:string>>")["top_provisions"]
    return E.dump_cases(results, report, cases).select(
        "case_name", field("$.passed").alias("passed"), field("$.detail").alias("detail"), F.size(docs).cast("bigint").alias("provisions"),
        field("$.top_provisions[0].document_id").alias("first_document"), field("$.top_provisions[0].quoted_text").alias("first_text"),
    )


@query(
    "eval_load",
    sql(
        """SELECT v.case_name, v.passed, v.retrieval_mode, any_value(length(q.clause)) * 0.5 AS latency_ms, count(f.rank) AS provisions, coalesce(max(k.document_id || '::' || k.paragraph_anchor) FILTER (WHERE f.rank = 1), '') AS first_key
FROM verdicts v JOIN cases q USING (case_name) LEFT JOIN (SELECT * FROM fused WHERE rank <= 5) f ON f.query_id = v.case_name LEFT JOIN chunks k USING (chunk_id) GROUP BY v.case_name, v.passed, v.retrieval_mode""",
        "verdicts", "cases", "fused", "chunks",
    ),
)
def eval_load(spark, sf):
    """Half a millisecond a character stands for the time a case took."""
    cases, report, results = _evaluated(spark, sf)
    results = results.join(cases.select("case_name", (F.length("clause") * 0.5).cast("double").alias("latency_ms")), "case_name")
    path = _folder(spark, "dump")
    write_dump(E.dump_cases(results, report, cases), path)
    loaded = load_dump(spark, path, "now")
    return loaded.select(
        "case_name", "passed", "retrieval_mode", "latency_ms", F.size("keys").cast("bigint").alias("provisions"), F.coalesce(F.get("keys", F.lit(0)), F.lit("")).alias("first_key")
    )


@query("publish_snapshot", sql("SELECT md_id, status, title FROM registry WHERE lang <> 'de'", "registry"))
def publish(spark, sf):
    """Two builds are published and one is left uncommitted; readers see the second."""
    root = _folder(spark, "corpus")
    rows = registry(spark, sf).select("md_id", "status", "title", "lang")
    gate = E.eval_gate(rows.select((F.col("status").isNotNull()).alias("passed")))
    publish_snapshot(spark, root, "one", {"documents": rows}, gate=gate)
    publish_snapshot(spark, root, "two", {"documents": rows.filter("lang <> 'de'")}, gate=gate)
    write_table(rows.filter("lang = 'de'"), f"{root}/snapshot=three/documents")
    return read_snapshot(spark, root, "documents").select("md_id", "status", "title")


RUNS = ("keywords", "keywords_all", "hybrid")


def runs(spark, sf):
    """Three rankers over the same clauses; a case passes when its first key is no plain English document."""
    q, c = clauses(spark, sf), chunks(spark, sf)
    found = {
        "keywords": lexical.bm25_topk(q, c, 5),
        "keywords_all": lexical.bm25_topk(q, c, 5, include_withdrawn=True),
        "hybrid": fusion.hybrid_search(q, c, vectors(spark, sf), clause_vectors(spark, sf), 5),
    }
    out = None
    ids = c.select("chunk_id", "document_id", "paragraph_anchor")
    for run, hits in found.items():
        keys = E.provision_keys(hits.join(ids, "chunk_id")).select(
            F.lit(run).alias("run"), F.col("query_id").alias("case_name"), (F.get("keys", F.lit(0)) < "ns:src2").alias("passed"), "keys"
        )
        out = keys if out is None else out.unionByName(keys)
    return out


cte(
    "hits_of",
    """SELECT 'keywords' AS run, query_id, chunk_id, sparse_rank AS rank FROM sparse30 WHERE sparse_rank <= 5 UNION  ALL
SELECT 'keywords_all', query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score, chunk_id) AS r FROM scores QUALIFY r <= 5 UNION  ALL
SELECT 'hybrid', query_id, chunk_id, rank FROM fused WHERE rank <= 5""",
    "sparse30", "scores", "fused",
)
cte(
    "runs",
    """SELECT run, query_id AS case_name, list(k.document_id || '::' || k.paragraph_anchor ORDER BY rank) AS keys,
  (list(k.document_id || '::' || k.paragraph_anchor ORDER BY rank))[1] < 'ns:src2' AS passed FROM hits_of JOIN chunks k USING (chunk_id) GROUP BY ALL""",
    "hits_of", "chunks",
)
JACCARD = "CASE WHEN len(list_distinct(list_concat(a.keys, b.keys))) = 0 THEN 1.0 ELSE len(list_intersect(a.keys, b.keys)) / len(list_distinct(list_concat(a.keys, b.keys))) END"
cte(
    "pairs",
    f"""SELECT a.run AS run_a, b.run AS run_b, case_name, a.passed AS passed_a, b.passed AS passed_b, a.keys[1] = b.keys[1] AS top1_same, {JACCARD}::DOUBLE AS jaccard
FROM runs a JOIN runs b USING (case_name) WHERE a.run < b.run""",
    "runs",
)


@query(
    "compare_runs_cases",
    sql(
        """SELECT case_name, true AS present, passed_a, passed_b, top1_same, round(jaccard, 6) AS jaccard,
  CASE WHEN passed_a <> passed_b THEN 'different outcome' WHEN NOT top1_same THEN 'top-1 differs' ELSE 'same' END AS flag
FROM pairs WHERE run_a = 'hybrid' AND run_b = 'keywords'""",
        "pairs",
    ),
)
def compare_cases(spark, sf):
    both = runs(spark, sf)
    pair = E.compare_pair(both.filter("run = 'hybrid'"), both.filter("run = 'keywords'"))
    return pair.withColumn("jaccard", F.round("jaccard", 6))


SUMMARY = """count(*) FILTER (passed_a AND passed_b) AS both_pass, count(*) FILTER (passed_a AND NOT passed_b) AS only_a,
  count(*) FILTER (NOT passed_a AND passed_b) AS only_b, count(*) FILTER (NOT passed_a AND NOT passed_b) AS neither, count(*) FILTER (top1_same) AS top1_same"""
OVERLAP = "round(avg(jaccard), 6) AS mean_jaccard, round(quantile_cont(jaccard, 0.5), 6) AS median_jaccard, round(min(jaccard), 6) AS min_jaccard"


@query(
    "compare_runs",
    sql(
        f"""SELECT count(*) AS n, round(count(*) FILTER (passed_a) / count(*), 6) AS hit_rate_a, round(count(*) FILTER (passed_b) / count(*), 6) AS hit_rate_b, {SUMMARY}, {OVERLAP}
FROM pairs WHERE run_a = 'hybrid' AND run_b = 'keywords'""",
        "pairs",
    ),
)
def compare(spark, sf):
    both = runs(spark, sf)
    out = E.compare_summary(E.compare_pair(both.filter("run = 'hybrid'"), both.filter("run = 'keywords'")))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


@query(
    "compare_n_runs",
    sql(
        f"""SELECT run_a, run_b, count(*) FILTER (passed_a) AS passed_a, count(*) FILTER (passed_b) AS passed_b, count(*) FILTER (top1_same) AS top1_same, {OVERLAP},
  (SELECT count(DISTINCT case_name) FROM runs) AS cases, (SELECT count(*) FROM (SELECT case_name FROM runs GROUP BY 1 HAVING count(DISTINCT passed) > 1)) AS disagreements
FROM pairs GROUP BY run_a, run_b""",
        "pairs", "runs",
    ),
)
def compare_n(spark, sf):
    out = E.compare_runs(runs(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


STATS = """count(*) AS calls, round(avg(value) + 1e-9, 6) AS mean, min(value) AS min, max(value) AS max,
  list_sort(list(value))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95"""


@query("latency_stats", f"SELECT event_type AS tool, {STATS} FROM events GROUP BY 1")
def latency_stats(spark, sf):
    calls = table(spark, sf, "events").withColumnRenamed("event_type", "tool")
    return E.latency_stats(calls, ["tool"], "value").withColumn("mean", F.round(F.col("mean") + 1e-9, 6))


# --- corpus quality -------------------------------------------------------------------------------------------


@query(
    "corpus_profile",
    sql(
        """SELECT document_family, count(DISTINCT r.document_id) AS documents, count(o.chunk_id) AS chunks
FROM registry r LEFT JOIN outline_chunks o USING (document_id) GROUP BY ROLLUP (document_family)""",
        "registry", "outline_chunks",
    ),
)
def corpus_profile(spark, sf):
    from ..operators.chunking import outline_chunks
    from .bindings import outlined

    return Q.corpus_profile(registry(spark, sf), outline_chunks(outlined(spark, sf))).select("document_family", *LONG("documents", "chunks"))


@query(
    "corpus_health",
    """SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS chunks, (SELECT count(*) FROM embeddings) AS vectors,
  'ok' AS status, NULL::VARCHAR AS reason""",
)
def corpus_health(spark, sf):
    out = Q.corpus_health(table(spark, sf, "documents"), table(spark, sf, "pages"), table(spark, sf, "embeddings"))
    return out.select(*LONG("documents", "chunks", "vectors"), "status", "reason")


@query(
    "compatibility_check",
    """SELECT '3' AS schema_version, CAST(max(len(embedding)) AS VARCHAR) AS embedding_dim, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim,
  'ok' AS schema_check, CASE WHEN min(len(embedding)) = 64 AND max(len(embedding)) = 64 THEN 'ok' ELSE 'mismatch' END AS dim_check, min(len(embedding)) = 64 AND max(len(embedding)) = 64 AS accepted FROM embeddings""",
)
def compatibility_check(spark, sf):
    emb = table(spark, sf, "embeddings")
    declared = emb.agg(F.max(F.size("embedding")).cast("string").alias("value")).select(F.lit("embedding_dim").alias("key"), "value")
    meta = declared.unionByName(emb.agg(F.lit("3").alias("value")).select(F.lit("schema_version").alias("key"), "value"))
    out = Q.compatibility_check(meta, "3", 64, emb)
    return out.select("schema_version", "embedding_dim", *LONG("min_dim", "max_dim"), "schema_check", "dim_check", "accepted")


@query(
    "orphan_chunks",
    sql(
        """SELECT count(*) AS orphans, array_to_string(list_sort(list(chunk_id))[1:3], ',') AS sample
FROM (SELECT 'page' || page_id AS chunk_id FROM pages WHERE CAST(page_id AS VARCHAR) NOT IN (SELECT md_id FROM registry WHERE status = 'current'))""",
        "registry",
    ),
)
def orphan_chunks(spark, sf):
    pages = table(spark, sf, "pages").select(F.concat(F.lit("page"), "page_id").alias("chunk_id"), F.col("page_id").cast("string").alias("md_id"))
    return Q.orphan_chunks(pages, registry(spark, sf).filter("status = 'current'"), "md_id")


@query(
    "key_violations",
    """SELECT 'duplicate_key' AS violation, lang || '/' || source AS key, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'unknown_family', lang, count(*) FROM documents WHERE lang NOT IN ('en', 'fr') GROUP BY ALL
UNION ALL SELECT 'unknown_status', source, count(*) FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY ALL""",
)
def key_violations(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("source").alias("md_id"), F.col("lang").alias("document_family"), F.col("source").alias("status"))
    return Q.key_violations(rows, ("en", "fr"), ("src1", "src2"))


@query(
    "schema_evolution",
    sql(
        "SELECT md_id, document_id, title, 'master_direction' AS document_family, 'current' AS status, NULL::VARCHAR AS ref_no, 0 AS links, (SELECT count(*) FROM registry) AS row_count FROM registry",
        "registry",
    ),
)
def schema_evolution(spark, sf):
    old = registry(spark, sf).select("document_id", "md_id", "title", "detail_url", "first_seen_at", "last_seen_at")
    new = Q.evolve_schema(
        old, DOCUMENTS, {"document_family": F.lit("master_direction"), "status": F.lit("current"), "pdf_urls": F.array().cast("array<string>")}
    )
    return new.select(
        "md_id", "document_id", "title", "document_family", "status", "ref_no", F.size("pdf_urls").cast("bigint").alias("links"),
        old.agg(F.count(F.lit(1))).scalar().alias("row_count"),
    )


@query(
    "length_buckets",
    """SELECT 'text' AS kind, CASE WHEN n_chars < 500 THEN '0-500' WHEN n_chars < 2000 THEN '500-2000' WHEN n_chars < 10000 THEN '2000-10000' ELSE '10000+' END AS bucket, count(*) AS n FROM documents GROUP BY ALL
UNION ALL SELECT 'query', CASE WHEN length(text) < 50 THEN '0-50' WHEN length(text) < 200 THEN '50-200' WHEN length(text) < 500 THEN '200-500' ELSE '500+' END, count(*) FROM conversations GROUP BY ALL""",
)
def length_buckets(spark, sf):
    count = F.count(F.lit(1)).alias("n")
    texts = table(spark, sf, "documents").groupBy(F.lit("text").alias("kind"), Q.length_bucket(F.col("n_chars")).alias("bucket")).agg(count)
    asked = table(spark, sf, "conversations").groupBy(F.lit("query").alias("kind"), Q.length_bucket(F.length("text"), small=True).alias("bucket")).agg(count)
    return texts.unionByName(asked)


@query(
    "hint_labels",
    """SELECT hint_label, count(*) AS n FROM (SELECT CASE WHEN lang = 'en' THEN lower(source) WHEN lang = 'fr' THEN 'other' END AS hint_label FROM documents) GROUP BY 1""",
)
def hint_labels(spark, sf):
    docs = table(spark, sf, "documents")
    hint = F.when(F.col("lang") == "en", F.upper("source")).when(F.col("lang") == "fr", F.concat(F.lit("free text "), "doc_id"))
    known = docs.select(F.col("source").alias("alias")).distinct()
    return Q.hint_label(docs.withColumn("topic_hint", hint), known).groupBy("hint_label").agg(F.count(F.lit(1)).alias("n"))


def calls(spark, sf):
    events = table(spark, sf, "events")
    return events.select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("tool"), F.when(F.col("value") > 100, "error").otherwise("ok").alias("status"), F.col("value").alias("latency_ms"),
    )


@query(
    "tool_telemetry",
    f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS tool, CASE WHEN value > 100 THEN 'error' ELSE 'ok' END AS status, {STATS} FROM events GROUP BY ALL""",
)
def tool_telemetry(spark, sf):
    out = Q.tool_telemetry(calls(spark, sf))
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "tool", "status", "calls", F.round(F.col("mean") + 1e-9, 6).alias("mean"), "min", "max", "p95"
    )


WINDOW_SECONDS, LIMIT = 86_400, 4
cte(
    "starts",
    f"""SELECT user_id, min(ts) AS s FROM events GROUP BY 1 UNION ALL
SELECT s.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = s.user_id AND e.ts >= s.s + INTERVAL {WINDOW_SECONDS} SECOND) AS s FROM starts s WHERE s.s IS NOT NULL""",
)
cte(
    "limited",
    f"""SELECT event_id AS request_id, client, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS window_start, request_no, request_no > {LIMIT} AS limited,
  CASE WHEN request_no > {LIMIT} THEN greatest(1, CAST(trunc({WINDOW_SECONDS} - (epoch_us(ts) - epoch_us(s)) / 1000000) AS BIGINT)) END AS retry_after
FROM (SELECT e.event_id, e.user_id AS client, e.ts, s.s, row_number() OVER (PARTITION BY e.user_id, s.s ORDER BY e.ts, e.event_id) AS request_no
  FROM events e ASOF JOIN (SELECT * FROM starts WHERE s IS NOT NULL) s ON e.user_id = s.user_id AND e.ts >= s.s)""",
    "starts",
)


@query("rate_limit_audit", sql("SELECT request_id, client, window_start, request_no, limited, retry_after FROM limited", "limited"))
def rate_limit_audit(spark, sf):
    out = Q.rate_limit_audit(calls(spark, sf), LIMIT, WINDOW_SECONDS)
    return out.select(
        "request_id", "client", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("window_start"), "request_no", "limited", *LONG("retry_after")
    )


# --- streams: each runs over everything there is and stops ----------------------------------------------------


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf, name):
    """A test table as a stream of files; its path, written as a pattern, may be one file or a folder of them."""
    return S.file_stream(spark, f"{sf}/{name}.parque[t]", table(spark, sf, name).schema)


def _collect_stream(spark, stream, name, mode="append"):
    """Write a stream to parquet and read it back."""
    out = _folder(spark, name)
    S.run_available(stream.writeStream.format("parquet").option("path", f"{out}/rows").outputMode(mode), f"{out}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


# The raw texts carry no outline marks, so each is one paragraph: its kept lines, cut by size.
cte(
    "ingest_bodies",
    r"""SELECT 'ns:' || source || ':' || doc_id AS key, 0 AS start, trim(array_to_string(list_filter(string_split(text, chr(10)),
  lambda x: trim(x) <> '' AND NOT regexp_full_match(trim(x), '\d{1,3}')), chr(10)), ' ' || chr(9) || chr(10)) AS body FROM documents""",
)
split_cte("ingest_parts", "SELECT * FROM ingest_bodies WHERE length(body) >= 80", "ingest_bodies")


@query(
    "stream_ingest",
    sql("SELECT key AS document_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM ingest_parts GROUP BY 1", "ingest_parts"),
)
def stream_ingest(spark, sf):
    docs = _stream(spark, sf, "documents")
    bodies = docs.select(
        F.concat_ws(":", F.lit("ns"), "source", "doc_id").alias("document_id"), F.col("doc_id").cast("string").alias("md_id"), F.lit(None).cast("string").alias("ref_no"), "text"
    )
    root = _folder(spark, "ingest")
    S.stream_ingest(bodies, root, f"{root}/checkpoint")
    chunk_schema = T._parse_datatype_string(
        "chunk_id string, document_id string, md_id string, ref_no string, section string, paragraph_anchor string, page int, text string, "
        "text_sha256 string, char_start int, char_end int"
    )
    found = S.ingested_chunks(spark, root, chunk_schema)
    return found.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


@query(
    "stream_changed_only",
    """SELECT document_id, seq, text_sha256 FROM (SELECT 'c' || conv_id || role AS document_id, turn AS seq, sha256(text) AS text_sha256,
  lag(sha256(text)) OVER (PARTITION BY conv_id, role ORDER BY turn, sha256(text)) AS before FROM conversations) WHERE text_sha256 IS DISTINCT FROM before""",
)
def stream_changed_only(spark, sf):
    rows = _stream(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id", "role").alias("document_id"), F.col("turn").alias("seq"), "text")
    out = _folder(spark, "changed")
    S.stream_changed_only(rows, out, f"{out}/checkpoint")
    return S.batch_folders(spark, f"{out}/rows", S.CHANGED)


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf):
    rows = _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return _collect_stream(spark, S.stream_dedupe(rows, ["user_id", "event_type"], horizon="400 days"), "dedupe").select("user_id", "event_type")


@query("stream_search", sql("SELECT query_id, chunk_id, bm25_score, sparse_rank AS rank FROM sparse30 WHERE sparse_rank <= 5", "sparse30"))
def stream_search(spark, sf):
    asked = _stream(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    out = _folder(spark, "search")
    segments.create(lexical.build_index(chunks(spark, sf)), f"{out}/index", buckets=8)
    S.stream_search(asked, chunks(spark, sf), f"{out}/rows", f"{out}/checkpoint", segments.load(spark, f"{out}/index"))
    rows = S.batch_folders(spark, f"{out}/rows", "query_id string, chunk_id string, bm25_score double, rank int")
    return rows.select("query_id", "chunk_id", "bm25_score", *LONG("rank"))


TELEMETRY = """SELECT strftime(time_bucket(INTERVAL {slide}, ts), '%Y-%m-%d %H') AS window_start, event_type AS tool, count(*) AS calls, count(*) FILTER (value > 100) AS errors,
  round(sum(value), 4) AS latency_sum, max(value) AS latency_max FROM events GROUP BY ALL"""


@query("stream_telemetry", TELEMETRY.format(slide="6 HOUR"))
def stream_telemetry(spark, sf):
    rows = _stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), F.when(F.col("value") > 100, "error").otherwise("ok").alias("status"),
        F.col("value").alias("latency_ms"),
    )
    out = _folder(spark, "telemetry")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch-{batch_id}")

    stream = S.stream_telemetry(rows, "6 hours", "1 day")
    # Complete mode also shows the windows the watermark has not closed when the files run out.
    S.run_available(stream.writeStream.foreachBatch(keep).outputMode("complete"), f"{out}/checkpoint")
    last = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows")
    return last.select(
        F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "tool", "calls", "errors", F.round("latency_sum", 4).alias("latency_sum"), "latency_max"
    )


@query("stream_rate_limit", sql("SELECT request_id, client, request_no, limited FROM limited", "limited"))
def stream_rate_limit(spark, sf):
    rows = _stream(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts")
    )
    out = _folder(spark, "limit")
    S.stream_rate_limit(rows, out, f"{out}/checkpoint", LIMIT, WINDOW_SECONDS)
    return S.batch_folders(spark, f"{out}/rows", S.LIMITED).select("request_id", "client", "request_no", "limited")
