import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citadex.operators import lexical
from citadex.operators import quality as Q
from citadex.operators.chunking import outline_chunks
from citadex.streaming import streams as S

FILL = " words that make the paragraph long enough to be kept as a citable chunk of its own, as the rule asks."


@pytest.fixture()
def files(spark, tmp_path):
    """Write frames one by one as arriving files and return a stream over them, one file per micro-batch."""

    def make(*frames):
        folder = tmp_path / "in"
        for i, df in enumerate(frames):
            df.coalesce(1).write.mode("append").parquet(str(folder))
        return S.file_stream(spark, str(folder), frames[0].schema, files_per_batch=1)

    return make


def collected(spark, stream, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    S.run_available(stream.writeStream.format("parquet").option("path", out).outputMode(mode), str(tmp_path / "cp"))
    return spark.read.schema(stream.schema).parquet(out)


BODY = "document_id string, md_id string, ref_no string, text string"


def test_ingest_equals_batch(spark, tmp_path, files):
    one = spark.createDataFrame([("a", "1", None, f"1. A{FILL}"), ("b", "2", None, f"1. B{FILL}")], BODY)
    two = spark.createDataFrame([("a", "1", None, f"1. A{FILL}"), ("b", "2", None, f"1. B changed{FILL}\n2. More{FILL}"), ("c", "3", None, f"5. C{FILL}")], BODY)
    root = str(tmp_path / "corpus")
    S.stream_ingest(files(one, two), root, str(tmp_path / "cp"))
    batch = outline_chunks(two)
    got = S.ingested_chunks(spark, root, batch.schema)
    assert sorted(r.chunk_id + r.text for r in got.collect()) == sorted(r.chunk_id + r.text for r in batch.collect())
    hashes = S.batch_folders(spark, root + "/hashes", S.HASHES)
    assert sorted((r.document_id, r.batch_id) for r in hashes.collect()) == [("a", 0), ("b", 0), ("b", 1), ("c", 1)]


def test_body_without_chunks_keeps_the_former_ones(spark, tmp_path, files):
    one = spark.createDataFrame([("a", "1", None, f"1. A{FILL}")], BODY)
    two = spark.createDataFrame([("a", "1", None, "too short")], BODY)
    three = spark.createDataFrame([("a", "1", None, f"1. A again{FILL}")], BODY)
    root = str(tmp_path / "corpus")
    S.stream_ingest(files(one, two), root, str(tmp_path / "cp"))
    got = S.ingested_chunks(spark, root, outline_chunks(one).schema)
    assert sorted(r.text for r in got.collect()) == sorted(r.text for r in outline_chunks(one).collect())
    failed = S.batch_folders(spark, root + "/failed", S.FAILED).collect()
    assert [(r.document_id, r.batch_id, r.error) for r in failed] == [("a", 1, "no_chunks")]
    again = str(tmp_path / "again")
    S.stream_ingest(files(one, two, three), again, str(tmp_path / "cp2"))
    got = S.ingested_chunks(spark, again, outline_chunks(one).schema)
    assert sorted(r.text for r in got.collect()) == sorted(r.text for r in outline_chunks(three).collect())


def test_changed_only(spark, tmp_path, files):
    schema = "document_id string, seq int, text string"
    one = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x")], schema)
    two = spark.createDataFrame([("a", 3, "x"), ("b", 2, "y"), ("b", 3, "x"), ("c", 1, "z")], schema)
    out = str(tmp_path / "out")
    S.stream_changed_only(files(one, two), out, str(tmp_path / "cp"))
    got = S.batch_folders(spark, f"{out}/rows", S.CHANGED)
    assert sorted((r.document_id, r.seq) for r in got.collect()) == [("a", 1), ("b", 1), ("b", 2), ("b", 3), ("c", 1)]


def test_changed_only_of_a_hot_document_in_pieces(spark, tmp_path, files, monkeypatch):
    """One document with most rows, ordered in pieces over three batches; equal to reading all of it in order."""
    monkeypatch.setattr(S, "PIECE", 50)
    frames, want, last, seq = [], [], {}, 0
    for b in range(3):
        rows = [("hot", seq + i, f"text {(seq + i) * 7 // 30}") for i in range(400)] + [(f"d{i}", b, f"text {b * i % 3}") for i in range(30)] + [(None, b, "same")]
        seq += 400
        for d, n, t in sorted(rows, key=lambda r: (str(r[0]), r[1])):
            if last.get(d) != t:
                want.append((d, n))
            last[d] = t
        frames.append(spark.createDataFrame(rows, "document_id string, seq int, text string"))
    out = str(tmp_path / "out")
    S.stream_changed_only(files(*frames), out, str(tmp_path / "cp"))
    got = [(r.document_id, r.seq) for r in S.batch_folders(spark, f"{out}/rows", S.CHANGED).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_keyed_table_reads_a_base_and_what_came_after(spark, tmp_path):
    from citadex.streaming.keyed import KeyedTable

    table = KeyedTable(spark, str(tmp_path / "s"), "k string, v bigint", buckets=4, every=3)
    known = {}
    for n in range(8):
        assert {r.k: r.v for r in table.before(n).collect()} == known
        new = {f"k{n}": n, "same": n}
        rows = spark.createDataFrame(list(new.items()), "k string, v bigint")
        for _ in range(2):  # a batch that runs again finds and leaves the same
            table.write(n, rows)
        known |= new
        asked = spark.createDataFrame([("same",), ("k0",), ("none",)], "k string")
        assert {r.k: r.v for r in table.before(n + 1, asked).collect()} == {k: v for k, v in known.items() if k in ("same", "k0")}
    names = {p.name for p in (tmp_path / "s").iterdir()}
    assert names == {"base-2", "base-5", "batch-3", "batch-4", "batch-5", "batch-6", "batch-7"}
    table.write(8, rows, F.col("v") > 5)
    assert {r.v for r in table.before(9).collect()} == {6, 7}


def test_dedupe(spark, tmp_path, files):
    at = lambda m: dt.datetime(2025, 1, 1, 0, m)
    one = spark.createDataFrame([("k", at(0)), ("k", at(1)), ("l", at(2))], "key string, ts timestamp")
    two = spark.createDataFrame([("k", at(3)), ("m", at(4))], one.schema)
    got = collected(spark, S.stream_dedupe(files(one, two), ["key"], horizon="1 hour"), tmp_path)
    assert sorted(r.key for r in got.collect()) == ["k", "l", "m"]


def test_search_equals_batch(spark, tmp_path, files):
    chunks = spark.createDataFrame([("c1", "kyc rules", "1", "current"), ("c2", "loan rules", "2", None)], "chunk_id string, text string, md_id string, status string")
    one = spark.createDataFrame([("q1", "kyc")], "query_id string, text string")
    two = spark.createDataFrame([("q2", "loan rules")], one.schema)
    out = str(tmp_path / "hits")
    S.stream_search(files(one, two), chunks, out, str(tmp_path / "cp"), lexical.build_index(chunks))
    want = lexical.bm25_topk(one.union(two), chunks, 5)
    assert sorted(S.batch_folders(spark, out, want.schema).collect()) == sorted(want.collect())


def test_telemetry_drops_late_rows(spark, tmp_path, files):
    row = lambda m, v, s="ok": (dt.datetime(2025, 1, 1) + dt.timedelta(minutes=m), "t", s, v)
    schema = "ts timestamp, tool string, status string, latency_ms double"
    one = spark.createDataFrame([row(1, 1.0), row(2, 2.0, "error"), row(65, 3.0)], schema)
    two = spark.createDataFrame([row(300, 4.0)], schema)
    three = spark.createDataFrame([row(310, 4.0)], schema)
    four = spark.createDataFrame([row(3, 9.0), row(600, 5.0)], schema)  # the first one is five hours late
    got = collected(spark, S.stream_telemetry(files(one, two, three, four), "1 hour", "1 hour"), tmp_path)
    first = got.orderBy("window_start").first()
    assert (first.calls, first.errors, first.latency_sum) == (2, 1, 3.0)


@pytest.mark.parametrize("late", [None, 3600.0])
def test_rate_limit_equals_batch(spark, tmp_path, files, late):
    rows = [(i, i % 2, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=(i * i * 7) % 50 + 20 * i)) for i in range(60)]
    rows.sort(key=lambda r: r[2])
    rows = [(i, c, at) for i, (_, c, at) in enumerate(rows)]
    df = spark.createDataFrame(rows, "request_id bigint, client bigint, ts timestamp")
    out = str(tmp_path / "out")
    parts = [df.filter(f"request_id BETWEEN {a} AND {a + 19}") for a in (0, 20, 40)]
    S.stream_rate_limit(files(*parts), out, str(tmp_path / "cp"), 3, 60.0, late)
    got = {r.request_id: (r.request_no, r.limited) for r in S.batch_folders(spark, f"{out}/rows", S.LIMITED).collect()}
    want = {r.request_id: (r.request_no, r.limited) for r in Q.rate_limit_audit(df, 3, 60.0).collect()}
    assert got == want


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_is_a_stream_whether_file_or_folder(spark, tmp_path, files):
    """tables written as folders of part files are read like single files."""
    from citadex.plans import report_queries

    rows = spark.range(30).withColumn("text", F.lit("t"))
    rows.repartition(files).write.parquet(str(tmp_path / "w"))
    if files == 1:
        next((tmp_path / "w").glob("part-*")).rename(tmp_path / "documents.parquet")
    else:
        (tmp_path / "w").rename(tmp_path / "documents.parquet")
    rows.write.parquet(str(tmp_path / "other.parquet"))
    got = collected(spark, report_queries._stream(spark, str(tmp_path), "documents"), tmp_path)
    assert got.count() == 30
