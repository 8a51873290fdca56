import datetime as dt

import pytest
from pyspark.sql import functions as F

from citadex.operators import maintain as M
from citadex.operators import quality as Q
from citadex.schema import DOCUMENTS
from citadex.sources import dumps, snapshots, tables

T0, T1 = dt.datetime(2025, 1, 1), dt.datetime(2025, 6, 1)


def docs(spark, *rows):
    """(md_id, title, urls, status, seen)"""
    full = [
        (f"ns:md:{i}", i, t, f"u/{i}", None, None, None, "dep", "md", list(u), s, T0, seen, "0") for i, t, u, s, seen in rows
    ]
    return spark.createDataFrame(full, DOCUMENTS)


def test_diff(spark):
    prev = docs(spark, ("A", "Old", [], "current", T0), ("B", "Same", ["x", "y"], "current", T0), ("C", "Gone", [], "current", T0))
    curr = docs(spark, ("A", "New", [], "current", T1), ("B", "Same", ["y", "x"], "current", T1), ("D", "Added", [], "current", T1))
    assert {(r.md_id, r.change) for r in M.snapshot_diff(prev, curr).collect()} == {("A", "changed"), ("C", "removed"), ("D", "added")}
    assert M.snapshot_diff(prev, prev).count() == 0
    twice = curr.withColumn("pos", F.lit(1)).unionByName(curr.withColumn("title", F.lit("last")).withColumn("pos", F.lit(2)))
    assert M.snapshot_diff(curr, twice, order="pos").count() == 3


@pytest.mark.parametrize("listed,retired", [(["1", "2", "3", "4", "6"], {"5"}), (["1", "2"], set())])
def test_guard(spark, listed, retired):
    prev = docs(spark, *[(str(i), "T", [], "current", T0) for i in range(1, 6)])
    curr = docs(spark, *[(i, "T", [], "current", T1) for i in listed])
    merged = M.upsert_listing(prev, curr)
    out = M.guarded_supersede(merged, prev, curr, F.lit(T1)).collect()
    assert {r.md_id for r in out if r.status == "superseded"} == retired
    counts = M.refresh_counts(prev, curr, M.snapshot_diff(prev, curr)).first()
    assert (counts.seen, counts.removed) == (len(listed), len(retired))
    row = M.audit_run(M.refresh_counts(prev, curr, M.snapshot_diff(prev, curr)), "md", "u", F.lit(T0), F.lit(T1)).first()
    assert row.items_seen == len(listed) and row.error is None


def test_guard_keeps_other_statuses(spark):
    prev = docs(spark, ("1", "T", [], "withdrawn", T0), *[(str(i), "T", [], "current", T0) for i in range(2, 8)])
    curr = docs(spark, *[(str(i), "T", [], "current", T1) for i in range(2, 8)])
    out = {r.md_id: r for r in M.guarded_supersede(prev, prev, curr, F.lit(T1)).collect()}
    assert out["1"].status == "withdrawn" and out["1"].last_seen_at == T0


def test_upsert_twice_is_once(spark):
    stored = docs(spark, ("A", "Old", ["x"], "current", T0))
    new = docs(spark, ("A", "New", [], "current", T1), ("B", "B", [], "current", T1)).withColumn("department", F.lit(None).cast("string"))
    once = M.upsert_listing(stored, new)
    rows = {r.md_id: r for r in once.collect()}
    assert rows["A"].title == "New" and rows["A"].department == "dep" and rows["A"].first_seen_at == T0 and rows["A"].pdf_urls == []
    assert rows["B"].department is None
    assert sorted(map(str, M.upsert_listing(once, new).collect())) == sorted(map(str, once.collect()))
    family = new.withColumn("document_family", F.lit("press"))
    assert M.upsert_listing(once, family).count() == 4  # the same id in another family is another document


def test_titles(spark):
    rows = [("Good title", "x", "Good title"), ("12 March 2020", "Old one", "Old one"), ("Subject", "1/2/2020", "Subject"), ("", None, "Master Direction R/1"), (None, "", "Master Direction R/1")]
    df = spark.createDataFrame([(n, o) for n, o, _ in rows], "n string, o string")
    got = df.select(M.choose_title(F.col("n"), F.col("o"), F.lit("master_direction"), F.lit("R/1"), F.lit("9"))).collect()
    assert [r[0] for r in got] == [w for _, _, w in rows]
    indexed = docs(spark, ("A", "5 May 2020", [], "current", T1))
    kept = M.upsert_indexed(docs(spark, ("A", "Proper", [], "current", T0)), indexed).first()
    assert kept.title == "Proper" and kept.raw_list_sha256 == "0"


WD = "original_ref string, original_id string, title string, issued_date date, withdrawn_date date, replacement_ref string, detail_url string, first_seen_at timestamp, last_seen_at timestamp"


def test_withdrawn_tiers(spark):
    d = dt.date(2020, 1, 1)
    stored = spark.createDataFrame(
        [("R1", "1", "T1", d, None, None, "u", T0, T0), ("R2", None, "T2", None, d, None, None, T0, T0), (None, None, "T3", None, d, None, None, T0, T0)], WD
    )
    batch = spark.createDataFrame(
        [
            (1, None, "1", "T1 new", None, d, None, None, T1, T1), (2, "R2", None, "T2", d, None, None, None, T1, T1),
            (3, None, None, "T3", d, None, None, None, T1, T1), (4, "R1", None, "T1", None, None, "N", None, T1, T1),
            (5, "R2", None, "other", None, d, None, None, T1, T1), (6, None, "9", "T9", d, None, None, None, T1, T1), (7, None, "9", "T9 later", None, d, None, None, T1, T1),
        ],
        "pos int, " + WD,
    )
    out = M.upsert_withdrawn(stored, batch).collect()
    by = {(r.original_id, r.original_ref, r.title): r for r in out}
    assert len(out) == 5
    assert by[("1", "R1", "T1")].replacement_ref == "N" and by[("1", "R1", "T1")].withdrawn_date == d
    assert by[(None, "R2", "T2")].issued_date == d and by[(None, "R2", "other")].first_seen_at == T1
    assert by[("9", None, "T9 later")].issued_date == d and by[("9", None, "T9 later")].withdrawn_date == d
    again = M.upsert_withdrawn(M.upsert_withdrawn(stored, batch), batch)
    assert again.count() == 5


def test_hash_skip(spark):
    body = spark.createDataFrame([("a", "same"), ("b", "changed"), ("c", "page only"), ("d", "same"), ("e", "same")], "document_id string, text string")
    sha = F.sha2(F.lit("same"), 256)
    art = spark.createDataFrame([("a", T0), ("a", T1), ("b", T0), ("d", T0), ("e", T0)], "document_id string, fetched_at timestamp")
    art = art.withColumn("text_sha256", F.when(F.col("fetched_at") == T1, sha).when(F.col("document_id") == "a", "old").otherwise(sha))
    chunk = spark.createDataFrame([("a1", "a"), ("b1", "b"), ("c1", "c"), ("d1", "d"), ("d2", "d")], "chunk_id string, document_id string")
    vec = spark.createDataFrame([("a1",), ("b1",), ("d1",)], "chunk_id string")
    skip = lambda *x, **o: {r.document_id for r in M.content_hash_skip(body, art, chunk, *x, **o).collect() if r.skip}
    assert skip(vec) == {"a"} and skip(None) == {"a", "d"} and skip(vec, force=True) == set()


def test_selection(spark):
    reg = docs(spark, *[(i, "T", [], "current", T0) for i in "1234"]).withColumn(
        "last_updated_at", F.when(F.col("md_id") == "2", F.lit("2025-03-01").cast("date")).when(F.col("md_id") == "3", F.lit("2025-01-01").cast("date"))
    )
    art = spark.createDataFrame([("ns:md:1", T0, True), ("ns:md:2", T0, True), ("ns:md:3", T0, True), ("ns:md:4", T0, False)], "document_id string, fetched_at timestamp, is_indexed boolean")
    assert {r.md_id for r in M.stale_selection(reg, art, ["md"]).collect()} == {"2", "4"}
    fresh = M.fresh_ids(reg, art, ["md"])
    assert [(r.md_id, r.skip) for r in M.select_targets(reg, "md", fresh, limit=2).orderBy("md_id").collect()] == [("1", True), ("2", False)]
    assert not any(r.skip for r in M.select_targets(reg, "md", fresh, force=True).collect())
    assert [r.md_id for r in M.select_targets(reg, "md", only="3").collect()] == ["3"]
    listed = spark.createDataFrame([("4",), ("5",)], "md_id string")
    assert [r.md_id for r in M.existing_skip(listed, reg, "md").collect()] == ["5"]


def test_replace_chunks(spark):
    old = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "document_id string, chunk_id string")
    new = spark.createDataFrame([("a", "9")], old.schema)
    once = M.replace_by_document(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", "9"), ("b", "3")]
    assert sorted(map(tuple, M.replace_by_document(once, new).collect())) == [("a", "9"), ("b", "3")]
    assert M.replace_by_document(old, new.limit(0)).count() == 3


def test_bookkeeping(spark):
    runs = spark.createDataFrame([("f", "1", "failed"), ("f", "2", "success"), ("f", "3", "failed"), ("g", "1", "skipped")], "document_family string, md_id string, outcome string")
    retry = spark.createDataFrame([("f", "1", "success"), ("f", "3", "failed")], runs.schema)
    got = {r.document_family: (r.success, r.skipped, r.failed, r.total) for r in M.run_summary(runs, retry).collect()}
    assert got == {"f": (2, 0, 1, 3), "g": (0, 1, 0, 1)}
    meta = spark.createDataFrame([("schema_version", "3", T0), ("k", "old", T0)], "key string, value string, updated_at timestamp")
    new = spark.createDataFrame([("schema_version", "4", T1), ("k", "new", T1), ("n", "x", T1)], meta.schema)
    assert {r.key: r.value for r in M.meta_upsert(meta, new, ("schema_version",)).collect()} == {"schema_version": "3", "k": "new", "n": "x"}
    verdict = lambda *e: M.refresh_verdict(spark.createDataFrame([(x,) for x in e], "error string")).first()[0]
    assert (verdict(None, None), verdict("x", "y"), verdict(None, "y")) == (0, 1, 2)


def test_publish(spark, tmp_path):
    root = str(tmp_path / "corpus")
    one, two = spark.range(3), spark.range(5)
    ok, bad = spark.createDataFrame([(True,)], "gate_passed boolean"), spark.createDataFrame([(False,)], "gate_passed boolean")
    assert snapshots.current_snapshot(spark, root) is None
    snapshots.publish_snapshot(spark, root, "a", {"t": one}, gate=ok)
    with pytest.raises(snapshots.PublishRefused):
        snapshots.publish_snapshot(spark, root, "b", {"t": two}, gate=bad)
    tables.write_table(two, f"{root}/snapshot=c/t")  # written but never committed
    assert snapshots.read_snapshot(spark, root, "t").count() == 3
    snapshots.publish_snapshot(spark, root, "d", {"t": two}, gate=ok)
    assert snapshots.read_snapshot(spark, root, "t").count() == 5 and snapshots.read_snapshot(spark, root, "t", "a").count() == 3
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        snapshots.publish_snapshot(spark, root, "d", {"t": one}, gate=ok)


def test_sources(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"one\n\x0ctwo\x0c")
    text = tables.paged_text_source(spark, str(tmp_path / "x.txt"))
    assert [(r.page, r.page_text) for r in tables.text_pages(text, "path").collect()] == [(1, "one\n"), (2, "two"), (3, "")]
    line = '{"case_name":"c","passed":true,"retrieval_mode":"hybrid","top_provisions":[{"document_id":"d","paragraph_anchor":"1"}]}'
    dumps.write_dump(spark.createDataFrame([("c", line)], "case_name string, line string"), str(tmp_path / "dump"))
    row = dumps.load_dump(spark, str(tmp_path / "dump"), "A").first()
    assert (row.run, row.case_name, row.passed, list(row["keys"])) == ("A", "c", True, ["d::1"])
    root = tmp_path / "corpus"
    from citadex.schema import TABLES

    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(root / name))
    loaded = tables.load_corpus(spark, str(root), views=True)
    assert [f.name for f in loaded["documents"].schema] == [f.name for f in DOCUMENTS] and spark.sql("SELECT count(*) FROM chunks").first()[0] == 0


def test_quality(spark):
    reg = docs(spark, ("1", "T", [], "current", T0), ("1", "T", [], "odd", T0))
    assert {(r.violation, r.key, r.n) for r in Q.key_violations(reg, ("md",)).collect()} == {("duplicate_key", "md/1", 2), ("unknown_status", "odd", 1)}
    chunk = spark.createDataFrame([("c1", "ns:md:1"), ("c2", "x"), ("c3", "x")], "chunk_id string, document_id string")
    assert tuple(Q.orphan_chunks(chunk, reg).first()) == (2, "c2,c3")
    health = lambda d, v: Q.corpus_health(d, chunk, v).first().status
    assert (health(reg, chunk), health(reg, None), health(reg.limit(0), None)) == ("ok", "degraded", "unhealthy")
    meta = lambda *kv: spark.createDataFrame(list(kv), "key string, value string")
    check = lambda *kv: tuple(Q.compatibility_check(meta(*kv), "3", 768).select("schema_check", "dim_check", "accepted").first())
    assert check(("schema_version", "3"), ("embedding_dim", "768")) == ("ok", "ok", True)
    assert check(("embedding_dim", "768")) == ("missing", "ok", False)
    assert check(("schema_version", "3"), ("embedding_dim", "384")) == ("ok", "mismatch", False)
    assert check(("schema_version", "3"), ("embedding_dim", "many")) == ("ok", "warn", True)
    n = spark.createDataFrame([(0,), (49,), (50,), (200,), (499,), (500,), (1999,), (2000,), (10000,)], "n int")
    assert [r[0] for r in n.select(Q.length_bucket(F.col("n"))).collect()] == ["0-500"] * 5 + ["500-2000"] * 2 + ["2000-10000", "10000+"]
    assert [r[0] for r in n.select(Q.length_bucket(F.col("n"), small=True)).collect()] == ["0-50", "0-50", "50-200", "200-500", "200-500"] + ["500+"] * 4


def test_publishers_at_once_draw_different_numbers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "corpus")
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda i: snapshots._commit(spark, root, f"build{i}"), range(8)))
    assert sorted(numbers) == list(range(1, 9))
    listed = {r.seq: r.snapshot for r in snapshots._manifest(spark, root).collect()}
    assert listed == {n: f"build{i}" for i, n in enumerate(numbers)} and snapshots.current_snapshot(spark, root) == listed[8]


def test_a_taken_name_is_left_alone(spark, tmp_path):
    from citadex.sources.claims import claim, entries

    assert claim(spark, str(tmp_path / "log" / "1.json"), {"n": 1}) and not claim(spark, str(tmp_path / "log" / "1.json"), {"n": 2})
    assert [r.n for r in entries(spark, str(tmp_path / "log"), "n int").collect()] == [1]
    assert [p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")] == ["1.json"]


def test_replacing_documents_leaves_other_buckets_alone(spark, tmp_path):
    folder = tmp_path / "chunks"
    rows = [(f"d{i % 60}", f"c{i}", i) for i in range(600)] + [(None, "c-none", 1)]
    M.write_by_document(spark.createDataFrame(rows, "document_id string, chunk_id string, n int"), str(folder), buckets=16)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    before = files()
    fresh = spark.createDataFrame([("d1", "new", 0), ("d2", "new", 0), ("d99", "new", 0)], "document_id string, chunk_id string, n int")
    dirty = M.replace_stored(spark, str(folder), fresh, buckets=16)
    after = files()
    assert 0 < len(dirty) <= 3
    kept = lambda f: {k: v for k, v in f.items() if not any(f"bucket={b}/" in k for b in dirty)}
    assert kept(before) == kept(after) and len(kept(after)) > 8
    got = sorted(map(str, spark.read.parquet(str(folder)).select("document_id", "chunk_id", "n").collect()))
    want = M.replace_by_document(spark.createDataFrame(rows, "document_id string, chunk_id string, n int"), fresh)
    assert got == sorted(map(str, want.collect()))
    assert M.replace_stored(spark, str(folder), fresh.limit(0), buckets=16) == [] and files() == after
