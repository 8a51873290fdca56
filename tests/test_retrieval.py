import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from citadex.functions.stem import porter
from citadex.functions.vectors import hashed_encoder
from citadex.operators import dense, fusion, lexical, segments

TEXTS = {
    "a": ("1", "current", "ledger audit of client account opening"),
    "b": ("1", "current", "ledger audit weekly summary elsewhere"),
    "c": ("2", "current", "another topic about reserve share"),
    "d": ("3", "withdrawn", "ledger ledger ledger"),
    "e": ("4", None, "summary ledger_reserve share share"),
}


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, m, f"ns:{m}", s, t) for i, (m, s, t) in TEXTS.items()]
    return spark.createDataFrame(rows, "chunk_id string, md_id string, document_id string, status string, text string")


def queries(spark, *rows, extra=""):
    return spark.createDataFrame(list(rows), "query_id string, text string" + extra)


def expected_scores(query):
    import re

    docs = {i: re.findall(r"[^\W_]+", t.lower()) for i, (_, _, t) in TEXTS.items()}
    avg = sum(map(len, docs.values())) / len(docs)
    out = {}
    for term in [p for t in re.findall(r"\w+", query)[:32] for p in re.findall(r"[^\W_]+", t.lower())]:
        n = sum(term in d for d in docs.values())
        if not n:
            continue
        idf = math.log((len(docs) - n + 0.5) / (n + 0.5))
        idf = idf if idf > 0 else 1e-6
        for i, d in docs.items():
            tf = d.count(term)
            if tf:
                out[i] = out.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
    return {i: round(-s, 6) for i, s in out.items()}


@pytest.mark.parametrize("small", [True, False])
def test_bm25(spark, chunks, small, monkeypatch):
    if not small:
        monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(lexical, "HOT_SHARE", 0.05)
    text = "Summary share, share: ledger!"
    got = lexical.bm25_topk(queries(spark, ("q", text), ("none", "?!"), ("miss", "zebra")), chunks, 10, include_withdrawn=True).collect()
    assert {r.chunk_id: r.bm25_score for r in got} == pytest.approx(expected_scores(text))
    assert {r.query_id for r in got} == {"q"}
    shown = lexical.bm25_topk(queries(spark, ("q", text)), chunks, 10).collect()
    assert {r.chunk_id for r in shown} == {"a", "b", "c", "e"}
    narrowed = lexical.bm25_topk(
        queries(spark, ("q", "ledger", "1"), ("all", "ledger", None), extra=", filter_md_id string"), chunks, 10
    ).collect()
    assert sorted((r.query_id, r.chunk_id) for r in narrowed) == [("all", "a"), ("all", "b"), ("all", "e"), ("q", "a"), ("q", "b")]


def test_query_terms(spark):
    many = " ".join(f"tok{i}" for i in range(100))
    q = queries(spark, ("long", many), ("ops", 'ledger AND "x" NOT text:y'), ("blank", " \t"), ("deva", "LEDGER नियम"))
    terms = lexical.query_terms(q).groupBy("query_id").agg(F.sum("qtf").alias("n"), F.collect_set("term").alias("t")).collect()
    by = {r.query_id: r for r in terms}
    assert by["long"].n == 32 and "blank" not in by
    assert {"ledger", "and", "not", "text", "x", "y"} == set(by["ops"].t)
    assert "ledger" in by["deva"].t and len(by["deva"].t) > 1


def test_saved_index_gives_same_ranking(spark, chunks, tmp_path):
    segments.create(lexical.build_index(chunks), str(tmp_path / "i"))
    q = queries(spark, ("q", "ledger share"))
    stored = lexical.bm25_topk(q, chunks, 5, index=segments.load(spark, str(tmp_path / "i")))
    assert sorted(stored.collect()) == sorted(lexical.bm25_topk(q, chunks, 5).collect())
    # The status of the moment counts, not that of the indexing.
    index = segments.load(spark, str(tmp_path / "i"))
    now = chunks.withColumn("status", F.when(F.col("chunk_id") == "a", "superseded").when(F.col("chunk_id") != "d", F.col("status")))
    assert {r.chunk_id for r in lexical.bm25_topk(q, now, 5, index=index).collect()} == {"b", "c", "d", "e"}
    gone = lexical.bm25_topk(q, chunks.where("chunk_id <> 'b'"), 5, index=index)
    assert "b" not in {r.chunk_id for r in gone.collect()}


def test_stemmed_search_meets_all_forms(spark, tmp_path):
    rows = [("1", "The banks failed"), ("2", "a bank"), ("3", "banking café"), ("4", "river")]
    texts = spark.createDataFrame([(i, t, i, None) for i, t in rows], "chunk_id string, text string, md_id string, status string")
    q = queries(spark, ("q", "BANKS cafe"))
    plain = lexical.bm25_topk(q, texts)
    assert {r.chunk_id for r in plain.collect()} == {"1"}
    index = lexical.build_index(texts, stem=True)
    for found in (lexical.bm25_topk(q, texts, stem=True), lexical.bm25_topk(q, texts, index=index)):
        assert {r.chunk_id for r in found.collect()} == {"1", "2", "3"}
    segments.create(index, str(tmp_path / "s"))
    assert segments.load(spark, str(tmp_path / "s")).stem
    with pytest.raises(ValueError):
        lexical.bm25_topk(q, texts, index=index, stem=False)


def test_folding_follows_the_unicode_tables(spark):
    from citadex.functions.text import fold_diacritics

    df = spark.createDataFrame([("Ạ ά й É e\u0301 ñ ß",)], "v string")
    assert df.select(fold_diacritics(F.col("v"))).first()[0] == "a α и e e n ß"


def test_search_in_the_row_equals_the_join(spark, monkeypatch):
    """Floored words, ties, filters and several batches a task: the k best are those of scoring every pair."""
    import random

    rng = random.Random(7)
    words = ["the", "of", "and"] + [f"w{i}" for i in range(25)]
    text = lambda: " ".join([w for w in words[:3] if rng.random() < 0.8] * rng.randrange(1, 4) + rng.choices(words[3:], k=rng.randrange(0, 5)))
    rows = [(f"c{i:03}", text() if i % 50 else None, f"m{i % 7}" if i % 11 else None, rng.choice(["current", "withdrawn", None])) for i in range(400)]
    corpus = spark.createDataFrame(rows, "chunk_id string, text string, md_id string, status string").repartition(3)
    asked = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 6))), rng.choice([None, None, "m1", "m2", "none"]), rng.choice([None, True, False])) for i in range(60)]
    asked += [(100, "the of", None, None), (101, "the", "m3", True), (102, "", None, None), (103, "unseen", None, None), (104, "the w1", None, False)]
    q = spark.createDataFrame(asked, "query_id long, text string, filter_md_id string, include_withdrawn boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        for k in (1, 5, 50):
            got = sorted(map(tuple, lexical.bm25_topk(q, corpus, k).collect()))
            assert got == sorted(map(tuple, lexical.bm25_topk(q, corpus, k, small=False).collect()))
            assert got == sorted(map(tuple, lexical.bm25_topk(q, corpus, k, index=lexical.build_index(corpus)).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def same_index(got, want):
    assert sorted(got.stats.collect()) == sorted(want.stats.collect())
    rows = lambda i: sorted(map(str, i.postings.select("chunk_id", "dl", "term", "tf").collect()))
    assert rows(got) == rows(want)


def written(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_refreshed_index_equals_a_new_one(spark, chunks, tmp_path):
    old = chunks.filter("chunk_id <> 'e'")
    new = chunks.filter("chunk_id <> 'a'").withColumn("text", F.when(F.col("chunk_id") == "b", "ledger only").otherwise(F.col("text")))
    fresh = lexical.build_index(new.filter("chunk_id IN ('b', 'e')"))
    gone = spark.createDataFrame([("a",), ("b",), ("never",), (None,)], "chunk_id string")
    segments.create(lexical.build_index(old), str(tmp_path))
    assert segments.refresh(spark, str(tmp_path), gone, fresh) == 2
    same_index(segments.load(spark, str(tmp_path)), lexical.build_index(new))


def test_refreshes_write_the_difference_only(spark, tmp_path):
    text = lambda i, v: " ".join(f"w{(i * 7 + k * k + v) % 50}" for k in range(20))
    table = lambda rows: spark.createDataFrame([(f"c{i}", text(i, v), "m", None) for i, v in rows.items()], "chunk_id string, text string, md_id string, status string")
    now = {i: 0 for i in range(400)}
    segments.create(lexical.build_index(table(now)), str(tmp_path), buckets=16)
    before = written(tmp_path)
    for v in range(1, 5):
        some = {i: v for i in range(3)}
        gone = spark.createDataFrame([(f"c{i}",) for i in [*some, 100 + v]], "chunk_id string")
        segments.refresh(spark, str(tmp_path), gone, lexical.build_index(table(some)), most=4)
        now = {i: some.get(i, x) for i, x in now.items() if i != 100 + v}
        after = written(tmp_path)
        assert before.items() <= after.items()  # nothing is rewritten in place
        new = [f for f in after.keys() - before.keys() if f.startswith("postings")]
        dirty = {f.split("bucket=")[1].split("/")[0] for f in new}
        assert 0 < len(dirty) <= 3
        rows = sum(spark.read.parquet(str(tmp_path / f)).count() for f in new)
        assert rows <= 60 if v < 4 else rows > 60  # the last one merges the crowded buckets
        same_index(segments.load(spark, str(tmp_path)), lexical.build_index(table(now)))
        before = after
    assert segments._state(spark, str(tmp_path)).lines[-1].kind == "merge"
    stale = segments._state(spark, str(tmp_path))
    with pytest.raises(segments.RefreshRefused):
        segments._commit(spark, str(tmp_path), {"version": stale.version, "segment": "x", "kind": "refresh"})


def test_stemming(spark):
    pairs = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
        "motoring": "motor", "sing": "sing", "conflated": "conflat", "sized": "size", "hopping": "hop", "falling": "fall",
        "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
        "vietnamization": "vietnam", "operator": "oper", "hopefulness": "hope", "electrical": "electr", "revival": "reviv",
        "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas",
        "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil",
    }
    assert {w: porter(w) for w in pairs} == pairs
    chunk = spark.createDataFrame([("x", "Verifying verified Vérification")], "chunk_id string, text string")
    rows = lexical.build_index(chunk, stem=True).postings.collect()
    assert {(r.term, r.tf) for r in rows} == {("verifi", 2), ("verif", 1)}


def test_best_of_all_rows_at_once():
    from citadex.functions.vectors import best_k

    rng = np.random.default_rng(2)
    for n in (0, 3, 40, 200):
        d, ids = np.round(rng.random((7, n)), 1), np.array([f"c{i}" for i in rng.permutation(n)])
        row, column = best_k(d, ids, 4)
        want = [(r, c) for r in range(7) for c in sorted(range(n), key=lambda c: (d[r, c], ids[c]))[:4]]
        assert list(zip(row.tolist(), column.tolist())) == want


def test_grid_of_groups_and_shards_hands_on_k_rows_a_meeting(spark):
    from citadex.operators.dense import _knn_blocks

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.standard_normal(3), 1)]) for i in range(600)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").selectExpr("*", "cast(null AS string) md_id", "true is_current")
    asked = spark.createDataFrame(rows[:300], "query_id long, embedding array<double>").selectExpr("*", "cast(null AS string) wanted", "true any")
    found = _knn_blocks(vectors, asked, 3, 64)
    assert found.count() <= 300 * 2 * 3  # five groups, two shards each at four shuffle partitions
    got = {r.query_id: r.ids for r in lexical.top_k(found, 3, F.col("vec_distance"), F.col("chunk_id")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("ids")).collect()}
    x = np.array([v for _, v in rows])
    for q in range(300):
        d = np.round(np.sqrt(((x - x[q]) ** 2).sum(1)), 6)
        assert [r.chunk_id for r in got[q]] == sorted(range(600), key=lambda i: (d[i], i))[:3]


@pytest.fixture(scope="module")
def vec_tables(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(120, 8))
    rows[7] = rows[3]
    data = [(f"v{i:03d}", r.tolist(), str(i % 3), "withdrawn" if i % 4 == 0 else None) for i, r in enumerate(rows)]
    vectors = spark.createDataFrame(data, "chunk_id string, embedding array<float>, md_id string, status string").repartition(5)
    asked = [(f"q{i}", rows[i].tolist(), None if i % 2 else str(i % 3), bool(i % 5 == 0)) for i in range(9)]
    q = spark.createDataFrame(asked, "query_id string, embedding array<float>, filter_md_id string, include_withdrawn boolean")
    return data, asked, vectors, q


def brute(data, asked, k):
    out = []
    for q, vec, wanted, any_status in asked:
        d = [
            (round(float(np.linalg.norm(np.float32(vec).astype(float) - np.float32(v).astype(float))), 6), i)
            for i, v, m, s in data
            if (wanted is None or m == wanted) and (any_status or s is None)
        ]
        out += [(q, i, dist, n) for n, (dist, i) in enumerate(sorted(d)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("held", [100, 2])
def test_knn_is_exact(vec_tables, held):
    data, asked, vectors, q = vec_tables
    got = dense.knn_topk(vectors, q, 6, query_rows=held).collect()
    assert sorted((r.query_id, r.chunk_id, r.vec_distance, r["rank"]) for r in got) == brute(data, asked, 6)


def test_overfetch_can_fall_short(spark):
    rows = [(f"w{i}", [0.9, 0.002 * i], "1", "withdrawn") for i in range(30)] + [("keep", [0.3, 0.7], "2", "current")]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, md_id string, status string")
    q = spark.createDataFrame([("q", [0.9, 0.0])], "query_id string, embedding array<float>")
    assert [r.chunk_id for r in dense.knn_topk(vectors, q, 3, include_withdrawn=False).collect()] == ["keep"]
    assert dense.knn_overfetch(vectors, q, 3).count() == 0
    assert [r.chunk_id for r in dense.knn_overfetch(vectors, q, 3, factor=11).collect()] == ["keep"]


def test_failing_encoder_leaves_texts_for_later(spark):
    """A failure that passes is tried again, a lasting one costs the vectors of its batch only; NULL queries are blank."""
    docs = spark.createDataFrame([("a", "good words"), ("b", "poison"), ("c", "more words")], "chunk_id string, text string").coalesce(1)
    plain, calls = hashed_encoder(16), []

    def flaky(texts):
        calls.append(1)
        if "poison" in texts or len(calls) == 1:
            raise ConnectionError("gone")
        return plain(texts)

    assert {r.chunk_id for r in dense.embed(docs, flaky, 16, batch_size=1).collect()} == {"a", "c"}
    asked = spark.createDataFrame([("q", None), ("r", "words")], "query_id string, text string")
    vec = {r.query_id: r.embedding for r in dense.embed_queries(asked, plain, 16).collect()}
    assert set(vec) == {"q", "r"} and not any(vec["q"])


def test_embedding(spark):
    docs = spark.createDataFrame([("a", "tax tax rule"), ("b", "  "), ("c", "Rule, TAX tax")], "chunk_id string, text string")
    got = {r.chunk_id: r.embedding for r in dense.embed(docs, hashed_encoder(16), 16).collect()}
    assert got["a"] == got["c"] and sum(x * x for x in got["a"]) == pytest.approx(1.0) and not any(got["b"])
    with pytest.raises(Exception, match="expected 8"):
        dense.embed(docs, hashed_encoder(16), 8).collect()

    def picky(texts):
        if sum(map(len, texts)) > 12:
            raise dense.InputTooLong
        return hashed_encoder(16)(texts)

    kept = dense.embed(docs, picky, 16)
    assert {r.chunk_id for r in kept.collect()} == {"a", "b"}
    late = dense.embed_missing(docs, kept, hashed_encoder(16), 16).collect()
    assert [r.chunk_id for r in late] == ["c"]
    asked = spark.createDataFrame([("1", "same"), ("2", "same"), ("3", "other")], "query_id string, text string")
    vec = {r.query_id: r.embedding for r in dense.embed_queries(asked, hashed_encoder(16), 16).collect()}
    assert vec["1"] == vec["2"] != vec["3"]


def test_fusion(spark):
    s = spark.createDataFrame([("q", "a", -9.0, 1), ("q", "b", -8.0, 2), ("only", "a", -1.0, 1)], "query_id string, chunk_id string, bm25_score double, rank int")
    d = spark.createDataFrame([("q", "c", 0.1, 1), ("q", "a", 0.2, 2), ("q", "d", 0.3, 3)], "query_id string, chunk_id string, vec_distance double, rank int")
    rows = fusion.rrf_fuse(s, d).orderBy("query_id", "rank").collect()
    q = [r for r in rows if r.query_id == "q"]
    assert [r.chunk_id for r in q] == ["a", "c", "b", "d"]
    assert q[0].fusion_score == pytest.approx(1 / 61 + 1 / 62) and q[0].bm25_score == -9.0 and q[0].vec_distance == 0.2
    one = [r for r in rows if r.query_id == "only"]
    assert one[0].fusion_score is None and one[0].sparse_rank == 1 and one[0].dense_rank is None
    tie = fusion.rrf_fuse(
        spark.createDataFrame([("q", "s", -1.0, 1)], s.schema), spark.createDataFrame([("q", "d", 0.1, 1)], d.schema)
    ).orderBy("rank").collect()
    assert [r.chunk_id for r in tie] == ["s", "d"]


def test_compliance_and_search(spark, chunks):
    registry = spark.createDataFrame(
        [(f"ns:{m}", m, f"T{m}", f"u/{m}", s) for m, s in (("1", "current"), ("2", "current"), ("3", "withdrawn"))],
        "document_id string, md_id string, title string, detail_url string, status string",
    ).withColumn("last_updated_at", F.lit(None).cast("date"))
    enc = hashed_encoder(32)
    vectors = dense.embed(chunks, enc, 32).join(chunks.select("chunk_id", "md_id", "status"), "chunk_id")
    asked = spark.createDataFrame(
        [("hit", "client account opening", None), ("topic", "ledger share", "PA"), ("blank", "  ", None), ("punct", "?!", None), ("amb", "ledger share", "kyc"), ("sparse", "zebra", None)],
        "query_id string, text string, topic_hint string",
    )
    q_vec = dense.embed_queries(asked.filter("query_id <> 'sparse'"), enc, 32, "")
    aliases = spark.createDataFrame([("pa", "2"), ("kyc", None)], "alias string, md_id string")
    rows = fusion.check_compliance(asked, chunks, registry, vectors, q_vec, aliases).orderBy("query_id", "rank").collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {"hit", "topic", "blank", "punct", "amb", "sparse"}
    assert by["hit"][0].chunk_id == "a" and by["hit"][0].retrieval == "hybrid" and not by["hit"][0].low_confidence
    assert by["hit"][0].document_title == "T1" and by["hit"][0].quoted_text == TEXTS["a"][2]
    assert {r.document_id for r in by["topic"]} == {"ns:2"}
    assert len({r.document_id for r in by["amb"]}) > 1
    assert by["blank"][0].message == "empty_input" and by["blank"][0].low_confidence and by["blank"][0].retrieval is None
    assert by["punct"][0].message == "no_searchable_tokens"
    assert by["sparse"][0].message == "no_provisions_matched" and by["sparse"][0].retrieval == "sparse_only"
    assert all(r.status == "current" for r in rows if r.chunk_id)
    finds = spark.createDataFrame(
        [("w", "ledger", None, True, "bank", None), ("n", "ledger", "pa", False, None, "2024-01-01")],
        "query_id string, text string, topic string, include_withdrawn boolean, regulated_entity string, as_of_date string",
    )
    found = fusion.search(finds, chunks, registry, vectors, dense.embed_queries(finds, enc, 32, ""), aliases).collect()
    w = [r for r in found if r.query_id == "w"]
    assert "d" in {r.chunk_id for r in w} and w[0].filter_warning == "regulated_entity"
    n = [r for r in found if r.query_id == "n"]
    assert {r.document_id for r in n} == {"ns:2"} and n[0].filter_warning == "as_of_date"


def test_limits(spark):
    df = spark.createDataFrame([("0",), ("99",), ("x",), (None,), ("7",), ("-3",)], "v string")
    assert [r[0] for r in df.select(fusion.clamp_limit(F.col("v"))).collect()] == [1, 50, 5, 5, 7, 1]
    ok, bad = fusion.split_oversized(spark.createDataFrame([("a" * 10,), ("a" * 11,)], "text string"), 10)
    assert ok.count() == 1 and [(r.reason, r.length) for r in bad.collect()] == [("input_too_large", 11)]


def test_many_queries_and_rows_meet_in_tiles():
    """the memory of a task holds no matrix of all queries and all rows of a batch; a missing number does not cost a hit."""
    import tracemalloc

    rng = np.random.default_rng(7)
    rows, asked = rng.standard_normal((10_000, 16)), rng.standard_normal((4096, 16))
    rows[5] = np.nan
    best = dense._Best(np.arange(4096), asked, [(None, True)] * 4096, 5)
    tracemalloc.start()
    best.add(np.arange(10_000), rows, np.full(10_000, None), np.ones(10_000, bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    d = np.round(np.sqrt(((rows - asked[77]) ** 2).sum(1)), 6)
    assert best.ids[77].tolist() == np.lexsort((np.arange(10_000), d))[:5].tolist()
    few = dense._Best(np.arange(1), asked[:1], [(None, True)], 3)
    few.add(np.arange(2), rows[4:6], np.full(2, None), np.ones(2, bool))
    assert few.ids[0, : few.count[0]].tolist() == [0, 1]


def test_vectors_travel_once_a_group_of_queries(spark):
    """with all queries in one group, the shuffle holds each vector once."""
    rows = spark.range(20_000).select(F.col("id").alias("chunk_id"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.rand(3) + i * 0).alias("embedding"))
    asked = rows.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")

    def written():
        store = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(store.apply(i).totalShuffleWrite() for i in range(store.size()))

    before = written()
    assert dense.knn_topk(rows, asked, 3, query_rows=0).count() == 1200
    assert written() - before < 20_000 * 16 * 8 * 3


def test_texts_are_read_once_and_chunks_without_terms_leave(spark, tmp_path):
    """no token is shuffled to count it; an empty chunk that leaves is no longer counted."""
    chunks = spark.createDataFrame([("a", "x y x"), ("b", "y é"), ("c", ""), ("d", None)], "chunk_id string, text string")
    index = lexical.build_index(chunks)
    assert sorted(map(tuple, index.postings.collect())) == [("a", 3, "x", 2), ("a", 3, "y", 1), ("b", 2, "y", 1), ("b", 2, "é", 1)]
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
    assert {r.term: r.df for r in index.stats.collect()} == {"x": 1, "y": 2, "é": 1, lexical.EVERY: 4, lexical.LENGTH: 5}
    segments.create(index, str(tmp_path))
    gone = spark.createDataFrame([("a",), ("c",), ("d",)], "chunk_id string")
    segments.refresh(spark, str(tmp_path), gone, lexical.build_index(chunks.limit(0)))
    got = segments.load(spark, str(tmp_path))
    assert {r.term: r.df for r in got.stats.collect()} == {"y": 1, "é": 1, lexical.EVERY: 1, lexical.LENGTH: 2}
    assert got.postings.count() == 2 and not list((tmp_path / "draft").glob("segment*"))


def test_only_distinct_tokens_of_a_batch_become_strings(monkeypatch):
    """A batch of lists with few words asks for few stems, however long the lists are; nulls and empty lists stay."""
    import pyarrow as pa

    from citadex.functions import stem

    asked = []
    monkeypatch.setattr(stem, "_remembered", lambda word: asked.append(word) or stem.porter(word))
    lists = [["running", "houses"] * 500, None, [], ["running", None], ["houses"]]
    got = stem.porter_lists(pa.array([["x"], *lists], pa.list_(pa.string())).slice(1)).to_pylist()
    assert got == [["run", "hous"] * 500, None, [], ["run", None], ["hous"]]
    assert sorted(asked) == ["houses", "running"]


@pytest.mark.parametrize("name", ["knn_blocked", "knn_topk", "knn_filtered"])
def test_every_vector_searches(spark, sf, name):
    """F5 to F7: each vector of the table is a query, as in the SQL."""
    import duckdb

    from citadex import plans
    from citadex.plans.bindings import ORACLES

    found, con = plans.load()[name](spark, sf), duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(f"SELECT query_id, chunk_id, vec_distance, rank FROM ({ORACLES[name]})").fetchall()
    got = found.select("query_id", "chunk_id", "vec_distance", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert len({r.query_id for r in got}) == con.execute("SELECT count(*) FROM embeddings").fetchone()[0]


def test_close_vectors_are_measured_by_differences():
    """far from the origin, a product cancels out the distance of neighbours; equal vectors, however many, are ordered by id."""
    rng = np.random.default_rng(5)
    rows = 1e4 + rng.standard_normal((3000, 8)) * 1e-3
    rows[100:2500] = rows[7]
    best = dense._Best(np.arange(3000), rows, [(None, True)] * 3000, 5)
    for at in range(0, 3000, 1000):
        best.add(np.arange(at, at + 1000), rows[at : at + 1000], np.full(1000, None), np.ones(1000, bool))
    for i in (7, 50, 2700):
        d = np.round(np.sqrt(((rows - rows[i]) ** 2).sum(1)), 6)
        order = np.lexsort((np.arange(3000), d))[:5]
        assert best.ids[i].tolist() == order.tolist() and best.distance[i].tolist() == d[order].tolist()
