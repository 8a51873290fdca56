"""One key holds a third of the rows: results stay whole and no row multiplies."""

import datetime as dt

from pyspark.sql import functions as F

from citadex.operators import lexical, status
from citadex.operators import maintain as M
from citadex.operators import records as R
from citadex.schema import DOCUMENTS, WITHDRAWN

T0, T1 = dt.datetime(2025, 1, 1), dt.datetime(2025, 6, 1)


def rows(spark, n, hot_share=3):
    """n rows, every third of them with the same key."""
    return spark.range(n).withColumn("key", F.when(F.col("id") % hot_share == 0, F.lit("hot")).otherwise(F.col("id").cast("string")))


def test_listing_with_a_hot_key(spark):
    listing = rows(spark, 3000).select(
        F.col("id").alias("pos"), F.col("key").alias("md_id"), F.lit("md").alias("document_family"), F.concat(F.lit("t"), "id").alias("title"),
        F.lit("u").alias("detail_url"), F.array().cast("array<string>").alias("pdf_urls"), F.lit("current").alias("status"), F.lit(T1).alias("last_seen_at"),
        F.lit(T1).alias("first_seen_at"), F.concat(F.lit("ns:md:"), "key").alias("document_id"),
    )
    stored = spark.createDataFrame([("ns:md:hot", "hot", "old", "u", None, None, None, None, "md", [], "current", T0, T0, None)], DOCUMENTS)
    out = M.upsert_listing(stored, listing, order="pos")
    assert out.count() == 2001
    hot = out.filter("md_id = 'hot'").first()
    assert hot.title == "t2997" and hot.first_seen_at == T0 and hot.last_seen_at == T1


def test_first_row_of_a_hot_id(spark):
    first = R.first_by_id(rows(spark, 3000), "key", ("id",), F.col("id") > 5)
    assert first.count() == 1996 + 1 and first.filter("key = 'hot'").first().id == 6


def test_hot_and_missing_ids_in_status_lookup(spark):
    site = "https://www.rbi.org.in/Scripts/"
    asked = rows(spark, 3000).select(
        F.col("id").alias("input_id"),
        F.when(F.col("key") == "hot", f"{site}BS_ViewMasDirections.aspx?id=1").when(F.col("id") % 3 == 1, "no id here").otherwise(
            F.concat(F.lit(f"{site}NotificationUser.aspx?Id="), "id")
        ).alias("reference"),
    )
    registry = spark.createDataFrame([("d", "1", "T", "u", None, None, None, None, "master_direction", [], "current", T0, T0, None)], DOCUMENTS)
    out = status.check_current(asked, registry, spark.createDataFrame([], WITHDRAWN), F.lit("x"))
    assert {r["status"]: r["count"] for r in out.groupBy("status").count().collect()} == {"current": 1000, "not_withdrawn": 1000, status.UNSUPPORTED: 1000}


def test_hot_term_and_copies(spark, monkeypatch):
    """A word in every chunk and a third of all chunks alike: both join forms give the same whole answer."""
    chunks = rows(spark, 900).select(
        F.col("id").cast("string").alias("chunk_id"), F.col("id").cast("string").alias("md_id"), F.lit(None).cast("string").alias("status"),
        F.concat(F.lit("the rule about "), F.when(F.col("key") == "hot", "copies of one text").otherwise(F.concat(F.lit("topic"), "id"))).alias("text"),
    )
    asked = spark.createDataFrame([("a", "the copies"), ("b", "the topic7"), ("c", "rule")], "query_id string, text string")
    small = lexical.bm25_topk(asked, chunks, 400).collect()
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lexical, "HOT_SHARE", 0.01)
    large = lexical.bm25_topk(asked, chunks, 400).collect()
    assert sorted(small) == sorted(large) and len(small) == 1200
    best = [r for r in small if r.query_id == "a"]
    assert len({r.bm25_score for r in best if r["rank"] <= 300}) == 1 and {r.chunk_id for r in best if r["rank"] <= 300} == {str(i) for i in range(0, 900, 3)}


def test_rate_limit_of_one_client_without_a_pause(spark):
    """A client with over a third of all rows, never pausing, with bursts and ties; others pause. No Python in the plan."""
    import random

    from citadex.operators import quality as Q

    rng = random.Random(2)
    rows, at = [], 0
    for i in range(3000):
        at += rng.choice((0, 1, 400_000, 2_000_000, 9_000_000))
        rows.append((i, 7, at))
    rows += [(3000 + i, rng.choice((1, 2, None)), rng.randrange(0, 10**10)) for i in range(3000)]
    rows += [(6000 + i, 9, 5_000_000 + i % 3) for i in range(500)] + [(9000, 9, None)]
    df = spark.createDataFrame(rows, "request_id long, client long, us long").selectExpr("request_id", "client", "timestamp_micros(us) AS ts")
    want, state = {}, {}
    for i, who, us in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        start, n = state.get(who, (None, 0))
        if start is None or us - start >= 10_000_000:
            start, n = us, 0
        state[who] = (start, n + 1)
        want[i] = (start, n + 1, n + 1 > 5)
    audit = Q.rate_limit_audit(df, 5, 10.0)
    got = {r.request_id: (r.us, r.request_no, r.limited) for r in audit.selectExpr("request_id", "unix_micros(window_start) us", "request_no", "limited").collect()}
    assert got == want
    plan = audit._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_window_starts_are_followed_once_and_met_in_one_join(spark, monkeypatch):
    from citadex.operators import quality as Q

    df = spark.range(400).selectExpr("id AS request_id", "id % 5 AS client", "timestamp_micros(id * 1500000) AS ts")
    settled, kept = [], Q.settle
    monkeypatch.setattr(Q, "settle", lambda d: settled.append(d) or kept(d))
    audit = Q.rate_limit_audit(df, 5, 60.0)
    assert audit.count() == 400
    joins = lambda d: d._jdf.queryExecution().analyzed().toString().count("Join ")
    placed = next(d for d in settled if "part" in d.columns)
    assert joins(placed) == 1 and joins(audit) == 1
