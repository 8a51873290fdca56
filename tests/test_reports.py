import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from citadex.operators import documents, status
from citadex.operators import evaluate as E
from citadex.operators import quality as Q
from citadex.schema import DOCUMENTS, WITHDRAWN

T0 = dt.datetime(2025, 1, 1)
SITE = "https://www.rbi.org.in/Scripts/"


@pytest.fixture(scope="module")
def registry(spark):
    row = lambda family, i, state, date=None: (
        f"rbi:{family}:{i}", i, f"Title {i}", f"u/{i}", date, None, "R", None, family, [], state, T0, T0, None
    )
    return spark.createDataFrame(
        [
            row("master_direction", "40100", "current", dt.date(2025, 2, 14)), row("master_direction", "7", "superseded"),
            row("press_release", "40100", "withdrawn"), row("standalone_circular", "900", "current"), row("notification", "901", "superseded"),
        ],
        DOCUMENTS,
    )


@pytest.fixture(scope="module")
def withdrawn(spark):
    d = dt.date(2019, 8, 21)
    return spark.createDataFrame(
        [
            ("RBI/AAA/2017/4", "555", "Old", None, d, None, None, T0, T0), ("RBI/AAA/2017/4", "555", "Newer", None, d, "N", "w/1", dt.datetime(2025, 3, 1), T0),
            (None, "900", "Gone", None, d, None, "w/2", T0, T0),
        ],
        WITHDRAWN,
    )


def test_check_current(spark, registry, withdrawn):
    asks = {
        "dir": SITE + "BS_ViewMasDirections.aspx?id=40100", "old": SITE + "bs_viewmasdirections.aspx?ID=7", "new": SITE + "BS_ViewMasDirections.aspx?id=1",
        "list": SITE + "NotificationUserWithdrawnCircular.aspx?Id=42", "gone": SITE + "NotificationUser.aspx?Id=555&Mode=0",
        "both": SITE + "NotificationUser.aspx?Id=900", "none": SITE + "NotificationUser.aspx?Id=901", "faq": SITE + "FAQView.aspx?Id=3",
        "ref": " RBI/BBB/2019/8 ", "ref2": "RBI/2020-21/33", "junk": "hello", "empty": "  ", "null": None, "case": SITE + "notificationuserwithdrawncircular.aspx",
    }
    inputs = spark.createDataFrame(list(asks.items()), "input_id string, reference string")
    rows = {r.input_id: r for r in status.check_current(inputs, registry, withdrawn, F.lit("2025-06-01")).collect()}
    assert set(rows) == set(asks) and set(status.ENVELOPE) <= set(rows["dir"].asDict())
    assert {k: rows[k].status for k in asks} == {
        "dir": "current", "old": "superseded", "new": "unknown", "list": "list_page", "gone": "withdrawn", "both": "withdrawn", "none": "not_withdrawn",
        **dict.fromkeys(("faq", "ref", "ref2", "junk", "empty", "null", "case"), status.UNSUPPORTED),
    }
    assert rows["dir"].document_id == "rbi:master_direction:40100" and rows["dir"].last_updated_at == dt.date(2025, 2, 14)
    assert rows["new"].document_id == "rbi:master_direction:1" and rows["new"].official_url == asks["new"]
    assert rows["gone"].title == "Newer" and rows["gone"].ref_no == "RBI/AAA/2017/4" and rows["gone"].replacement_ref == "N"
    assert {k: rows[k].reason for k in ("faq", "ref", "ref2", "junk", "empty", "null")} == {
        "faq": "faq_url", "ref": "textual_ref", "ref2": "unknown", "junk": "unknown", "empty": "unknown", "null": "unknown",
    }
    live = status.check_current(inputs, registry, withdrawn.filter("original_id <> '900'"), F.lit("x")).filter("input_id = 'both'").first()
    assert live.status == "current" and live.document_family == "standalone_circular" and live.note.endswith("2025-01-01")


def test_lookups(spark, registry, withdrawn):
    ids = spark.createDataFrame([("40100",), ("5",)], "md_id string")
    assert [r.document_id for r in status.find_document(ids, registry).collect()] == ["rbi:master_direction:40100"]
    assert {r.title for r in status.withdrawn_latest(withdrawn).collect()} == {"Newer", "Gone"}
    assert [r.title for r in status.withdrawn_latest(withdrawn, "original_ref").collect()] == ["Newer"]


def test_documents(spark, registry):
    chunks = spark.createDataFrame(
        [("c2", "rbi:master_direction:7", "1", "1.a", 1, 50, "x" * 100), ("c1", "rbi:master_direction:7", "1", "1", 1, 0, "first")],
        "chunk_id string, document_id string, section string, paragraph_anchor string, page int, char_start int, text string",
    )
    asked = spark.createDataFrame([("rbi:master_direction:7",), ("rbi:master_direction:40100",), ("nope",)], "document_id string")
    rows = documents.document_toc(asked, registry, chunks).orderBy("document_id", "char_start").collect()
    by = {}
    for r in rows:
        by.setdefault(r.document_id, []).append(r)
    assert [(r.chunk_id, r.chunk_count, len(r.preview)) for r in by["rbi:master_direction:7"]] == [("c1", 2, 5), ("c2", 2, 80)]
    assert by["rbi:master_direction:40100"][0].chunk_count == 0 and by["nope"][0].status == "unknown" and by["nope"][0].error
    assert documents.assemble_text(chunks).first().text == "first\n\n" + "x" * 100


def test_evaluation(spark):
    cases = spark.createDataFrame(
        [
            ("anchor", "1", "d:1", "9.4", "", True), ("text", "1", "d:1", "", "OPENING-balance", True), ("either", "1", "d:1", "99", "opening-balance", True),
            ("neither", "1", "d:1", "99", "zebra", True), ("absent", "5", "d:5", "", "", True), ("nothing", "1", "d:1", "", "", True),
            ("negative", "", None, "", "", True), ("negative_hit", "", None, "", "", True), ("off", "9", "d:9", "", "", False),
        ],
        "case_name string, expected_md_id string, expected_document_id string, expected_anchor_prefix string, expected_text_contains string, enabled boolean",
    ).withColumn("clause", F.lit("c"))
    hits = [(c, 1, "d:2", "3", "other", False) for c in ("anchor", "text", "either", "neither", "absent", "negative_hit")]
    hits += [(c, 2, "d:1", "9.4.b", "The Opening-Balance rule", False) for c in ("anchor", "text", "either", "neither", "absent")]
    report = spark.createDataFrame(hits, "query_id string, rank int, document_id string, paragraph_anchor string, quoted_text string, low_confidence boolean")
    extra = spark.createDataFrame([("negative", True), ("nothing", True)], "query_id string, low_confidence boolean")
    report = report.unionByName(extra, allowMissingColumns=True).withColumn("retrieval", F.lit("hybrid"))
    rows = {r.case_name: r for r in E.evaluate_cases(cases, report).collect()}
    assert {k for k, r in rows.items() if r.passed} == {"anchor", "text", "either", "negative", "off"}
    assert rows["anchor"].detail == "matched at 9.4.b" and rows["absent"].detail == "expected 5 not among 1,2"
    assert rows["neither"].detail.endswith("present but unmatched") and rows["nothing"].detail == "no provisions returned"
    assert rows["off"].detail == "skipped (disabled)" and rows["negative_hit"].detail == "expected low confidence, got 1 provisions"
    results = E.evaluate_cases(cases, report)
    gate = E.eval_gate(results, F.lit(0.60)).first()
    assert (gate.total, gate.passed, gate.failed, gate.gate_passed) == (9, 5, 4, False) and gate.hit_rate == pytest.approx(5 / 9)
    assert E.eval_gate(results.limit(0)).first().hit_rate == 0.0
    good = E.eval_gate(results.filter("passed"), F.lit(0.9)).first()
    assert good.release_ok and not E.eval_gate(results.filter("passed").withColumn("passed", F.col("case_name") != "off"), F.lit(0.85)).first().release_ok
    locked = spark.createDataFrame([("anchor",), ("neither",), ("missing",)], "case_name string")
    assert tuple(E.locked_regressions(results, locked).first()) == (3, 2, False)
    line = E.dump_cases(results, report.withColumn("fusion_score", F.lit(0.1)).withColumn("sparse_rank", F.lit(1)).withColumn("dense_rank", F.lit(1)), cases)
    assert '"top_provisions":[{"document_id":"d:2"' in line.filter("case_name = 'text'").first().line


def test_comparison(spark):
    rows = [("A", "x", True, ["1", "2"]), ("B", "x", True, ["1", "3"]), ("A", "y", True, []), ("B", "y", False, []), ("A", "only", True, ["1"])]
    rows += [("C", "x", False, ["2"]), ("C", "y", False, ["9"])]
    runs = spark.createDataFrame(rows, "run string, case_name string, passed boolean, keys array<string>")
    pair = E.compare_pair(runs.filter("run = 'A'"), runs.filter("run = 'B'"))
    by = {r.case_name: r for r in pair.collect()}
    assert by["x"].jaccard == pytest.approx(1 / 3) and by["x"].flag == "same" and by["y"].jaccard == 1.0
    assert by["y"].flag == "different outcome" and by["only"].flag == "missing on one side"
    s = E.compare_summary(pair).first()
    assert (s.n, s.both_pass, s.only_a, s.only_b, s.neither, s.top1_same) == (3, 1, 1, 0, 0, 1) and s.hit_rate_a == pytest.approx(2 / 3)
    three = {(r.run_a, r.run_b): r for r in E.compare_runs(runs).collect()}
    assert set(three) == {("A", "B"), ("A", "C"), ("B", "C")}
    assert three["A", "B"].top1_same == 1 and three["A", "C"].disagreements == 2 and three["A", "B"].cases == 3


@pytest.mark.parametrize("buckets", [1, 7, 1024])
def test_latency(spark, buckets):
    rng = random.Random(5)
    rows = [("hot", round(rng.expovariate(0.1), 1)) for _ in range(900)] + [("one", 3.0)] + [("same", 2.0)] * 40
    rows += [("few", float(v)) for v in (5, 1, 9)]
    got = E.latency_stats(spark.createDataFrame(rows, "tool string, v double"), ["tool"], "v", buckets=buckets).collect()
    for r in got:
        values = sorted(v for t, v in rows if t == r.tool)
        assert r.p95 == values[int(len(values) * 0.95)] and r.calls == len(values) and r.mean == pytest.approx(sum(values) / len(values))


def limited(requests, limit, width):
    """The window rule, request by request."""
    state, out = {}, {}
    for i, client, at in sorted(requests, key=lambda r: (r[2], r[0])):
        start, n = state.get(client, (at, 0))
        if (at - start).total_seconds() >= width:
            start, n = at, 0
        state[client] = (start, n + 1)
        out[i] = (start, n + 1, n + 1 > limit, max(1, int(width - (at - start).total_seconds())) if n + 1 > limit else None)
    return out


def test_rate_limit(spark):
    rng = random.Random(11)
    rows, at = [], T0
    for i in range(1500):
        at += dt.timedelta(milliseconds=rng.choice((0, 10, 300, 2000, 9000, 61_000)) * (1 if rng.random() < 0.98 else 30))
        rows.append((i, rng.choice((1, 1, 1, 2, 3)), at))
    df = spark.createDataFrame(rows, "request_id bigint, client bigint, ts timestamp").repartition(6)
    got = {r.request_id: (r.window_start, r.request_no, r.limited, r.retry_after) for r in Q.rate_limit_audit(df, 5, 60.0).collect()}
    assert got == limited(rows, 5, 60.0)
    split = Q.rate_limit_audit(
        df, 5, 60.0, excluded=F.col("client") == 3, bucket=F.when(F.col("client") == 2, "auth").otherwise("main"), bucket_limits={"auth": 1}
    ).collect()
    assert all((r.request_no > (1 if r.client == 2 else 5)) == r.limited for r in split) and 3 not in {r.client for r in split}


def test_schema_evolution(spark):
    old = spark.createDataFrame([("ns:1", "1", "T")], "document_id string, md_id string, title string")
    new = Q.evolve_schema(old, DOCUMENTS, {"document_family": F.lit("master_direction"), "status": F.lit("current"), "pdf_urls": F.array().cast("array<string>")})
    row = new.first()
    assert [f.name for f in new.schema] == [f.name for f in DOCUMENTS] and row.document_family == "master_direction" and row.pdf_urls == []
