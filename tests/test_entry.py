import importlib.util
import pathlib
import re

import duckdb
import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def contract():
    spec = importlib.util.spec_from_file_location("__spark_entry__", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_flagship(spark, contract):
    df = contract.entry(spark)
    rows = df.collect()
    assert rows and {"query_id", "rank", "chunk_id", "paragraph_anchor", "document_title"} <= set(df.columns)
    assert len({(r.query_id, r["rank"]) for r in rows}) == len(rows) and all(r.status == "current" for r in rows)


def test_every_oracle_has_a_query_and_parses(contract):
    queries, oracles = contract.queries(), contract.oracle_sql()
    own = {q for q in queries if not re.match(r"op\d+_|pipeline$", q)}
    assert set(oracles) <= set(queries) and own <= set(oracles)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in oracles.items():
        con.execute("EXPLAIN " + sql)


@pytest.mark.parametrize("name", ["outline_chunks", "bm25_topk", "bm25_stored_index", "bm25_stemmed", "stem_terms", "eval_load", "stale_selection", "knn_filtered", "upsert_documents", "html_body", "check_current", "tool_telemetry"])
def test_queries_match_their_oracles(spark, contract, sf, name):
    """A cross-section; the driver compares all of them."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = contract.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(contract.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = [tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()]
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_plans(spark, contract, sf):
    """Shapes the design relies on."""
    plan = lambda n: contract.queries()[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
    chunking = plan("outline_chunks")
    assert "Window" not in chunking and len(re.findall(r"Exchange hashpartitioning", chunking)) <= 2  # only the registry's own join
    bm25 = plan("bm25_topk")
    assert "WindowGroupLimit" in bm25 and "CartesianProduct" not in bm25 and "BroadcastNestedLoopJoin" not in bm25
    assert "hashpartitioning(query_id#" in bm25 and bm25.count("Exchange") == 1  # only the best rows of the tasks travel
    assert "Generate" not in bm25 and "Aggregate" not in bm25  # neither tokens nor (query, chunk) pairs are rows
    nodes = [n for n in bm25.split("Exchange") if "text#" in n.split("\n")[0]]
    assert not nodes  # no exchange carries the text
