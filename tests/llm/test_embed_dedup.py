import numpy as np
import pytest
from common_rows import sample

from citadex.llm import embed_dedup
from citadex.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, component long, rep long, unit string"


def slow(rows, least=0.98):
    ids = [r[0] for r in rows]
    links = {i: set() for i in range(len(rows))}
    usable = [r[1] is not None and len(r[1]) > 0 and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) and r[2] is not None for r in rows]
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if usable[i] and usable[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[i].add(j)
                    links[j].add(i)
    least_id = list(ids)
    for _ in rows:
        for i in links:
            for j in links[i]:
                least_id[i] = min(least_id[i], least_id[j])
    return sorted((ids[i], len(links[i]), least_id[i], least_id[i] == ids[i]) for i in links)


def test_query_matches_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in sample(spark, sf, "embeddings").collect()]
    assert sorted(map(tuple, QUERIES["op1_embedding_near_dedup"](spark, sf).collect())) == slow(rows)


def clusters(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(24)
        for _ in range(25):
            x = centre + rng.standard_normal(24) * rng.choice([0.0, 0.05, 0.12, 0.3])
            rows.append([float(np.float32(v)) for v in x])
    return [(i, v, int(rng.integers(0, 3))) for i, v in enumerate(rows)]


@pytest.mark.parametrize(("block", "window", "held"), [(1024, 128, 32_768), (8, 128, 32_768), (8, 4, 32_768), (1024, 4, 16)])
def test_clusters_match_brute_force(spark, monkeypatch, block, window, held):
    """Small blocks make one component meet in many tasks; small windows make passes out of small labels."""
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "WINDOW", window)
    monkeypatch.setattr(embed_dedup, "HELD", held)
    rows = clusters()
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, embed_dedup.near_duplicates(docs).collect())) == slow(rows)


def test_awkward_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 1), (8, [], 1), (9, [1.0, 0.0, 0.0], 1), (10, [1.0, 0.0], 2), (11, [-1.0, 0.0], 1), (12, [1.0, 0.0], 1)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    got = sorted(map(tuple, embed_dedup.near_duplicates(docs).collect()))
    assert got == slow(rows) and got[0] == (0, 2, 0, True)
    assert embed_dedup.near_duplicates(docs.where("false")).count() == 0
    extra = spark.createDataFrame([(None, [1.0, 0.0], 1, 1, 1, "x")], SCHEMA)
    assert [r for r in embed_dedup.near_duplicates(docs.union(extra)).collect() if r.vec_id is None][0].kept is None


def planted(n, dim, radius, seed):
    """Unit vectors within ``radius`` of one direction, and 100 partners at a cosine just over the threshold."""
    rng = np.random.default_rng(seed)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    x = unit(unit(rng.standard_normal(dim)) + unit(rng.standard_normal((n, dim))) * radius)
    x[-100:] = unit(x[:100] + unit(rng.standard_normal((100, dim))) * 0.195)
    x = x.astype(np.float32)
    y = unit(x.astype(np.float64))
    near = y @ y.T >= 0.98
    np.fill_diagonal(near, False)
    return x, near


@pytest.mark.parametrize(("radius", "held"), [(0.229, 32_768), (0.6, 32_768), (3.0, 32_768), (3.0, 1500)])
def test_recall_on_dense_and_wide_labels(spark, monkeypatch, radius, held):
    """A third of all rows in one label, dense (mutual cosine 0.95) to wide, ordered by one task or cut by signs."""
    monkeypatch.setattr(embed_dedup, "HELD", held)
    x, near = planted(6000, 64, radius, 4)
    assert near.sum() >= 200
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), 1, 1, 2, "x") for i, v in enumerate(x)]
    rows += [(10_000 + i, v.tolist(), 2 + i % 40, 1, 2, "x") for i, v in enumerate(rng.standard_normal((12_000, 64)).astype(np.float32))]
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()}
    want = near.sum(axis=1)
    assert sum(got[i].n_links for i in range(6000)) >= 0.99 * want.sum()
    assert all(got[i].n_links <= want[i] for i in range(6000))


def test_plan_follows_size_and_density(spark):
    mean = lambda length: [length] + [0.0] * 3
    rows = [("wide", 4, 100_000, mean(0.1)), ("dense", 4, 100_000, mean(0.9)), ("small", 4, 50, mean(0.1)), ("huge", 4, 10**9, mean(0.1))]
    plan = {r.label: r for r in embed_dedup.planned(spark.createDataFrame(rows, "label string, dim int, n long, mean array<double>"), 0.98, 0.999).collect()}
    assert 0 < plan["wide"].passes < plan["dense"].passes and plan["wide"].passes < plan["huge"].passes and plan["small"].passes == 0
    assert plan["small"].cut == 0 < plan["wide"].cut < plan["huge"].cut


def test_a_pass_compares_windows_and_runs():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1, 8)) + 1e-3 * rng.standard_normal((400, 8))  # one run of equal hashes, longer than a window
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    root = np.arange(400)
    embed_dedup._pass(x, x.astype(np.float32), embed_dedup.hashes(x, 0), root, 0.98)
    assert set(root) == {0}


def test_exact_way_equals_the_passes_on_clusters(spark):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in clusters(7)], SCHEMA)
    assert sorted(map(tuple, embed_dedup.near_duplicates(docs, exact=True).collect())) == slow(clusters(7)) == sorted(map(tuple, embed_dedup.near_duplicates(docs).collect()))
