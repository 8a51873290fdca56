import numpy as np
import pytest
from common_rows import sample

from citadex.llm import cover_tree
from citadex.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, x string, centre int, part int"


def slow(rows, every=100):
    kept = {}
    for i, v, lab in rows:
        if i is not None and lab is not None and v and None not in v and np.isfinite(v).all():
            kept[i] = ([int(np.floor(256 * float(x))) for x in v], (lab + 1) % 10 if i % 7 == 0 else lab)
    out = []
    for a, (x, lab) in kept.items():
        if a % every:
            continue
        s = {i: sum(p * q for p, q in zip(x, y)) for i, (y, _) in kept.items() if i != a and len(y) == len(x)}
        for p in sorted((i for i in s if kept[i][1] == lab), key=lambda i: (-s[i], i))[:5]:
            fit = [i for i in s if kept[i][1] != lab and 80 * s[p] <= 100 * s[i] <= 100 * s[p]]
            out += [(a, p, r + 1, i, s[p], s[i]) for r, i in enumerate(sorted(fit, key=lambda i: (-s[i], i))[:5])]
    return sorted(out)


def test_query_matches_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in sample(spark, sf, "embeddings").collect()]
    assert sorted(map(tuple, QUERIES["op13_hard_negatives"](spark, sf).collect())) == slow(rows)


def clustered(n=1500, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, n)] + 0.2 * rng.standard_normal((n, 16))
    x[: n // 3] = x[0]  # a third of the rows are one vector: ties everywhere
    x[n // 3 : n // 3 + 40] = 0
    return [(i, np.float32(v).tolist(), int(rng.integers(0, 4))) for i, v in enumerate(x)]


@pytest.mark.parametrize("shard", [16_384, 100])
def test_clusters_ties_and_many_shards_match_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(cover_tree, "SHARD", shard)
    rows = clustered()
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, cover_tree.hard_negatives(docs, every=30).collect())) == slow(rows, 30)


def test_tree_covers_separates_and_skips():
    rng = np.random.default_rng(1)
    x = np.floor(256 * np.concatenate([c + 0.03 * rng.standard_normal((400, 8)) for c in rng.standard_normal((10, 8))]))
    tree = cover_tree.CoverTree(x)
    for depth, (first, end, centre, radius, above) in enumerate(tree.levels):
        for a, b, c, r in zip(first, end, centre, radius):
            assert np.linalg.norm(tree.augmented[tree.order[a:b]] - tree.augmented[c], axis=1).max() <= r * (1 + 1e-12)
        if depth:
            up = tree.levels[depth - 1]
            for node in np.unique(above):
                children = np.flatnonzero(above == node)
                assert up[2][node] in centre[children] and end[children].max() == up[1][node] and first[children].min() == up[0][node]
                c = tree.augmented[centre[children]]
                d = np.linalg.norm(c[:, None] - c[None], axis=2)[np.triu_indices(len(c), 1)]
                assert not len(d) or d.min() >= up[3][node] / cover_tree.SHRINK * (1 - 1e-9)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    q = x[::400]
    s = q @ x.T
    low, high = np.quantile(s, 0.97, axis=1), np.quantile(s, 0.99, axis=1)
    seen = np.zeros(s.shape, bool)
    for who, leaf, _ in tree.leaves(q, low, high):
        for w, a, b in zip(who, *tree.stretch(leaf)):
            seen[w, tree.order[a:b]] = True
    assert seen[(s >= low[:, None]) & (s <= high[:, None])].all() and seen.mean() < 0.6


def test_large_components_stay_whole():
    q, x = np.array([[3e9, 1.0]]), np.array([[2.5e9, 7.0]])
    assert cover_tree.exact(q, x).tolist() == [3 * 25 * 10**17 + 7]


def test_awkward_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.85, 0.0], 2), (3, None, 1), (4, [], 1), (5, [1.0, None], 2), (6, [float("nan"), 1.0], 2), (8, [1.0, 0.0, 0.0], 2), (9, [0.8, 0.3], None), (10, [-1.0, 0.0], 1), (11, [0.85, 0.0], 2), (None, [0.9, 0.0], 2), (100, [-0.5, 0.0], 3), (200, [0.0, 0.0], 1)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows] + [(11, [0.85, 0.0], 2, "y", 3, 4)], SCHEMA)
    assert sorted(map(tuple, cover_tree.hard_negatives(docs).collect())) == slow(rows)
    assert cover_tree.hard_negatives(docs.where("false")).count() == 0
