import re
from collections import defaultdict

import pytest
from common_rows import awkward, nothing, sample

from citadex.llm import mixing
from citadex.llm.registry import QUERIES


def slow_targets(sizes, share=1.5, most=2.0):
    """Share by weight, cap, share the excess again among the others."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_takes(spark, sf):
    docs = {r.doc_id: r for r in sample(spark, sf).collect()}
    sizes = defaultdict(int)
    for r in docs.values():
        sizes[r.source] += words(r.text)
    want, taken = slow_targets(sizes), defaultdict(int)
    rows = QUERIES["op3_source_mix"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        source = docs[r.doc_id].source
        assert r.size == words(docs[r.doc_id].text) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source]) and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.05 * t, 60)
    assert sorted(rows) == sorted(QUERIES["op3_source_mix"](spark, sf).collect())


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100, None: 5}, {"a": 10, "b": 1000, "c": 1000}, {"x": 7}, {"a": 0, "b": 50}, {f"s{i}": i * i for i in range(20)}])
def test_water_level(spark, sizes):
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = slow_targets(sizes)
    assert {r.source: r.target for r in rows} == pytest.approx(want)
    assert sum(r.target for r in rows) == pytest.approx(1.5 * sum(sizes.values()))


def test_tree_deals_every_block_once_and_evenly(spark):
    drawn = spark.createDataFrame([(s, b, 1 + b % 2) for s in ("a", None) for b in range(100)], "source string, block long, times int")
    rows = mixing.deal(drawn, 3, 42).collect()
    assert all(len(r.shards) == 1 + r.block % 2 for r in rows) and len(rows) == 200
    load = defaultdict(int)
    for r in rows:
        for s in r.shards:
            load[s] += 1
    assert sorted(load) == list(range(8)) and max(load.values()) - min(load.values()) <= 1


def test_mixed_rows_are_the_drawn_copies(spark, sf):
    docs = sample(spark, sf)
    copies = defaultdict(int)
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] += len(r.shards)
    out = mixing.mixed(docs)
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
    assert out.columns == docs.columns and {d: n for d, n in copies.items() if n} == dict(got)


def test_no_python_in_the_plan(spark, sf):
    plan = QUERIES["op3_source_mix"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == 10 and sum(r.size * len(r.shards) for r in rows) > 0
    assert {r.size for r in rows if r.doc_id == 2} == {0} and {r.source_size for r in rows if r.source is None} == {3}
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(nothing(spark)).count() == 0 and mixing.mixed(nothing(spark)).count() == 0
