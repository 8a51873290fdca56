import hashlib
import os
import random

import numpy as np
import pytest
from common_rows import BASE, awkward, nothing, sample
from hypothesis import given, settings
from hypothesis import strategies as st

from citadex.llm import suffix_dedup as sd


def slow(texts):
    """n_bytes, n_removed, n_spans, kept of texts in order."""
    seen, out = set(), []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 99):
            s = t[i : i + 100]
            if s in seen:
                gone[i : i + 100] = True
            seen.add(s)
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def fast(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sd.dedup(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sorted(rows)]


def test_documents_match_brute_force(spark, sf):
    texts = [r.text or "" for r in sample(spark, sf).orderBy("doc_id").collect()]
    assert fast(spark, texts) == slow([t.encode() for t in texts])


def crafted(seed):
    """Passages in many surroundings, overlaps, periods, single letters, NUL bytes, cut and clipped repeats."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdeé\x00 ") for _ in range(n))
    passages = [word(n) for n in (60, 99, 100, 101, 130, 240, 400)] + ["ab" * 90, "x" * 150, word(51) * 4, word(70) * 3]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.choice((0, 0, 0, rng.randrange(len(p))))
            parts += [word(rng.choice((0, 1, 30, 80))), p[a : len(p) - rng.choice((0, 0, rng.randrange(20)))]]
        texts.append("".join(parts))
    return texts + [passages[4], passages[5][20:180], ""]


@pytest.mark.parametrize("seed", range(3))
def test_crafted_texts_match_brute_force(spark, seed):
    texts = crafted(seed)
    assert fast(spark, texts) == slow([t.encode() for t in texts])


def test_frequent_grams_match_brute_force(spark, monkeypatch):
    """Groups beyond the bound are sorted string by string; small bounds also give many ranges and pieces."""
    monkeypatch.setattr(sd, "GROUP", 3)
    monkeypatch.setattr(sd, "MERGE", 50)
    monkeypatch.setattr(sd, "TASK_BYTES", 3000)
    texts = crafted(7)
    assert fast(spark, texts) == slow([t.encode() for t in texts])


def test_long_texts_have_the_same_anchors_in_pieces():
    text = os.urandom(40_000) + b"abc" * 300 + os.urandom(5000)
    for a, b in zip(sd.anchors(text), sd.anchors(text, piece=3000)):
        assert np.array_equal(a, b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=12).map(sorted), min_size=1, max_size=7))
def test_loser_tree_merges_front_coded_runs(runs):
    coded = [(sd.decoded(*sd.front_coded(r)), sd.front_coded(r)[0].tolist()) for r in runs]
    order, shared = sd.merge_runs(coded)
    out = [runs[r][i] for r, i in order]
    assert out == sorted(x for r in runs for x in r)
    assert shared[1:] == [len(os.path.commonprefix([a, b])) for a, b in zip(out, out[1:])]


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = sd.dedup(docs).select("row.doc_id", "row.t", "n_bytes", "n_removed", "kept").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == 10 and [r.n_bytes for r in by[None]].count(0) == 1
    text = (BASE * 3).encode()
    assert bytes(by[1][0].kept) == slow([text])[0][3]
    assert [r.n_removed for r in by[5]] == [len(text)] * 2  # both start earlier in 1
    assert by[8][0].n_removed > by[8][0].n_bytes - 200
    clean = sd.cleaned(docs)
    assert clean.columns == docs.columns and clean.count() == 10
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    assert sd.dedup(nothing(spark)).count() == 0 and sd.cleaned(nothing(spark)).count() == 0


def test_query_digest(spark, sf):
    from citadex.llm.registry import QUERIES

    r = QUERIES["op6_suffix_dedup"](spark, sf).orderBy("doc_id").first()
    text = sample(spark, sf).where(f"doc_id = {r.doc_id}").first().text.encode()
    if not r.n_removed:
        assert r.kept_sha256 == hashlib.sha256(text).hexdigest()
