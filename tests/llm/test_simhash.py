import random

import pyarrow as pa
import xxhash
from common_rows import awkward, nothing, sample

from citadex.llm import simhash


def slow_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints, bits=2):
    """Least id reachable, for {id: fingerprint}."""
    least = {i: i for i in prints}
    todo = True
    while todo:
        todo = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= bits and least[b] < least[a]:
                    least[a], todo = least[b], True
    return least


def test_fingerprint_is_the_majority_of_shingle_hashes(spark, sf):
    for r in sample(spark, sf).limit(40).collect():
        assert simhash.fingerprint((r.text or "").encode()) == slow_fingerprint(r.text)
    assert simhash.fingerprint(b" \t\x0b ") == 0 and simhash.fingerprint(b"One TWO") == slow_fingerprint("one two")


def test_groups_match_brute_force(spark, sf):
    docs = sample(spark, sf)
    want = slow_groups({r.doc_id: slow_fingerprint(r.text) for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in simhash.simhash_groups(docs).collect()} == want


def _pairs_of(fps, bits, monkeypatch_rows=None):
    rows = sorted({(0, f - (1 << 64) if f >> 63 else f, i) for i, f in fps.items()})
    batch = pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["key", "fp", "rep"])
    return [p for b in simhash._list_links(bits)(iter([batch])) for p in zip(*(c.to_pylist() for c in b.columns))]


def test_long_lists_span_their_groups():
    """A list beyond the shifting bound yields links that join exactly what two bits join."""
    rng = random.Random(3)
    fps = {i: rng.getrandbits(64) for i in range(60)}
    for i in range(60, 200):
        fps[i] = fps[rng.randrange(i)] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
    found = slow_groups(fps)
    pairs = _pairs_of(fps, 2)
    joined = {i: i for i in fps}
    for _ in range(200):
        for a, b in pairs:
            joined[a] = joined[b] = min(joined[a], joined[b])
    assert joined == found and len(pairs) < len(fps)


def test_hot_lists_are_split_without_losing_links(spark, monkeypatch):
    """All fingerprints share four bytes; the lists are cut by the other bits."""
    monkeypatch.setattr(simhash, "LIST_ROWS", 8)
    rng = random.Random(5)
    fps = {}
    for i in range(120):
        fps[i] = 0xABCD_0123_0000_0000 | rng.getrandbits(32) if i < 60 else fps[i - 60] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in fps.items()]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long, rep long"))
    joined = {i: i for i in fps}
    pairs = [(r.src, r.dst) for r in links.collect()]
    for _ in range(150):
        for a, b in pairs:
            joined[a] = joined[b] = min(joined[a], joined[b])
    assert joined == slow_groups(fps)


def test_awkward_rows(spark):
    rows = simhash.simhash_groups(awkward(spark)).collect()
    assert len(rows) == 10
    group = {(r.doc_id, r.fp): r.component_id for r in rows}
    assert group[2, 0] == group[3, 0] == 2 and group[None, 0] == 2
    assert {r.component_id for r in rows if r.doc_id in (1, 5)} == {1}
    kept = simhash.keep_one(awkward(spark))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 4, 8, 9]
    assert kept.columns == awkward(spark).columns and kept.where("doc_id IS NULL").count() == 2
    assert simhash.simhash_groups(nothing(spark)).count() == 0 and simhash.keep_one(nothing(spark)).count() == 0
