import pathlib
import sys
from collections import Counter

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from common_rows import awkward, nothing  # noqa: E402
from test_near_copies import groups as near_groups  # noqa: E402
from test_suffix_dedup import slow  # noqa: E402

from citadex.llm import mixing  # noqa: E402


def test_stages_follow_each_other_and_match_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(name)
        old, new = ({r.doc_id: r for r in d.collect()} for d in (before, docs))
        if name == "near_dedup":
            groups, _ = near_groups({d: r.text for d, r in old.items()})  # all pairs, five words, Jaccard
            assert set(new) == {d for d, g in groups.items() if d == g} and all(new[d] == old[d] for d in new)
        if name == "language_id":
            assert len(new) > 0.97 * len(old) and all(any(c.isalpha() for c in r.text) for r in new.values())
        if name == "suffix_dedup":
            order = sorted(old)
            want = dict(zip(order, (s[3].decode("utf-8", "ignore") for s in slow([old[d].text.encode() for d in order]))))
            assert {d: r.text for d, r in new.items()} == want
        if name == "source_mix":
            copies = Counter({r.doc_id: len(r.shards) for r in mixing.mix(before).collect() if r.shards})
            assert Counter(r.doc_id for r in docs.collect()) == copies
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen == ["language_id", "near_dedup", "suffix_dedup", "source_mix", "best_fit_packing"]
    rows = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows.collect()) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in docs.collect())


def test_stages_stand_awkward_and_empty_tables(spark, sf):
    for docs in (awkward(spark), nothing(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name == "best_fit_packing":
                assert (out.count() > 0) == (docs.count() > 0)
            else:
                assert out.count() <= 2 * docs.count() and out.columns == docs.columns
