import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from common_rows import awkward, nothing, sample
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from citadex.llm import packing
from citadex.llm.registry import tokenizer_paths


def expected(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = defaultdict(list)
    for doc, text in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        out[doc].append([(a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(cuts, cuts[1:])])
    return out


def verify(rows, want):
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.start, r.length, r.ids_crc32))
    assert {d: sorted(p) for d, p in got.items()} == {d: sorted(x for copy in v for x in copy) for d, v in want.items()}
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 2048
    return len(places)


def test_pieces_match_the_tokenizer_and_fill_sequences(spark, sf):
    docs = sample(spark, sf)
    rows = packing.pack(docs, *tokenizer_paths()).collect()
    n = verify(rows, expected([(r.doc_id, r.text) for r in docs.collect()]))
    assert n <= sum(r.length for r in rows) / 2048 * 1.02 + 1
    assert {(r.doc_id, r.piece) for r in rows} == {(r.doc_id, i) for d in {r.doc_id for r in rows} for r in rows if r.doc_id == d for i in [r.piece]}


def test_fast_and_plain_encoders_agree():
    """White space, digits, contractions, marks, special tokens and foreign scripts."""
    fast, plain = packing.Encoder(*tokenizer_paths()), packing.Encoder(tokenizer_paths()[0])
    for text in ("", " ", "  a", "a  b", "it's we'll I'd x'y", "a\nb\n\nc\t d ", "12 345é ß中文 \U0001f600!?..", "<|endoftext|> x", "a\xa0b   c", "'S 'LL don't", "%%% ***", "end "):
        assert fast(text) == plain(text), text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_two_fit_packs_everything_once(lengths):
    sequences = packing.best_two_fit(np.array(lengths, np.int64), 40)
    assert sorted(x for s in sequences for x in s) == sorted(lengths) and all(sum(s) <= 40 for s in sequences)


def test_two_replace_the_smallest():
    assert sorted(map(sorted, packing.best_two_fit(np.array([60, 30, 21, 19]), 100))) == [[19, 21, 60], [30]]


def test_awkward_rows(spark):
    docs = awkward(spark)
    verify(packing.pack(docs, *tokenizer_paths()).collect(), expected([(r.doc_id, r.text) for r in docs.collect()]))
    assert packing.pack(nothing(spark), *tokenizer_paths()).count() == 0


def test_many_equal_rows_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 50)
    docs = spark.createDataFrame([(1, "same text")] * 400, "doc_id long, text string")
    rows = packing.pack(docs, *tokenizer_paths()).collect()
    verify(rows, expected([(1, "same text")] * 400))
    assert len({r.sequence_id >> 32 for r in rows}) == 8
