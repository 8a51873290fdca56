import io
import zlib
from array import array

import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import zstandard
from common_rows import awkward, nothing, sample
from tokenizers import Tokenizer

from citadex.llm import token_files
from citadex.llm.registry import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def slow(rows, end=1):
    whole = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc, text in rows:
        ids = array("I", [*whole.encode(text or "", add_special_tokens=False).ids, end])
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_matches_the_library(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in sample(spark, sf).collect())
    found = QUERIES["op12_token_files"](spark, sf).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == slow(rows)


@pytest.mark.parametrize("text", ["", "  ", "İstanbul ßtraße ŉ ǰ", "áb c ́x école NAÏVE", "can't won't I'LL 'tis", "x y z\x1cq\x85w", "<|endoftext|> a<|startoftext|>b", "Ⅷ ½ ² ⑤x 12ab3", "\r\n\t\x0b\x0c tab", "ΑΣ Σ", "日本語 한국어 ไทย", "\U0001f937‍♂️ok", "a" * 3000, "...!!! $$$x) b.c,d"])
def test_words_give_what_whole_texts_give(text):
    whole = Tokenizer.from_file(PATH)
    texts = [text, f"the end. {text} The", text.replace(" ", "\n")]
    assert list(token_files.encoder(PATH)(texts)) == [array("I", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 10)
    encode = token_files.WordEncoder(PATH)
    texts = [f"word{'abcdefgh'[i % 8]} other{'xyz'[i % 3]} {i}" for i in range(200)]
    whole = Tokenizer.from_file(PATH)
    assert list(encode(texts)) == [array("I", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def test_texts_are_looked_up_by_their_bytes(monkeypatch):
    """Texts on both sides of a cut, longer than it, or empty, from an Arrow column, of which no text becomes a Python string."""
    monkeypatch.setattr(token_files, "CALL_BYTES", 50)
    texts = ["", "one two, three", "x " * 90, "", "Ünder (the) hill's 12,", "one\ntwo", "end."] * 3
    whole = Tokenizer.from_file(PATH)
    want = [array("I", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    encode = token_files.WordEncoder(PATH)
    assert list(encode(pa.array(texts))) == want and list(encode(pa.array(["skip", *texts]).slice(1))) == want
    assert list(encode(pa.array([], pa.string()))) == [] == list(encode([])) and list(encode([""])) == [b""]


def written(tmp_path, docs):
    fs = pafs.LocalFileSystem()
    w = token_files.Writer(fs, str(tmp_path / "x.zst"))
    for d, ids in docs:
        w.add(d, array("I", ids).tobytes())
    return fs, w.close()


def test_readers_open_only_the_frames_they_need(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 100)
    docs = [(i, range(i * 50, i * 50 + 50)) for i in range(40)] + [(99, range(1000)), (100, []), (101, [7])]
    fs, (path, n, ids, first, last) = written(tmp_path, docs)
    assert (n, ids, first, last) == (43, 3001, 0, 101)
    file = token_files.Reader(fs, path)
    assert file.opened == 0 and array("I", file.ids(10)).tolist() == list(range(500, 550)) and file.opened == 1
    assert array("I", file.ids(40)).tolist() == list(range(1000)) and file.opened == 11
    assert file.ids(41) == b"" and array("I", file.ids(42)).tolist() == [7]
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(path, "rb").read()), read_across_frames=True).read()
    assert plain == b"".join(array("I", ids).tobytes() for _, ids in docs)
    assert not list(tmp_path.glob("*.draft"))


def test_a_changed_frame_is_noticed(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 100)
    fs, (path, *_) = written(tmp_path, [(i, range(100)) for i in range(3)])
    raw = bytearray(open(path, "rb").read())
    file = token_files.Reader(fs, path)
    packed = zstandard.ZstdCompressor(level=token_files.LEVEL, write_content_size=True).compress(array("I", [*range(99), 5]).tobytes())
    if len(packed) == file.frames[1, 0]:
        raw[file.places[1] : file.places[2]] = packed
    else:
        raw[file.places[1] + 12] ^= 255
    open(path, "wb").write(raw)
    broken = token_files.Reader(fs, path)
    assert array("I", broken.ids(0)).tolist() == list(range(100))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.ids(1)
    open(path, "wb").write(bytes(raw[:-1]))
    with pytest.raises(ValueError):
        token_files.Reader(fs, path)


def test_asked_documents_only_and_several_files(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 2000)
    docs = sample(spark, sf).repartition(5)
    files = token_files.write(docs, str(tmp_path), PATH)
    listed = files.orderBy("file").collect()
    assert len(listed) >= 4 and [r.first_id for r in listed] == sorted(r.first_id for r in listed)
    want = {r[0]: r for r in slow(sorted((r.doc_id, r.text) for r in docs.collect()))}
    asked = spark.createDataFrame([(3,), (77,), (3,), (10**9,), (None,)], "id long")
    found = token_files.read(files, asked).withColumn("c", token_files.ids_crc32()).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.c) for r in found) == [want[3], want[77]]
    assert token_files.read(token_files.files(spark, str(tmp_path))).count() == len(want)


def test_awkward_rows(spark):
    found = token_files.round_trip(awkward(spark), PATH).withColumn("c", token_files.ids_crc32()).collect()
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    size = lambda t: slow([(0, t)])[0][2:]
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.c) for r in found) == sorted(((d is None, d or 0), *size(t)) for d, t in rows)
    found.sort(key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, None, 1, 2, 3, 4, 5, 5, 8, 9]
    assert [r.start for r in found] == [sum(x.n_tokens for x in found[:i]) for i in range(len(found))]
    assert token_files.round_trip(nothing(spark), PATH).count() == 0


def test_forms_of_a_word_share_what_is_learned():
    """Letters are encoded once for all cases and marks of an ASCII word; words that lower case treats unlike stay apart."""
    import public_tokenizers

    encode = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Straßen word Word WORD, word.", "ΟΔΟΣ οδος İstanbul ISTANBUL KK wort's Ünder ünder!?", "", "WORD;; x1 word"]
    for _ in range(2):
        got = list(encode(texts))
        assert got == [array("I", encode.whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert sum(core == "word" for core in encode.cores) == 1 and "WORD" not in encode.cores
