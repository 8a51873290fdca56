"""Token files: ids of documents in independent zstandard frames, with a trailing seek table and a checksum a frame.

A file is, in this order:

* data frames, each an independent zstandard frame over at most ``FRAME_IDS`` little-endian unsigned 32-bit ids; the ids of
  the documents follow one another without gaps, so a document may begin and end anywhere in a frame;
* one skippable frame (magic 0x184D2A50) that holds the index of documents: a zstandard frame over their number, ids, null flags
  and lengths;
* the seek table of the public seekable format: a skippable frame (magic 0x184D2A5E) with the compressed size, the
  decompressed size and the low 32 bits of XXH64 of every frame before it, then the number of frames, a descriptor byte
  and the magic 0x8F92EAB1.

A plain zstandard decoder reads all ids from it, a reader of this module only the frames that a document lies in.
"""

from __future__ import annotations

import operator
import os
import posixpath
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citadex.llm.common import arrow_map, settle
from citadex.session import shared_dir
from citadex.sizes import BROADCAST_ROWS, broadcast_if, fits

#: Ids of a data frame, and ids after which a task begins another file.
FRAME_IDS, FILE_IDS = 32_768, 1 << 24
#: Words whose ids a worker remembers.
CACHE_WORDS = 600_000
#: Bytes of the texts whose unknown words are looked up together, and words of one call to the tokenizer.
CALL_BYTES, CALL_WORDS = 1 << 22, 1000
LEVEL = 3
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
MANIFEST = "file long, path string, docs long, ids long, first_id long, last_id long"
#: Marks that may follow a word of letters.
MARKS = ".,;:!?$&*%#)"
_CORE = regex.compile(r"([[:alpha:]]+)([.,;:!?$&*%#)]*)")
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and never reads across it, word by word.

    Words come to the library once, many in a call, and are remembered. A word of letters is one unit of the tokenizer, whose ids
    end in the one id that closes a word; that tells the words of a call apart. All other words are encoded alone.
    """

    def __init__(self, json_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        #: Ids of words as they stand, of their letters in lower case, and of the marks after them.
        self.known: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def alone(self, word: str) -> bytes:
        return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def learn(self, words: list[str]) -> None:
        whole, cores, tails = [], [], []
        for w in words:
            if w.isascii():
                front = w[:-1]
                if w.isalpha():
                    core, tail = w, ""
                elif front.isalpha() and w[-1] in MARKS:
                    core, tail = front, w[-1]
                elif m := _CORE.fullmatch(w):
                    core, tail = m.groups()
                else:
                    self.known[w] = self.alone(w)
                    continue
                core = core.lower()
            elif m := _CORE.fullmatch(w):
                core, tail = m.groups()
                # The tokenizer ignores case; only for ASCII is it certain that both lower it alike.
                core = core.lower() if core.isascii() else core
            else:
                self.known[w] = self.alone(w)
                continue
            whole.append(w)
            cores.append(core)
            tails.append(tail)
        for tail in set(tails) - self.tails.keys():
            self.tails[tail] = self.alone(tail)
        if len(self.cores) + len(whole) > CACHE_WORDS:
            self.cores.clear()
        ids = self.cores
        fresh = list(set(cores) - ids.keys())
        calls = [fresh[i : i + CALL_WORDS] for i in range(0, len(fresh), CALL_WORDS)]
        for call, found in zip(calls, self.whole.encode_batch_fast([" ".join(c) for c in calls], add_special_tokens=False)):
            got = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.closes[got]) + 1 if len(got) else np.zeros(0, np.int64)
            if len(ends) == len(call):
                raw = got.tobytes()
                ids.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(call, [0, *ends.tolist()], ends.tolist()))
            else:  # a letter that lower case turns into several characters
                ids.update((w, self.alone(w)) for w in call)
        self.known.update(zip(whole, map(operator.add, map(ids.__getitem__, cores), map(self.tails.__getitem__, tails))))

    def __call__(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(upto // CALL_BYTES)) + 1).tolist(), len(texts)]
        for at, end in pairwise(cuts):
            some = texts[at:end]
            split = pc.split_pattern(pc.replace_substring(some, "\n", " "), " ")
            coded = split.flatten().dictionary_encode()
            words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            if len(self.known) + len(words) > CACHE_WORDS:
                self.known.clear()
            self.learn([w for w in words if w not in self.known])
            ids = pa.array([self.known[w] for w in words], pa.large_binary()).take(coded.indices)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
            _, offsets, data = ids.buffers()
            places = np.frombuffer(offsets, np.int64)[ids.offset :][ends].tolist()
            data = memoryview(data or b"")
            yield from (data[a:b].tobytes() for a, b in pairwise(places))


def encoder(json_path: str) -> WordEncoder:
    if json_path not in _encoders:
        _encoders[json_path] = WordEncoder(json_path)
    return _encoders[json_path]


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path there."""
    uri = "s3://" + folder[6:] if folder.startswith("s3a://") else folder
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """One token file; it appears under its name only when it is closed."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.fs, self.path, self.draft = fs, path, f"{path}.{uuid.uuid4().hex}.draft"
        self.out = fs.open_output_stream(self.draft)
        self.press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.rest, self.frames = bytearray(), []
        self.doc_ids, self.lengths, self.ids = [], [], 0

    def _frame(self, data: bytes) -> None:
        packed = self.press.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """The ids of the next document, as little-endian unsigned 32-bit numbers."""
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.ids += len(ids) // 4
        self.rest += ids
        size = 4 * FRAME_IDS
        if len(self.rest) >= size:
            whole = len(self.rest) // size * size
            for at in range(0, whole, size):
                self._frame(bytes(self.rest[at : at + size]))
            del self.rest[:whole]

    def close(self) -> tuple[str, int, int, int | None, int | None]:
        """path, docs, ids, first and last id of the file."""
        if self.rest:
            self._frame(bytes(self.rest))
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        index = struct.pack("<Q", len(null)) + np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + null.tobytes() + np.array(self.lengths, "<u8").tobytes()
        packed = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(index)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(packed)) + packed)
        self.frames.append((len(packed) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.out.close()
        self.fs.move(self.draft, self.path)
        return self.path, len(null), self.ids, self.doc_ids[0], self.doc_ids[-1]


class Reader:
    """Documents of one token file; decompresses the frames that the asked documents lie in, and checks them."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.path, self.file = path, fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{path} has no seek table with checksums")
        start = size - 9 - 12 * n - 8
        if struct.unpack("<II", self.file.read_at(8, start)) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError(f"{path} has a broken seek table")
        self.frames = np.frombuffer(self.file.read_at(12 * n, start + 8), "<u4").reshape(n, 3).astype(np.int64)
        self.places = np.concatenate([[0], self.frames[:, 0].cumsum()])
        self.offsets = np.concatenate([[0], self.frames[:, 1].cumsum()])
        index = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(self.frames[-1, 0]) - 8, int(self.places[-2]) + 8))
        (docs,) = struct.unpack_from("<Q", index)
        ids, null = np.frombuffer(index, "<i8", docs, 8), np.frombuffer(index, np.uint8, docs, 8 + 8 * docs)
        self.doc_ids = [None if x else d for d, x in zip(ids.tolist(), null.tolist())]
        lengths = np.frombuffer(index, "<u8", docs, 8 + 9 * docs).tolist()
        self.starts = [0, *accumulate(lengths)]
        self.opened, self._held = 0, (-1, b"")

    def _frame(self, i: int) -> bytes:
        if self._held[0] != i:
            data = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(self.frames[i, 0]), int(self.places[i])))
            if len(data) != self.frames[i, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames[i, 2]:
                raise ValueError(f"frame {i} of {self.path} does not match its checksum")
            self.opened += 1
            self._held = (i, data)
        return self._held[1]

    def ids(self, k: int) -> bytes:
        """The ids of the document at place ``k``."""
        a, b = 4 * self.starts[k], 4 * self.starts[k + 1]
        first = int(np.searchsorted(self.offsets, a, "right")) - 1
        out = []
        while a < b:
            data, at = self._frame(first), a - int(self.offsets[first])
            out.append(data[at : at + b - a])
            a += len(out[-1])
            first += 1
        return b"".join(out)


def write(docs: DataFrame, folder: str, json_path: str, end: int = 1) -> DataFrame:
    """Write the ids of all ``docs`` (doc_id, text), each closed by ``end``, in ascending doc_id; returns the files written.

    Null texts count as empty and give one id; rows without an id come first; rows that repeat an id follow one another,
    in order of their texts' hashes. Extra columns are not read. An empty table writes no file and gives no row. The result: file (from
    0, in order), path, docs, ids, first_id, last_id of every file, also kept as Parquet in the folder. A task writes
    under a draft name and renames, so a task that runs again leaves the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, closing = encoder(json_path), struct.pack("<I", end)
        fs, root = store(folder)
        part, rows, now = TaskContext.get().partitionId(), [], None

        def done() -> None:
            rows.append((part * 1_000_000 + len(rows), *now.close()))

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1))):
                now = now or Writer(fs, f"{root}/ids-{part:06d}-{len(rows):06d}.zst")
                now.add(doc, ids + closing)
                if now.ids >= FILE_IDS:
                    done()
                    now = None
        if now:
            done()
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "path", "docs", "ids", "first_id", "last_id"])

    fs, root = store(folder)
    fs.create_dir(root, recursive=True)
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = arrow_map(placed, run, MANIFEST)
    path = posixpath.join(folder, "_files")
    found.write.mode("overwrite").parquet(path)
    return files(docs.sparkSession, folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder as ``write`` returned them, and ``start``: the ids of all files before."""
    found = spark.read.schema(MANIFEST).parquet(posixpath.join(folder, "_files"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file of 64 MB
    return found.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _wanted(files: DataFrame, doc_ids: DataFrame | None) -> DataFrame:
    if doc_ids is None:
        return files.select("path", "start", F.lit(None).cast("array<long>").alias("only"))
    ids = doc_ids.select(F.col(doc_ids.columns[0]).cast("long").alias("want")).where("want IS NOT NULL").distinct()
    small = broadcast_if(fits(files, BROADCAST_ROWS), files)
    met = ids.join(small, F.col("want").between(F.coalesce("first_id", F.lit(-(1 << 63))), F.col("last_id")))
    return met.groupBy("path", "start").agg(F.sort_array(F.collect_list("want")).alias("only"))  # at most the documents of a file


def read(files: DataFrame, doc_ids: DataFrame | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian bytes), read back from ``files``.

    ``doc_ids``, a table of one column, asks for some documents: only files whose range holds one are opened, and only the
    frames they lie in decompressed; ids that no file holds have no row, nor has null. Every frame is held against its checksum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base, only in zip(*(b.column(i).to_pylist() for i in range(3))):
                fs, at = store(path)
                file, wanted = Reader(fs, at), None if only is None else set(only)
                places = [k for k, d in enumerate(file.doc_ids) if wanted is None or d in wanted]
                for i in range(0, len(places), 256):
                    some = places[i : i + 256]
                    starts = np.array([file.starts[k] for k in some] + [0], np.int64)[:-1]
                    lengths = np.array([file.starts[k + 1] for k in some] + [0], np.int64)[:-1] - starts
                    ids = pa.array([file.ids(k) for k in some], pa.large_binary())
                    yield pa.RecordBatch.from_arrays([pa.array([file.doc_ids[k] for k in some], pa.int64()), pa.array(starts + base), pa.array(lengths), ids.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return arrow_map(_wanted(files, doc_ids).repartition("path"), run, "doc_id long, start long, n_tokens long, ids binary")


def ids_crc32(ids: str = "ids") -> Column:
    return F.crc32(F.col(ids))


def round_trip(docs: DataFrame, json_path: str, end: int = 1, folder: str | None = None) -> DataFrame:
    """Write ``docs`` to token files below the session's shared folder and read all of them back."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    return read(write(docs, folder, json_path, end))
