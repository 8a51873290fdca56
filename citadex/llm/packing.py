"""Packing tokenized documents into sequences by best-two-fit."""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadex.llm.common import arrow_map, settle, ship

#: Pieces that one task packs; shards are dealt by hash, so the loss is under one sequence a shard.
SHARD_PIECES = 16_384
END = 0
_BLANKS = re.compile(r"\s\s")
#: The word pattern without its look-ahead, which matters only where white space meets white space.
_SIMPLE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_encoders: dict[tuple, object] = {}


class Encoder:
    """Ids of a text as little-endian bytes: by tokenizers, or faster and alike by tiktoken from the same vocabulary."""

    def __init__(self, json_path: str, ranks_path: str | None = None) -> None:
        with open(json_path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        self.json_path = json_path
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("plain", pat_str=_SIMPLE, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def __call__(self, text: str) -> bytes:
        if self.fast and not _BLANKS.search(text) and not any(s in text for s in self.special):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()


def encoder(json_path: str, ranks_path: str | None = None) -> Encoder:
    key = (json_path, ranks_path)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, the first may be shorter."""
    first = n % limit or limit
    return [(0, first)] + [(at, limit) for at in range(first, n, limit)]


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document, null texts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        closing = array("I", [END]).tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text or "") + closing
                view = memoryview(ids)
                rows += [(doc, i, at, n, zlib.crc32(view[4 * at : 4 * (at + n)])) for i, (at, n) in enumerate(cut(len(ids) // 4, limit))]
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _pair(present: np.ndarray, counts: np.ndarray, gap: int, above: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is the largest up to ``gap``, if it is more than ``above``."""
    below = np.maximum.accumulate(np.where(present[: gap + 1], np.arange(gap + 1), 0))
    a = np.flatnonzero(present[: gap // 2 + 1])
    b = below[gap - a]
    lone = (a == b) & (counts[a] < 2)
    b[lone] = below[b[lone] - 1]
    total = np.where(b > 0, a + b, 0)
    if not len(total):
        return None
    best = int(np.argmax(total))
    return (int(a[best]), int(b[best])) if total[best] > above else None


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The lengths of each sequence.

    A sequence is filled greedily with the longest length that fits. Then, as long as it helps, its shortest length goes
    back and the two unpacked ones take its place that fill the gap most tightly.
    """
    counts = np.bincount(lengths, minlength=capacity + 1)
    if len(counts) > capacity + 1 or counts[0]:
        raise ValueError("lengths must lie between 1 and the capacity")
    out = [[capacity]] * int(counts[capacity])
    counts[capacity] = 0
    present = counts > 0
    left = np.flatnonzero(present).tolist()

    def take(n: int) -> None:
        counts[n] -= 1
        if not counts[n]:
            present[n] = False
            left.pop(bisect_right(left, n) - 1)

    while left:
        now, gap = [], capacity
        while left and left[0] <= gap:
            n = left[bisect_right(left, gap) - 1]
            take(n)
            now.append(n)
            gap -= n
        while gap and left and 2 * left[0] <= gap + min(now):
            least = min(now)
            two = _pair(present, counts, gap + least, least)
            if not two:
                break
            now.remove(least)
            for n in two:
                take(n)
                now.append(n)
            gap = capacity - sum(now)
            counts[least] += 1
            if not present[least]:
                present[least] = True
                left.insert(bisect_right(left, least), least)
            while left and left[0] <= gap:
                n = left[bisect_right(left, gap) - 1]
                take(n)
                now.append(n)
                gap -= n
        out.append(now)
    return out


def _pack(limit: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lengths = rows.column("length").to_numpy()
        order = np.argsort(lengths, kind="stable")
        at = np.searchsorted(lengths[order], np.arange(limit + 1)).tolist()
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for i, seq in enumerate(best_two_fit(lengths, limit)):
            place = 0
            for n in seq:
                row = order[at[n]]
                at[n] += 1
                sequence[row], offset[row] = i, place
                place += n
        sequence += key[0].as_py() << 32
        return rows.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, limit: int = 2048) -> DataFrame:
    """Every piece of every row of ``docs`` with its place in a sequence of at most ``limit`` tokens.

    A document is its ids, then id 0; null texts are empty, that is one id. Only longer documents are cut. Returns doc_id,
    piece, start, length, ids_crc32, sequence_id, offset. Repeated rows are packed each for itself; columns beyond doc_id
    and text do not matter; an empty table gives an empty one. Pieces are dealt by hash over tasks of about
    ``SHARD_PIECES``, so that no task grows with the input.
    """
    ship(docs.sparkSession)
    found = settle(pieces(docs, json_path, ranks_path, limit))
    shards = max(1, math.ceil(found.count() / SHARD_PIECES))
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("shard").applyInArrow(_pack(limit), schema)
