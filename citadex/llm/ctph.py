"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes triggers boundaries; each chunk between two boundaries leaves one character of the
signature. The block size sets how often boundaries come; a fingerprint carries the signatures of its block size and of the
next larger one, so that texts whose sizes differ by a factor of two stay comparable.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadex.llm.common import arrow_map, settle

#: Bytes that the rolling hash sees, the least block size, and the chunks a signature aims at.
SPAN, LEAST_BLOCK, CHUNKS = 7, 1, 64
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Signatures without so long a run in common count as unrelated.
COMMON = 4
_RUN = re.compile(r"(.)\1{3,}")


def rolling(b: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the last seven bytes at every position."""
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint32), b.astype(np.uint32)])
    h = np.zeros(len(b), np.uint32)
    for i in range(SPAN):
        h *= np.uint32(0x01000193)
        h ^= padded[i : i + len(b)]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ h >> np.uint32(13)


def _signature(data: bytes, h: np.ndarray, block: int) -> str:
    """One character for each chunk, of a run of equal ones at most three; what follows the last boundary is a chunk too."""
    ends = np.flatnonzero(h % np.uint32(block) == block - 1) + 1
    if not len(ends) or ends[-1] < len(data):
        ends = np.append(ends, len(data))
    at, view, codes = 0, memoryview(data), []
    for end in ends.tolist():
        codes.append(zlib.crc32(view[at:end]) * 0x9E3779B1 >> 26 & 63)
        at = end
    return _RUN.sub(r"\1\1\1", ALPHABET[codes].tobytes().decode())


def fingerprint(data: bytes) -> str:
    """``block:signature:signature at twice the block``; ``0::`` for no bytes.

    The block size depends on the length alone, so that a text and an edited one stay comparable.
    """
    if not data:
        return "0::"
    h = rolling(np.frombuffer(data, np.uint8))
    block = LEAST_BLOCK
    while block * CHUNKS < len(data):
        block *= 2
    return f"{block}:{_signature(data, h, block)}:{_signature(data, h, 2 * block)}"


def edit_distance(a: str, b: str) -> int:
    """Insertions and deletions that turn ``a`` into ``b``, by bit-parallel common subsequence."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        u = row & at.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) + len(b) - 2 * (len(a) - row.bit_count())


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n = min(COMMON, len(a), len(b))
    if not n or {a[i : i + n] for i in range(len(a) - n + 1)}.isdisjoint(b[i : i + n] for i in range(len(b) - n + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / (len(a) + len(b))


def likeness(a: str | None, b: str | None) -> float:
    """0 to 1: one less the edit distance by length, at the block sizes that two fingerprints share; 0 if they share none.

    Equal fingerprints give 1. A missing fingerprint is like nothing.
    """
    if a is None or b is None:
        return 0.0
    if a == b:
        return 1.0
    (x, a1, a2), (y, b1, b2) = (f.split(":") for f in (a, b))
    x, y = int(x), int(y)
    if not x or not y:
        return 0.0
    if x == y:
        return max(_alike(a1, b1), _alike(a2, b2))
    return _alike(a1, b2) if x == 2 * y else _alike(a2, b1) if y == 2 * x else 0.0


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row of ``docs``, from the whole text in UTF-8; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            prints = [fingerprint(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_chars long, fingerprint string")


def _compare(doc_id, text: str, mark: str, following: str, next_mark: str) -> dict:
    changed = edited(text, following)
    data = changed.encode()
    new = mark if changed == text else fingerprint(data)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(data).hexdigest(),
        "fingerprint": mark,
        "edited_fingerprint": new,
        "near_edited": likeness(mark, new),
        "near_next": likeness(mark, next_mark),
    }


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64())] + [(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")] + [(n, pa.float64()) for n in ("near_edited", "near_next")]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a partition's rows but the last, then its first and last row for the seam."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    schema = pa.schema(_FIELDS + [("part", pa.int32()), ("seam", pa.string()), ("text", pa.string())])
    first = last = None
    for b in batches:
        out = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = text or ""
            now = (doc_id, text, fingerprint(text.encode()))
            if last:
                out.append(_compare(*last, *now[1:]))
            first = first or now
            last = now
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if last:
        ends = [{"doc_id": r[0], "text": r[1], "fingerprint": r[2], "part": part, "seam": s} for s, r in (("first", first), ("last", last))]
        yield pa.RecordBatch.from_pylist(ends, schema)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_compare(r["doc_id"], r["text"], r["fingerprint"], r["next_text"], r["next_fingerprint"]) for r in b.to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(_FIELDS))


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text edited with the next document, and how alike they are.

    The next document is the one of the next smaller doc_id, after the last the first; rows of one id follow each other by
    text, rows without an id come last. A single document is its own next. Null texts count as empty, an empty table gives
    an empty one. Texts are range partitioned once by id; every partition compares its neighbours in order, and only its
    first and last row meet those of the next partition.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()]
    rows = docs.select("doc_id", "text").repartitionByRange(order[0]).sortWithinPartitions(*order)
    found = settle(arrow_map(rows, _in_order, f"{_RESULT}, part int, seam string, text string"))
    ends = found.where("seam IS NOT NULL")
    # Two rows a partition: the seams are joined by the number of partitions that have rows.
    parts = sorted(r.part for r in ends.where("seam = 'last'").select("part").collect())
    follows = {p: parts[(i + 1) % len(parts)] for i, p in enumerate(parts)}
    spark = docs.sparkSession
    order_rows = spark.createDataFrame(list(follows.items()) or [(None, None)], "part int, next_part int")
    lasts = ends.where("seam = 'last'").select("doc_id", "text", "fingerprint", "part")
    firsts = ends.where("seam = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    joined = lasts.join(order_rows, "part").join(firsts, "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    inner = found.where("seam IS NULL").select(*[n for n, _ in _FIELDS])
    return inner.unionByName(arrow_map(joined, _seams, _RESULT))
