"""Near duplicates by SimHash and an index of positional bytes.

A fingerprint has eight bytes. Two that differ in at most two bits share at least six of them in place, so at least two
of the four byte pairs agree; postings are therefore kept for two byte pairs at a time, which makes a posting list four
bytes selective and leaves six lists a fingerprint. Within a list the shared positional bytes of a pair are tallied,
pairs below six are dropped, and the rest verified by their differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadex.llm.common import arrow_map, settle, text_bytes
from citadex.llm.components import components
from citadex.sizes import BROADCAST_ROWS, broadcast_if, fits

SEED = 42
#: Fingerprints in a posting list beyond which the list is split by the bits its key leaves out.
LIST_ROWS = 4096
#: Lists up to this length are compared by shifting, longer ones by search.
SHIFT_ROWS = 64


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of one text as an unsigned 64-bit number; zero for a text without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the SimHash of the whole text as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return arrow_map(docs.select("doc_id", text_bytes().alias("t")), run, "doc_id long, fp long")


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """True where enough positional bytes are shared and few enough bits differ."""
    x = a ^ b
    tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    near = tally >= 8 - bits
    near[near] = np.bitwise_count(x[near]) <= bits
    return near


def _spread(fp: np.ndarray, rep: np.ndarray, bits: int) -> tuple[list, list]:
    """Links that span the near groups of one long list: each fingerprint is reached once."""
    src, dst = [], []
    left = np.arange(len(fp))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            hit = _near(np.full(len(left), fp[at]), fp[left], bits)
            found = left[hit]
            if len(found):
                src.append(np.full(len(found), rep[at]))
                dst.append(rep[found])
                todo.extend(found.tolist())
                left = left[~hit]
    return src, dst


def _list_links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        key, fp, rep = (np.concatenate([b.column(i).to_numpy() for b in parts]) for i in range(3))
        order = np.lexsort((fp, key))
        key, fp, rep = key[order], fp[order].view(np.uint64), rep[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        src, dst = [], []
        for s, n in zip(starts[sizes > SHIFT_ROWS], sizes[sizes > SHIFT_ROWS]):
            a, b = _spread(fp[s : s + n], rep[s : s + n], bits)
            src += a
            dst += b
        at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHIFT_ROWS), sizes))
        for shift in range(1, SHIFT_ROWS):
            at = at[at + shift < len(key)]
            at = at[key[at] == key[at + shift]]
            if not len(at):
                break
            hit = at[_near(fp[at], fp[at + shift], bits)]
            src.append(rep[hit])
            dst.append(rep[hit + shift])
        if src:
            pairs = np.unique(np.stack([np.concatenate(src), np.concatenate(dst)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["src", "dst"])

    return run


def _bits(col: str, low: int, width: int):
    return F.shiftrightunsigned(F.col(col), low).bitwiseAND(F.lit((1 << width) - 1))


def near_links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Links (src, dst) between the representatives of fingerprints that differ in at most ``bits`` <= 2 bits.

    ``fps`` has one row per fingerprint: fp and rep. The links span every group of near fingerprints, so components are
    exact; a pair that other links already join may be left out. A list longer than ``LIST_ROWS`` is split further: of
    three parts of the bits outside its key one must agree, and of three parts of what then remains again one, which
    leaves at most 2**15 different fingerprints a list however many rows there are.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the index guarantees matches for at most two differing bits")
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    lists = fps.where("rep IS NOT NULL").select(
        "fp",
        "rep",
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(k).alias("k"),
                        (_bits("fp", 16 * i, 16) * 65536 + _bits("fp", 16 * j, 16)).alias("value"),
                        (_bits("fp", 16 * [x for x in range(4) if x not in (i, j)][0], 16) * 65536 + _bits("fp", 16 * [x for x in range(4) if x not in (i, j)][1], 16)).alias("rest"),
                    )
                    for k, (i, j) in enumerate(pairs)
                )
            )
        ).alias("p"),
    ).select("fp", "rep", (F.col("p.k").cast("long") * (1 << 32) + F.col("p.value")).alias("key"), F.col("p.rest").alias("rest"))
    hot = settle(lists.groupBy("key").count().where(F.col("count") > LIST_ROWS).select("key", F.lit(True).alias("hot")))
    small = fits(hot, BROADCAST_ROWS)
    marked = lists.join(broadcast_if(small, hot), "key", "left")
    parts = ((0, 11), (11, 11), (22, 10))

    def sub_keys():
        for p, (low, width) in enumerate(parts):
            # What remains beside part p, as one number of 21 or 22 bits.
            above = F.shiftrightunsigned(F.col("rest"), low + width)
            below = F.col("rest").bitwiseAND(F.lit((1 << low) - 1))
            remains = above * (1 << low) + below
            for q in range(3):
                piece = F.shiftrightunsigned(remains, 7 * q).bitwiseAND(F.lit(127 if q < 2 else 255))
                yield F.xxhash64(F.col("key"), F.lit(p), _bits("rest", low, width), F.lit(q), piece)

    split = marked.select(F.explode(F.when(F.col("hot"), F.array(*sub_keys())).otherwise(F.array("key"))).alias("key"), "fp", "rep")
    return arrow_map(split.repartition("key"), _list_links(bits), "src long, dst long").distinct()


def simhash_groups(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs``: fingerprints link at ``bits`` or fewer differing bits.

    component_id is the least doc_id that links reach, itself included. Null texts count as empty; texts without words
    have fingerprint zero and link like any other. Rows without an id get a fingerprint and the component of the rows that
    share it, null if none has an id. Repeated rows stay. Other columns of ``docs`` do not matter.
    """
    prints = settle(fingerprints(docs, words))
    reps = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    parts = components(near_links(reps, bits)).select(F.col("node").alias("rep"), "component")
    labelled = reps.join(parts, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(labelled, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row of the least id, once.

    Rows without an id belong to no group and stay.
    """
    groups = simhash_groups(docs, words, bits)
    keep = settle(groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("copies_of_id")))
    out = docs.join(keep.select("doc_id"), "doc_id", "left_semi")
    if keep.where("copies_of_id > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id"])
    return out.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
