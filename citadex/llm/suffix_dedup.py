"""Repeated byte strings by a distributed sort of sparse suffixes.

Every string of ``LENGTH`` bytes holds the least hash of its ``GRAM``-byte grams at a place that depends on its bytes alone;
only suffixes that start at such anchors are considered. An anchor whose gram occurs once lies in no repeat. One whose
whole surroundings occur earlier lies in a repeat all over. What is left, the first of several surroundings around one gram,
is decided by sorting: tasks write sorted runs of suffixes, front-coded, ranges of all runs are merged by loser trees that
carry common prefixes along and never compare a known one again, and neighbours' common prefixes to the right, with those of
the sorted left sides, tell which of the ``LENGTH``-byte strings around an anchor start earlier elsewhere.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadex.llm.common import arrow_map, settle
from citadex.sizes import BROADCAST_ROWS, broadcast_if

LENGTH = 100
GRAM = 50
#: How far a string may reach to the left of the gram it is anchored at, and to the right of it.
SIDE = LENGTH - GRAM
#: Bytes of text whose anchors one task holds at a time, and a task of the first exchange receives.
TASK_BYTES = 12 << 20
#: Different surroundings of one gram beyond which its strings are sorted each for itself.
GROUP = 20_000
#: Suffixes that one merge aims at.
MERGE = 40_000
#: Positions in lists beside which a broadcast is hinted, about 16 MB.
BROADCAST_NUMBERS = 4_000_000
#: Documents whose anchors show which grams are frequent and how suffixes spread; steers the work, not the result.
SAMPLE = 4_096
_BASE = 0x100000001B3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial that all window hashes are taken from."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _power_tables(len(values) + 1)[0][: len(values)])])


def _windows(sums: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of ``width`` values."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = (sums[width:] - sums[:-width]) * _power_tables(len(sums))[1][:n]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def _slide(values: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every window of ``width`` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = op(values[:-step], values[step:])
        done += step
    return values


def anchors(text: bytes, piece: int = 4 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a text's anchors, hashes of their grams and of their whole surroundings.

    Long texts are read in pieces that overlap by more than an anchor depends on.
    """
    n, margin = len(text), 2 * (LENGTH + SIDE)
    if n <= piece:
        return _anchors(text)
    found = []
    for a in range(0, n, piece):
        low = max(0, a - margin)
        at, gram, around = _anchors(text[low : a + piece + margin])
        mine = (at + low >= a) & (at + low < a + piece)
        found.append((at[mine] + low, gram[mine], around[mine]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(text)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    width = SIDE + 1
    padded = np.zeros(n + 2 * SIDE, np.uint64)
    padded[SIDE:-SIDE] = np.frombuffer(text, np.uint8)
    padded[SIDE:-SIDE] += np.uint64(1)  # the padding is no byte
    sums = _sums(padded)
    grams = _windows(sums, GRAM)[SIDE : SIDE + n - GRAM + 1]
    least = _slide(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum) == grams)
    return at, grams[at], _windows(sums, GRAM + 2 * SIDE)[at]


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as compressed bytes."""
    return zlib.compress(struct.pack("<q", len(columns[0])) + b"".join(np.ascontiguousarray(c).tobytes() for c in columns), 1)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zlib.decompress(blob)
    n, at, out = struct.unpack_from("<q", raw)[0], 8, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


SETTLED, OPEN, FREQUENT = 0, 1, 2
_ROW = (np.uint64, np.uint64, np.int64, np.int32)


def _first_of_equal(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """True for sorted rows that differ from the row before."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for c in columns:
            s = c[order]
            new[1:] |= s[1:] != s[:-1]
    return new


def _deal(parts: int, frequent: frozenset[int]):
    """Anchors of whole texts, equal surroundings of a task reduced to their first, packed by target."""
    hot = np.array(sorted(frequent), np.uint64)

    def pack(held: list) -> Iterator[pa.RecordBatch]:
        gram, around, doc, at = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((at, doc, around, gram))
        first = _first_of_equal(order, gram, around)
        again, keep = order[~first], order[first]
        target = gram[keep] % np.uint64(parts)
        if len(hot):
            often = np.isin(gram[keep], hot)
            target[often] = around[keep][often] % np.uint64(parts)
        rows: list[tuple[int, int, bytes]] = []
        by = np.lexsort((at[keep], doc[keep], target))
        keep, target = keep[by], target[by]
        bounds = np.searchsorted(target, np.arange(parts + 1, dtype=np.uint64))
        for p in range(parts):
            k = keep[bounds[p] : bounds[p + 1]]
            if len(k):
                rows.append((p, OPEN, _pack(gram[k], around[k], doc[k], at[k].astype(np.int32))))
        again = again[np.lexsort((at[again], doc[again]))]
        for i, k in enumerate(np.array_split(again, max(1, min(parts, len(again) // 5000)))):
            if len(k):
                rows.append((int(doc[k[0]] + i) % parts, SETTLED, _pack(doc[k], at[k].astype(np.int32))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["part", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, gram, around = anchors(text)
                if len(at):
                    held.append((gram, around, np.full(len(at), rid, np.int64), at))
                    size += len(text)
                if size > TASK_BYTES:
                    yield from pack(held)
                    held, size = [], 0
        if held:
            yield from pack(held)

    return run


def _decide(parts: int, frequent: frozenset[int]):
    """Anchors whose surroundings start earlier, and those that sorting has to decide, packed by hash of their document."""
    hot = np.array(sorted(frequent), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, places = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for b in batches:
            for kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if kind == SETTLED:
                    d, p = _unpack(blob, np.int64, np.int32)
                    docs.append(d)
                    places.append(p)
                else:
                    held.append(_unpack(blob, *_ROW))
        kinds = [np.zeros(sum(map(len, docs)), np.int32)]
        if held:
            gram, around, doc, at = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((at, doc, around, gram))
            first = _first_of_equal(order, gram, around)
            again, keep = order[~first], order[first]
            docs.append(doc[again])
            places.append(at[again])
            kinds.append(np.full(len(again), SETTLED, np.int32))
            # Of the first ones, those count whose gram has other surroundings, too.
            starts = np.flatnonzero(_first_of_equal(keep, gram))
            size = np.repeat(np.diff(np.r_[starts, len(keep)]), np.diff(np.r_[starts, len(keep)]))
            often = np.isin(gram[keep], hot) if len(hot) else np.zeros(len(keep), bool)
            for kind, which in ((FREQUENT, often | (size > GROUP)), (OPEN, ~often & (size > 1) & (size <= GROUP))):
                docs.append(doc[keep[which]])
                places.append(at[keep[which]])
                kinds.append(np.full(int(which.sum()), kind, np.int32))
        doc, place, kind = np.concatenate(docs), np.concatenate(places), np.concatenate(kinds)
        target = doc.view(np.uint64) * _MIX >> np.uint64(33)
        target %= np.uint64(parts)
        order = np.lexsort((place, doc, target))
        bounds = np.searchsorted(target[order], np.arange(parts + 1, dtype=np.uint64))
        rows = [(p, _pack(doc[k], place[k], kind[k])) for p in range(parts) if len(k := order[bounds[p] : bounds[p + 1]])]
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), (pa.int32(), pa.binary()))], ["part", "blob"])

    return run


def _lists(rid: np.ndarray, ids: np.ndarray, *values: np.ndarray) -> list[pa.ListArray]:
    """One list of each column's values for each of ``ids``; both are sorted."""
    offsets = pa.array(np.r_[np.searchsorted(rid, ids), len(rid)].astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in values]


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: open and frequent anchors, and the joined stretches of the settled ones."""
    held = [_unpack(blob, np.int64, np.int32, np.int32) for b in batches for blob in b.column(1).to_pylist()]
    if not held:
        return
    doc, at, kind = (np.concatenate(c) for c in zip(*held))
    held.clear()
    order = np.lexsort((at, doc))
    doc, at, kind = doc[order], at[order], kind[order]
    d, p = doc[kind == SETTLED], at[kind == SETTLED].astype(np.int64)
    start, end = np.maximum(p - SIDE, 0), p + GRAM + SIDE
    fresh = np.r_[True, (d[1:] != d[:-1]) | (start[1:] > end[:-1])] if len(d) else np.zeros(0, bool)
    last = np.r_[fresh[1:], True] if len(d) else fresh
    ids = np.unique(doc)
    for a in range(0, len(ids), 4096):
        some = ids[a : a + 4096]
        within = lambda x: (x >= some[0]) & (x <= some[-1])  # noqa: E731, B023
        columns = [pa.array(some)]
        for k in (OPEN, FREQUENT):
            mine = (kind == k) & within(doc)
            columns += _lists(doc[mine], some, at[mine])
        mine = fresh & within(d)
        columns += _lists(d[mine], some, start[mine], end[last & within(d)])
        yield pa.RecordBatch.from_arrays(columns, ["rid", "at", "often", "starts", "ends"])


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are not looked at again."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


def front_coded(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of sorted keys: common prefixes with the key before, lengths of the rests, and the rests."""
    shared = [0] + [common(a, b) for a, b in zip(keys, keys[1:])]
    rests = [k[s:] for k, s in zip(keys, shared)]
    return np.array(shared, np.uint8), np.array([len(r) for r in rests], np.uint8), b"".join(rests)


def decoded(shared: np.ndarray, lengths: np.ndarray, rests: bytes) -> list[bytes]:
    keys, key, at = [], b"", 0
    for s, n in zip(shared.tolist(), lengths.tolist()):
        key = key[:s] + rests[at : at + n]
        at += n
        keys.append(key)
    return keys


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs (keys, common prefixes with the key before) by a loser tree.

    Returns (run, index) in order and each key's common prefix with the one before. A contender carries its common prefix
    with the last key given out; the longer one wins, and only of equal ones bytes beyond it are compared.
    """
    width = 1 << max(0, len(runs) - 1).bit_length()
    at = [0] * width
    size = [len(k) for k, _ in runs] + [0] * (width - len(runs))
    known = [0 if n else -1 for n in size]
    head = [k[0] if k else b"" for k, _ in runs] + [b""] * (width - len(runs))

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser then carries its common prefix with the winner."""
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        p, q = head[a], head[b]
        h = common(p, q, x)
        if p < q or p == q and a < b:
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    losers = [0] * width
    winners = list(range(width))
    node = width
    while len(winners) > 1:
        node //= 2
        level = []
        for i in range(node):
            w, losers[node + i] = play(winners[2 * i], winners[2 * i + 1])
            level.append(w)
        winners = level
    w = winners[0]
    order, shared = [], []
    for _ in range(sum(size)):
        order.append((w, at[w]))
        shared.append(known[w])
        at[w] += 1
        if at[w] < size[w]:
            keys, prefixes = runs[w]
            head[w], known[w] = keys[at[w]], prefixes[at[w]]
        else:
            known[w] = -1
        node = (width + w) // 2
        while node:
            w, losers[node] = play(w, losers[node])
            node //= 2
    return order, shared


def _run_rows(splits: list[bytes], held: list[tuple[bytes, bytes, int, int]], strings: bool) -> list[tuple[int, bytes]]:
    """One sorted run, cut at the splits: (part, front-coded block)."""
    held.sort()
    cuts = [bisect_right(splits, h[0][:GRAM] if not strings else h[0]) for h in held]
    rows, a = [], 0
    while a < len(held):
        b = bisect_right(cuts, cuts[a], a)
        block = held[a:b]
        shared, lengths, rests = front_coded([h[0] for h in block])
        lefts = [h[1] for h in block]
        columns = (shared, lengths, np.array([len(x) for x in lefts], np.uint8), np.array([h[2] for h in block], np.int64), np.array([h[3] for h in block], np.int32))
        body = _pack(*columns)
        tail = zlib.compress(rests + b"".join(lefts), 1)
        rows.append((cuts[a], struct.pack("<qq", len(body), len(rests)) + body + tail))
        a = b
    return rows


def _first_strings(held: list[tuple[bytes, bytes, int, int]]) -> tuple[list[tuple[bytes, bytes, int, int]], list[tuple[int, int]]]:
    """Of equal strings the first, so that a run never repeats one; and where the others start."""
    held.sort()
    first, again = [], []
    for i, h in enumerate(held):
        if not i or held[i - 1][0] != h[0]:
            first.append(h)
        elif held[i - 1][2:] != h[2:]:  # two anchors may share a string of one place
            again.append(h[2:])
    return first, again


def _runs(splits: list[bytes], frequent_splits: list[bytes]):
    """Sorted, front-coded runs of the suffixes at open anchors, and of the strings at frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes: list[tuple[bytes, bytes, int, int]] = []
        strings: list[tuple[bytes, bytes, int, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, held, cuts in ((OPEN, suffixes, splits), (FREQUENT, strings, frequent_splits)):
                if held:
                    offset = 0 if kind == OPEN else len(splits) + 1
                    run, again = _first_strings(held) if kind == FREQUENT else (held, [])
                    if again:
                        blob = _pack(*(np.array(c, np.int64) for c in zip(*again)))
                        part = offset + zlib.crc32(blob) % (len(cuts) + 1)
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([SETTLED], pa.int32()), pa.array([blob])], ["part", "kind", "blob"])
                    rows = _run_rows(cuts, run, kind == FREQUENT)
                    held.clear()
                    for i in range(0, len(rows), 64):
                        parts = pa.array([r[0] + offset for r in rows[i : i + 64]], pa.int32())
                        yield pa.RecordBatch.from_arrays([parts, pa.array([kind] * len(parts), pa.int32()), pa.array([r[1] for r in rows[i : i + 64]], pa.binary())], ["part", "kind", "blob"])

        for b in batches:
            for rid, text, at, often in zip(*(b.column(i).to_pylist() for i in range(4))):
                for p in at or ():
                    suffixes.append((text[p : p + LENGTH], text[max(0, p - SIDE) : p][::-1], rid, p))
                for p in often or ():
                    for s in range(max(0, p - SIDE), min(p, len(text) - LENGTH) + 1):
                        strings.append((text[s : s + LENGTH], b"", rid, s))
                if len(suffixes) + len(strings) > 400_000:
                    yield from flush()
        yield from flush()

    return run


def _read_block(blob: bytes) -> tuple[list[bytes], list[int], list[bytes], np.ndarray, np.ndarray]:
    size, rest = struct.unpack_from("<qq", blob)
    shared, lengths, left_lengths, rid, at = _unpack(blob[16 : 16 + size], np.uint8, np.uint8, np.uint8, np.int64, np.int32)
    tail = zlib.decompress(blob[16 + size :])
    ends = (rest + np.cumsum(left_lengths.astype(np.int64))).tolist()
    lefts = [tail[a:b] for a, b in zip([rest, *ends], ends)]
    return decoded(shared, lengths, tail[:rest]), shared.tolist(), lefts, rid, at


def _classes(shared: np.ndarray, depth: int) -> np.ndarray:
    return np.cumsum(shared < depth)


def repeated(keys: list[bytes], shared: np.ndarray, lefts: list[bytes], rid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For sorted suffixes: whether the string that starts ``o`` bytes before each anchor starts earlier, too, by o.

    Two anchors share that string if they agree in ``o`` bytes to the left and ``LENGTH - o`` to the right. Either side is
    sorted, so that agreeing means having no shorter common prefix in between.
    """
    n = len(keys)
    group = _classes(shared, GRAM)
    left = np.zeros((n, 56), np.uint8)
    for i, x in enumerate(lefts):
        left[i, : len(x)] = np.frombuffer(x, np.uint8)
    words = left.view(">u8")
    order = np.lexsort((*words.T[::-1], group))
    same = left[order][1:] == left[order][:-1]
    agree = np.where(same.all(axis=1), SIDE, np.minimum(same.argmin(axis=1), SIDE))
    agree = np.r_[-1, np.where(group[order][1:] == group[order][:-1], agree, -1)]
    left_room = np.array([len(x) for x in lefts])
    right_room = np.array([len(k) for k in keys])
    age = np.empty(n, np.int64)
    age[np.lexsort((at, rid))] = np.arange(n)
    hit = np.zeros((n, SIDE + 1), bool)
    for o in range(SIDE + 1):
        has = np.flatnonzero((left_room >= o) & (right_room >= LENGTH - o))
        if len(has) < 2:
            continue
        by_left = np.empty(n, np.int64)
        by_left[order] = _classes(agree, o)
        pair = by_left[has] * np.int64(n + 1) + _classes(shared, LENGTH - o)[has]
        rank = np.lexsort((age[has], pair))
        hit[has[rank], o] = ~_first_of_equal(rank, pair)
    return hit


def _stretches(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["rid", "start", "end"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge all blocks of a range and tell the repeated strings: rid, start, end."""
    blocks: dict[int, list] = {OPEN: [], FREQUENT: []}
    for b in batches:
        for kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            if kind == SETTLED:
                doc, start = _unpack(blob, np.int64, np.int64)
                yield _stretches(doc, start, start + LENGTH)
            else:
                blocks[kind].append(_read_block(blob))
    for kind, found in blocks.items():
        if not found:
            continue
        order, shared = merge_runs([(keys, prefixes) for keys, prefixes, *_ in found])
        shared = np.array(shared)
        rid = np.array([found[r][3][i] for r, i in order])
        at = np.array([found[r][4][i] for r, i in order]).astype(np.int64)
        if kind == OPEN:
            keys = [found[r][0][i] for r, i in order]
            hit = repeated(keys, shared, [found[r][2][i] for r, i in order], rid, at)
            edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, low = np.nonzero(edge == 1)
            high = np.nonzero(edge == -1)[1] - 1
            start, end, doc = at[row] - high, at[row] - low + LENGTH, rid[row]
        else:
            group = _classes(shared, LENGTH)
            rank = np.lexsort((at, rid, group))
            again = rank[~_first_of_equal(rank, group)]
            start, end, doc = at[again], at[again] + LENGTH, rid[again]
        yield _stretches(doc, start, end)


def _keyed(docs: DataFrame, id_column: str) -> DataFrame:
    """rid, row, t (bytes): a unique number in the order of the ids, the other columns, and the text.

    The ids themselves serve if they are unique and not null; else the rows are numbered in a written table, in the order of
    id, null last, and text.
    """
    row = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    rows = docs.select(F.col(id_column).alias("id"), row, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t"))
    unusable = rows.groupBy("id").count().where("count > 1 OR id IS NULL").limit(1).count()
    if not unusable:
        return rows.select(F.col("id").alias("rid"), "row", "t")
    order = [F.col("id").asc_nulls_last(), F.col("t")]
    return settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("rid"), "row", "t"))


def _sampled(docs: DataFrame, total: int) -> tuple[frozenset[int], list[bytes]]:
    """Frequent grams and a spread of grams from at most about ``SAMPLE`` documents."""
    modulus = max(1, math.ceil(total / SAMPLE))
    chosen = docs.where(F.pmod(F.xxhash64("rid"), F.lit(modulus)) == 0).select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                at, gram, _ = anchors(text)
                if len(at):
                    where = np.unique(gram, return_index=True)
                    spread = [text[p : p + GRAM] for p in at[:: max(1, len(at) // 8)].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([where[0].view(np.int64).tolist()], pa.list_(pa.int64())), pa.array([spread], pa.list_(pa.binary()))], ["grams", "spread"])

    found = settle(arrow_map(chosen, run, "grams array<long>, spread array<binary>"))
    often = found.select(F.explode("grams").alias("gram")).groupBy("gram").count().where(F.col("count") >= max(32, SAMPLE // 64))
    frequent = frozenset(r.gram & (1 << 64) - 1 for r in often.select("gram").collect())
    spread = sorted(bytes(r.g) for r in found.select(F.explode("spread").alias("g")).collect())
    return frequent, spread


def _quantiles(values: list[bytes], parts: int) -> list[bytes]:
    if parts < 2 or not values:
        return []
    return sorted({values[len(values) * i // parts] for i in range(1, parts)})


def repeats(docs: DataFrame) -> DataFrame:
    """rid, starts, ends: the stretches of each text of ``docs`` (rid, t) that repeat earlier ones, overlapping or not."""
    total, size = docs.agg(F.count("*"), F.sum(F.length("t"))).first()
    parts = max(4, math.ceil((size or 0) / TASK_BYTES))
    frequent, spread = _sampled(docs, total)
    dealt = arrow_map(docs.select("rid", "t"), _deal(parts, frequent), "part int, kind int, blob binary").repartitionById(parts, F.col("part"))
    decided = arrow_map(dealt, _decide(parts, frequent), "part int, blob binary").repartitionById(parts, F.col("part"))
    found = settle(arrow_map(decided, _by_document, "rid long, at array<int>, often array<int>, starts array<int>, ends array<int>"))
    n_open, n_often = found.agg(F.sum(F.size("at")), F.sum(F.size("often"))).first()
    splits = _quantiles(spread, max(1, math.ceil((n_open or 0) / MERGE)))
    frequent_splits = _quantiles(spread, max(1, math.ceil((n_often or 0) * SIDE / MERGE)))
    todo = found.where((F.size("at") > 0) | (F.size("often") > 0)).select("rid", "at", "often")
    joined = docs.join(_if_light(todo, "at", "often"), "rid").select("rid", "t", "at", "often")
    ranges = len(splits) + len(frequent_splits) + 2
    runs = arrow_map(joined, _runs(splits, frequent_splits), "part int, kind int, blob binary").repartitionById(ranges, F.col("part"))
    sorted_out = arrow_map(runs, _merge, "rid long, start int, end int")
    single = sorted_out.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("s")).select("rid", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))
    every = found.where(F.size("starts") > 0).select("rid", "starts", "ends").unionByName(single)
    return every.groupBy("rid").agg(F.collect_list(F.struct("starts", "ends")).alias("s")).select("rid", F.flatten("s.starts").alias("starts"), F.flatten("s.ends").alias("ends"))


def _if_light(lists: DataFrame, *columns: str) -> DataFrame:
    """Hint a broadcast if rows and all numbers in the lists are few enough."""
    rows, numbers = lists.agg(F.count("*"), F.sum(sum((F.size(c) for c in columns), F.lit(0)))).first()
    return broadcast_if(rows <= BROADCAST_ROWS and (numbers or 0) <= BROADCAST_NUMBERS, lists)


def kept_mask(n: int, starts: list[int] | None, ends: list[int] | None) -> np.ndarray:
    """Which bytes of a text stay."""
    step = np.zeros(n + 1, np.int64)
    if starts is not None and len(starts):
        np.add.at(step, np.asarray(starts), 1)
        np.add.at(step, np.minimum(np.asarray(ends), n), -1)
    return np.cumsum(step[:n]) == 0


def _cut(as_text: bool):
    """Apply the stretches: counts and what stays, as bytes or as text."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, starts, ends in zip(*(b.column(i).to_pylist() for i in range(1, 4))):
                keep = kept_mask(len(text), starts, ends)
                runs = int(np.count_nonzero(np.diff(np.r_[True, keep].astype(np.int8)) == -1))
                kept = text if not runs else np.frombuffer(text, np.uint8)[keep].tobytes()
                out.append((len(text), len(text) - len(kept), runs, kept.decode("utf-8", "ignore") if as_text else kept))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def dedup(docs: DataFrame, doc_id: str = "doc_id", as_text: bool = False) -> DataFrame:
    """row, n_bytes, n_removed, n_spans, kept (bytes, or text) of every row of ``docs``; row holds its columns but the text.

    Removed is each byte under a string of ``LENGTH`` bytes that also starts earlier: in a document of smaller id or further
    ahead in the same one. Strings are judged on the input. Null texts are empty. Rows that share an id are documents of
    their own in the order of their texts; rows without an id come last. Texts under ``LENGTH`` bytes stay whole; columns
    beyond the id and text do not matter; an empty table gives an empty one.
    """
    keyed = _keyed(docs, doc_id)
    found = settle(repeats(keyed.select("rid", "t")))
    joined = keyed.join(_if_light(found, "starts", "ends"), "rid", "left").select("row", "t", "starts", "ends")
    row = joined.schema["row"].dataType.simpleString()
    kept = "string" if as_text else "binary"
    return arrow_map(joined, _cut(as_text), f"row {row}, n_bytes long, n_removed long, n_spans long, kept {kept}")


def cleaned(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with what ``dedup`` leaves of the texts; n_chars, if there, counts it.

    Bytes of a character that a removed stretch cuts in two go with it. A null text comes out empty; a document of which
    nothing is left stays with an empty text.
    """
    found = dedup(docs, doc_id, as_text=True).select("row", "kept")
    columns = [F.col("kept").alias(c) if c == "text" else F.char_length("kept").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return found.select(*columns)
