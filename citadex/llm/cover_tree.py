"""Hard negatives by cover trees over norm-augmented candidates.

Every candidate gets one more component, the root of what its squared norm lacks to the greatest, so that all have one norm and the
order of inner products is the order of distances. Candidates are dealt to shards by the nearest of a few centres, the
top level; each shard is a cover tree: the children of a node cover it within a radius that shrinks from level to level and
stand farther apart than that. A node of centre c and covering radius r bounds the inner products of a query q below it by
q.c - |q| r and q.c + |q| r. Queries descend level by level, skip nodes outside their window of scores or below their k-th best,
visit the remaining leaves best first, and take exact integer products there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citadex.llm.common import arrow_map, settle
from citadex.sizes import BROADCAST_ROWS, broadcast_if

#: Centres of the top level, drawn by hash: a fixed number, their table is broadcast.
CENTRES = 64
#: Rows of a shard that share a tree; larger parts of the top level are split by hash.
SHARD = 16_384
#: Rows of a leaf, and the factor by which covering radii shrink from level to level.
LEAF, SHRINK = 32, 1.3
#: Partitions that shards are dealt to at most.
TASKS = 20_000
#: Queries that descend together.
QUERIES = 256
#: Greatest absolute product that doubles hold exactly.
EXACT = float(1 << 53)
NONE = -np.iinfo(np.int64).max


class CoverTree:
    """A cover tree over the rows of ``x``; levels are arrays, the rows of a node are a stretch of ``order``."""

    def __init__(self, x: np.ndarray) -> None:
        norms = (x * x).sum(axis=1)
        self.augmented = np.column_stack([x, np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))])
        self.x = x
        self.order = np.arange(len(x))
        #: Per level: first row, end, centre (a row) and covering radius of its nodes, and the node above.
        self.levels: list[tuple[np.ndarray, ...]] = []
        nodes = [(0, len(x), 0, -1)] if len(x) else []
        while nodes:
            first, end, centre, above = (np.array(c, np.int64) for c in zip(*nodes))
            radius = np.array([self._reach(a, b, c) for a, b, c in zip(first, end, centre)])
            self.levels.append((first, end, centre, radius, above))
            nodes = []
            for i, (a, b, c, r) in enumerate(zip(first.tolist(), end.tolist(), centre.tolist(), radius.tolist())):
                if b - a > LEAF and r > 0:
                    nodes += [(*child, i) for child in self._split(a, b, c, r / SHRINK)]

    def _reach(self, a: int, b: int, centre: int) -> float:
        d = self.augmented[self.order[a:b]] - self.augmented[centre]
        return float(np.sqrt((d * d).sum(axis=1).max()))

    def _split(self, a: int, b: int, centre: int, radius: float) -> list[tuple[int, int, int]]:
        """Children of a node: centres more than ``radius`` apart, its own first, and the rows within it of the nearest centre."""
        rows = self.order[a:b].copy()
        y = self.augmented[rows]
        squares = (y * y).sum(axis=1)
        best, owner, centres = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64), []

        def take(new: np.ndarray) -> None:
            d = squares[:, None] + squares[new] - 2.0 * (y @ y[new].T)
            near = d.argmin(axis=1)
            least = d[np.arange(len(rows)), near]
            closer = least < best
            best[closer], owner[closer] = least[closer], near[closer] + len(centres)
            best[new], owner[new] = -1.0, len(centres) + np.arange(len(new))
            centres.extend(new.tolist())

        take(np.flatnonzero(rows == centre)[:1])
        limit = radius * radius
        while True:
            open_ = np.flatnonzero(best > limit)
            if not len(open_):
                break
            some = open_[np.argsort(-best[open_], kind="stable")[:64]]
            apart = squares[some][:, None] + squares[some] - 2.0 * (y[some] @ y[some].T) > limit
            chosen: list[int] = []
            for i in range(len(some)):
                if apart[i, chosen].all():
                    chosen.append(i)
            take(some[chosen])
        by_owner = np.argsort(owner, kind="stable")
        self.order[a:b] = rows[by_owner]
        bounds = a + np.concatenate([[0], np.bincount(owner, minlength=len(centres)).cumsum()])
        return [(int(bounds[i]), int(bounds[i + 1]), int(rows[c])) for i, c in enumerate(centres)]

    def leaves(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """query, leaf and upper bound of the leaves that may hold a product in each query's window, level by level.

        A leaf is its first row and end in ``order``, packed as a number of the level and its node.
        """
        length = np.sqrt((q * q).sum(axis=1))
        slack = 1e-9 * (1.0 + length)
        alive_q = np.arange(len(q))
        alive_n = np.zeros(len(q), np.int64)
        for depth, (first, end, centre, radius, above) in enumerate(self.levels):
            middle = q @ self.x[centre].T
            if depth:
                under = np.argsort(above, kind="stable")
                counts = np.bincount(above, minlength=len(self.levels[depth - 1][0]))
                begins = counts.cumsum() - counts
                n = counts[alive_n]
                at = np.repeat(begins[alive_n] - (n.cumsum() - n), n) + np.arange(n.sum())
                alive_q, alive_n = np.repeat(alive_q, n), under[at]
            m, reach = middle[alive_q, alive_n], length[alive_q] * radius[alive_n] + slack[alive_q] * (1.0 + radius[alive_n])
            inside = (m + reach >= low[alive_q]) & (m - reach <= high[alive_q])
            alive_q, alive_n, upper = alive_q[inside], alive_n[inside], (m + reach)[inside]
            is_leaf = (end - first <= LEAF) | (radius == 0)
            ended = is_leaf[alive_n]
            if ended.any():
                yield alive_q[ended], depth * (1 << 40) + alive_n[ended], upper[ended]
            alive_q, alive_n = alive_q[~ended], alive_n[~ended]
            if not len(alive_q):
                return

    def stretch(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of packed leaves."""
        depth, node = leaf >> 40, leaf & ((1 << 40) - 1)
        out = np.zeros((2, len(leaf)), np.int64)
        for d in np.unique(depth):
            here = depth == d
            out[:, here] = self.levels[d][0][node[here]], self.levels[d][1][node[here]]
        return out[0], out[1]


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products of the paired rows, whole also beyond what doubles hold."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= EXACT:
        return (q.astype(np.int64) * x.astype(np.int64)).sum(axis=1)
    return np.einsum("ij,ij->i", q, x).astype(np.int64)


def _merge(scores: np.ndarray, ids: np.ndarray, new_scores: np.ndarray, new_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first of each row by score, ties by smaller id."""
    s, i = np.concatenate([scores, new_scores], axis=1), np.concatenate([ids, new_ids], axis=1)
    by = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)


def search(tree: CoverTree, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the first k rows of each query in its window: of its own label, or of the others; empty places are NONE."""
    scores, found = np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max)
    parts = list(tree.leaves(q, low, high))
    if not parts:
        return scores, found
    who, leaf, upper = (np.concatenate(c) for c in zip(*parts))
    by = np.lexsort((-upper, who))  # best first for each query
    who, leaf, upper = who[by], leaf[by], upper[by]
    n = np.bincount(who, minlength=len(q))
    at, last = n.cumsum() - n, n.cumsum()
    live = np.flatnonzero(at < last)
    while len(live):
        live = live[upper[at[live]] >= np.maximum(scores[live, k - 1], low[live])]  # at a tie a smaller id may follow
        if not len(live):
            break
        first, end = tree.stretch(leaf[at[live]])
        size = end - first
        width = int(size.max())
        place = first[:, None] + np.arange(min(width, 4 * LEAF))
        while True:  # a leaf of equal rows may be long and is read in pieces
            real = place < end[:, None]
            if not real.any():
                break
            i, j = np.nonzero(real)
            rows, query = tree.order[place[i, j]], live[i]
            s = exact(q[query], tree.x[rows])
            good = ((labels[rows] == q_labels[query]) == same) & (ids[rows] != q_ids[query]) & (s >= low[query]) & (s <= high[query])
            new_s, new_i = np.full(place.shape, NONE), np.full(place.shape, np.iinfo(np.int64).max)
            new_s[i[good], j[good]], new_i[i[good], j[good]] = s[good], ids[rows[good]]
            scores[live], found[live] = _merge(scores[live], found[live], new_s, new_i, k)
            place = place + place.shape[1]
        at[live] += 1
        live = live[at[live] < last[live]]
    return scores, found


def prepared(vectors: DataFrame, shift: int = 7, labels: int = 10, scale: int = 256) -> DataFrame:
    """vec_id, label, x (bytes of the scaled, floored components as doubles), dim of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, lab, v in zip(*(b.column(c).to_pylist() for c in range(3))):
                if i is None or lab is None or not v or None in v:
                    continue
                x = np.asarray(v, np.float64)
                if np.isfinite(x).all():
                    rows.append((i, (lab + 1) % labels if i % shift == 0 else lab, np.floor(scale * x).tobytes(), len(x)))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int32()))], ["vec_id", "label", "x", "dim"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    return arrow_map(rows, run, "vec_id long, label long, x binary, dim int")


def sharded(rows: DataFrame) -> DataFrame:
    """``rows`` with shard: the nearest of ``CENTRES`` rows of its dimension, split by hash where a shard would grow too large."""
    drawn = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id", "x").limit(CENTRES).select("x").collect()  # at most 64 rows
    centres = [np.frombuffer(r.x, np.float64) for r in drawn]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x in b.column(2).to_pylist():
                v = np.frombuffer(x, np.float64)
                d = [((c - v) ** 2).sum() if len(c) == len(v) else np.inf for c in centres]
                near.append(int(np.argmin(d)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32())], [*b.schema.names, "centre"])

    dealt = settle(arrow_map(rows.select("vec_id", "label", "x", "dim"), run, "vec_id long, label long, x binary, dim int, centre int"))
    sizes = dealt.groupBy("dim", "centre").agg(F.ceil(F.count("*") / SHARD).alias("parts"))
    return dealt.join(sizes, ["dim", "centre"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "x"), "parts").cast("int")).drop("parts")


def _found(rows: DataFrame, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor, window, negative, score: up to k rows a query and shard. ``queries``: anchor, window, label, x, dim, low, high."""
    shards = settle(rows.select("dim", "centre", "part").distinct())
    tasks = shards.count()
    asked = queries.join(broadcast_if(tasks <= BROADCAST_ROWS, shards), "dim").select("dim", "centre", "part", F.lit(1).alias("side"), F.col("anchor").alias("vec_id"), "label", "x", "window", "low", "high")
    held = rows.select("dim", "centre", "part", F.lit(0).alias("side"), "vec_id", "label", "x", F.lit(0).cast("long").alias("window"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    keys = ["dim", "centre", "part"]
    met = held.unionByName(asked).repartition(max(1, min(TASKS, tasks)), *keys).sortWithinPartitions(*keys, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree, ids, labels = None, [], None, None, None

        def grown() -> None:
            nonlocal tree, ids, labels, held
            if tree is None:
                t = pa.Table.from_batches(held)
                ids, labels = t.column("vec_id").to_numpy(), t.column("label").to_numpy()
                tree = CoverTree(np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(len(ids), -1))
                held = []

        for b in batches:
            spots = list(zip(*(b.column(n).to_pylist() for n in (*keys, "side"))))
            bounds = [0, *(i for i in range(1, len(spots)) if spots[i] != spots[i - 1]), len(spots)]
            for first, last in zip(bounds, bounds[1:]):
                if first == last:
                    continue
                if spots[first][:3] != shard:
                    shard, held, tree = spots[first][:3], [], None
                some = b.slice(first, last - first)
                if spots[first][3] == 0:
                    held.append(some)
                    continue
                grown()
                for at in range(0, last - first, QUERIES):
                    q = some.slice(at, QUERIES)
                    anchor, window, low, high, label = (q.column(n).to_numpy() for n in ("vec_id", "window", "low", "high", "label"))
                    x = np.frombuffer(b"".join(q.column("x").to_pylist()), np.float64).reshape(len(anchor), -1)
                    scores, found = search(tree, ids, labels, x, anchor, label, low, high, same, k)
                    i, j = np.nonzero(scores != NONE)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (anchor[i], window[i], found[i, j], scores[i, j])], ["anchor", "window", "found", "score"])

    return arrow_map(met, run, "anchor long, window long, found long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and window over all shards, with rank."""
    by = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "found")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, **options: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``vectors`` (vec_id, embedding, label).

    Rows without an id or a label, and those whose vector is null, empty or holds a null or non-finite component, take no part;
    vectors of different dimensions do not meet. Rows that repeat an id count once; if they differ, the one of least label
    and vector does. Anchors are the rows whose id is divisible by ``every``. Positives are the first ``positives`` rows of
    the anchor's label, negatives of a positive the first ``negatives`` rows of other labels whose score lies between ``least``
    and ``most`` percent of the positive's; scores are integer products of floored components (``prepared``), higher first,
    ties by smaller id. A positive below zero has no such window. Other columns are not read; an empty table gives an empty one.
    """
    once = prepared(vectors, **options).groupBy("vec_id").agg(F.min(F.struct("label", "x", "dim")).alias("row"))
    rows = settle(sharded(settle(once.select("vec_id", "row.*"))))
    anchors = settle(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor"), F.lit(0).cast("long").alias("window"), "label", "x", "dim"))
    wide = anchors.withColumn("low", F.lit(float("-inf"))).withColumn("high", F.lit(float("inf")))
    found = settle(_first(_found(rows, wide, True, positives), positives).select("anchor", F.col("found").alias("window"), F.col("score").alias("positive_score")))
    window = [F.ceil(F.col("positive_score") * least / 100.0), F.floor(F.col("positive_score") * most / 100.0)]
    windows = found.where("positive_score >= 0").join(anchors.drop("window"), "anchor").select("anchor", "window", "label", "x", "dim", window[0].cast("double").alias("low"), window[1].cast("double").alias("high"))
    mined = _first(_found(rows, windows, False, negatives), negatives)
    return mined.join(found, ["anchor", "window"]).select(
        F.col("anchor").alias("anchor_id"), F.col("window").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
