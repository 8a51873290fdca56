"""Near duplicates among embeddings by sorted projection passes.

The vectors of a label are centred on its mean, and every pass orders them by concatenated random hashes, the signs of 64 random
projections, read as one number. Vectors close together agree in most signs and stand near each other in some pass, so
each is compared with a bounded window of successors; runs of equal hashes longer than the window are compared block
against block. How many passes a label takes follows from its size and density, so that a pair at the threshold is met in one of
them with the chance asked for; a label that would need more comparisons than it has pairs is compared whole. Pairs verified
in any pass are united into components. Links are then counted within components, all pairs, block against block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadex.llm.common import arrow_map, grouped, settle
from citadex.llm.components import components
from citadex.sizes import BROADCAST_ROWS, broadcast_if, fits

#: Vectors of a block: a label has up to 64 blocks of at least ``BLOCK``, beyond that blocks grow to ``MOST``.
BLOCK, MOST = 2048, 32_768
#: Vectors a side that are multiplied at a time.
TILE = 1024
#: Partitions in which blocks meet.
TASKS = 20_000
#: Successors that a vector is compared with in a pass, and signs of a hash.
WINDOW, SIGNS = 128, 64
#: Chance that a pair at the threshold stands within a window in some pass.
RECALL = 0.9999
#: Vectors of a label that a task orders whole; larger labels are cut by leading signs, pass by pass.
HELD = 32_768


def prepared(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, unit (bytes of the unit vector in doubles), dim of the vectors that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, units, dims = [], [], [], []
            for i, lab, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if i is None or lab is None or not v or None in v:
                    continue
                x = np.asarray(v, np.float64)
                norm = np.sqrt(x @ x)
                if not np.isfinite(x).all() or not norm > 0 or not np.isfinite(norm):
                    continue
                ids.append(i)
                labels.append(lab)
                units.append((x / norm).tobytes())
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(units, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "label", "unit", "dim"])

    rows = vectors.select(F.col(vec_id).cast("long"), F.col(label).cast("string"), F.col(embedding).cast("array<double>"))
    return arrow_map(rows, run, "vec_id long, label string, unit binary, dim int")


def _near(x: np.ndarray, y: np.ndarray, x32: np.ndarray, y32: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs at a cosine of at least ``least``: in single precision, and in double where that leaves it open."""
    g = x32 @ y32.T
    slack = 1e-6 + x.shape[1] * 2.0**-22
    i, j = np.nonzero(g >= least - slack)
    open_ = np.flatnonzero(g[i, j] < least + slack)
    keep = np.ones(len(i), bool)
    for at in range(0, len(open_), 1 << 15):
        part = open_[at : at + (1 << 15)]
        keep[part] = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= least
    return i[keep], j[keep]


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Make the roots of i and j one; every node points at its root."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def _met(least: float, diagonal: bool, side: np.ndarray, rep: np.ndarray, copies: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """rep, links, peer of the vectors that link in one meeting; all pairs of one block, or those between two."""
    x32 = x.astype(np.float32)
    rows, cols = (np.arange(len(rep)),) * 2 if diagonal else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
    for r in range(0, len(rows), TILE):
        p = rows[r : r + TILE]
        for c in range(r if diagonal else 0, len(cols), TILE):
            q = cols[c : c + TILE]
            i, j = _near(x[p], x[q], x32[p], x32[q], least)
            i, j = p[i], q[j]
            if diagonal and r == c:
                i, j = i[i < j], j[i < j]
            if len(i):
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                _join(root, i, j)
    at = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(links[at]), pa.array(rep[root[at]])], ["rep", "links", "peer"])


def _meetings(least: float):
    """The meetings of a partition that is ordered by them, one held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            side, rep, copies = (t.column(n).to_numpy() for n in ("side", "rep", "copies"))
            x = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(len(rep), -1)
            return _met(least, now[2] == now[3], side, rep, copies, x)

        for b in batches:
            keys = list(zip(*(b.column(n).to_pylist() for n in ("label", "dim", "a", "b"))))
            bounds = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for first, last in zip(bounds, bounds[1:]):
                if first == last:
                    continue
                if held and keys[first] != now:
                    yield done()
                    held = []
                now = keys[first]
                held.append(b.slice(first, last - first))
        if held:
            yield done()

    return run


def links(reps: DataFrame, least: float = 0.98) -> DataFrame:
    """rep, links, peer: what the vectors of ``reps`` (rep, copies, label, unit, dim) link, a row a meeting of two blocks.

    All pairs of a label and dimension are compared. The links of a vector add up over its rows; rep and peer, both ways,
    span the components. A vector without a link has no row.
    """
    size = F.greatest(F.lit(BLOCK), F.least(F.lit(MOST), F.ceil(F.col("n") / 64)))
    sizes = settle(reps.groupBy("label", "dim").agg(F.count("*").alias("n")).where("n > 1").select("label", "dim", "n", F.ceil(F.col("n") / size).cast("int").alias("blocks")))
    work = sizes.agg(F.sum(F.expr("bigint(blocks) * (blocks + 1) div 2")).alias("meetings"), F.ceil(F.sum(F.col("n") * F.col("blocks")) / BLOCK).alias("parts")).first()
    sizes = sizes.drop("n")
    dealt = (
        reps.join(broadcast_if(fits(sizes, BROADCAST_ROWS), sizes), ["label", "dim"])
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("m", F.explode(F.expr("transform(sequence(0, blocks - 1), o -> struct(least(o, block) AS a, greatest(o, block) AS b, int(o < block) AS side))")))
        .select("label", "dim", "m.a", "m.b", "m.side", "rep", "copies", "unit")
    )
    keys = ["label", "dim", "a", "b"]
    ordered = dealt.repartition(max(1, min(TASKS, work.meetings or 1, work.parts or 1)), *keys).sortWithinPartitions(*keys)
    return arrow_map(ordered, _meetings(least), "rep long, links long, peer long")


def densities(reps: DataFrame) -> DataFrame:
    """label, dim, n, mean (bytes of doubles) of the vectors of every label and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}
        for b in batches:
            for lab, dim, unit in zip(*(b.column(i).to_pylist() for i in range(3))):
                held = sums.setdefault((lab, dim), [0, np.zeros(dim)])
                held[0] += 1
                held[1] += np.frombuffer(unit, np.float64)
        rows = [(lab, dim, n, v.tolist()) for (lab, dim), (n, v) in sums.items()]
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64())))], ["label", "dim", "n", "sums"])

    parts = arrow_map(reps.select("label", "dim", "unit"), run, "label string, dim int, n long, sums array<double>")
    sizes = parts.groupBy("label", "dim").agg(F.sum("n").alias("n"))
    each = parts.select("label", "dim", F.posexplode("sums").alias("i", "x")).groupBy("label", "dim", "i").agg(F.sum("x").alias("x"))
    means = each.join(sizes, ["label", "dim"]).groupBy("label", "dim", "n").agg(F.array_sort(F.collect_list(F.struct("i", F.col("x") / F.col("n")))).alias("m"))
    return means.select("label", "dim", "n", F.expr("transform(m, e -> e.col2)").alias("mean"))


def planned(means: DataFrame, least: float, recall: float) -> DataFrame:
    """``means`` with passes, cut: passes of the label (0: compare it whole) and leading signs that deal it to tasks.

    Unit vectors at the threshold stand sqrt(2 - 2 least) apart; seen from the mean of a label of radius r that is an
    angle, and a sign differs with that share of pi. Windows hold a pair when the signs that split the label into runs of half a
    window agree.
    """
    apart = (2 - 2 * least) ** 0.5
    out = means.withColumn("radius", F.sqrt(F.greatest(F.lit(1e-9), 1 - F.expr("aggregate(mean, 0D, (s, x) -> s + x * x)"))))
    out = out.withColumn("differ", F.least(F.lit(0.5), 2 * F.asin(F.least(F.lit(1.0), apart / (2 * F.col("radius")))) / np.pi))
    out = out.withColumn("signs", F.greatest(F.lit(0.0), F.log2(2 * F.col("n") / WINDOW)))
    met = F.pow(1 - F.col("differ"), F.col("signs"))
    passes = F.when(met >= recall, 1).otherwise(F.ceil(F.log(F.lit(1 - recall)) / F.log(1 - met)))
    out = out.withColumn("passes", passes.cast("long"))
    out = out.withColumn("passes", F.when(F.col("passes") * WINDOW * 2 >= F.col("n"), 0).otherwise(F.col("passes")).cast("int"))
    cut = F.when(F.col("n") > HELD, F.ceil(F.log2(2 * F.col("n") / HELD))).otherwise(0)
    return out.select("label", "dim", "n", "mean", "passes", cut.cast("int").alias("cut"))


def hashes(x: np.ndarray, number: int) -> np.ndarray:
    """The hashes of centred vectors in one pass, as numbers whose order is that of the signs."""
    planes = np.random.default_rng((number, x.shape[1])).standard_normal((x.shape[1], SIGNS))
    return np.ascontiguousarray(np.packbits(x @ planes > 0, axis=1)).view(">u8")[:, 0].astype(np.uint64)


def _pass(x: np.ndarray, x32: np.ndarray, key: np.ndarray, root: np.ndarray, least: float) -> None:
    """Unite what one pass finds: windows of successors, and runs of equal hashes that are longer than a window."""
    order = np.argsort(key, kind="stable")
    for at in range(0, len(order), 2 * WINDOW):
        p, q = order[at : at + 2 * WINDOW], order[at : at + 3 * WINDOW]
        i, j = _near(x[p], x[q], x32[p], x32[q], least)
        good = (j > i) & (j - i <= WINDOW)
        _join(root, p[i[good]], q[j[good]])
    sorted_key = key[order]
    bounds = np.r_[0, np.flatnonzero(sorted_key[1:] != sorted_key[:-1]) + 1, len(order)]
    for first, last in zip(bounds[:-1], bounds[1:]):
        if last - first > WINDOW:
            run = order[first:last]
            for r in range(0, len(run), TILE):
                for c in range(r, len(run), TILE):
                    p, q = run[r : r + TILE], run[c : c + TILE]
                    i, j = _near(x[p], x[q], x32[p], x32[q], least)
                    _join(root, p[i], q[j])


def spans(reps: DataFrame, least: float = 0.98, recall: float = RECALL) -> DataFrame:
    """rep, peer: links that span what the passes find among ``reps`` (rep, label, unit, dim); a vector without one has no row."""
    plan = settle(planned(densities(reps), least, recall).where("n > 1"))
    known = broadcast_if(fits(plan, BROADCAST_ROWS), plan)
    rows = reps.select("label", "dim", "rep", "copies", "unit").join(known, ["label", "dim"])
    whole = links(rows.where("passes = 0").select("label", "dim", "rep", "copies", "unit"), least).select("rep", "peer")
    passed = rows.where("passes > 0")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once for a label that one task orders, else once a pass with the leading signs of its hash."""
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("label", "dim", "unit", "mean", "passes", "cut")}
            by: dict[tuple[str, int], list[int]] = {}
            for k, key in enumerate(zip(c["label"], c["dim"])):
                by.setdefault(key, []).append(k)
            for ks in by.values():
                cut, passes = c["cut"][ks[0]], c["passes"][ks[0]]
                some = b.take(pa.array(ks))
                x = np.frombuffer(b"".join(c["unit"][k] for k in ks), np.float64).reshape(len(ks), -1) - np.asarray(c["mean"][ks[0]])
                for number in range(passes) if cut else [-1]:
                    slab = (hashes(x, number) >> np.uint64(SIGNS - cut)).astype(np.int64) if cut else np.zeros(len(ks), np.int64)
                    fixed = [pa.array(np.full(len(ks), number, np.int32)), pa.array(slab)]
                    yield pa.RecordBatch.from_arrays([some.column("label"), some.column("dim"), *fixed, some.column("rep"), some.column("unit"), some.column("mean"), some.column("passes")], ["label", "dim", "number", "slab", "rep", "unit", "mean", "passes"])

    keys = ["label", "dim", "number", "slab"]
    schema = "label string, dim int, number int, slab long, rep long, unit binary, mean array<double>, passes int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, number, _), t in grouped(batches, keys):
            rep = t.column("rep").to_numpy()
            x = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(len(rep), -1)
            x32, root = x.astype(np.float32), np.arange(len(rep))
            centred = x - np.asarray(t.column("mean")[0].as_py())
            for k in range(t.column("passes")[0].as_py()) if number < 0 else [number]:
                _pass(x, x32, hashes(centred, k), root, least)
            moved = np.flatnonzero(root != np.arange(len(rep)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[root[moved]])], ["rep", "peer"])

    tasks = plan.agg(F.sum(F.when(F.col("cut") > 0, F.col("passes") * F.pow(F.lit(2), F.col("cut"))).otherwise(1))).first()[0] or 1
    dealt = arrow_map(passed, deal, schema).repartition(int(min(TASKS, tasks)), *keys).sortWithinPartitions(*keys)
    return whole.unionByName(arrow_map(dealt, run, "rep long, peer long"))


def near_duplicates(vectors: DataFrame, least: float = 0.98, recall: float = RECALL, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label link at a cosine of at least ``least`` in double precision. Vectors that are null, empty, zero, hold
    null or non-finite components, or whose label is null, link with nothing; vectors of different dimensions do not
    either. component_id is the least vec_id reachable by links, itself included; kept says whether it is the row's own.
    Components are what sorted projection passes find, each pair at the threshold with a chance of ``recall``; ``exact`` compares
    all pairs of a label instead. Links are counted over all pairs of a component. Equal vectors are collapsed before and
    counted as links. Repeated rows count each for itself as vectors; rows without an id come out with component null and
    kept null. An empty table gives an empty one.
    """
    usable = settle(prepared(vectors))
    reps = settle(usable.groupBy("label", "dim", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    if exact:
        found = settle(links(reps, least))
        joined = components(found.select("rep", "peer")).select(F.col("node").alias("rep"), "component")
    else:
        joined = settle(components(settle(spans(reps, least, recall))).select(F.col("node").alias("rep"), "component"))
        found = links(reps.join(joined, "rep").select(F.concat_ws(" ", "component", "label").alias("label"), "dim", "rep", "copies", "unit"), least)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = (
        reps.join(joined, "rep", "left")
        .join(counts, "rep", "left")
        .select("label", "dim", "unit", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    linked = usable.join(classes, ["label", "dim", "unit"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = vectors.select("vec_id").join(linked, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
