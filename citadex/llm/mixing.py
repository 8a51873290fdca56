"""Mixing sources to target weights, in DataFrame operations only.

Documents fall by hash into blocks of their source. A source's quota is met by whole passes over all its blocks and, for
the rest, by distinct blocks in a random order. All drawn blocks are then dealt over the output shards by a splitting tree:
a node orders its blocks at random and hands the first half to its left child, which draws the children's quotas from the
multivariate hypergeometric distribution exactly. Shards are shuffled locally.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citadex.llm.common import settle
from citadex.sizes import BROADCAST_ROWS, broadcast_if, fits

#: Blocks a source is cut into; the plan has at most so many rows a source, however many documents there are.
BLOCKS = 1024
#: Random orders that a source's blocks are tried in; the one that comes nearest to the quota is drawn.
ORDERS = 24
#: Words of the mix that one shard should hold.
SHARD_WORDS = 4_000_000
MAX_SHARDS = 4096


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def block_of(seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(BLOCKS))


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """source, source_size, target from source, source_size, one row a source.

    Sources in code point order, null last, weigh ``weights``, repeating. They share ``share`` of all sizes; a target stops
    at ``most`` times its source's size and the excess goes to the others by weight. That is one water level: sources are
    capped in the order of cap by weight until the level that is left lies below the next cap.
    """
    one = Window.partitionBy(F.lit(0))
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    by_cap = one.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("pot", F.sum("source_size").over(one) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("pot") / (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
        .withColumn("water", F.max(F.when(F.col("free"), F.col("level"))).over(one))
    )
    target = F.when(F.col("free"), F.least(F.col("water") * F.col("weight"), F.col("cap"))).otherwise(F.col("cap"))
    return ranked.select("source", "source_size", target.alias("target"))


def _draw(blocks: Column, need: Column) -> Column:
    """Per block of the ordered array, 1 if it is drawn: those that still fit, and at the end the least of the others if
    that comes nearer."""
    start = F.struct(need.cast("double").alias("left"), F.array().cast("array<int>").alias("drawn"))
    walked = F.aggregate(
        blocks,
        start,
        lambda s, b: F.when(
            (b["words"] > 0) & (b["words"] <= s["left"]),
            F.struct((s["left"] - b["words"]).alias("left"), F.concat(s["drawn"], F.array(F.lit(1))).alias("drawn")),
        ).otherwise(F.struct(s["left"].alias("left"), F.concat(s["drawn"], F.array(F.lit(0))).alias("drawn"))),
    )
    return walked


def _order(blocks: Column, seed: Column) -> Column:
    """Blocks in the random order of a seed."""
    return F.sort_array(F.transform(blocks, lambda b: F.struct(F.xxhash64(b["block"], seed).alias("key"), b["block"].alias("block"), b["words"].alias("words"))))


def _left(blocks: Column, need: Column) -> Column:
    """Words that are missing after drawing in this order."""
    return F.aggregate(blocks, need.cast("double"), lambda left, b: F.when(b["words"] <= left, left - b["words"]).otherwise(left))


def plan(blocks: DataFrame, targets: DataFrame, seed: int, most: float) -> DataFrame:
    """source, block, times: how often each block goes into the mix."""
    per_source = (
        blocks.groupBy("source")
        .agg(F.sort_array(F.collect_list(F.struct("block", "words"))).alias("blocks"))
        .alias("b")
        .join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .select("b.source", "blocks", "source_size", "target")
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.least(F.col("target") / F.col("source_size"), F.lit(most)) + 1e-12)).otherwise(0).cast("int")
    need = F.when(F.col("passes") >= int(most), 0.0).otherwise(F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    # Few rows, one a source; each step is settled, so that no later expression repeats it.
    base = settle(per_source.withColumn("passes", whole).withColumn("need", need))
    tried = base.select("source", "blocks", "need", F.explode(F.sequence(F.lit(seed + 1), F.lit(seed + ORDERS))).alias("seed"))
    left = tried.select("source", F.struct(_left(_order(F.col("blocks"), F.col("seed")), F.col("need")).alias("left"), "seed").alias("try"))
    best = left.groupBy("source").agg(F.min("try").alias("best"))
    joined = base.alias("b").join(best.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    ordered = settle(joined.select("b.source", "passes", "need", _order(F.col("blocks"), F.col("best.seed")).alias("blocks")))
    walked = settle(ordered.withColumn("walk", _draw(F.col("blocks"), F.col("need"))))
    drawn = (
        walked.withColumn("pairs", F.arrays_zip(F.col("blocks"), F.col("walk.drawn").alias("drawn")))
        .withColumn("least", F.array_min(F.transform(F.filter("pairs", lambda p: (p["drawn"] == 0) & (p["blocks"]["words"] > 0)), lambda p: p["blocks"]["words"])))
        .withColumn("more", F.coalesce((F.col("passes") < int(most)) & (F.col("least") < 2 * F.col("walk.left")), F.lit(False)))
        .withColumn("first", F.when(F.col("more"), F.array_min(F.transform(F.filter("pairs", lambda p: (p["drawn"] == 0) & (p["blocks"]["words"] == F.col("least"))), lambda p: p["blocks"]["key"]))))
    )
    rows = drawn.select("source", "passes", "first", F.explode("pairs").alias("p"))
    extra = F.when((F.col("p.drawn") == 1) | (F.col("p.blocks.key") == F.col("first")), 1).otherwise(0)
    return rows.select("source", F.col("p.blocks.block").alias("block"), (F.col("passes") + extra).cast("int").alias("times"))


def deal(drawn: DataFrame, depth: int, seed: int) -> DataFrame:
    """source, block, shards: the shard of every drawn copy, by the splitting tree."""
    units = drawn.select("source", "block", F.explode(F.expr("sequence(1, times)")).alias("copy")).where("copy > 0").withColumn("node", F.lit(0))
    for level in range(depth):
        order = Window.partitionBy("node").orderBy(F.xxhash64("source", "block", "copy", F.lit(seed + 100 + level)), "source", "block", "copy")
        half = (F.count("*").over(Window.partitionBy("node")) + 1) / 2
        units = units.withColumn("node", F.col("node") * 2 + (F.row_number().over(order) > half).cast("int"))
    return units.groupBy("source", "block").agg(F.sort_array(F.collect_list("node")).alias("shards"))


def mix_plan(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Slim documents, targets, the dealt blocks (source, block, shards), and the number of shards."""
    slim = settle(docs.select("doc_id", "source", word_count("text").alias("size"), block_of(seed).alias("block")))
    blocks = settle(slim.groupBy("source", "block").agg(F.sum("size").alias("words")))
    targets = settle(source_targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), share, most, weights))
    total = targets.agg(F.sum("target")).first()[0] or 0
    depth = max(2, min(math.ceil(math.log2(max(1, total / SHARD_WORDS))), int(math.log2(MAX_SHARDS))))
    dealt = settle(deal(plan(blocks, targets, seed, most).where("times > 0"), depth, seed))
    return slim, targets, dealt, 1 << depth


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, shards of every row of ``docs``.

    size counts words (null text: 0), target is the source's share of words, and shards has one entry for each copy of the
    document in the mix: none, one or two with the default ``most``. Documents without words are never drawn unless their
    block is. Rows alike in id and text fall into one block and are drawn together. A source that is null is a source of
    its own, the last. Reruns draw alike. An empty table gives an empty one.
    """
    slim, targets, dealt, _ = mix_plan(docs, share, most, weights, seed)
    d = slim.alias("d")
    small = fits(dealt, BROADCAST_ROWS)
    out = d.join(
        broadcast_if(small, dealt).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.block") == F.col("p.block")), "left"
    ).join(broadcast_if(fits(targets, BROADCAST_ROWS), targets).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    return out.select("d.doc_id", "d.source", "d.size", "t.source_size", "t.target", F.coalesce("p.shards", F.array().cast("array<int>")).alias("shards"))


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: int = 42) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as drawn, each shard in one partition and in random order."""
    _, _, dealt, shards = mix_plan(docs, share, most, weights, seed)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", block_of(seed).alias("block")).alias("d")
    on = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.block") == F.col("p.block"))
    drawn = keyed.join(broadcast_if(fits(dealt, BROADCAST_ROWS), dealt).alias("p"), on)
    copies = drawn.select("row", "doc_id", F.posexplode("shards").alias("copy", "shard")).repartitionById(shards, F.col("shard"))
    return copies.sortWithinPartitions(F.xxhash64("doc_id", "copy", F.lit(seed + 7)), "doc_id", "copy").select("row.*")
