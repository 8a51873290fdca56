"""Vector retrieval and embedding upkeep.

Distances are computed in Arrow batches, one matrix product per batch, and each task hands on at most k rows per
query, so the full set of query-vector pairs is never written anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import QUERY_INSTRUCTION, Encoder, distances, list_column, matrix, normalise
from ..session import arrow_map
from ..sizes import BROADCAST_ROWS, broadcast_if, fits
from .lexical import top_k

#: Query rows that may be held by the driver and each worker (about 3 MB per thousand at 768 dimensions).
QUERY_ROWS = 4096
#: Partitions of the shuffled form at most.
MOST_TASKS = 20_000
#: Numbers in the queries that a task of the shuffled form holds (32 MB).
GROUP_NUMBERS = 1 << 22
#: Distances worked on at a time (8 MB), and the rows in them.
TILE, TILE_ROWS = 1 << 20, 2048
#: Pairs measured at a time (6 MB each at 768 dimensions per thousand).
PAIRS = 1 << 13
OVERFETCH = 8


def _id_array(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist())


class _Best:
    """Running best k of one task, per query.

    ``wishes`` holds per query the wanted record id (None: any) and whether non-current rows count. Queries and rows meet in tiles
    of ``TILE`` distances, so that memory depends neither on the number of queries nor on that of rows.
    """

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, wishes: list[tuple[object, bool]], k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        # A row's squared distance without the query's own square is one product with these.
        self.squares = (queries**2).sum(1)
        self.asking = np.hstack([-2.0 * queries, np.ones((len(queries), 1))])
        groups: dict[tuple[object, bool], list[int]] = {}
        for position, wish in enumerate(wishes):
            groups.setdefault(wish, []).append(position)
        self.groups = {wish: np.array(positions) for wish, positions in groups.items()}
        #: The best so far, a row a query: how many there are, their distances and ids in order.
        self.count, self.distance, self.ids = np.zeros(len(query_ids), np.int64), np.full((len(query_ids), k), np.inf), None

    def add(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, current: np.ndarray) -> None:
        if self.ids is None:
            self.ids = np.empty((len(self.query_ids), self.k), ids.dtype)
        self.ids = self.ids.astype(np.result_type(self.ids, ids), copy=False)  # longer strings
        for (wanted, any_status), positions in self.groups.items():
            usable = np.ones(len(ids), dtype=bool) if any_status else current.copy()
            if wanted is not None:
                usable &= labels == wanted
            inside = np.flatnonzero(usable)
            for at in range(0, len(inside), TILE_ROWS):
                some = inside[at : at + TILE_ROWS]
                step = max(1, TILE // len(some))
                for first in range(0, len(positions), step):
                    self._meet(positions[first : first + step], rows[some], ids[some])

    def _meet(self, asked: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        """Merge a tile of queries ``asked`` and ``rows`` into the best. Only what may be among them is measured, by differences, as
        products cancel out between vectors that are close."""
        squares = (rows**2).sum(1)
        near = self.asking[asked] @ np.column_stack([rows, squares]).T
        own = self.squares[asked]
        slack = 1e-12 * (own + squares[np.isfinite(squares)].max(initial=0.0))
        bound = lambda worst: (worst + 1e-6) ** 2 - own + slack  # distances are rounded to 6 places
        worst = np.where(self.count[asked] == self.k, self.distance[asked, -1], np.inf)
        row, column = np.nonzero(~(near > bound(worst)[:, None]))
        if len(row) > 4 * self.k * len(asked):
            if near.shape[1] > self.k:  # the k nearest of the tile alone, and what ties with them
                kth = np.sqrt(np.clip(np.partition(near, self.k - 1, axis=1)[:, self.k - 1] + own + slack, 0.0, None))
                row, column = np.nonzero(~(near > np.fmin(bound(worst), bound(kth))[:, None]))
        if not len(row):
            return
        measured = np.concatenate([distances(self.queries[asked[row[i : i + PAIRS]]], rows[column[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)])
        touched = np.unique(row)
        held = np.arange(self.k) < self.count[asked[touched]][:, None]
        query = np.concatenate([np.nonzero(held)[0], np.searchsorted(touched, row)])
        distance = np.concatenate([self.distance[asked[touched]][held], measured])
        found = np.concatenate([self.ids[asked[touched]][held], ids[column]])
        order = np.lexsort((found, distance, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order, place = order[place < self.k], place[place < self.k]
        position = asked[touched[query[order]]]
        self.distance[position, place], self.ids[position, place] = distance[order], found[order]
        self.count[asked[touched]] = np.bincount(query[order], minlength=len(touched))

    def tables(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        step = max(1, TILE // self.k)
        for first in range(0, len(self.query_ids) if self.ids is not None else 0, step):
            part = slice(first, first + step)
            query, place = np.nonzero(np.arange(self.k) < self.count[part][:, None])
            columns = [pa.array(c.tolist(), kind) for c, kind in zip((self.query_ids[part][query], self.ids[part][query, place]), schema.types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(self.distance[part][query, place], pa.float64())], schema=schema)


def _arrow_type(df: DataFrame, col: str) -> pa.DataType:
    return pa.int64() if df.schema[col].dataType.simpleString() in ("bigint", "int") else pa.string()


def knn_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 30,
    include_withdrawn: bool = True,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Exact L2 top-k: (query_id, chunk_id, vec_distance, rank).

    ``vectors`` has chunk_id, embedding and, for filtering, md_id and status; ``queries`` has query_id, embedding
    and optionally filter_md_id and include_withdrawn. Filters act before the ranking, so k rows come back
    whenever they exist.
    """
    current = F.coalesce("status", F.lit("current")) == "current" if "status" in vectors.columns else F.lit(True)
    label = F.col("md_id").cast("string") if "md_id" in vectors.columns else F.lit(None).cast("string")
    wanted = F.col("filter_md_id") if "filter_md_id" in queries.columns else F.lit(None)
    any_status = F.col("include_withdrawn") if "include_withdrawn" in queries.columns else F.lit(include_withdrawn)
    if not include_withdrawn and "include_withdrawn" not in queries.columns:
        vectors = vectors.filter(current)
    vectors = vectors.select("chunk_id", "embedding", label.alias("md_id"), current.alias("is_current"))
    queries = queries.select(
        "query_id", "embedding", wanted.cast("string").alias("wanted"), F.coalesce(any_status, F.lit(False)).alias("any")
    )

    def nearest(candidates: DataFrame, asked: DataFrame) -> DataFrame:
        held = asked.limit(query_rows + 1).toArrow()
        return _knn_broadcast(candidates, asked, held, k) if held.num_rows <= query_rows else _knn_blocks(candidates, asked, k)

    if "filter_md_id" not in queries.columns:
        partial = nearest(vectors, queries)
    else:
        # Queries with a filter only meet the vectors of the records asked for.
        filtered = queries.filter("wanted IS NOT NULL")
        records = filtered.select(F.col("wanted").alias("md_id")).distinct()
        named = vectors.join(broadcast_if(fits(records, BROADCAST_ROWS), records), "md_id", "left_semi")
        named = named.select(*vectors.columns)
        partial = nearest(named, filtered).unionByName(nearest(vectors, queries.filter("wanted IS NULL")))
    return top_k(partial, k, F.col("vec_distance"), F.col("chunk_id"))


def _schema(vectors: DataFrame, queries: DataFrame) -> pa.Schema:
    return pa.schema(
        [
            ("query_id", _arrow_type(queries, "query_id")),
            ("chunk_id", _arrow_type(vectors, "chunk_id")),
            ("vec_distance", pa.float64()),
        ]
    )


def _query_side(columns) -> tuple[np.ndarray, np.ndarray, list[tuple[object, bool]]]:
    wishes = list(zip(columns["wanted"].to_pylist(), columns["any"].to_pylist()))
    return _id_array(columns["query_id"]), matrix(columns["embedding"]), wishes


def _vector_side(columns) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (
        _id_array(columns["chunk_id"]),
        matrix(columns["embedding"]),
        np.array(columns["md_id"].to_pylist(), dtype=object),
        np.array(columns["is_current"].to_pylist(), dtype=bool),
    )


def _knn_broadcast(vectors: DataFrame, queries: DataFrame, held: pa.Table, k: int) -> DataFrame:
    """Queries of checked size go to every task; vectors stay where they are."""
    payload = vectors.sparkSession.sparkContext.broadcast(_query_side(held))
    schema = _schema(vectors, queries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, rows, wishes = payload.value
        if not len(query_ids):
            return
        best = _Best(query_ids, rows, wishes, k)
        for batch in batches:
            if batch.num_rows:
                best.add(*_vector_side(batch))
        yield from best.tables(schema)

    return arrow_map(vectors, scan, _ddl(vectors, queries))


def _ddl(vectors: DataFrame, queries: DataFrame) -> str:
    kind = lambda df, c: "bigint" if _arrow_type(df, c) == pa.int64() else "string"
    return f"query_id {kind(queries, 'query_id')}, chunk_id {kind(vectors, 'chunk_id')}, vec_distance double"


def _knn_blocks(vectors: DataFrame, queries: DataFrame, k: int, group_rows: int | None = None) -> DataFrame:
    """Large query sets: a grid of query groups and vector shards, a task a meeting.

    A task holds its queries and one running best for each, and reads the vectors of its shard as a stream; so k rows
    a query and shard leave. The vectors travel once a group, and a group is as many queries as a task can hold; there are
    only as many shards as it takes to keep all cores busy.
    """
    spark = vectors.sparkSession
    sizes = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    groups = max(1, -(-sizes.n // (group_rows or max(1, GROUP_NUMBERS // max(1, sizes.dim or 1)))))
    busy = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    shards = max(1, -(-2 * busy // groups))
    over = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    chunk, query = (df.schema[c].dataType for df, c in ((vectors, "chunk_id"), (queries, "query_id")))
    left = vectors.select(
        F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("side"), F.lit(None).cast(query).alias("query_id"), "chunk_id",
        "embedding", "md_id", "is_current", over(groups).alias("g"),
    )
    right = queries.select(
        over(shards).alias("shard"), F.lit(0).alias("side"), "query_id", F.lit(None).cast(chunk).alias("chunk_id"),
        "embedding", F.col("wanted").alias("md_id"), F.col("any").alias("is_current"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("g"),
    )
    met = left.unionByName(right).repartition(min(MOST_TASKS, groups * shards), "g", "shard").sortWithinPartitions("g", "shard", "side")
    schema = _schema(vectors, queries)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, best = None, [], None
        for batch in batches:
            spots = list(zip(*(batch[c].to_pylist() for c in ("g", "shard", "side"))))
            bounds = [0, *(i for i in range(1, len(spots)) if spots[i] != spots[i - 1]), len(spots)]
            for first, last in zip(bounds, bounds[1:]):
                if first == last:
                    continue
                if spots[first][:2] != now:
                    if best:
                        yield from best.tables(schema)
                    now, held, best = spots[first][:2], [], None
                rows = batch.slice(first, last - first)
                if spots[first][2] == 0:
                    held.append(rows)
                    continue
                if best is None and held:
                    asked = pa.Table.from_batches(held)
                    best = _Best(*_query_side({"query_id": asked["query_id"], "embedding": asked["embedding"], "wanted": asked["md_id"], "any": asked["is_current"]}), k)
                if best:
                    best.add(*_vector_side({c: rows[c] for c in ("chunk_id", "embedding", "md_id", "is_current")}))
        if best:
            yield from best.tables(schema)

    return arrow_map(met, meet, _ddl(vectors, queries))


def knn_overfetch(vectors: DataFrame, queries: DataFrame, k: int = 30, factor: int = OVERFETCH) -> DataFrame:
    """The cut-then-filter variant: the nearest factor*k first, then non-current rows dropped; may return fewer."""
    near = knn_topk(vectors, queries, k * factor)
    flags = vectors.select("chunk_id", (F.coalesce("status", F.lit("current")) == "current").alias("ok"))
    kept = near.join(flags, "chunk_id").filter("ok").drop("ok", "rank")
    return top_k(kept, k, F.col("vec_distance"), F.col("chunk_id"))


# --- embedding ------------------------------------------------------------------------------------------------


class DimensionMismatch(ValueError):
    """The encoder does not produce the configured dimension: the build must stop."""


class InputTooLong(ValueError):
    """Raised by an encoder for a batch it cannot take."""


def _encode_split(encoder: Encoder, texts: list[str], again: bool = True) -> list[np.ndarray | None]:
    """Halve a refused batch until it passes; a refused single text gets no vector. Order is kept.

    Any other failure is tried once more, then the batch goes without vectors.
    """
    try:
        rows = encoder(texts)
    except InputTooLong:
        if len(texts) == 1:
            return [None]
        half = len(texts) // 2
        return _encode_split(encoder, texts[:half]) + _encode_split(encoder, texts[half:])
    except DimensionMismatch:
        raise
    except Exception:  # a failing encoder must not stop a build
        if again:
            return _encode_split(encoder, texts, again=False)
        return [None] * len(texts)
    if len(rows) != len(texts):
        raise RuntimeError(f"encoder returned {len(rows)} vectors for {len(texts)} texts")
    return list(rows)


def embed(
    df: DataFrame,
    encoder: Encoder,
    dim: int,
    id_col: str = "chunk_id",
    prefix: str = "",
    batch_size: int = 100,
) -> DataFrame:
    """(id, embedding): unit vectors as float arrays.

    A wrong dimension or count fails the job; texts the encoder refuses or fails on are left out, so that retrieval falls back
    to keywords for them and a later :func:`embed_missing` picks them up. Blank texts get a zero vector.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch[id_col], batch["text"].to_pylist()
            for at in range(0, len(texts), batch_size):
                part = [t or "" for t in texts[at : at + batch_size]]
                filled = [i for i, t in enumerate(part) if t.strip()]
                out: list[np.ndarray | None] = [np.zeros(dim)] * len(part)
                for i, row in zip(filled, _encode_split(encoder, [prefix + part[i] for i in filled]) if filled else []):
                    out[i] = row
                kept = [i for i, row in enumerate(out) if row is not None]
                if not kept:
                    continue
                if any(len(out[i]) != dim for i in kept):
                    raise DimensionMismatch(f"encoder gave {len(out[kept[0]])} dimensions, expected {dim}")
                rows = normalise(np.stack([out[i] for i in kept]))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)).take(pa.array(kept)), list_column(rows)], names=[id_col, "embedding"]
                )

    return arrow_map(df.select(id_col, "text"), run, f"{id_col} {id_type}, embedding array<float>")


def embed_queries(queries: DataFrame, encoder: Encoder, dim: int, instruction: str = QUERY_INSTRUCTION) -> DataFrame:
    """(query_id, embedding) with every distinct text encoded once."""
    text = F.coalesce("text", F.lit(""))  # an absent query gets the zero vector of a blank one
    distinct = queries.select(text.alias("text")).distinct().withColumn("text_id", F.sha2("text", 256))
    vectors = embed(distinct, encoder, dim, "text_id", instruction)
    return (
        queries.select("query_id", F.sha2(text, 256).alias("text_id")).join(vectors, "text_id").drop("text_id")
    )


def embed_missing(chunks: DataFrame, vectors: DataFrame, encoder: Encoder, dim: int) -> DataFrame:
    """Vectors for the chunks that have none yet; append the result to resume a build."""
    return embed(chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti"), encoder, dim)
