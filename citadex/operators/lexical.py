"""Keyword retrieval: query terms, term index, BM25 top-k.

Layout for scale. A chunk's text never travels: its terms are read where the chunk is and held against the words asked for
inside the row, so that a chunk stays one row with the few terms that matter. Queries of a checked-small number are held by
the tasks: a batch of chunks is scored query by query in sparse arrays, informative terms first; terms of more than half
of all chunks, whose weight is next to nothing, are only added where they can still change the k best. Status and document
filters act before the ranking, and only the best k rows per query and task travel. More queries than that meet the
postings in a salted join. A stored index lies in term order, so that a batch of queries reads the files of its terms.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import stem_tokens
from ..functions.text import index_tokens, word_tokens
from ..session import arrow_map, few_rows_a_batch, settle
from ..sizes import BROADCAST_ROWS, fits

MAX_QUERY_TERMS = 32
K1 = 1.2
B = 0.75
MIN_IDF = 1e-6
#: A term is hot when it alone makes up more than this share of all postings; there are fewer than 1/share of them.
HOT_SHARE = 0.001
SALTS = 64


def analysed(tokens: Column, stem: bool) -> Column:
    """Index terms as they are, or folded to base letters and stripped of suffixes: one function for texts and queries."""
    return stem_tokens(tokens) if stem else tokens


def query_terms(queries: DataFrame, carry: tuple[str, ...] = (), stem: bool = False) -> DataFrame:
    """(query_id, carry.., term, qtf): the first 32 word tokens; a query without tokens has no rows."""
    tokens = F.slice(word_tokens(F.col("text")), 1, MAX_QUERY_TERMS)
    parts = F.flatten(F.transform(tokens, index_tokens))
    return (
        queries.select("query_id", *carry, parts.alias("parts"))
        .select("query_id", *carry, F.explode(analysed(F.col("parts"), stem)).alias("term"))
        .groupBy("query_id", *carry, "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


@dataclass
class TextIndex:
    """Terms of chunks; what is known of a chunk beside its text is not part of it."""

    postings: DataFrame  # chunk_id, dl, term, tf
    stats: DataFrame  # term, df; two pseudo terms hold the number of chunks and their total length
    hot_terms: DataFrame  # term
    stored: bool = False  # postings come from files, in term order
    stem: bool = False  # terms are folded and stemmed, queries have to be, too
    rows: DataFrame | None = None  # chunk_id, dl, terms, tfs: what the others are derived from, if they are not stored


#: Pseudo terms of the statistics, never tokens: number of chunks and total length. One column for all keeps the
#: plan of the statistics the same wherever they are used, so they are computed once.
EVERY, LENGTH = "", "\u0001"


def build_index(chunks: DataFrame, stem: bool = False) -> TextIndex:
    """Inverted index of chunks (chunk_id, text) over all of their terms; ``chunk_id`` is a key."""
    return index_of(counted_terms(chunks, stem), stem)


def index_of(rows: DataFrame, stem: bool = False) -> TextIndex:
    """The index of chunks whose terms are counted."""
    every = all_postings(rows)
    stats = term_stats(every)
    return TextIndex(every.filter(F.col("term") != EVERY), stats, hot_terms(stats), stem=stem, rows=rows)


def counted_terms(chunks: DataFrame, stem: bool = False) -> DataFrame:
    """(chunk_id, dl, terms, tfs), a row a chunk: terms are counted where the chunk is, so that no token is shuffled for it."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column("tokens")
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())])
            coded = tokens.flatten().dictionary_encode()
            size = max(1, len(coded.dictionary))
            seen, tf = np.unique(np.repeat(np.arange(b.num_rows), np.diff(ends)) * size + coded.indices.to_numpy().astype(np.int64), return_counts=True)
            offsets = pa.array(np.searchsorted(seen // size, np.arange(b.num_rows + 1)).astype(np.int32))
            terms = pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(seen % size)))
            tfs = pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(np.diff(ends).astype(np.int32)), terms, tfs], ["chunk_id", "dl", "terms", "tfs"])

    return arrow_map(tokens_of(chunks, stem, "chunk_id"), run, f"chunk_id {kind}, dl int, terms array<string>, tfs array<int>")


def all_postings(rows: DataFrame) -> DataFrame:
    """(chunk_id, dl, term, tf) of counted chunks, with one row of the pseudo term ``EVERY`` for each chunk, also without terms."""
    pairs = F.arrays_zip(F.concat(F.array(F.lit(EVERY)), F.col("terms")).alias("term"), F.concat(F.array(F.lit(1)), F.col("tfs")).alias("tf"))
    return rows.select("chunk_id", "dl", F.inline(pairs).alias("term", "tf")).withColumn("tf", F.col("tf").cast("bigint"))


def tokens_of(chunks: DataFrame, stem: bool, *keep: str) -> DataFrame:
    """``keep`` and tokens, the index terms of each text in order."""
    few_rows_a_batch(chunks.sparkSession)  # stems come from Python
    rows = chunks.select(*keep, index_tokens(F.col("text")).alias("tokens"))
    return rows.select(*keep, analysed(F.col("tokens"), stem).alias("tokens"))


def term_stats(postings: DataFrame) -> DataFrame:
    """(term, df) from postings with a row of ``EVERY`` for each chunk, in one pass; pseudo terms included."""
    length = F.sum(F.when(F.col("term") == EVERY, F.col("dl")))
    counted = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), length.alias("length"))
    pair = lambda term, df: F.struct(term.alias("term"), df.cast("bigint").alias("df"))
    own = pair(F.col("term"), F.col("df"))
    both = F.array(own, pair(F.lit(LENGTH), F.coalesce("length", F.lit(0))))
    return counted.select(F.inline(F.when(F.col("term") == EVERY, both).otherwise(F.array(own))))


def hot_terms(stats: DataFrame) -> DataFrame:
    """Terms in more than their share of chunks; there are fewer than 1 / HOT_SHARE of them."""
    real = ~F.col("term").isin(EVERY, LENGTH)
    total = stats.agg(F.sum(F.when(real, F.col("df")))).scalar()
    return stats.filter(real & (F.col("df") > total * F.lit(HOT_SHARE))).select("term")


def corpus_row(stats: DataFrame) -> DataFrame:
    """One row: chunks, avgdl."""
    value = lambda term: F.max(F.when(F.col("term") == term, F.col("df")))
    return stats.agg(value(EVERY).alias("chunks"), (value(LENGTH) / value(EVERY)).alias("avgdl"))


def idf(df: Column, n: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(MIN_IDF)).otherwise(raw)


def bm25_scores(index: TextIndex, terms: DataFrame, state: DataFrame, keep: Column) -> DataFrame:
    """(query_id, chunk_id, bm25_score): lower is better, statistics from the whole index, by a shuffle join.

    ``state`` has a row for each chunk that may be found; ``keep`` is a predicate over its columns and those of the query
    and acts before anything is scored.
    """
    corpus = corpus_row(index.stats).select(F.struct("chunks", "avgdl")).scalar()
    frequencies = index.stats.select(F.col("term").alias("_term"), "df")
    # Null-safe on purpose: a plain equality would add a filter that sets these statistics apart from the corpus row's.
    query_side = (
        terms.join(frequencies, F.col("term").eqNullSafe(F.col("_term")))
        .withColumn("weight", F.col("qtf") * idf(F.col("df"), corpus["chunks"]))
        .drop("qtf", "df", "_term")
    )
    length = 1 - B + B * F.col("dl") / corpus["avgdl"]
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length)
    matched = _salted_match(index, query_side).join(state, "chunk_id").filter(keep)
    scores = matched.withColumn("part", part).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))
    return scores.select("query_id", "chunk_id", F.round(-F.col("score"), 6).alias("bm25_score"))


def _salted_match(index: TextIndex, query_side: DataFrame) -> DataFrame:
    """Shuffle join on (term, salt): hot terms are spread, their query rows repeated once per salt."""
    hot = F.broadcast(index.hot_terms.withColumn("is_hot", F.lit(True)))
    spread = F.when(F.col("is_hot"), F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS))).otherwise(F.lit(0))
    left = index.postings.join(hot, "term", "left").withColumn("salt", spread.cast("int")).drop("is_hot")
    copies = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = query_side.join(hot, "term", "left").withColumn("salt", F.explode(copies)).drop("is_hot")
    return left.join(right, ["term", "salt"]).drop("salt")


def top_k(scored: DataFrame, k: int, *order: Column, partition: str = "query_id", rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per query; Spark keeps only k rows per query and task before the shuffle."""
    by_query = Window.partitionBy(partition).orderBy(*order)
    return scored.withColumn(rank, F.row_number().over(by_query)).filter(F.col(rank) <= k)


@dataclass
class Prepared:
    """Query terms with the decision whether they may be broadcast."""

    terms: DataFrame
    small: bool


def prepare_queries(queries: DataFrame, carry: tuple[str, ...] = (), small: bool | None = None, stem: bool = False) -> Prepared:
    """Query terms, counted before they may be broadcast; ``small=False`` forgoes it."""
    terms = query_terms(queries, carry, stem)
    if small is None:
        small = fits(queries, BROADCAST_ROWS)
    if small:
        terms = settle(terms)
        small = fits(terms, BROADCAST_ROWS)
    return Prepared(terms, small)


def _matched(chunks: DataFrame, vocabulary: list[str], stem: bool) -> DataFrame:
    """chunk_id, md_id, is_current, dl, terms, tfs: one row a chunk, with its terms of ``vocabulary`` as places in it."""
    words = pa.array(vocabulary, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column("tokens")
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())])
            place = pc.index_in(tokens.flatten().cast(pa.string()), words)
            hit = np.flatnonzero(np.asarray(place.is_valid()))
            row = np.searchsorted(ends, hit, "right") - 1
            seen, tf = np.unique(row * len(vocabulary) + place.take(pa.array(hit)).to_numpy().astype(np.int64), return_counts=True)
            offsets = pa.array(np.searchsorted(seen // max(1, len(vocabulary)), np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (seen % max(1, len(vocabulary)), tf)]
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), b.column("md_id"), b.column("is_current"), pa.array(np.diff(ends).astype(np.int32)), *lists], MATCHED_NAMES)

    rows = tokens_of(chunks, stem, "chunk_id", "md_id", "is_current")
    return arrow_map(rows, run, MATCHED)


MATCHED = "chunk_id string, md_id string, is_current boolean, dl int, terms array<int>, tfs array<int>"
MATCHED_NAMES = ["chunk_id", "md_id", "is_current", "dl", "terms", "tfs"]


def _matched_postings(index: TextIndex, vocabulary: DataFrame, state: DataFrame) -> DataFrame:
    """As ``_matched``, from the postings of an index; ``vocabulary``: term, place. Chunks without a match have no row."""
    postings = index.postings
    if index.stored:
        ends = vocabulary.agg(F.min("term").alias("a"), F.max("term").alias("b")).first()
        if ends.a is not None:
            postings = postings.filter(F.col("term").between(ends.a, ends.b))  # prunes row groups
    hits = postings.join(F.broadcast(vocabulary), "term")
    hits = hits.groupBy("chunk_id").agg(F.max("dl").cast("int").alias("dl"), F.collect_list(F.struct(F.col("place").alias("t"), F.col("tf").cast("int").alias("f"))).alias("h"))
    return hits.join(state, "chunk_id").select("chunk_id", "md_id", "is_current", "dl", F.col("h.t").alias("terms"), F.col("h.f").alias("tfs"))


@dataclass
class _Asked:
    """One query for the scorer: places and weights of its informative and of its floored terms, and its filters."""

    query_id: object
    sure: list[tuple[int, float]]
    slight: list[tuple[int, float]]
    md_id: str | None
    withdrawn: bool


class _Scorer:
    """Best k of every query over the batches of a task."""

    def __init__(self, asked: list[_Asked], k: int, avgdl: float) -> None:
        self.asked, self.k, self.avgdl = asked, k, avgdl
        self.best: list[list[tuple[float, str]]] = [[] for _ in asked]
        #: Floored terms add less than this to any chunk.
        self.bound = [sum(w for _, w in a.slight) * (K1 + 1) for a in asked]

    def add(self, b: pa.RecordBatch) -> None:
        terms, tfs, dl = b.column("terms"), b.column("tfs"), b.column("dl").to_numpy()
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(terms).to_numpy())
        place, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.float64)
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / self.avgdl))
        order = np.argsort(place, kind="stable")
        place, row, part = place[order], row[order], part[order]
        known, begins = np.unique(place, return_index=True)
        at = {int(t): (row[x:y], part[x:y]) for t, x, y in zip(known, begins, [*begins[1:], len(place)])}
        ids, current = b.column("chunk_id").to_pylist(), np.asarray(b.column("is_current").fill_null(False), bool)
        md = np.array(b.column("md_id").to_pylist(), object)
        for n, a in enumerate(self.asked):
            self._one(n, a, at, b.num_rows, ids, current, md)

    def _one(self, n: int, a: _Asked, at: dict, rows: int, ids: list[str], current: np.ndarray, md: np.ndarray) -> None:
        found = [(*at[t], w) for t, w in a.sure if t in at]
        least = self.best[n][-1][0] if len(self.best[n]) == self.k else -np.inf
        slight = [(*at[t], w) for t, w in a.slight if t in at]
        if least <= self.bound[n] + 1e-6:  # chunks of floored words alone may count
            found, slight = found + slight, []
        if not found:
            return
        score = np.bincount(np.concatenate([r for r, _, _ in found]), np.concatenate([p * w for _, p, w in found]), rows)
        near = score > 0
        if len(self.best[n]) == self.k:
            near &= score + self.bound[n] + 1e-6 >= least
        if not a.withdrawn:
            near &= current
        some = np.flatnonzero(near)
        if a.md_id is not None and len(some):
            some = some[md[some] == a.md_id]
        if not len(some):
            return
        if len(some) > 4 * self.k:  # only those that may be among the best by the sure part
            cut = np.partition(score[some], -self.k)[-self.k]
            some = some[score[some] + self.bound[n] + 1e-6 >= cut]
        total = score[some]
        for r, p, w in slight:
            i = np.searchsorted(r, some)
            i[i == len(r)] = 0
            total = total + np.where(r[i] == some, p[i] * w, 0.0)
        merged = self.best[n] + [(round(float(s), 6), ids[i]) for s, i in zip(total, some)]
        merged.sort(key=lambda x: (-x[0], x[1]))
        self.best[n] = merged[: self.k]


#: Terms of the chunks that are scored together; their texts are no longer there.
SCORED_TERMS = 1 << 19


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most about ``SCORED_TERMS`` terms, as every batch costs each query a step."""
    held, terms = [], 0
    for b in batches:
        held.append(b)
        terms += len(b.column("terms").flatten()) + b.num_rows
        if terms >= SCORED_TERMS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, terms = [], 0
    if terms:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _held_topk(matched: DataFrame, stats: dict[int, int], chunks: int, avgdl: float, queries: list, places: dict[str, int], k: int) -> DataFrame:
    """(query_id, chunk_id, bm25_score): the best k rows of each query in each task. ``queries``: rows of query terms."""
    weights = {t: _idf(df, chunks) for t, df in stats.items()}
    per_query: dict = defaultdict(list)
    for q in queries:
        per_query[q.query_id].append(q)
    asked = []
    for query_id, rows in per_query.items():
        pairs = [(places[r.term], r.qtf * weights[places[r.term]], weights[places[r.term]] > MIN_IDF) for r in rows if places[r.term] in weights]
        if pairs:
            first = rows[0].asDict()
            asked.append(_Asked(query_id, [(t, w) for t, w, sure in pairs if sure], [(t, w) for t, w, sure in pairs if not sure], first.get("filter_md_id"), bool(first.get("include_withdrawn"))))
    kind = pa.int64() if asked and isinstance(asked[0].query_id, int) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(asked, k, avgdl)
        for b in _joined(batches):
            scorer.add(b)
        rows = [(a.query_id, i, -s) for a, best in zip(asked, scorer.best) for s, i in best]
        cols = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.string(), pa.float64()))], ["query_id", "chunk_id", "bm25_score"])

    return arrow_map(matched, run, f"query_id {'long' if kind == pa.int64() else 'string'}, chunk_id string, bm25_score double")


def _idf(df: int, n: int) -> float:
    raw = np.log((n - df + 0.5) / (df + 0.5)) if n - df + 0.5 > 0 else 0.0
    return float(raw) if raw > 0 else MIN_IDF


def bm25_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    include_withdrawn: bool = False,
    index: TextIndex | None = None,
    small: bool | None = None,
    stem: bool | None = None,
) -> DataFrame:
    """(query_id, chunk_id, bm25_score, rank) for queries (query_id, text).

    Optional query columns filter_md_id and include_withdrawn narrow or widen single queries. ``chunks`` carries
    chunk_id, text, md_id and status (NULL status counts as current) as they are now; only its rows are found, also
    through an ``index`` built earlier. Filters act before the ranking and never on the statistics. ``stem`` folds and
    stems texts and queries alike; an index tells by itself how it was built.
    """
    if index is not None and stem is not None and stem != index.stem:
        raise ValueError(f"the index is built with stem={index.stem}")
    stem = index.stem if index is not None else bool(stem)
    if "include_withdrawn" not in queries.columns and include_withdrawn:
        queries = queries.withColumn("include_withdrawn", F.lit(True))
    carry = tuple(c for c in ("filter_md_id", "include_withdrawn") if c in queries.columns)
    prepared = prepare_queries(queries, carry, small, stem)
    rows = chunks.withColumn("is_current", F.coalesce("status", F.lit("current")) == "current")
    state = rows.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("md_id").cast("string").alias("md_id"), "is_current")
    if prepared.small:
        asked = prepared.terms.collect()  # at most BROADCAST_ROWS rows
        words = sorted({q.term for q in asked})
        places = {w: i for i, w in enumerate(words)}
        scores = _held(index, rows, state, asked, words, places, stem, k)
    else:
        index = index or build_index(chunks.select("chunk_id", "text"), stem)
        any_status = F.coalesce(F.col("include_withdrawn"), F.lit(False)) if "include_withdrawn" in carry else F.lit(False)
        keep = F.col("is_current") | any_status
        if "filter_md_id" in carry:
            keep = keep & (F.col("filter_md_id").isNull() | (F.col("filter_md_id") == F.col("md_id")))
        scores = bm25_scores(index, prepared.terms, state, keep)
    return top_k(scores, k, F.col("bm25_score"), F.col("chunk_id"))


def _held(index: TextIndex | None, rows: DataFrame, state: DataFrame, asked: list, words: list[str], places: dict[str, int], stem: bool, k: int) -> DataFrame:
    """The best k rows of each query and task, with the queries held by the tasks."""
    if index is None:
        typed = rows.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("md_id").cast("string").alias("md_id"), "is_current", "text")
        matched = settle(_matched(typed, words, stem))
        total = matched.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        seen = matched.select(F.explode("terms").alias("place")).groupBy("place").count().collect()  # a row a word asked for
        frequencies = {r.place: r["count"] for r in seen}
    else:
        spark = rows.sparkSession
        vocabulary = spark.createDataFrame([(w, i) for w, i in places.items()], "term string, place int")
        known = index.stats.join(F.broadcast(vocabulary), "term", "left").filter(F.col("place").isNotNull() | F.col("term").isin(EVERY, LENGTH)).collect()
        frequencies = {r.place: r.df for r in known if r.place is not None}
        value = {r.term: r.df for r in known if r.place is None}
        total = type("Total", (), {"n": value.get(EVERY, 0), "length": value.get(LENGTH, 0)})
        matched = _matched_postings(index, vocabulary, state)
    return _held_topk(matched, frequencies, total.n, total.length / total.n if total.n and total.length else 1.0, asked, places, k)


def topic_filter(queries: DataFrame, aliases: DataFrame, hint_col: str = "topic_hint") -> DataFrame:
    """Add filter_md_id from a table (alias, md_id); unknown and ambiguous hints give NULL, that is no filter."""
    asked = queries.select(F.lower(F.col(hint_col)).alias("_alias")).filter("_alias IS NOT NULL").distinct()
    # Only the aliases in use, so that Spark can tell at run time whether they are few enough to broadcast.
    table = aliases.select(F.col("alias").alias("_alias"), F.col("md_id").alias("filter_md_id")).join(asked, "_alias", "left_semi")
    return queries.join(table, F.lower(F.col(hint_col)) == F.col("_alias"), "left").drop("_alias")
