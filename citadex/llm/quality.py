"""Quality by a sparse rule ensemble.

Small trees over text statistics are grown on a bounded sample of labelled documents; every path in them becomes a
conjunctive rule, a lasso logistic regression keeps few of the rules, and those are compiled into one Spark column
expression over the statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citadex.llm.common import arrow_map, held_out

#: Labelled documents that the ensemble is fitted on, those of least id hash; bounds what reaches the driver.
SAMPLE = 20_000
TREES, DEPTH, CUTS = 30, 3, 24
STATS = ("chars", "words", "word_length", "upper", "digits", "symbols", "marks", "distinct", "repeats", "lines", "repeated_lines", "stops", "common")
_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256))
_UPPER, _DIGITS, _STOPS, _MARKS, _BLANK = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,", b"!?|", b" \t\n\r\x0b\x0c"
_SYMBOLS = bytes(c for c in range(128) if c not in _LETTERS + _DIGITS + _STOPS + _MARKS + _BLANK + b"'-")


def statistics(text: str | None) -> tuple[float, ...]:
    """The statistics of one whole text, zeros for none; ratios are by bytes, words or lines."""
    b = (text or "").encode()
    words = b.split()
    if not words:
        return (float(len(text or "")), *[0.0] * (len(STATS) - 1))
    n, w = len(b), len(words)
    share = lambda chars: (n - len(b.translate(None, chars))) / n
    letters = share(_LETTERS)
    lines = [x for x in b.split(b"\n") if x.strip()]
    return (
        math.log1p(n),
        math.log1p(w),
        (n - w) / w,
        share(_UPPER) / letters if letters else 0.0,
        share(_DIGITS),
        share(_SYMBOLS),
        share(_MARKS),
        len(set(words)) / w,
        sum(map(eq, words, words[1:])) / w,
        len(lines) / w,
        1 - len(set(lines)) / len(lines),
        share(_STOPS),
        sum(len(x) <= 3 for x in words) / w,
    )


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the statistics of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([statistics(t) for t in b.column(len(keep)).to_pylist()], float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *map(pa.array, found.T)], [*keep, *STATS])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"{s} double" for s in STATS])
    return arrow_map(docs.select(*keep, "text"), run, schema)


Condition = tuple[int, bool, float]  # statistic, above, cut


@dataclass
class Rules:
    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]]


def _paths(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], features: np.ndarray, path: tuple = ()) -> list[tuple[Condition, ...]]:
    """All paths of one tree that is grown on these rows."""
    found = [path] if path else []
    if len(path) >= DEPTH or len(y) < 10 or y.min() == y.max():
        return found
    best, gain = None, 1e-9
    total, n = y.sum(), len(y)
    for f in features:
        above = x[:, f][:, None] > cuts[f][None, :]
        m = above.sum(axis=0)
        s = (above * y[:, None]).sum(axis=0)
        ok = (m >= 3) & (m <= n - 3)
        if not ok.any():
            continue
        g = np.where(ok, s**2 / np.maximum(m, 1) + (total - s) ** 2 / np.maximum(n - m, 1) - total**2 / n, 0)
        if g.max() > gain:
            gain, best = g.max(), (int(f), float(cuts[f][g.argmax()]))
    if not best:
        return found
    f, cut = best
    up = x[:, f] > cut
    return found + _paths(x[up], y[up], cuts, features, (*path, (f, True, cut))) + _paths(x[~up], y[~up], cuts, features, (*path, (f, False, cut)))


def _matches(x: np.ndarray, path: tuple[Condition, ...]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, above, cut in path:
        hit &= (x[:, f] > cut) == above
    return hit


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 2e-3, seed: int = 11) -> Rules:
    """Grow trees on resampled rows, take their paths as rules, and weigh them by lasso logistic regression."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if len(y) < 4 or y.min() == y.max():
        return Rules(base, [])
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, CUTS))) for c in x.T]
    # Quantiles among the rarer label resolve what the majority would hide.
    rare = x[y == (y.mean() < 0.5)]
    cuts = [np.unique(np.r_[c, np.quantile(r, np.linspace(0.02, 0.98, CUTS))]) for c, r in zip(cuts, rare.T)]
    paths: dict[tuple, None] = {}
    for _ in range(TREES):
        rows = rng.integers(0, len(y), min(len(y), 4000))
        features = rng.choice(x.shape[1], min(x.shape[1], 6), replace=False)
        for path in _paths(x[rows], y[rows], cuts, features):
            paths.setdefault(tuple(sorted(path)))
    rules = list(paths)
    a = np.column_stack([_matches(x, p) for p in rules]).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    weights, intercept = np.zeros(a.shape[1]), base
    moved, t = weights, 1.0
    bound = 4.0 / max(1e-9, float(np.linalg.eigvalsh(a.T @ a / len(y))[-1]) + 1.0) if len(rules) else 1.0
    previous = (weights, intercept)
    ahead = (weights, intercept)
    for _ in range(400):
        error = 1 / (1 + np.exp(-(a @ ahead[0] + ahead[1]))) - y
        step = ahead[0] - bound * (a.T @ error) / len(y)
        now = (np.sign(step) * np.maximum(np.abs(step) - bound * penalty, 0), ahead[1] - bound * float(error.mean()))
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        pull = (t - 1) / later
        ahead = (now[0] + pull * (now[0] - previous[0]), now[1] + pull * (now[1] - previous[1]))
        previous, t = now, later
    weights, intercept = previous
    return Rules(float(intercept), [(rules[i], float(weights[i])) for i in np.flatnonzero(np.abs(weights) > 1e-4)])


def compiled(model: Rules) -> Column:
    """The score as a column expression over the statistics."""
    logit = F.lit(model.intercept)
    for path, weight in model.rules:
        hit = F.lit(True)
        for f, above, cut in path:
            hit = hit & ((F.col(STATS[f]) > cut) if above else (F.col(STATS[f]) <= cut))
        logit = logit + F.when(hit, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def labelled_sample(labels: DataFrame, column: str, folds: int, hold: int, sample: int) -> DataFrame:
    """doc_id and y of at most ``sample`` labelled ids outside the held-out fold; of several labels the mean decides."""
    usable = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, hold))
    one = usable.groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, hold: int = 0, sample: int = SAMPLE) -> Rules:
    """The ensemble from labelled documents outside the held-out fold; a constant score where labels do not differ."""
    chosen = F.broadcast(labelled_sample(labels, "quality", folds, hold, sample))
    train = with_statistics(docs.select("doc_id", "text").join(chosen, "doc_id"), "doc_id", "y").orderBy("doc_id").toPandas()
    return fit_rules(train[list(STATS)].to_numpy(float), train["y"].to_numpy(float))


def score(docs: DataFrame, model: Rules) -> DataFrame:
    """doc_id and score, 0 to 1, of every row of ``docs``, from statistics of the whole text.

    Null and empty texts have zero statistics and get the score of those. Repeated rows give repeated results; columns
    beyond doc_id and text do not matter.
    """
    return with_statistics(docs, "doc_id").select("doc_id", compiled(model).alias("score"))
