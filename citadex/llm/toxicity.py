"""Toxicity by a weighted finite-state grammar over clauses.

Small transducers read a clause's words: insults (learned words and stems, each with its weight), threats, targets,
negation and reported speech. Their composition is one automaton whose state says whether a negation is near, whether
speech is being reported and whether someone is addressed; an insult or a threat that it reads leaves a weight that depends
on that state. A threat without anyone addressed is owed until a target follows in its clause. Matched clauses are scored, and a logistic regression turns a document's clause scores into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadex.llm.common import arrow_map, settle
from citadex.llm.quality import labelled_sample

# Seed words of the closed classes, in English, German, French and Spanish.
TARGETS = "you your yours youre yourself yourselves u ur them themselves him her everyone everybody du dich dir dein deine ihr euch ihn alle toi vous votre tes eux tous usted ustedes vosotros eres ellos ellas todos".split()
NEGATIONS = "not never no dont doesnt isnt arent wasnt nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say wrote writes called calls reported claimed quoted sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split()
THREATS = "kill hurt murder destroy strangle shoot stab töten umbringen verletzen tuer frapper détruire matar golpear destruir".split()
INSULTS = "idiot moron imbecile scum loser pathetic worthless disgusting stupid".split()

#: Words that a negation reaches.
REACH = 3
STEMS = (4, 5, 6, 7, 8)
#: A clause of at least this weight is a strong match.
STRONG = 3.5
FEATURES = 6
#: Labelled documents for the lexicon, and for the weights of the clause scores; bounds broadcast and driver.
LEXICON_SAMPLE, SAMPLE = 100_000, 20_000
#: Partial counts that a task holds before it hands them on.
HELD = 400_000
SEED_WEIGHT = 2.5
NEGATION, TARGET, REPORT, THREAT, INSULT = range(5)

_SPACE = bytes(c if chr(c).isalnum() or c > 127 or c in b".'" else 32 for c in range(128)) + bytes(range(128, 256))


def words(text: str) -> list[bytes]:
    """Lower-cased words in UTF-8, with a full stop at the end of each clause."""
    b = text.lower().encode("utf-8", "replace")
    for mark in (b".", b",", b";", b":", b"!", b"?", b"\n"):
        b = b.replace(mark, b" . ")
    return b.translate(_SPACE).split()


@dataclass
class Grammar:
    insults: dict[bytes, float]  # words, and stems with a trailing star
    weights: tuple[float, ...] = (0.0,)  # of the intercept and the features

    def __post_init__(self) -> None:
        self.words = {w: (INSULT, x) for w, x in self.insults.items() if not w.endswith(b"*")}
        self.stems = {w[:-1]: (INSULT, x) for w, x in self.insults.items() if w.endswith(b"*")}
        #: What threat words have learned, as insults; it adds to the threat.
        self.own = {w: hit[1] for w in map(str.encode, THREATS) if (hit := self.read(w))}
        for kind, seeds in ((NEGATION, NEGATIONS), (TARGET, TARGETS), (REPORT, REPORTS), (THREAT, THREATS)):
            self.words |= {s.encode(): (kind, SEED_WEIGHT) for s in seeds}
        self.heads = {w[:4] for w in (*self.words, *self.stems)}
        self.product = compose()

    def read(self, word: bytes) -> tuple[int, float] | None:
        """The class and weight of a word: its own entry, or that of its longest stem."""
        if hit := self.words.get(word):
            return hit
        for n in reversed(STEMS):
            if len(word) > n and (hit := self.stems.get(word[:n])):
                return hit
        return None

    def clauses(self, text: str | None) -> tuple[list[float], int]:
        """The scores of the clauses in which an insult or a threat is matched, and the number of all clauses."""
        if not text:
            return [], 1
        tokens, heads = words(text), self.heads
        clauses = max(1, tokens.count(b"."))
        hits = [(i, r) for i, t in enumerate(tokens) if t[:4] in heads and (r := self.read(t))]
        if not any(kind >= THREAT for _, (kind, _) in hits):
            return [], clauses
        stops = np.flatnonzero(np.array([t == b"." for t in tokens]))
        clause = np.searchsorted(stops, [i for i, _ in hits]).tolist()
        found, state, now, owed, at, negated = [], 0, 0.0, 0.0, -1, -99
        for (i, (kind, weight)), c in zip(hits, clause):
            if c != at:
                if now:
                    found.append(now)
                state, now, owed, at, negated = 0, 0.0, 0.0, c, -99
            if state & 1 and i - negated > REACH:
                state &= ~1
            if kind == NEGATION:
                negated = i
            if kind == THREAT and (own := self.own.get(tokens[i])):
                now += self.product[state, INSULT][1] * own
            state, factor, later = self.product[state, kind]
            now += factor * weight
            owed += later * weight
            if kind == TARGET:
                now, owed = now + owed, 0.0
        return (found + [now] if now else found), clauses

    def features(self, text: str | None) -> tuple[float, ...]:
        """What the probability depends on: the best clause, sum and number of matches, clauses, density, strong matches."""
        found, clauses = self.clauses(text)
        total = sum(found)
        strong = sum(x for x in found if x >= STRONG)
        return (max(found, default=0.0), math.log1p(total), math.log1p(len(found)), math.log1p(clauses), total / clauses, math.log1p(strong))

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def compose() -> dict[tuple[int, int], tuple[int, float, float]]:
    """The composed automaton: (state, class read) -> (state, factor of the word's weight, factor that a target pays later).

    State bits: 1 a negation is near, 2 speech is reported, 4 someone is addressed.
    """
    out = {}
    for state in range(8):
        damp = (0.25 if state & 1 else 1.0) * (0.5 if state & 2 else 1.0)
        aimed = bool(state & 4)
        out[state, NEGATION] = (state | 1, 0.0, 0.0)
        out[state, REPORT] = (state | 2, 0.0, 0.0)
        out[state, TARGET] = (state | 4, 0.0, 0.0)
        out[state, INSULT] = (state, damp * (1.25 if aimed else 1.0), 0.0)
        out[state, THREAT] = (state, damp, 0.0) if aimed else (state, 0.0, damp)
    return out


def entries(text: str) -> set[bytes]:
    """Distinct words and stems of a text that could enter the lexicon."""
    distinct = set(words(text))
    distinct.discard(b".")
    found = {w for w in distinct if len(w) > 2}
    for n in STEMS:
        found |= {w[:n] + b"*" for w in distinct if len(w) > n}
    return found


def _document_counts(train: DataFrame) -> DataFrame:
    """entry, pos, neg: in how many texts of ``train`` (y, text) of either label each entry occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}  # toxic texts in the upper half of a number, clean ones in the lower

        def rows() -> pa.RecordBatch:
            n = np.fromiter(held.values(), np.int64, len(held))
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(n >> 32), pa.array(n & 0xFFFFFFFF)], ["entry", "pos", "neg"])

        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                one = 1 << 32 if y else 1
                for e in entries(text or ""):
                    held[e] = held.get(e, 0) + one
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return arrow_map(train.select("y", "text"), run, "entry binary, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))


def learn_insults(train: DataFrame, n_toxic: int, n_clean: int) -> dict[bytes, float]:
    """Words and stems that set the toxic texts of ``train`` (y, text) apart, with their log odds as weights.

    Every entry is counted over all of ``train`` in one table and judged there; what passes comes to the driver, which the
    number of texts bounds. Texts of one label alone teach nothing, then only the seed words count.
    """
    seeds = {w.encode(): SEED_WEIGHT for w in INSULTS}
    if not n_toxic or not n_clean:
        return seeds
    least, clear = (3, 2.8) if n_toxic >= 30 else (2, 1.5)
    odds = F.expr(f"ln((p + 0.5) / ({n_toxic} - p + 0.5)) - ln((q + 0.5) / ({n_clean} - q + 0.5))")
    error = F.expr(f"sqrt(1 / (p + 0.5) + 1 / ({n_toxic} - p + 0.5) + 1 / (q + 0.5) + 1 / ({n_clean} - q + 0.5))")
    seed = F.col("entry").isin([bytearray(s) for s in seeds])
    counts = _document_counts(train).withColumn("odds", odds).withColumn("error", error).withColumn("seed", seed)
    sharp = (F.col("odds") > 2.3) & (F.col("p") / n_toxic > 6 * F.col("q") / n_clean) & (F.col("odds") > F.col("error"))
    passed = (F.col("p") >= least) & sharp & (F.col("odds") / F.col("error") > F.when(F.col("seed"), 2.8).otherwise(clear))
    found = counts.withColumn("passed", passed).where("passed OR seed").collect()
    learned = {bytes(r.entry): min(6.0, r.odds - r.error) for r in found if r.passed}
    met = {bytes(r.entry) for r in found if r.q}
    return {s: w for s, w in seeds.items() if s not in met} | learned


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Intercept and weights of a logistic regression, by Newton steps."""
    a = np.column_stack([np.ones(len(y)), x])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (p - y) / len(y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, hold: int = 2, sample: int = SAMPLE, lexicon_sample: int = LEXICON_SAMPLE) -> Grammar:
    """The grammar from labelled documents outside the held-out fold.

    The lexicon comes from at most ``lexicon_sample`` of them, the weights of the clause scores from at most ``sample``, each
    those of least id hash; so many ids at most are broadcast. Without labels of both kinds only the seed words count.
    """
    chosen = settle(labelled_sample(labels, "toxic", folds, hold, lexicon_sample))
    train = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sizes = {r.y: r["count"] for r in chosen.groupBy("y").count().collect()}
    grammar = Grammar(learn_insults(train, sizes.get(1, 0), sizes.get(0, 0)))
    shared = docs.sparkSession.sparkContext.broadcast(grammar.insults)
    names = [f"f{i}" for i in range(FEATURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(shared.value)
        for b in batches:
            f = np.array([g.features(t) for t in b.column(1).to_pylist()], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, f.T)], ["y", *names])

    few = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    weighed = docs.select("doc_id", "text").join(few, "doc_id").select("y", "text")
    rows = arrow_map(weighed, run, "y int, " + ", ".join(f"{n} double" for n in names)).toPandas()
    y = rows["y"].to_numpy(float)
    if len(y) and y.min() < y.max():
        weights = logistic(rows[names].to_numpy(float), y)
    else:
        weights = (-3.0, 1.0, 1.0, 0.0, -0.5, 0.0, 0.0)
    return Grammar(grammar.insults, weights)


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id and score, 0 to 1, of every row of ``docs`` from its whole text.

    Null and empty texts match no clause and get the score of that. Repeated rows give repeated results; columns beyond
    doc_id and text do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast((grammar.insults, grammar.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, score double")
