"""Language identification by error-correcting output codes.

Every language has a codeword; one binary n-gram classifier for each bit predicts it. Decoding adds, over the bits, the
logistic loss of the classifier's margin against the codeword, weighted by how well the bit separates the languages, and
takes the codeword of least loss. Texts whose two nearest codewords lie close together are flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadex.llm.common import arrow_map, held_out

#: Hash bits of byte trigrams, and of byte pairs.
TRI, PAIR = 13, 11
WIDTH = (1 << TRI) + (1 << PAIR)
UNKNOWN = "und"
#: Evidence of further n-grams beyond this many no longer adds to the confidence.
EVIDENCE = 48
_PLAIN = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(128)) + bytes(range(128, 256))


def ngrams(text: str) -> np.ndarray:
    """Hashed byte trigrams and pairs of a text, lower-cased, with all but letters as spaces."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_PLAIN) + b" ", np.uint8).astype(np.uint32)
    pair = b[:-1] | b[1:] << 8
    tri = pair[:-1] | b[2:] << 16
    tri = tri[(tri != 0x202020)]
    return np.concatenate([(tri * np.uint32(2654435761)) >> np.uint32(32 - TRI), ((pair * np.uint32(2246822519)) >> np.uint32(32 - PAIR)) + np.uint32(1 << TRI)])


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """An n x bits matrix of -1 and 1: the exhaustive code for up to six languages, beyond that the best of random ones."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        cols = [[1] + [1 if c >> k & 1 else -1 for k in range(n - 1)] for c in range((1 << (n - 1)) - 1)]
        return np.array(cols, float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(12 * np.log2(n)))
    best, score = None, -1
    for _ in range(50):
        m = rng.choice([-1.0, 1.0], (n, bits))
        apart = ((bits - m @ m.T) / 2 + np.eye(n) * bits).min()
        if apart > score and (np.abs(m.sum(axis=0)) < n).all():
            best, score = m, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # n-grams x bits
    bit_weight: np.ndarray  # bits

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, confidence from 0 to 1, and whether a second language is nearly as likely."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        grams = ngrams(text)
        if len(grams) < WIDTH:
            margin = self.weights[grams].sum(axis=0, dtype=np.float64) / len(grams)
        else:
            margin = np.bincount(grams, minlength=WIDTH) @ self.weights / len(grams)
        margin = margin * min(len(grams), EVIDENCE)
        loss = np.logaddexp(0, -self.code * margin) @ self.bit_weight
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(np.argmin(loss))
        second = np.partition(p, -2)[-2] if len(p) > 1 else 0.0
        return self.languages[best], float(p[best]), bool(p[best] - second < 0.1)


def fit(docs: DataFrame, folds: int = 5, hold: int = 0) -> Model:
    """Count the n-grams of every labelled document outside the held-out fold, and derive the bit classifiers.

    All labelled rows count, and every language that has one is learned. What reaches the driver is one number a language
    and n-gram, 40 KB a language, however many rows there are; it grows with the distinct values of lang alone.
    Rows without text or label teach nothing; without any labelled row the model knows no language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                grams = ngrams(text)
                if len(grams):
                    v = sums.setdefault(lang, np.zeros(WIDTH))
                    v += np.bincount(grams, minlength=WIDTH) / np.sqrt(len(grams))
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at])], ["lang", "gram", "n"])

    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", folds, hold)).select("lang", "text")
    counts = arrow_map(train, run, "lang string, gram int, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    languages, place = np.unique(found["lang"].to_numpy(str), return_inverse=True)
    gram, n = found["gram"].to_numpy(), found["n"].to_numpy()
    share = np.zeros((len(languages), WIDTH), np.float32)
    share[place, gram] = n
    languages = languages.tolist()
    return build(languages, share)


def build(languages: list[str], counts: np.ndarray) -> Model:
    """The bit classifiers from the n-gram counts of each language."""
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((WIDTH, 1), np.float32), np.ones(1))
    smooth = counts.astype(np.float64) + 0.05 * counts.sum(axis=1, keepdims=True) / WIDTH + 1e-9
    share = smooth / smooth.sum(axis=1, keepdims=True)
    weights = np.empty((WIDTH, code.shape[1]))
    for b in range(code.shape[1]):
        yes, no = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
        weights[:, b] = np.clip(np.log(yes) - np.log(no), -6, 6)
    # How far a bit's classifier sets the languages apart from the wrong side, at the worst language.
    apart = np.maximum((code * (share @ weights)).min(axis=0), 1e-3)
    return Model(languages, code, weights.astype(np.float32), apart / apart.sum() * np.sqrt(len(apart)) * 1.5)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row of ``docs``, from the whole text.

    Texts that are null, empty or without a letter are ``und`` with score 0. Repeated rows give repeated results; columns
    beyond doc_id and text do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language is told without ambiguity, in all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([lang != UNKNOWN and not ambiguous for lang, _, ambiguous in got], pa.bool_()))

    return arrow_map(docs, run, docs.schema)
