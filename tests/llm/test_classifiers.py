"""Language, quality and toxicity: held-out accuracy, defined results on awkward rows."""

import numpy as np
import pytest
from common_rows import awkward, nothing, sample

from citadex.llm import langid, quality, toxicity
from citadex.llm.common import held_out
from citadex.llm.registry import QUERIES

BIG = "/root/testdata/sf0.01"


def joined(spark, name, column):
    labels = sample(spark, BIG, "labels").select("doc_id", column)
    return QUERIES[name](spark, BIG).join(labels, "doc_id").where("held_out").collect()


def test_fold_is_crc32_of_the_id_as_text(spark):
    import zlib

    rows = spark.range(50).select("id", held_out("id", 5, 0).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows.collect())


def test_language_held_out(spark):
    docs = sample(spark, BIG)
    rows = QUERIES["op5_language_id"](spark, BIG).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_codewords_keep_their_distance():
    for n in (2, 3, 4, 6, 7, 20):
        code = langid.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert set(np.unique(code)) == {-1.0, 1.0} and min(apart) >= max(1, code.shape[1] // 4)


def test_wrong_bits_are_corrected():
    """With seven languages a few failing bits leave the decoding right."""
    counts = np.full((7, langid.WIDTH), 1e-3)
    texts = ["".join(chr(97 + (i * 3 + j) % 26) for j in range(3)) * 12 for i in range(7)]
    for i, t in enumerate(texts):
        counts[i] += np.bincount(langid.ngrams(t), minlength=langid.WIDTH)
    model = langid.build([f"l{i}" for i in range(7)], counts)
    model.weights[:, :4] *= -1
    assert [model.predict(t)[0] for t in texts] == [f"l{i}" for i in range(7)]


def test_language_awkward_rows(spark):
    docs = awkward(spark)
    model = langid.fit(docs, folds=50, hold=49)
    rows = langid.identify(docs, model).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == 10 and [by[i].lang_pred for i in (2, 3, 4, 8)] == ["und", "und", "und", "de"]
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and {2, 3, 4}.isdisjoint(r.doc_id for r in kept.collect())
    assert langid.identify(nothing(spark), langid.fit(nothing(spark))).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(nothing(spark))).collect()} == {"und"}


def test_quality_held_out(spark):
    rows = joined(spark, "op8_quality_classifier", "quality")
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    low = [r.score for r in rows if r.quality == 0]
    assert np.mean([s < 0.5 for s in low]) > 0.85


def test_compiled_rules_equal_the_fitted_ones(spark, sf):
    docs, labels = sample(spark, sf), sample(spark, sf, "labels")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        x = np.array([quality.statistics(r.text)])
        z = model.intercept + sum(w * quality._matches(x, p)[0] for p, w in model.rules)
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_awkward_rows(spark, sf):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, None), (3, 0, 1), (None, 1, 1), (5, None, None), (8, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], labels.schema)
    assert {round(r.score, 6) for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert quality.score(nothing(spark), quality.fit(nothing(spark), labels)).count() == 0


def test_toxicity_held_out(spark):
    rows = joined(spark, "op4_toxicity", "toxic")
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([s >= 0.3 for s in toxic]) > 0.6 and np.mean([s >= 0.3 for s in clean]) < 0.05


def test_grammar_reads_clauses_not_words():
    g = toxicity.Grammar({b"idiot": 4.0, b"lowe*": 3.0})
    best = lambda text: max(g.clauses(text)[0], default=0.0)
    plain = best("what an idiot")
    assert best("you idiot") > plain > best("not an idiot") > 0
    assert best("she said he was an idiot") < plain
    assert best("not now and then but an idiot") == plain  # out of the negation's reach
    assert best("not. an idiot") == plain and best("nothing to see") == 0
    assert best("i will kill you") == best("you i will kill") == best("you: i kill you") == toxicity.SEED_WEIGHT and best("you: i kill") == 0
    assert best("kill yourself") == best("i will hurt them") == toxicity.SEED_WEIGHT
    assert best("loweich war es") == 3.0 and best("lowe") == 0
    assert g.clauses(None) == ([], 1) and 0 < g.score("") < 1


def test_threats_meet_targets_on_either_side():
    g = toxicity.Grammar({b"idiot": 4.0})
    best = lambda grammar, text: max(grammar.clauses(text)[0], default=0.0)
    assert best(g, "i will kill you") == best(g, "you i will kill") > best(g, "i will not kill you") > 0
    assert best(g, "i will kill") == best(g, "i kill. you") == best(g, "you: i kill") == 0
    assert best(g, "ich werde dich töten") == best(g, "ich töten dich") > 0
    learned = toxicity.Grammar({b"murder": 3.0, b"hurt": 2.0})
    assert best(learned, "a murder") == 3.0 and best(learned, "murder you") == 3.0 + best(g, "murder you")


def test_toxicity_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, None), (3, 0, 1), (None, 1, 1), (5, None, 0), (8, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], labels.schema)
    assert toxicity.score(nothing(spark), toxicity.fit(nothing(spark), none)).count() == 0


def read_naively(grammar, text):
    """Clause scores by the rules in words: what stands where in the clause, without an automaton."""
    scores = []
    for clause in " ".join(w.decode() for w in toxicity.words(text)).split("."):
        tokens, total = [w.encode() for w in clause.split()], 0.0
        kinds = [grammar.read(w) for w in tokens]
        of = lambda kind: [i for i, k in enumerate(kinds) if k and k[0] == kind]  # noqa: B023, E731
        for i, k in enumerate(kinds):
            if not k or k[0] < toxicity.THREAT:
                continue
            # The latest negation counts while every hit since it lay within its reach.
            last = [j for j in of(toxicity.NEGATION) if j < i]
            near = bool(last) and i - last[-1] <= toxicity.REACH
            damp = (0.25 if near else 1.0) * (0.5 if any(j < i for j in of(toxicity.REPORT)) else 1.0)
            before, after = (any(j < i for j in of(toxicity.TARGET)), any(j > i for j in of(toxicity.TARGET)))
            if k[0] == toxicity.INSULT:
                total += damp * (1.25 if before else 1.0) * k[1]
            else:
                total += damp * (1.25 if before else 1.0) * grammar.own.get(tokens[i], 0.0)
                total += damp * k[1] if before or after else 0.0
        if total:
            scores.append(total)
    return scores


def test_automaton_equals_a_naive_reader():
    import random

    g = toxicity.Grammar({b"idiot": 4.0, b"lowe*": 3.0, b"murder": 2.0})
    rng = random.Random(1)
    vocabulary = ["idiot", "loweich", "murder", "kill", "you", "not", "said", "never", "dich", "tree", "house", "runs", ".", ",", "and", "töten"]
    for _ in range(3000):
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(1, 14)))
        assert g.clauses(text)[0] == pytest.approx(read_naively(g, text)), text


def test_lexicon_counts_every_entry(spark):
    """The table of counts and what passes, against plain counting over all texts."""
    import math
    import random
    from collections import Counter

    rng = random.Random(4)
    texts = [(1, f"{rng.choice(['zonker', 'blarg', 'fribble'])} {' '.join(rng.choices('abcdefgh', k=9))} common{rng.randrange(4)}") for _ in range(60)]
    texts += [(0, f"common{rng.randrange(4)} plain{rng.randrange(9)} {rng.choice(['blarg', 'x', 'y'] if i % 7 == 0 else ['x'])}") for i in range(400)]
    n1, n0 = sum(y for y, _ in texts), sum(1 - y for y, _ in texts)
    count = {y: Counter(e for label, t in texts if label == y for e in toxicity.entries(t)) for y in (0, 1)}
    want = {}
    for e, p in count[1].items():
        q = count[0][e]
        odds = math.log((p + 0.5) / (n1 - p + 0.5)) - math.log((q + 0.5) / (n0 - q + 0.5))
        error = math.sqrt(1 / (p + 0.5) + 1 / (n1 - p + 0.5) + 1 / (q + 0.5) + 1 / (n0 - q + 0.5))
        if p >= 3 and odds > max(2.3, error, 2.8 * error) and p / n1 > 6 * q / n0:
            want[e] = min(6.0, odds - error)
    got = toxicity.learn_insults(spark.createDataFrame(texts, "y int, text string"), n1, n0)
    seeds = {w.encode() for w in toxicity.INSULTS}
    assert {e: w for e, w in got.items() if e not in seeds} == pytest.approx(want) and b"zonker" in got


def test_decoding_equals_a_search_of_all_codewords(spark, sf):
    model = langid.fit(sample(spark, sf))
    assert len(model.languages) == 4
    for r in sample(spark, sf).collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert model.predict(r.text) == ("und", 0.0, False)
            continue
        grams = langid.ngrams(r.text)
        margin = [sum(float(model.weights[g, b]) for g in grams) / len(grams) * min(len(grams), langid.EVIDENCE) for b in range(model.code.shape[1])]
        loss = [sum(w * np.log1p(np.exp(-min(700, c * m))) for w, c, m in zip(model.bit_weight, code, margin)) for code in model.code]
        best = min(range(len(loss)), key=lambda i: loss[i])
        assert model.predict(r.text)[0] == model.languages[best]
        assert model.predict(r.text)[1] == pytest.approx(1 / sum(np.exp(loss[best] - x) for x in loss), rel=1e-4)


def test_texts_without_a_letter_are_undetermined(spark, sf):
    model = langid.fit(sample(spark, sf))
    for text in ("²", "½ ①", "Ⅷ", "12 ³", "_ - !", "\U0001f600", "٣", ""):
        assert model.predict(text)[0] == "und", text
    assert model.predict("ñ")[0] in model.languages


def test_every_language_is_learned(spark):
    """More languages than any bound of before, a few texts each."""
    rows = [(i, f"{a}{b} {b}{a}{a} {a}{a}{b}{b} " * 8, f"l{a}{b}") for i, (a, b) in enumerate((a, b) for a in "abcdefghijklmnopqrstuvwxy" for b in "abcdefghijklmnopqrstuvwxyz" if a != b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, folds=10**6, hold=10**6 - 1)
    assert len(model.languages) == len(rows) > 512
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.9
