"""Spelling variants of words, by partition-and-enumerate signatures of letter multisets.

A word is read as a binary vector over (letter, k), set where the letter occurs at least k times. One inserted, deleted or
replaced letter changes at most two places of it. The letters are dealt into ``PARTS`` parts; whichever two parts those
places lie in, the other parts agree. So every word gets one signature for each way of leaving two parts out, near words share
at least one signature, and an equi-join over signatures finds them all; each meeting is verified by edit distance.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citadex.llm.common import settle

#: Runs of letters that count as words, and the letters that are lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts that letters are dealt into; two are left out of a signature.
PARTS = 5
#: A signature with more words is refined by the halves of its words.
HALVED = 16
#: Joins that double the reach of a chain of forms; a form is at least twice as frequent, so chains are short.
DOUBLINGS = 7


def words(docs: DataFrame, one_in: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: the words of all texts after one run in ``one_in``, chosen by crc32 of ``doc_id:run``, has lost a letter."""
    runs = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run")
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    found = docs.select("doc_id", "text").select("doc_id", runs).withColumn("h", F.crc32(key.cast("binary")))
    at = F.expr("int(h % length(run))")
    less = F.concat(F.expr("substring(run, 1, int(h % length(run)))"), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % one_in == 0, less).otherwise(F.col("run")).alias("word")
    kept = found.where(F.length("run") >= least_length).select(word).where(F.length("word") >= least_length)
    return kept.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _part(k: int, letters: Column) -> Column:
    """The letters of part ``k``, in order; letters are dealt by code point, which parts common ones."""
    return F.array_join(F.filter(letters, lambda c: F.ascii(c) % PARTS == k), "")


def signatures(vocabulary: DataFrame) -> DataFrame:
    """word, n, sig: one signature for every two parts left out."""
    parted = vocabulary.withColumn("letters", F.array_sort(F.split("word", "")))
    for k in range(PARTS):
        parted = parted.withColumn(f"p{k}", _part(k, F.col("letters")))
    kept = [[k for k in range(PARTS) if k not in out] for out in combinations(range(PARTS), 2)]
    each = F.array(*(F.xxhash64(F.lit(i), *(f"p{k}" for k in ks)) for i, ks in enumerate(kept)))
    return parted.select("word", "n", F.explode(each).alias("sig"))


def _halves() -> Column:
    """Keys of a word's halves: words within one edit agree in the first half or in the rest, for the greater length L.

    The edit lies at or behind place L/2 and leaves the first L/2 letters, or before it and leaves the last L - L/2.
    """
    return F.expr(
        "flatten(transform(array(length(word), length(word) + 1), l -> array("
        "xxhash64('front', l, substring(word, 1, int(l div 2))), xxhash64('back', l, right(word, int(l - l div 2))))))"
    )


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, other, other_n: every word with each word one edit away, once.

    A signature of over ``HALVED`` words meets by halves as well, so that words which share letters in any order do not all
    meet; words one edit apart share a half, and no meeting is lost. Only verified pairs leave the join.
    """
    listed = settle(signatures(vocabulary))
    sizes = listed.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1")
    listed = listed.join(sizes, "sig")
    keys = F.when(F.col("size") > HALVED, _halves()).otherwise(F.array(F.lit(0).cast("long")))
    met = listed.select("sig", F.explode(keys).alias("half"), "word", "n")
    a, b = met.alias("a"), met.alias("b")
    close = F.abs(F.length("a.word") - F.length("b.word")) <= 1
    pairs = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.half") == F.col("b.half")) & (F.col("a.word") < F.col("b.word")) & close & (F.levenshtein("a.word", "b.word", 1) == 1))
    once = pairs.select(F.col("a.word").alias("x"), F.col("a.n").alias("x_n"), F.col("b.word").alias("y"), F.col("b.n").alias("y_n")).distinct()
    ends = F.explode(F.array(F.struct(F.col("x").alias("word"), F.col("y").alias("other"), F.col("y_n").alias("other_n")), F.struct(F.col("y").alias("word"), F.col("x").alias("other"), F.col("x_n").alias("other_n"))))
    return once.select(ends.alias("e")).select("e.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of ``forms`` (word, form) that begins at each word, by pointer doubling."""
    at = settle(forms.select("word", F.coalesce("form", "word").alias("root")))
    for _ in range(DOUBLINGS):
        onward = at.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return at
    raise RuntimeError("a chain of forms is longer than frequencies allow")


def variants(docs: DataFrame, one_in: int = 97, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``docs`` (doc_id, text).

    ``words`` says what a word is. Two words are near if one code point was inserted, deleted or replaced between them. A word's
    form is its most frequent near word (ties: the smallest in code-point order) if that is at least ``ratio`` times as
    frequent; its root is where forms lead in the end. A null text holds no word, a null id counts as empty text in
    the choice of runs; repeated rows count each; other columns are not read. An empty table gives an empty one.
    """
    vocabulary = settle(words(docs, one_in, least_length, least_count))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    found = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")))
    formed = settle(vocabulary.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("f")).select("word", "n", "n_near", "f.form", "f.form_n"))
    return formed.join(roots(formed), "word")
