"""English suffix stripping (Porter 1980), over token lists or a vocabulary, in Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import fold_diacritics

# The published suffix tables.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive",
    "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """One letter per letter: v for vowels, c for consonants (y after a consonant is a vowel)."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, table: dict[str, str]) -> str:
    suffix = max((s for s in table if word.endswith(s)), key=len, default=None)
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    return stem + table[suffix] if _measure(stem) > 0 else word


def porter(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    # plurals
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past tense and gerund
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _cvc(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2), _STEP3)
    suffix = max((s for s in _STEP4 if word.endswith(s)), key=len, default=None)
    if suffix:
        stem = word[: -len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=50_000)
def _remembered(word: str) -> str:
    return porter(word)


@F.pandas_udf(T.StringType())
def _porter_series(words: pd.Series) -> pd.Series:
    return words.map(_remembered, na_action="ignore")


def porter_lists(lists: pa.ListArray) -> pa.ListArray:
    """Stems of the tokens of every list; of a batch only the distinct tokens become Python strings."""
    coded = lists.flatten().dictionary_encode()
    stems = pa.array([_remembered(w) for w in coded.dictionary.to_pylist()], pa.string())
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, stems.take(coded.indices), mask=lists.is_null())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _porter_lists(lists: pa.Array) -> pa.Array:
    return porter_lists(lists)


def stem_tokens(tokens: Column) -> Column:
    """A list of tokens folded to base letters and stripped of suffixes, inside its row; NULL stays NULL."""
    return _porter_lists(F.transform(tokens, fold_diacritics))


def stem_vocabulary(terms: DataFrame, col: str = "term") -> DataFrame:
    """(term, stem) for every distinct term: folded to base letters, then stripped of suffixes."""
    distinct = terms.select(col).distinct()
    return distinct.withColumn("stem", _porter_series(fold_diacritics(F.col(col))))
