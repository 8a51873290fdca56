"""Text helpers as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in the Unicode sense plus the four ASCII separators, for use under (?U).
WS = r"[\s\x1c-\x1f]"
# The same characters spelled out.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression, so that nested lambdas reuse it."""
    return F.transform(F.array(value), body)[0]


def clean_text(c: Column) -> Column:
    """Collapse white space and strip; NULL becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"(?U){WS}+", " "))


def strip(c: Column) -> Column:
    """Drop white space at both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern`` or NULL."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def word_tokens(c: Column) -> Column:
    """Word tokens of any script, digits and underscore included."""
    return extract_all(c, WORD)


def index_tokens(c: Column) -> Column:
    """Lower-case index terms; the underscore separates."""
    return extract_all(F.lower(c), r"[\p{L}\p{N}]+")


def _folding() -> tuple[str, str]:
    """Letters that decompose into a base letter and marks, and their base letters, from the Unicode tables."""
    accented, base = [], []
    for code in range(0xC0, 0x2000):
        whole = unicodedata.normalize("NFD", chr(code))
        if len(whole) > 1 and unicodedata.combining(whole[0]) == 0 and all(unicodedata.combining(c) for c in whole[1:]):
            accented.append(chr(code))
            base.append(whole[0])
    return "".join(accented), "".join(base)


_ACCENTED, _BASE = _folding()


def fold_diacritics(c: Column) -> Column:
    """Lower case without diacritics: letters lose their marks, marks that stand alone go."""
    return F.regexp_replace(F.translate(F.lower(c), _ACCENTED, _BASE), r"\p{Mn}+", "")
