"""Porter's published steps as one DuckDB select over (term, w): the SQL twin of the stemmer."""

from __future__ import annotations

from ..functions.stem import _STEP2, _STEP3, _STEP4


def shape(x: str) -> str:
    """V for vowels, C for consonants; y is a vowel after a consonant, settled from left to right."""
    s = f"regexp_replace(regexp_replace(regexp_replace({x}, '^y', 'C'), '[aeiou]', 'V', 'g'), '[a-xz]', 'C', 'g')"
    for _ in range(3):
        s = f"replace(replace({s}, 'Cy', 'CV'), 'Vy', 'VC')"
    return s


def measure(x: str) -> str:
    return f"((length({shape(x)}) - length(replace({shape(x)}, 'VC', ''))) // 2)"


def cut(n: int) -> str:
    return f"substr(w, 1, length(w) - {n})"


def cvc(x: str) -> str:
    return f"({shape(x)} LIKE '%CVC' AND right({x}, 1) NOT IN ('w', 'x', 'y'))"


def _swap(table: dict[str, str]) -> str:
    cases = " ".join(
        f"WHEN ends_with(w, '{s}') THEN CASE WHEN {measure(cut(len(s)))} > 0 THEN {cut(len(s))} || '{table[s]}' ELSE w END"
        for s in sorted(table, key=len, reverse=True)
    )
    return f"CASE {cases} ELSE w END"


def steps() -> list[str]:
    has_vowel = lambda n: f"{shape(cut(n))} LIKE '%V%'"
    last = sorted(_STEP4, key=len, reverse=True)
    drop = " ".join(
        f"WHEN ends_with(w, '{s}') THEN CASE WHEN {measure(cut(len(s)))} > 1"
        + (f" AND right({cut(3)}, 1) IN ('s', 't')" if s == "ion" else "")
        + f" THEN {cut(len(s))} ELSE w END"
        for s in last
    )
    return [
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut(1)} ELSE w END",
        # The mark '+' tells that an ending went and the rest is to be mended.
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {measure(cut(3))} > 0 THEN {cut(1)} ELSE w END"
        f" WHEN ends_with(w, 'ed') AND {has_vowel(2)} THEN {cut(2)} || '+' WHEN ends_with(w, 'ing') AND {has_vowel(3)} THEN {cut(3)} || '+' ELSE w END",
        f"CASE WHEN NOT ends_with(w, '+') THEN w WHEN regexp_matches(w, '(at|bl|iz)\\+$') THEN {cut(1)} || 'e'"
        f" WHEN length(w) > 2 AND substr(w, length(w) - 1, 1) = substr(w, length(w) - 2, 1) AND {shape(cut(1))} LIKE '%C'"
        f" THEN CASE WHEN substr(w, length(w) - 1, 1) NOT IN ('l', 's', 'z') THEN {cut(2)}"
        f" WHEN {measure(cut(1))} = 1 AND {cvc(cut(1))} THEN {cut(1)} || 'e' ELSE {cut(1)} END"
        f" WHEN {measure(cut(1))} = 1 AND {cvc(cut(1))} THEN {cut(1)} || 'e' ELSE {cut(1)} END",
        f"CASE WHEN ends_with(w, 'y') AND {has_vowel(1)} THEN {cut(1)} || 'i' ELSE w END",
        _swap(_STEP2),
        _swap(_STEP3),
        f"CASE {drop} ELSE w END",
        f"CASE WHEN ends_with(w, 'e') AND ({measure(cut(1))} > 1 OR {measure(cut(1))} = 1 AND NOT {cvc(cut(1))}) THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {measure('w')} > 1 THEN {cut(1)} ELSE w END",
    ]


def stems_sql(source: str) -> str:
    """(term, stem) of a table or subquery with a column ``term``."""
    body = f"SELECT term, strip_accents(lower(term)) AS f, strip_accents(lower(term)) AS w FROM {source}"
    for step in steps():
        body = f"SELECT term, f, {step} AS w FROM ({body})"
    return f"SELECT term, CASE WHEN regexp_matches(f, '^[a-z]{{3,}}$') THEN w ELSE f END AS stem FROM ({body})"
