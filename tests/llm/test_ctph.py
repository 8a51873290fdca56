import hashlib

from common_rows import awkward, nothing, sample
from hypothesis import given, settings
from hypothesis import strategies as st

from citadex.llm import ctph


def slow(rows):
    """The contract over (doc_id, text) in descending order of ids, null last, then text."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        third = len(text) // 3
        new = text[: len(text) - third] + following[:third]
        a, b, c = (ctph.fingerprint(t.encode()) for t in (text, new, following))
        out.append((str(doc), len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, ctph.likeness(a, b), ctph.likeness(a, c)))
    return sorted(out)


def fast(docs):
    return sorted((str(r.doc_id), *r[1:]) for r in ctph.compare_with_edited(docs).collect())


def test_documents_match_brute_force(spark, sf):
    docs = sample(spark, sf)
    rows = fast(docs.repartition(5))
    assert rows == slow([(r.doc_id, r.text) for r in docs.collect()])
    long = [r for r in rows if r[1] > 300]
    assert sum(r[5] > 0.4 for r in long) > 0.95 * len(long)
    assert sum(r[6] < 0.2 for r in long) > 0.9 * len(long)


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert fast(docs) == slow([(r.doc_id, r.text) for r in docs.collect()])
    one = docs.where("doc_id = 1")
    assert fast(one) == slow([(r.doc_id, r.text) for r in one.collect()])
    assert ctph.compare_with_edited(nothing(spark)).count() == 0


def test_boundaries_depend_on_context_only():
    """An insertion changes the signature near it and leaves the rest."""
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(900)).encode()
    changed = text[:2000] + b"something else entirely" + text[2000:]
    assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint(changed)) > 0.85


@settings(max_examples=100, deadline=None)
@given(st.text("abcd", max_size=40), st.text("abcd", max_size=40))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (0 if x == y else 2))
    assert ctph.edit_distance(a, b) == row[-1]


def test_likeness_bounds():
    a, b = ctph.fingerprint(b"x" * 500), ctph.fingerprint(b"")
    assert ctph.likeness(a, a) == ctph.likeness(b, b) == 1.0 and ctph.likeness(a, b) == ctph.likeness(None, a) == 0.0
