import random
import re
import zlib
from collections import Counter

from common_rows import awkward, nothing, sample

from citadex.llm import spelling
from citadex.llm.registry import QUERIES


def edit_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def counted(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def slow(n):
    near = {w: [o for o in n if edit_one(w, o)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def got(docs):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs).collect())


def test_query_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in sample(spark, sf).collect()]
    found = QUERIES["op11_spelling_variants"](spark, sf).collect()
    assert sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in found) == slow(counted(rows))


def test_words_of_few_letters_in_any_order(spark):
    """Anagrams share all signatures; long lists meet by halves and lose nothing."""
    rng = random.Random(5)
    vocabulary = {"".join(rng.choices("abé", k=rng.randrange(5, 11))) for _ in range(700)} | {"banana" * 4, "banana" * 4 + "n", "anana" + "banana" * 3}
    n = {w: rng.randrange(3, 60) for w in vocabulary}
    docs = spark.createDataFrame([(i, " ".join([w] * k)) for i, (w, k) in enumerate(n.items())], "doc_id long, text string")
    assert got(docs) == slow(counted(docs.collect()))


def test_chains_and_ties(spark):
    text = "aaaaa " * 3 + "aaaab " * 6 + "aaabb " * 12 + "aabbb " * 24 + "zzzzx zzzzy zzzzw " * 6 + "zzzzz " * 3
    found = {r[0]: r for r in got(spark.createDataFrame([(1, text)], "doc_id long, text string"))}
    assert found["aaaaa"][3:] == ("aaaab", 6, "aabbb") and found["aabbb"][3:] == (None, None, "aabbb")
    assert found["zzzzz"][3] == "zzzzw" and found["zzzzx"][3] is None


def test_awkward_rows(spark):
    assert got(awkward(spark)) == slow(counted([(r.doc_id, r.text) for r in awkward(spark).collect()]))
    assert got(nothing(spark)) == [] and spelling.variants(nothing(spark)).columns == ["word", "n", "n_near", "form", "form_n", "root"]
