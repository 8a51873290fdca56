from pyspark.sql import functions as F

from citadex.operators import chunking as C


def chunks(spark, *texts, **options):
    docs = spark.createDataFrame([(f"d{i}", str(i), None, t) for i, t in enumerate(texts)], "document_id string, md_id string, ref_no string, text string")
    return C.outline_chunks(docs, **options).orderBy("document_id", "char_start").collect()


FILL = " words that make the paragraph long enough to be kept as a citable chunk of its own, as the rule asks."


def test_siblings_offsets_and_pages(spark):
    text = (
        f"4. Top{FILL}\n\n   a. first{FILL}\n   b) second{FILL}\n  17  \n   (1) numbered{FILL}\n\f"
        f"5.1 Next page{FILL}\n   c. third{FILL}\n"
    )
    rows = chunks(spark, text)
    assert [r.paragraph_anchor for r in rows] == ["4", "4.a", "4.b", "4.(1)", "5.1", "5.1.c"]
    assert [r.section for r in rows] == ["4", "4", "4", "4", "5", "5"]
    assert [r.page for r in rows] == [1, 1, 1, 1, 2, 2]
    for r in rows:
        assert text[r.char_start:].lstrip().startswith(r.text[:20])
    assert all("17" not in r.text for r in rows)
    assert rows[0].chunk_id == "d0#p=4@0"


def test_short_and_empty(spark):
    assert chunks(spark, "", "   ", "\f\n") == []
    rows = chunks(spark, f"5. Definitions\n6. Long{FILL}\n")
    assert [r.paragraph_anchor for r in rows] == ["6"]
    assert len(chunks(spark, "5. Definitions\n", min_chars=0)) == 1


def test_preamble_has_no_anchor_page_or_section(spark):
    rows = chunks(spark, f"Preamble{FILL}\n a. stray letter without a number\n1. One{FILL}")
    assert rows[0].paragraph_anchor is None and rows[0].page is None and rows[0].section is None
    assert rows[0].char_start == 0 and "stray" in rows[0].text
    assert rows[0].chunk_id.startswith("d0#p=") and rows[0].chunk_id.endswith("@0")


def test_same_anchor_does_not_split(spark):
    rows = chunks(spark, f"3. One{FILL}\n3. Again{FILL}\n")
    assert len(rows) == 1 and "Again" in rows[0].text


def test_line_ends_and_unicode_blanks(spark):
    text = f"1. A{FILL}\r\n2. B{FILL}\x0b3. C{FILL}  4. D{FILL}\x855. \x1c6. E{FILL}"
    rows = chunks(spark, text)
    assert [r.paragraph_anchor for r in rows] == ["1", "2", "3", "4", "6"]
    for r in rows:
        assert text[r.char_start:].lstrip().startswith(r.text[:10])


def split(spark, body, limit):
    df = spark.createDataFrame([(body,)], "b string").select(F.inline(C.split_long(F.col("b"), limit)))
    return [tuple(r) for r in df.collect()]


def packed(body, limit):
    """The packing rule, written out for comparison."""
    import re

    if len(body) <= limit:
        return [(body, 0)]
    out, cur, cur_at, at = [], "", 0, 0
    for s in re.split(r"(?<=[.!?])\s+", body):
        if cur and len(cur) + 1 + len(s) > limit:
            out.append((cur, cur_at))
            cur = ""
        if not cur:
            cur, cur_at = s, at
        else:
            cur += " " + s
        at += len(s) + 1
    return out + [(cur, cur_at)]


def test_split_long(spark):
    body = "One two. Three four!  Five six? " + "x" * 40 + ". End."
    for limit in (10, 20, 30, 500):
        assert split(spark, body, limit) == packed(body, limit)


def test_windows_agree_with_fold(spark):
    text = f"intro\n1. A{FILL}\n(2) b{FILL}\nplain\n\f 7 \n2.3. C{FILL}\nz) d{FILL}\n2.3 same\n"
    docs = spark.createDataFrame([("d", text)], "document_id string, text string")
    lines = C.outline_anchors(docs).orderBy("line_no").collect()
    assert [r.anchor for r in lines] == [None, "1", "1.(2)", "1.(2)", "2.3", "2.3.z", "2.3"]
    assert [r.page for r in lines] == [1, 1, 1, 1, 2, 2, 2]
    for r in lines:
        assert text[r.char_offset:].startswith(r.line)


def test_quality(spark):
    df = spark.createDataFrame([("a\fb\f",), ("a\fb",), ("\f\f\f",), ("a\f\f\f\f",)], "t string")
    q = [r[0] for r in df.select(C.extraction_quality(F.col("t"))).collect()]
    assert [(r.page_count, r.quality, r.passes) for r in q] == [(2, 1.0, True), (1, 2.0, True), (3, 0.0, False), (4, 0.25, False)]
