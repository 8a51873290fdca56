"""Extracted text to citable outline chunks.

Chunking is a narrow step: one document row in, its chunks out, by array functions inside the row. Nothing is
shuffled, so it keeps up with any number of documents and one oversized document delays only its own task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, let, strip

# Places after a line end in the sense of universal newlines; \r\n counts once and the form feed ends a page.
_AFTER_LINE = r"(?<=[\n\f\x0b\x1c-\x1e\x{85}\x{2028}\x{2029}])|(?<=\r)(?!\n)"
# Heading marks at the start of a line: "8.2", "8.", "(1)", "a." or "a)".
_HEADING = rf"(?Ud)^{WS}*(\d{{1,2}}\.\d{{1,2}}\.?|\d{{1,2}}\.|\(\d{{1,3}}\)|[a-z][.)]){WS}+."
_BLANK_OR_PAGE_NUMBER = rf"(?U)^{WS}*(?:\d{{1,3}}{WS}*)?$"

MIN_CHARS = 80
MAX_CHARS = 2000
QUALITY_GATE = 0.8


# --- extraction quality ---------------------------------------------------------------------------------------


def extraction_quality(text: Column, error: Column | None = None) -> Column:
    """struct(page_count, pages_with_text, quality, passes).

    The piece after the last form feed is taken to be empty, so text that lacks the closing form feed can
    reach a quality above one.
    """
    pages = F.split(text, "\f")
    page_count = F.greatest(F.size(pages) - 1, F.lit(1))
    with_text = F.size(F.filter(pages, lambda p: strip(p) != ""))
    quality = with_text / page_count
    no_error = F.lit(True) if error is None else error.isNull()
    return F.struct(
        page_count.alias("page_count"),
        with_text.alias("pages_with_text"),
        quality.alias("quality"),
        (no_error & (strip(text) != "") & (quality >= QUALITY_GATE)).alias("passes"),
    )


# --- lines ----------------------------------------------------------------------------------------------------


def _lines(text: Column) -> Column:
    """array<struct<body, kept, size, new_page, mark>> for every line of a text; no heading is an empty mark."""

    def describe(piece: Column) -> Column:
        body = F.rtrim(piece, F.lit("\n\f"))
        return F.struct(
            body.alias("body"),
            (~body.rlike(_BLANK_OR_PAGE_NUMBER)).alias("kept"),
            F.length(piece).alias("size"),
            piece.endswith("\f").cast("int").alias("new_page"),
            F.regexp_extract(body, _HEADING, 1).alias("mark"),
        )

    return F.transform(F.split(text, _AFTER_LINE), describe)


def lines_with_offsets(docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """One row per kept line: page from 1, line number from 1, character offset in the source text."""
    by_doc = Window.partitionBy(id_col).orderBy("pos")
    before = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    return (
        docs.select(id_col, F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
        .select(
            id_col,
            (F.col("pos") + 1).alias("line_no"),
            (F.lit(1) + F.coalesce(F.sum("line.new_page").over(before), F.lit(0))).cast("int").alias("page"),
            F.coalesce(F.sum("line.size").over(before), F.lit(0)).cast("int").alias("char_offset"),
            F.col("line.body").alias("line"),
            F.col("line.mark").alias("mark"),
            F.col("line.kept").alias("kept"),
        )
        .filter("kept")
        .drop("kept")
    )


# --- outline --------------------------------------------------------------------------------------------------


def _numeric(mark: Column) -> Column:
    """Anchor of a numbered heading, NULL for the other marks."""
    return F.when(mark.rlike(r"(?U)^\d"), F.rtrim(mark, F.lit(".")))


def _suffix(mark: Column) -> Column:
    """Last segment of a sub-clause mark: "(1)" or "a"."""
    return F.when(mark.startswith("("), mark).when(mark.rlike("^[a-z]"), F.substring(mark, 1, 1))


def outline_anchors(docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """Kept lines with the anchor and section that hold at each of them.

    Sub-clauses are siblings: whatever came before, a letter or "(n)" hangs on the last numbered heading.
    """
    by_doc = Window.partitionBy(id_col).orderBy("line_no")
    lines = lines_with_offsets(docs, id_col, text_col)
    base = F.last(_numeric(F.col("mark")), ignorenulls=True).over(by_doc)
    return (
        lines.withColumn("base", base)
        .withColumn(
            "opens",
            F.coalesce(_numeric(F.col("mark")), F.concat(F.col("base"), F.lit("."), _suffix(F.col("mark")))),
        )
        .withColumn("anchor", F.last("opens", ignorenulls=True).over(by_doc))
        .select(
            id_col, "line_no", "page", "char_offset", "line", "anchor",
            F.substring_index("base", ".", 1).alias("section"),
        )
    )


_BOUND = "struct<line:int,anchor:string,section:string,page:int,start:int>"


def _bounds(lines: Column) -> Column:
    """array of chunk openings; the first one holds the text before any heading."""
    none = F.lit(None).cast("string")
    opening = F.struct(
        F.lit(0).alias("line"), none.alias("anchor"), none.alias("section"),
        F.lit(None).cast("int").alias("page"), F.lit(0).alias("start"),
    ).cast(_BOUND)
    zero = F.struct(
        F.lit(0).alias("line"), F.lit(0).alias("start"), F.lit(1).alias("page"),
        none.alias("anchor"), none.alias("base"), F.array(opening).alias("out"),
    )

    def step(acc: Column, line: Column) -> Column:
        number = _numeric(line["mark"])
        base = F.coalesce(number, acc["base"])
        opens = F.coalesce(number, F.concat(acc["base"], F.lit("."), _suffix(line["mark"])))
        starts = opens.isNotNull() & ~opens.eqNullSafe(acc["anchor"])
        bound = F.struct(
            acc["line"].alias("line"), opens.alias("anchor"), F.substring_index(base, ".", 1).alias("section"),
            acc["page"].alias("page"), acc["start"].alias("start"),
        ).cast(_BOUND)
        return F.struct(
            (acc["line"] + 1).alias("line"),
            (acc["start"] + line["size"]).alias("start"),
            (acc["page"] + line["new_page"]).alias("page"),
            F.when(starts, opens).otherwise(acc["anchor"]).alias("anchor"),
            base.alias("base"),
            F.when(starts, F.concat(acc["out"], F.array(bound))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(lines, zero, step, lambda acc: acc["out"])


def outline(text: Column) -> Column:
    """array<struct<anchor, section, page, start, body>>: the paragraphs of a text before any size rule."""

    def assemble(lines: Column) -> Column:
        def cut(bounds: Column) -> Column:
            def body(bound: Column, i: Column) -> Column:
                following = F.coalesce(F.try_element_at(bounds, i + 2)["line"], F.size(lines))
                kept = F.filter(F.slice(lines, bound["line"] + 1, following - bound["line"]), lambda x: x["kept"])
                return F.struct(
                    bound["anchor"].alias("anchor"), bound["section"].alias("section"),
                    bound["page"].alias("page"), bound["start"].alias("start"),
                    strip(F.array_join(F.transform(kept, lambda x: x["body"]), "\n")).alias("body"),
                )

            return F.transform(bounds, body)

        return let(_bounds(lines), cut)

    return let(_lines(text), assemble)


def split_long(body: Column, max_chars: int = MAX_CHARS) -> Column:
    """array<struct<text, offset>>: greedy packing of sentences, an over-long sentence stays whole.

    Offsets count one blank per sentence gap, as the packed text does.
    """
    part = "struct<text:string,offset:int>"
    zero = F.struct(
        F.lit("").alias("cur"), F.lit(0).alias("cur_at"), F.lit(0).alias("at"),
        F.array().cast(f"array<{part}>").alias("out"),
    )

    def emit(acc: Column) -> Column:
        return F.concat(
            acc["out"],
            F.array(F.struct(acc["cur"].alias("text"), acc["cur_at"].alias("offset")).cast(part)),
        )

    def step(acc: Column, s: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(s) + 1 > max_chars)
        fresh = full | (acc["cur"] == "")
        return F.struct(
            F.when(fresh, s).otherwise(F.concat(acc["cur"], F.lit(" "), s)).alias("cur"),
            F.when(fresh, acc["at"]).otherwise(acc["cur_at"]).alias("cur_at"),
            (acc["at"] + F.length(s) + 1).alias("at"),
            F.when(full, emit(acc)).otherwise(acc["out"]).alias("out"),
        )

    sentences = F.filter(F.split(body, rf"(?U)(?<=[.!?]){WS}+"), lambda s: s != "")
    packed = F.aggregate(sentences, zero, step, lambda acc: F.when(acc["cur"] != "", emit(acc)).otherwise(acc["out"]))
    whole = F.array(F.struct(body.alias("text"), F.lit(0).alias("offset")).cast(part))
    return F.when(F.length(body) <= max_chars, whole).otherwise(packed)


def outline_chunks(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    max_chars: int = MAX_CHARS,
    carry: tuple[str, ...] = ("md_id", "ref_no"),
) -> DataFrame:
    """Citable chunks of (document_id, text, ...): short paragraphs dropped, long ones split, ids stable."""
    paragraphs = docs.select("document_id", *carry, F.inline(outline(F.col("text")))).filter(
        F.length("body") >= max(min_chars, 1)
    )
    parts = paragraphs.select(
        "document_id", *carry, "section", F.col("anchor").alias("paragraph_anchor"), "page", "start",
        F.inline(split_long(F.col("body"), max_chars)),
    )
    return parts.select(
        chunk_id(F.col("document_id"), F.col("paragraph_anchor"), F.col("text"), F.col("start") + F.col("offset")).alias(
            "chunk_id"
        ),
        "document_id", *carry, "section", "paragraph_anchor", "page", "text",
        F.sha2("text", 256).alias("text_sha256"),
        (F.col("start") + F.col("offset")).alias("char_start"),
        (F.col("start") + F.col("offset") + F.length("text")).alias("char_end"),
    )


def chunk_id(document_id: Column, anchor: Column, text: Column, start: Column) -> Column:
    """Stable citation id: the anchor, or a short text hash where there is none, and the offset."""
    label = F.coalesce(anchor, F.substring(F.sha1(text), 1, 8))
    return F.concat(document_id, F.lit("#p="), label, F.lit("@"), start.cast("string"))
