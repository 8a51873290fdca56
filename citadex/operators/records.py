"""Records out of fetched pages, as set operations over a page table (page_id, url, html).

Every parser is a narrow expression per page; only the removal of repeated ids shuffles, and that keeps one row per
id and task before it does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import html as H
from ..functions.text import clean_text, extract, extract_all, let
from ..functions.urls import canonicalize_url, is_attachment, resolve_url, stable_id
from ..profile import NOISE_LABELS, NOISE_URL_PARTS, REGULATOR, SiteProfile

# Shapes of agency references, serial numbers, years and file sizes in table cells.
REF_CAPITALS = r"[A-Z]{2,}"
REF_SEPARATOR = r"[/.]"
REF_START = r"^[A-Z][A-Z0-9.()/_\-]*[/.]"
REF_WITH_NUMBER = r"[A-Z]{2,}.*[/.].*\d"
SERIAL = r"(?U)^\d+\.?$"
YEAR = r"(?U)\b(19|20)\d{2}\b"
SIZE_SUFFIX = r"(?iU)\s+\d{1,5}\s*kb\s*$"

# --- links ----------------------------------------------------------------------------------------------------


def extract_links(pages: DataFrame, profile: SiteProfile = REGULATOR, pattern: str | None = None) -> DataFrame:
    """(page_id, pos, href, label, url): anchors in page order, resolved and canonical, optionally filtered."""
    found = pages.select("page_id", F.col("url").alias("_base"), F.posexplode(H.anchors(F.col("html"))).alias("pos", "a"))
    if pattern is not None:
        found = found.filter(F.col("a.href").rlike(pattern))
    return found.select(
        "page_id", "pos", F.col("a.href").alias("href"), F.col("a.label").alias("label"),
        canonicalize_url(resolve_url(F.col("_base"), F.col("a.href")), profile).alias("url"),
    )


def first_by_id(rows: DataFrame, id_col: str, order: Sequence[str], accept: Column | None = None, mark_before: bool = False) -> DataFrame:
    """First row per id in page order.

    ``accept`` drops unusable rows: before the choice, or, with ``mark_before``, after it, so that a rejected
    first row also hides the later ones.
    """
    if accept is not None and not mark_before:
        rows = rows.filter(accept)
    by_id = Window.partitionBy(id_col).orderBy(*order)
    first = rows.withColumn("_n", F.row_number().over(by_id)).filter("_n = 1").drop("_n")
    return first.filter(accept) if accept is not None and mark_before else first


def primary_attachment(pages: DataFrame, profile: SiteProfile = REGULATOR, prefer_unlabelled: bool = True) -> DataFrame:
    """(page_id, pos, url, label, is_primary) for the attachments of detail pages, each URL once.

    The first unlabelled attachment is primary, else the first. Direction pages use ``prefer_unlabelled=False``:
    there the first attachment is primary whatever its label. All of a page is in its row, so nothing is shuffled.
    """
    links = F.transform(
        F.filter(H.anchors(F.col("html")), lambda a: is_attachment(a["href"], profile)),
        lambda a: F.struct(
            canonicalize_url(resolve_url(F.col("url"), a["href"]), profile).alias("url"), a["label"].alias("label")
        ),
    )

    def mark(found: Column) -> Column:
        urls = F.transform(found, lambda a: a["url"])
        unique = F.filter(found, lambda a, i: F.array_position(urls, a["url"]) == i + 1)

        def choose(kept: Column) -> Column:
            bare = F.array_position(F.transform(kept, lambda a: a["label"]), "") if prefer_unlabelled else F.lit(0)
            first = F.greatest(bare, F.lit(1))
            return F.transform(
                kept,
                lambda a, i: F.struct(a["url"].alias("url"), a["label"].alias("label"), (first == i + 1).alias("is_primary")),
            )

        return let(unique, choose)

    return pages.select("page_id", F.posexplode(let(links, mark)).alias("pos", "a")).select("page_id", "pos", "a.*")


# --- table rows -----------------------------------------------------------------------------------------------


def table_rows(pages: DataFrame, *extra: Callable[[Column], Column]) -> DataFrame:
    """(page_id, url, row_no, cells, links, extra..): every table row with its cell texts and anchors.

    Rows are parsed inside the generator, so that later filters work on finished columns; ``extra`` functions of
    the row's HTML join in there.
    """
    parsed = F.transform(
        H.table_rows(F.col("html")),
        lambda row: F.struct(H.cell_texts(row).alias("cells"), H.anchors(row).alias("links"), *[e(row) for e in extra]),
    )
    return pages.select("page_id", "url", F.posexplode(parsed).alias("row_no", "r")).select("page_id", "url", "row_no", "r.*")


def _once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Select ``columns`` through a one-row generator: filters that follow do not evaluate them again."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def is_ref_like(text: Column, agency: str = REGULATOR.agency) -> Column:
    """Does a cell look like an agency reference: capitals, separators, no long phrase, no plain date?"""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return F.coalesce(
        (text != "")
        & (F.length(text) <= 200)
        & ~(text.contains(" ") & (words > 6))
        & text.rlike(REF_CAPITALS)
        & text.rlike(REF_SEPARATOR)
        & (F.trim(text).rlike(REF_START) | F.upper(text).startswith(agency))
        & (text.rlike(REF_WITH_NUMBER) | D.parse_date(text).isNull()),
        F.lit(False),
    )


def is_serial(text: Column) -> Column:
    return text.rlike(SERIAL)


def pick_title(cells: Column, linked: Column, ref: Column, agency: str = REGULATOR.agency) -> Column:
    """The first non-empty cell that holds the record's link, else the longest cell that is no date, reference or serial.

    ``linked`` is the parallel array of booleans; the earliest of equally long cells wins.
    """
    pairs = F.zip_with(cells, linked, lambda t, hit: F.struct(t.alias("t"), hit.alias("hit")))
    by_link = F.try_element_at(F.filter(pairs, lambda p: p["hit"] & (p["t"] != "")), F.lit(1))["t"]
    plain = F.filter(
        cells,
        lambda t: (t != "") & ~is_serial(t) & ~t.eqNullSafe(ref) & ~is_ref_like(t, agency) & ~D.is_date_cell(t),
    )
    longest = F.array_max(F.transform(plain, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))))["t"]
    return F.coalesce(by_link, longest)


def circular_rows(pages: DataFrame, profile: SiteProfile = REGULATOR) -> DataFrame:
    """Rows of a circulars listing: one record link, at least four cells (serial, reference, title, date)."""
    rows = table_rows(pages)
    page_name = F.filter("links", lambda a: a["href"].rlike(profile.notification_url))
    title_date = lambda t: D.parse_date(t, D.CIRCULAR_FORMS).isNotNull() & (F.length(t) < 30)
    candidates = rows.withColumn("hits", page_name).filter((F.size("hits") == 1) & (F.size("cells") >= 4))
    picked = (
        candidates.select(
            "page_id", "url", "row_no",
            F.get("hits", F.lit(0))["href"].alias("href"),
            F.get("cells", F.lit(1)).alias("ref_no"), F.get("cells", F.lit(2)).alias("c2"), F.get("cells", F.lit(3)).alias("c3"),
        )
        .withColumn("swapped", title_date(F.col("c2")) & ~title_date(F.col("c3")))
    )
    picked = _once(
        picked,
        "page_id", "row_no", extract(F.col("href"), profile.notification_url).alias("notif_id"), "ref_no",
        F.when(F.col("swapped"), F.col("c3")).otherwise(F.col("c2")).alias("title"),
        canonicalize_url(resolve_url(F.col("url"), F.col("href")), profile).alias("detail_url"),
        D.parse_date(F.when(F.col("swapped"), F.col("c2")).otherwise(F.col("c3")), D.CIRCULAR_FORMS).alias("issued_date"),
    )
    header = F.lower("ref_no").isin("circular number", "ref no.") | F.lower("title").isin("circular name/title", "subject")
    usable = F.col("notif_id").isNotNull() & (F.col("ref_no") != "") & (F.col("title") != "") & ~header
    return first_by_id(picked, "notif_id", ("page_id", "row_no"), usable)


def withdrawn_rows(pages: DataFrame, profile: SiteProfile = REGULATOR) -> DataFrame:
    """Rows of a withdrawals listing; layouts vary, so cells are told apart by their content."""
    linked = lambda row: F.transform(H.cell_html(row), lambda c: H.links_to(c, profile.notification_url)).alias("linked")
    rows = table_rows(pages, linked).filter(F.size("cells") >= 2)
    joined = F.array_join("cells", " ")
    is_link = lambda a: a["href"].rlike(profile.notification_url)
    href = F.try_element_at(F.filter("links", is_link), F.lit(1))["href"]
    dates = D.issue_and_withdrawal(joined, F.col("cells"))
    marked = _once(
        rows.filter(joined.rlike(YEAR)),
        "page_id", "url", "row_no", "cells", href.alias("href"), "linked", dates.alias("dates"),
        F.try_element_at(F.filter("cells", lambda t: is_ref_like(t, profile.agency)), F.lit(1)).alias("original_ref"),
    )
    found = _once(
        marked,
        "page_id", "row_no", "original_ref",
        extract(F.col("href"), profile.notification_url).alias("original_id"),
        pick_title(F.col("cells"), F.col("linked"), F.col("original_ref"), profile.agency).alias("title"),
        F.col("dates.issued_date").alias("issued_date"), F.col("dates.withdrawn_date").alias("withdrawn_date"),
        F.lit(None).cast("string").alias("replacement_ref"),
        canonicalize_url(resolve_url(F.col("url"), F.col("href")), profile).alias("detail_url"),
    )
    key = F.when(F.col("original_id").isNotNull(), F.concat_ws("|", F.lit("id"), "original_id")).otherwise(
        F.concat_ws("|", F.lit("title_ref"), F.lower("title"), F.coalesce("original_ref", F.lit("")))
    )
    usable = F.coalesce(F.col("title"), F.lit("")) != ""
    return first_by_id(found.withColumn("_key", key), "_key", ("page_id", "row_no"), usable).drop("_key")


def direction_rows(pages: DataFrame, profile: SiteProfile = REGULATOR) -> DataFrame:
    """Records of a directions listing: title, "Updated as on" date or first full cell date, attachments of the row."""
    in_rows = table_rows(pages).select("page_id", "url", "row_no", "cells", "links", F.posexplode("links").alias("pos", "a"))
    hit = in_rows.filter(F.col("a.href").rlike(profile.direction_url)).select(
        "page_id", "url", "row_no", "pos", extract(F.col("a.href"), profile.direction_url).alias("md_id"),
        F.col("a.href").alias("href"), H.plain_text(F.col("a.inner")).alias("title"), "cells", "links",
    )
    attachments = F.transform(
        F.filter("links", lambda a: is_attachment(a["href"], profile)),
        lambda a: canonicalize_url(resolve_url(F.col("url"), a["href"]), profile),
    )
    first = first_by_id(hit, "md_id", ("page_id", "row_no", "pos"), F.col("title") != "", mark_before=True)
    return first.select(
        "page_id", "md_id", "title",
        canonicalize_url(resolve_url(F.col("url"), F.col("href")), profile).alias("detail_url"),
        row_date(F.col("title"), F.col("cells")).alias("last_updated_at"),
        attachments.alias("pdf_urls"),
    )


def row_date(title: Column, cells: Column) -> Column:
    """Date of a listing row: "Updated as on" in the title, else the first cell with a full date."""
    cell_dates = F.filter(F.transform(cells, lambda c: D.parse_date(c, D.LISTING_FORMS)), lambda d: d.isNotNull())
    return F.coalesce(D.updated_as_on(title), F.try_element_at(cell_dates, F.lit(1)))


def press_release_rows(pages: DataFrame, profile: SiteProfile = REGULATOR, min_chars: int = 5) -> DataFrame:
    """Rows with exactly one press-release link; navigation rows hold many."""
    rows = table_rows(pages).withColumn("hits", F.filter("links", lambda a: a["href"].rlike(profile.press_release_url)))
    one = _once(
        rows.filter(F.size("hits") == 1),
        "page_id", "row_no", extract(F.get("hits", F.lit(0))["href"], profile.press_release_url).alias("prid"),
        F.get("hits", F.lit(0))["label"].alias("title"),
        canonicalize_url(resolve_url(F.col("url"), F.get("hits", F.lit(0))["href"]), profile).alias("detail_url"),
    )
    return first_by_id(one, "prid", ("page_id", "row_no"), F.length("title") >= min_chars)


def faq_rows(pages: DataFrame, profile: SiteProfile = REGULATOR, min_chars: int = 5) -> DataFrame:
    """FAQ topics: a leading date is split off the label."""
    links = extract_links(pages, profile, profile.faq_item).withColumn("split", D.split_date_prefix(F.col("label")))
    rows = _once(
        links,
        "page_id", "pos", extract(F.col("href"), profile.faq_item).alias("faq_id"), "label",
        F.col("split.title").alias("title"), F.col("url").alias("detail_url"), F.col("split.date").alias("issued_date"),
    )
    usable = (F.length("label") >= min_chars) & (F.length("title") >= min_chars)
    return first_by_id(rows, "faq_id", ("page_id", "pos"), usable).drop("label")


def category_rows(pages: DataFrame, profile: SiteProfile = REGULATOR, min_chars: int = 3) -> DataFrame:
    """(category_id, label, url) of an index page of categories."""
    links = extract_links(pages, profile, profile.category_url)
    rows = links.select("page_id", "pos", extract(F.col("href"), profile.category_url).alias("category_id"), "label", "url")
    return first_by_id(rows, "category_id", ("page_id", "pos"), F.length("label") >= min_chars)


def strip_size_suffix(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SIZE_SUFFIX, ""))


def is_noise(url: Column, label: Column, url_parts: Sequence[str] = NOISE_URL_PARTS, labels: Sequence[str] = NOISE_LABELS) -> Column:
    """Boilerplate attachment by a fragment of its URL or by its label."""
    hit = F.lower(label).isin(*labels)
    for part in url_parts:
        hit = hit | url.contains(part)
    return hit


def master_circular_rows(pages: DataFrame, profile: SiteProfile = REGULATOR, min_chars: int = 8) -> DataFrame:
    """Rows of category pages (page_id, url, html, department) with exactly one attachment and a real title."""
    text = lambda row: clean_text(H.text_of(row)).alias("text")
    rows = table_rows(pages, text).withColumn("pdfs", F.filter("links", lambda a: is_attachment(a["href"], profile)))
    found = _once(
        rows.filter(F.size("pdfs") == 1),
        "page_id", "row_no",
        canonicalize_url(resolve_url(F.col("url"), F.get("pdfs", F.lit(0))["href"]), profile, force_https=True).alias("pdf_url"),
        strip_size_suffix(F.col("text")).alias("title"),
        F.col("url").alias("detail_url"),
    )
    usable = (F.length("title") >= min_chars) & ~is_noise(F.col("pdf_url"), F.col("title"))
    first = first_by_id(found, "pdf_url", ("page_id", "row_no"), usable)
    out = first.withColumn("mc_id", stable_id(F.col("pdf_url")))
    if "department" in pages.columns:
        out = out.join(pages.select("page_id", "department"), "page_id", "left")
    return out


# --- header fields and bodies ---------------------------------------------------------------------------------


def parse_reference(text: Column, pattern: str = REGULATOR.header_reference, head_chars: int = 3000) -> Column:
    """Reference in the header area, white space removed."""
    return F.regexp_replace(extract(F.substring(text, 1, head_chars), pattern, 0), r"(?U)\s+", "")


def replacement_reference(text: Column, own: Column, pattern: str = REGULATOR.inline_reference) -> Column:
    """First reference in a text that is not the record's own."""
    found = F.transform(extract_all(text, pattern), clean_text)
    return F.try_element_at(F.filter(found, lambda r: own.isNull() | (r != own)), F.lit(1))


def circular_header(
    text: Column, ref_hint: Column, date_hint: Column, this_year: int, pattern: str = REGULATOR.header_reference
) -> Column:
    """struct(ref_no, issued_date) of a circular: what the text says, else what the listing said."""
    return F.struct(
        F.coalesce(parse_reference(text, pattern), ref_hint).alias("ref_no"),
        F.coalesce(D.header_date(text, this_year), date_hint).alias("issued_date"),
    )


def direction_header(
    text: Column, page_html: Column, this_year: int, pattern: str = REGULATOR.header_reference
) -> Column:
    """struct(ref_no, last_updated_at) of a direction: the page's "Updated as on", else the date in the text."""
    stamped = D.updated_as_on(H.text_of(page_html), D.PAGE_FORMS)
    return F.struct(
        parse_reference(text, pattern).alias("ref_no"),
        F.coalesce(stamped, D.header_date(text, this_year)).alias("last_updated_at"),
    )


def choose_body(passes: Column, text: Column, html_body: Column) -> Column:
    """struct(body, source): extracted text that passes the gate, else the page body, else nothing."""
    has_page = F.coalesce(html_body, F.lit("")) != ""
    good = F.coalesce(passes, F.lit(False))
    return F.struct(
        F.when(good, text).when(has_page, html_body).alias("body"),
        F.when(good, "attachment").when(has_page, "page").otherwise("none").alias("source"),
    )


def completeness_gate(fetches: DataFrame, family: str = "family") -> DataFrame:
    """(family, total, failed, complete) from one row per category with ``failed``: complete needs all of some."""
    return fetches.groupBy(family).agg(F.count(F.lit(1)).alias("total"), F.count_if("failed").alias("failed")).withColumn(
        "complete", (F.col("total") > 0) & (F.col("failed") == 0)
    )


def payload_check(payloads: DataFrame, content: str, content_type: str, magic: str = "%PDF", expected: str = "application/pdf") -> DataFrame:
    """Mark payloads whose type header and leading bytes disagree; bad rows stay, with the reason."""
    head = F.substring(F.col(content), 1, len(magic))
    good = F.col(content_type).startswith(expected) & (head.cast("string") == magic)
    return payloads.withColumn("is_valid", F.coalesce(good, F.lit(False))).withColumn(
        "error",
        F.when(~F.col("is_valid"), F.concat(F.lit("unexpected payload (content-type="), F.coalesce(content_type, F.lit("")), F.lit(")"))),
    ).withColumn("payload_sha256", F.sha2(F.col(content), 256)).withColumn("bytes", F.octet_length(content))
