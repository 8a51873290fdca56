"""HTML reading with regular expressions and array functions, all inside the JVM."""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, clean_text, extract, extract_all, let, strip

_BREAK = "\u0001"
_TAG = r"(?s)<!--.*?-->|<[/!?A-Za-z][^>]*>"
ENTITY = r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);"


def _named_entities() -> Column:
    """The published table of character names, with those that may go without a semicolon."""
    table = {f"&{name}": text for name, text in html5.items()}
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _code_point(entity: Column) -> Column:
    """Character of a numeric reference; NULL for zero, surrogates and what lies beyond Unicode."""
    digits = F.regexp_extract(entity, r"^&#[xX]?([0-9A-Fa-f]+);$", 1)
    hexed = F.when(entity.rlike("^&#[xX]"), F.upper(digits)).otherwise(F.conv(digits, 10, 16))
    small = F.lpad(F.ltrim(hexed, F.lit("0")), 8, "0")
    valid = (F.length(F.ltrim(hexed, F.lit("0"))).between(1, 6)) & (small <= "0010FFFF") & ~small.between("0000D800", "0000DFFF")
    return F.when(entity.startswith("&#") & valid, F.decode(F.unhex(small), "UTF-32"))


def unescape(c: Column) -> Column:
    """Replace character references; the ampersand goes last so nothing is decoded twice."""
    names = _named_entities()
    is_amp = lambda e: e.isin("&amp;", "&#38;", "&#x26;", "&#X26;")

    def decode(text: Column) -> Column:
        found = F.array_distinct(extract_all(text, ENTITY))
        ordered = F.concat(F.filter(found, lambda e: ~is_amp(e)), F.filter(found, is_amp))
        decoded = F.aggregate(
            ordered,
            text,
            lambda acc, e: F.replace(acc, e, F.coalesce(F.try_element_at(names, e), _code_point(e), e)),
        )
        return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)

    return let(c, decode)


def text_of(fragment: Column, joiner: str = " ") -> Column:
    """Text nodes of a fragment, each stripped, empty ones dropped, joined by ``joiner``."""
    nodes = F.split(unescape(F.regexp_replace(fragment, _TAG, _BREAK)), _BREAK)
    return F.array_join(F.filter(F.transform(nodes, strip), lambda n: n != ""), joiner)


def plain_text(fragment: Column) -> Column:
    """Text of a fragment as it runs, only the tags removed."""
    return clean_text(unescape(F.regexp_replace(fragment, _TAG, "")))


def without(html: Column, tags: Sequence[str]) -> Column:
    """Drop comments and the named elements with their content."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in tags:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return out


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a start tag, '' when absent."""
    quoted = rf"(?is)^<[^>]*?\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
    return unescape(F.concat(*[F.regexp_extract(tag, quoted, g) for g in (1, 2, 3)]))


_ANCHOR = r"(?is)<a\s[^>]*\bhref\s*=[^>]*>.*?</a\s*>"


def anchors(html: Column) -> Column:
    """array<struct<href, label, inner>> in page order; ``label`` joins the text nodes without blanks."""
    tags = extract_all(F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>", ""), _ANCHOR)

    def read(tag: Column) -> Column:
        inner = F.regexp_extract(tag, r"(?is)^<a\s[^>]*>(.*)</a\s*>$", 1)
        return F.struct(
            attribute(tag, "href").alias("href"), clean_text(text_of(inner, "")).alias("label"), inner.alias("inner")
        )

    return F.transform(tags, read)


def links_to(fragment: Column, pattern: str) -> Column:
    """Does a fragment hold an anchor whose target matches?"""
    return fragment.rlike(r"(?is)<a\s[^>]*\bhref\s*=\s*[\"']?[^\"'>]*?(?:" + pattern + ")")


def table_rows(html: Column) -> Column:
    """array<string>: the inner HTML of every table row."""
    return extract_all(html, r"(?is)<tr\b[^>]*>(.*?)(?=</tr\s*>|<tr\b|</table\s*>|$)", 1)


def cell_html(row: Column) -> Column:
    return extract_all(row, r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]\s*>|<t[dh]\b|$)", 1)


def cell_texts(row: Column) -> Column:
    """array<string>: cleaned text of every cell of a row."""
    return F.transform(cell_html(row), lambda c: clean_text(text_of(c)))


def element_text(html: Column, tag: str, joiner: str = " ") -> Column:
    """Cleaned text of the first element with this tag, NULL when there is none."""
    inner = extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>")
    return F.when(html.rlike(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>"), clean_text(text_of(F.coalesce(inner, F.lit("")), joiner)))


def _sized(text: Column, low: int, high: int, unwanted: Sequence[str] = ()) -> Column:
    """``text`` when its length lies strictly between the bounds and it is none of the unwanted labels."""

    def check(t: Column) -> Column:
        good = (F.length(t) > low) & (F.length(t) < high)
        return F.when(good & ~F.lower(t).isin(*unwanted) if unwanted else good, t)

    return let(text, check)


def page_title(html: Column, max_chars: int = 300) -> Column:
    """First heading (h1, else h2), else the title element, 5 < length < ``max_chars``."""
    heading = F.coalesce(element_text(html, "h1"), element_text(html, "h2"))
    return F.coalesce(_sized(heading, 5, max_chars), _sized(element_text(html, "title"), 5, max_chars))


def topic_title(html: Column, generic: Sequence[str], max_chars: int = 250) -> Column:
    """As :func:`page_title` for FAQ pages: h1, h2, title in turn, generic labels skipped."""
    return F.coalesce(*[_sized(element_text(html, tag, ""), 5, max_chars, generic) for tag in ("h1", "h2", "title")])


def static_title(html: Column, default: str, max_chars: int = 300) -> Column:
    """h1, else title, cut at ``max_chars``; ``default`` when both are empty."""
    parts = [text_of(extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), "") for tag in ("h1", "title")]
    return F.coalesce(*[F.substring(blank_to_null(p), 1, max_chars) for p in parts], F.lit(default))


def _opening(selector: str) -> str:
    """Pattern of the start tag a simple selector (#id, .class, tag) picks; group 1 is the tag name."""
    if selector.startswith("#"):
        return rf"(?s)<([A-Za-z][A-Za-z0-9]*)\b[^>]*\b(?i:id)\s*=\s*[\"']?{selector[1:]}[\"'\s>][^>]*>?"
    if selector.startswith("."):
        return rf"(?s)<([A-Za-z][A-Za-z0-9]*)\b[^>]*\b(?i:class)\s*=\s*[\"']?(?:[^\"'>]*\s)?{selector[1:]}[\"'\s>][^>]*>?"
    return rf"(?is)<({selector})\b[^>]*>"


def container(html: Column, selector: str) -> Column:
    """Inner HTML of the first element the selector picks, nested same-name elements balanced."""
    opening = _opening(selector)

    def inside(start: Column) -> Column:
        after = F.substring(html, F.position(start, html) + F.length(start), F.length(html))
        return F.when(start != "", _balanced(after, F.regexp_extract(start, opening, 1)))

    # A plain search for the name comes first: most pages have none of the containers.
    named = F.contains(html, F.lit(selector.lstrip("#."))) if selector[0] in "#." else F.contains(F.lower(html), F.lit(f"<{selector}"))
    return F.when(named, let(F.regexp_extract(html, opening, 0), inside))


def _balanced(rest: Column, name: Column) -> Column:
    """Prefix of ``rest`` up to the end tag that closes the element ``name``."""
    pieces = F.split(rest, F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"\b)")))

    def cut(parts: Column) -> Column:
        depth = F.aggregate(
            parts,
            F.struct(F.lit(1).alias("depth"), F.lit(0).alias("seen"), F.lit(-1).alias("stop")),
            lambda acc, p: F.struct(
                (
                    acc["depth"]
                    + F.when(p.startswith("</"), -1).when(F.rlike(p, F.concat(F.lit(r"(?i)^<"), name, F.lit(r"\b"))), 1).otherwise(0)
                ).alias("depth"),
                (acc["seen"] + 1).alias("seen"),
                F.when(
                    (acc["stop"] < 0) & p.startswith("</") & (acc["depth"] == 1), acc["seen"]
                ).otherwise(acc["stop"]).alias("stop"),
            ),
        )
        return let(
            depth,
            lambda d: F.array_join(F.when(d["stop"] < 0, parts).otherwise(F.slice(parts, 1, d["stop"])), ""),
        )

    return let(pieces, cut)


def page_body(html: Column, selectors: Sequence[str], drop: Sequence[str], min_chars: int = 200) -> Column:
    """Readable text of a page: the first known container, else everything; NULL when too short."""

    def read(cleaned: Column) -> Column:
        options = [_prose(container(cleaned, s)) for s in selectors] + [_prose(cleaned)]
        return F.coalesce(*[let(o, lambda x: F.when(F.length(x) > min_chars, x)) for o in options])

    return let(without(html, drop), read)


def _prose(fragment: Column) -> Column:
    return F.regexp_replace(text_of(fragment, "\n"), r"\n{3,}", "\n\n")


DETAIL_NOISE = ("script", "style", "nav", "header", "footer", "form")
FAQ_NOISE = ("script", "style", "nav", "header", "footer")
