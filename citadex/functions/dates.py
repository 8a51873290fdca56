"""Date extraction from running text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, clean_text, extract, extract_all, let


@dataclass(frozen=True)
class DateForm:
    pattern: str
    formats: tuple[str, ...]


# Date shapes and the formats tried for each.
DAY_MONTH_YEAR = DateForm(r"(?U)\b(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})\b", ("d MMMM yyyy", "d MMM yyyy"))
MONTH_DAY_COMMA_YEAR = DateForm(r"(?U)\b([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})\b", ("MMMM d, yyyy", "MMM d, yyyy"))
MONTH_DAY_YEAR = DateForm(r"(?U)\b([A-Za-z]+)\s+(\d{1,2})\s+(\d{4})\b", ("MMMM d yyyy", "MMM d yyyy"))
SLASHED = DateForm(r"(?U)\b(\d{1,2})/(\d{1,2})/(\d{4})\b", ("d/M/yyyy",))
DASHED = DateForm(r"(?U)\b(\d{1,2})-(\d{1,2})-(\d{4})\b", ("d-M-yyyy",))
HEADER_MONTH_DAY_COMMA_YEAR = DateForm(
    r"(?U)\b([A-Z][a-z]+)\s+(\d{1,2}),\s*(\d{4})\b", ("MMMM d, yyyy", "MMM d, yyyy")
)
HEADER_DAY_MONTH_YEAR = DateForm(r"(?U)\b(\d{1,2})\s+([A-Z][a-z]+)\s+(\d{4})\b", ("d MMMM yyyy", "d MMM yyyy"))
PREFIX_DATE = DateForm(
    r"(?U)\b([A-Z][a-z]+)\s+(\d{1,2}),?\s+(\d{4})\b",
    ("MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy"),
)

UPDATED_AS_ON = r"(?iU)Updated\s+as\s+on\s+([A-Za-z]+\s+\d{1,2},?\s*\d{4}|\d{1,2}\s+[A-Za-z]+\s+\d{4})"
DATE_PREFIX = r"(?U)^\s*([A-Z][a-z]{2,8}\s+\d{1,2},?\s+\d{4})\s+(.+)$"

ALL_FORMS = (DAY_MONTH_YEAR, MONTH_DAY_COMMA_YEAR, MONTH_DAY_YEAR, SLASHED, DASHED)
LISTING_FORMS = (DAY_MONTH_YEAR, MONTH_DAY_COMMA_YEAR, SLASHED, DASHED)
CIRCULAR_FORMS = (MONTH_DAY_COMMA_YEAR, DAY_MONTH_YEAR, SLASHED, DASHED)
PAGE_FORMS = (DAY_MONTH_YEAR, MONTH_DAY_COMMA_YEAR)
HEADER_FORMS = (HEADER_MONTH_DAY_COMMA_YEAR, HEADER_DAY_MONTH_YEAR, SLASHED, DASHED)

def _read(match: Column, formats: Sequence[str]) -> Column:
    """One matched date; impossible dates and unknown month names give NULL."""
    squeezed = F.regexp_replace(match, f"(?U){WS}+", " ")
    return F.coalesce(*[F.try_to_date(squeezed, fmt) for fmt in formats])


def _read_all(text: Column, form: DateForm) -> Column:
    return F.transform(extract_all(text, form.pattern), lambda m: _read(m, form.formats))


def parse_date(text: Column, forms: Sequence[DateForm] = ALL_FORMS) -> Column:
    """First readable date, forms in order, only the first match of each form."""
    return F.coalesce(*[_read(extract(text, f.pattern, 0), f.formats) for f in forms])


def all_dates(text: Column, forms: Sequence[DateForm] = ALL_FORMS) -> Column:
    """Every distinct readable date, in form order and then position."""
    return F.array_distinct(F.array_compact(F.concat(*[_read_all(text, f) for f in forms])))


def issue_and_withdrawal(row_text: Column, cells: Column | None = None) -> Column:
    """struct(issued, withdrawn): two or more dates are the span, a single one is the withdrawal.

    With no date in the joined text the first short date cell counts as the withdrawal.
    """
    fallback = F.lit(None).cast("date")
    if cells is not None:
        found = F.filter(F.transform(cells, lambda c: F.when(is_date_cell(c), parse_date(c))), lambda d: d.isNotNull())
        fallback = F.try_element_at(found, F.lit(1))

    def assign(dates: Column) -> Column:
        several = F.size(dates) >= 2
        return F.struct(
            F.when(several, F.array_min(dates)).alias("issued_date"),
            F.when(several, F.array_max(dates))
            .when(F.size(dates) == 1, F.try_element_at(dates, F.lit(1)))
            .otherwise(fallback)
            .alias("withdrawn_date"),
        )

    return let(all_dates(row_text, LISTING_FORMS), assign)


def updated_as_on(text: Column, forms: Sequence[DateForm] = LISTING_FORMS) -> Column:
    """Date that follows "Updated as on"."""
    return parse_date(extract(text, UPDATED_AS_ON), forms)


def header_date(text: Column, this_year: int, head_chars: int = 2000) -> Column:
    """First plausible date of the document header: all matches of a form before the next form."""
    head = F.substring(text, 1, head_chars)
    found = F.concat(*[_read_all(head, f) for f in HEADER_FORMS])
    plausible = F.filter(found, lambda d: F.year(d).between(1990, this_year + 1))
    return F.try_element_at(plausible, F.lit(1))


def is_date_cell(cell: Column, max_chars: int = 25) -> Column:
    """A short cell that holds a readable date."""
    return (F.length(cell) <= max_chars) & parse_date(cell).isNotNull()


def split_date_prefix(label: Column) -> Column:
    """struct(date, title) of a label such as "Nov 12, 2021 Title"."""
    text = clean_text(label)
    prefix = extract(text, DATE_PREFIX, 1)
    return F.struct(
        parse_date(prefix, (PREFIX_DATE,)).alias("date"),
        F.when(prefix.isNotNull(), F.trim(F.regexp_extract(text, DATE_PREFIX, 2))).otherwise(text).alias("title"),
    )
