"""URL helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profile import SiteProfile
from .text import extract

_NETLOC = r"^((?:[A-Za-z][A-Za-z0-9+.\-]*:)?//)([^/?#]*)(.*)$"


def netloc(url: Column) -> Column:
    """Lower-case authority part, '' when there is none."""
    return F.lower(F.regexp_extract(url, _NETLOC, 2))


def canonical_host(host: Column, profile: SiteProfile) -> Column:
    return F.when(
        host.rlike(profile.alias_pattern), F.regexp_replace(host, profile.alias_pattern, profile.alias_target)
    ).otherwise(host)


def canonicalize_url(url: Column, profile: SiteProfile, force_https: bool = False) -> Column:
    """Lower-case the host and map its aliases; a URL without a host stays as it is."""
    scheme = F.lower(F.regexp_extract(url, _NETLOC, 1))
    if force_https:
        scheme = F.when(scheme.isin("//", "http://"), F.lit("https://")).otherwise(scheme)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _NETLOC, 3), "#$", ""), r"\?(?=#|$)", "")
    host = netloc(url)
    return F.when(host == "", url).otherwise(F.concat(scheme, canonical_host(host, profile), rest))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` seen on page ``base``."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)//", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "[^/]*$", "")
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    target = F.trim(href)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target == "", base)
        .when(target.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), target))
        .when(target.startswith("?"), F.concat(page, target))
        .otherwise(
            F.concat(
                root,
                _fold_dots(F.when(target.startswith("/"), target).otherwise(F.concat(folder, target))),
            )
        )
    )


def _fold_dots(path: Column) -> Column:
    """Resolve "." and ".." segments of a path, leaving its query and fragment alone."""
    plain = F.regexp_extract(path, r"^([^?#]*)", 1)
    tail = F.regexp_extract(path, r"^[^?#]*(.*)$", 1)
    closed = F.regexp_replace(plain, r"/\.{1,2}$", "$0/")
    kept = F.aggregate(
        F.split(closed, "/"),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == ".", acc)
        .when(seg == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(seg))),
    )
    return F.when(plain.rlike(r"/\.{1,2}(/|$)"), F.concat(F.array_join(kept, "/"), tail)).otherwise(path)


def query_value(url: Column, *names: str) -> Column:
    """First non-empty value among the named query parameters, NULL when absent."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.coalesce(*[extract(F.concat(F.lit("&"), query), rf"&{name}=([^&]+)") for name in names])


def is_attachment(href: Column, profile: SiteProfile) -> Column:
    """PDF by suffix or by the host that serves attachments."""
    low = F.lower(href)
    return low.endswith(".pdf") | low.contains(profile.attachment_host)


def stable_id(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 12)


def document_id(namespace: Column, family: Column, record_id: Column) -> Column:
    return F.concat_ws(":", namespace, family, record_id)
