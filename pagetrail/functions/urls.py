"""URL scalars (Column -> Column). No UDF: plain string and regex built-ins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_control, trim_u

# RFC 3986, appendix B, with the scheme held to its grammar.
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_HAS_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
_DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|$)"

# Link targets that are never followed.
SKIP_SUFFIXES = [
    ".css", ".js", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".pdf", ".zip", ".tar", ".gz",
    ".mp4", ".mp3", ".avi", ".mov", ".wmv", ".flv", ".swf",
    ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
]
SKIP_FRAGMENTS = [
    "/admin", "/login", "/logout", "/register", "/signin", "/signup", "/auth", "/api/", "/assets/",
    "/static/", "/images/", "/img/", "/css/", "/js/", "/fonts/", "mailto:", "tel:", "javascript:", "#",
]
# Where a sitemap is looked for, in this order.
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemaps.xml", "/sitemap/sitemap.xml"]


@dataclass(frozen=True)
class UrlParts:
    """Columns of one URL. ``query`` is null when there is no ``?``."""

    scheme: Column
    authority: Column
    path: Column
    query: Column


def url_parts(url: Column) -> UrlParts:
    no_fragment = F.substring_index(url, "#", 1)
    return UrlParts(
        scheme=F.lower(F.regexp_extract(url, _URL, 1)),
        authority=F.regexp_extract(url, _URL, 2),
        path=F.regexp_extract(url, _URL, 3),
        query=F.when(no_fragment.contains("?"), F.regexp_extract(url, _URL, 4)),
    )


def host_of(url: Column) -> Column:
    """Host with its port, case kept, without user info; empty for a relative URL."""
    return drop_userinfo(F.regexp_extract(url, _URL, 2))


def drop_userinfo(authority: Column) -> Column:
    return F.when(authority.contains("@"), F.substring_index(authority, "@", -1)).otherwise(authority)


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def clean_url(raw: Column) -> Column:
    """Drop control characters, then trim. Inner spaces stay."""
    return trim_u(strip_control(raw))


def fold_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments; the result starts with a slash."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    kept = F.aggregate(
        segments,
        F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    last = F.element_at(segments, -1)
    tail = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    folded = F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
    return (
        F.when(path == "", path)
        .when(path.rlike(_DOT_SEGMENT), folded)
        .when(path.startswith("/"), path)
        .otherwise(F.concat(F.lit("/"), path))
    )


def resolve_parts(base: UrlParts, ref: UrlParts) -> UrlParts:
    """RFC 3986 reference resolution on parts, so that a base is taken apart only once."""
    absolute = (ref.scheme != "") | (ref.authority != "")
    opaque = (ref.scheme != "") & (ref.authority == "") & ~ref.path.startswith("/")
    directory = F.regexp_extract(base.path, r"^(.*/)", 1)
    path = (
        F.when(absolute | ref.path.startswith("/"), ref.path)
        .when(ref.path == "", base.path)
        .otherwise(F.concat(directory, ref.path))
    )
    inherits_query = ~absolute & (ref.path == "") & (F.coalesce(ref.query, F.lit("")) == "")
    return UrlParts(
        scheme=F.when(ref.scheme != "", ref.scheme).otherwise(base.scheme),
        authority=F.when(absolute, ref.authority).otherwise(base.authority),
        path=F.when(opaque, ref.path).otherwise(fold_dots(path)),
        query=F.when(inherits_query, base.query).otherwise(ref.query),
    )


def join_parts(parts: UrlParts) -> Column:
    return F.concat(
        F.when(parts.scheme != "", F.concat(parts.scheme, F.lit(":"))).otherwise(""),
        F.when(parts.authority != "", F.concat(F.lit("//"), parts.authority)).otherwise(""),
        parts.path,
        F.when(F.coalesce(parts.query, F.lit("")) != "", F.concat(F.lit("?"), parts.query)).otherwise(""),
    )


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href``; a bare ``#...`` gives an empty text, the fragment is dropped."""
    return F.when(href.startswith("#"), "").otherwise(
        join_parts(resolve_parts(url_parts(base), url_parts(href)))
    )


def decode_path(path: Column) -> Column:
    """Percent-decoded path; null for a bad escape. A path whose bytes are no UTF-8 text stays as written, since
    decoding would give different pages one address."""
    decoded = F.try_url_decode(F.regexp_replace(path, r"\+", "%2B"))
    return F.when(path.contains("%"), F.when(decoded.contains("\ufffd"), path).otherwise(decoded)).otherwise(path)


def canonical_parts(parts: UrlParts) -> Column:
    return F.concat(
        parts.scheme,
        F.lit("://"),
        drop_userinfo(parts.authority),
        decode_path(parts.path),
        F.when(F.coalesce(parts.query, F.lit("")) != "", F.concat(F.lit("?"), parts.query)).otherwise(""),
    )


def canonical_url(absolute: Column) -> Column:
    """``scheme://host`` + decoded path + raw query; null for a bad percent escape."""
    return canonical_parts(url_parts(absolute))


def site_hosts_of(host: Column) -> Column:
    twin = F.when(host.startswith("www."), F.substring(host, 5, 2147483647)).otherwise(
        F.concat(F.lit("www."), host)
    )
    return F.array(host, twin)


def site_hosts(url: Column) -> Column:
    """The host and its ``www.`` twin."""
    return site_hosts_of(host_of(url))


def same_site(dst: Column, seed: Column) -> Column:
    """Host of ``dst`` is the seed's host or its twin; case, port and sub-domain count."""
    return F.array_contains(site_hosts(seed), host_of(dst))


def fallback_urls(url: Column) -> Column:
    """Alternatives in order of trial: twin host; for http also https on both hosts."""
    p = url_parts(url)
    at = F.when(p.authority.contains("@"), F.regexp_extract(p.authority, r"^(.*@)", 1)).otherwise("")
    hosts = site_hosts_of(drop_userinfo(p.authority))
    tail = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")

    def build(scheme: Column, host: Column) -> Column:
        return F.concat(scheme, F.lit("://"), at, host, tail)

    is_http = p.scheme == "http"
    https = F.lit("https")
    return F.array_compact(
        F.array(
            build(p.scheme, hosts[1]),
            F.when(is_http, build(https, hosts[0])),
            F.when(is_http, build(https, hosts[1])),
        )
    )


def site_root(url: Column) -> Column:
    return F.concat(scheme_of(url), F.lit("://"), host_of(url))


def sitemap_candidates(url: Column) -> Column:
    root = site_root(url)
    return F.array(*[F.concat(root, F.lit(p)) for p in SITEMAP_PATHS])


def robots_url(url: Column) -> Column:
    return F.concat(site_root(url), F.lit("/robots.txt"))


def is_skippable(href: Column) -> Column:
    """A file type or page area that is never followed. Judged on the raw link text."""
    low = F.lower(href)
    suffix = r"\.(?:" + "|".join(s[1:] for s in SKIP_SUFFIXES) + r")\z"
    fragment = "|".join(SKIP_FRAGMENTS)
    return low.rlike(f"{suffix}|{fragment}")


def url_patterns(url: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Sub-string rules: any ``exclude`` hit rejects; a non-empty ``include`` must be hit."""

    def any_of(patterns: list[str]) -> Column:
        return F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(url, p))

    keep = any_of(include) if include else F.lit(True)
    return keep & ~any_of(exclude) if exclude else keep


def url_patterns_col(url: Column, include: Column, exclude: Column) -> Column:
    """As :func:`url_patterns`, with the rule lists in array columns of the row."""

    def any_of(patterns: Column) -> Column:
        return F.coalesce(F.exists(patterns, lambda p: F.contains(url, p)), F.lit(False))

    no_include = F.coalesce(F.size(include), F.lit(0)) <= 0
    return (no_include | any_of(include)) & ~any_of(exclude)
