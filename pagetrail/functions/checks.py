"""Predicates and small scalars on statuses, requests and headers (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reason phrases used in status errors (RFC 9110 and RFC 6585).
REASON_PHRASES = {
    400: "Bad Request",
    401: "Unauthorized",
    402: "Payment Required",
    403: "Forbidden",
    404: "Not Found",
    405: "Method Not Allowed",
    406: "Not Acceptable",
    407: "Proxy Authentication Required",
    408: "Request Timeout",
    409: "Conflict",
    410: "Gone",
    411: "Length Required",
    412: "Precondition Failed",
    413: "Request Entity Too Large",
    414: "Request URI Too Long",
    415: "Unsupported Media Type",
    417: "Expectation Failed",
    418: "I'm a teapot",
    422: "Unprocessable Entity",
    423: "Locked",
    429: "Too Many Requests",
    451: "Unavailable For Legal Reasons",
    500: "Internal Server Error",
    501: "Not Implemented",
    502: "Bad Gateway",
    503: "Service Unavailable",
    504: "Gateway Timeout",
    505: "HTTP Version Not Supported",
}
# Request defaults and limits.
DEFAULT_DEPTH = 1
DEFAULT_WORKERS = 10
DEFAULT_DELAY = "200ms"
DEFAULT_DELAY_SECONDS = 0.2
DEFAULT_MAX_URLS = 1000
DEFAULT_HEADLESS_TIMEOUT = 30
MAX_URLS_LIMIT = 5000
HTML_TIER_BELOW = 10
HEADLESS_TIER_BELOW = 5
# Seconds in one unit of a duration text.
DURATION_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def status_line(status: Column) -> Column:
    """``404 Not Found``; only the number when the code has no phrase here."""
    phrases = F.create_map(*[F.lit(x) for kv in REASON_PHRASES.items() for x in kv])
    code = status.cast("int")
    return F.concat_ws(" ", code.cast("string"), F.try_element_at(phrases, code))


def is_accessible(status: Column) -> Column:
    return F.coalesce(status.between(200, 399), F.lit(False))


def access_error(status: Column, error: Column) -> Column:
    """Why an address is not accessible; null when it is."""
    transport = F.coalesce(error, F.lit("")) != ""
    return (
        F.when(transport, error)
        .when(is_accessible(status), F.lit(None).cast("string"))
        .when(status == 403, "HTTP 403: Forbidden (may need different approach)")
        .otherwise(F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), status_line(status)))
    )


def is_blocked(status: Column) -> Column:
    return F.coalesce(status.isin(403, 429), F.lit(False))


def is_success_2xx(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def sitemap_exists(status: Column) -> Column:
    return F.coalesce(status == 200, F.lit(False))


def is_html(content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("text/html"), F.lit(False))


def valid_job_id(job_id: Column) -> Column:
    return F.coalesce(job_id.rlike(r"\A[A-Za-z0-9_-]{3,50}\z"), F.lit(False))


def _no_flag(sitemap: Column, html: Column, headless: Column) -> Column:
    on = [F.coalesce(c, F.lit(False)) for c in (sitemap, html, headless)]
    return ~(on[0] | on[1] | on[2])


def sitemap_tier_enabled(sitemap: Column, html: Column, headless: Column) -> Column:
    return F.coalesce(sitemap, F.lit(False)) | _no_flag(sitemap, html, headless)


def html_tier_enabled(sitemap: Column, html: Column, headless: Column) -> Column:
    return F.coalesce(html, F.lit(False)) | _no_flag(sitemap, html, headless)


def needs_html_tier(n_urls: Column) -> Column:
    return F.coalesce(n_urls, F.lit(0)) < HTML_TIER_BELOW


def needs_headless_tier(n_urls: Column) -> Column:
    return F.coalesce(n_urls, F.lit(0)) < HEADLESS_TIER_BELOW


def job_status_filter(status: Column, wanted: str | None) -> Column:
    return status == wanted if wanted else F.lit(True)


def zero_default(value: Column, default) -> Column:
    """``default`` for null, 0 or an empty text."""
    empty = F.lit("" if isinstance(default, str) else 0)
    return F.coalesce(F.nullif(value, empty), F.lit(default))


def duration_seconds(text: Column) -> Column:
    """Seconds of a duration text such as ``1m2.5s``; an invalid text counts as 0.2 s."""
    number = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
    unit = "|".join(sorted(DURATION_UNITS, key=len, reverse=True))
    token = f"({number})({unit})"
    body = F.regexp_replace(text, r"^[+-]", "")
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    units = F.create_map(*[F.lit(x) for kv in DURATION_UNITS.items() for x in kv])
    amounts = F.regexp_extract_all(body, F.lit(token), F.lit(1))
    names = F.regexp_extract_all(body, F.lit(token), F.lit(2))
    total = F.aggregate(
        F.zip_with(amounts, names, lambda a, n: a.try_cast("double") * units[n]),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return (
        F.when(body.rlike(rf"\A(?:{token})+\z"), sign * total)
        .when(body.rlike(r"\A0\z"), 0.0)
        .otherwise(DEFAULT_DELAY_SECONDS)
    )


def first_header_values(headers: Column) -> Column:
    """``map<string, array<string>>`` to the first value per name."""
    return F.transform_values(
        F.map_filter(headers, lambda _, v: F.size(v) > 0), lambda _, v: F.element_at(v, 1)
    )


def client_ip(xff: Column, x_real_ip: Column, remote_addr: Column) -> Column:
    """X-Forwarded-For as a whole, else X-Real-IP, else the peer address."""
    blank = F.lit("")
    return F.coalesce(F.nullif(xff, blank), F.nullif(x_real_ip, blank), remote_addr)


def elapsed_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def parse_rfc3339(text: Column) -> Column:
    """Timestamp of an RFC 3339 text, also of a bare date; null when it cannot be read."""
    return F.try_to_timestamp(text)
