"""Fixed schemas of the tables. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(ddl: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in ddl])


STR, INT, LONG, DBL, BOOL, TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)
STRINGS, HEADERS = T.ArrayType(STR), T.MapType(STR, STR)

CRAWL_REQUEST = _struct([
    ("url", STR), ("job_id", STR), ("depth", INT), ("workers", INT), ("delay", STR), ("max_urls", INT),
    ("enable_sitemap", BOOL), ("enable_html", BOOL), ("enable_headless", BOOL),
    ("headless_timeout", INT), ("wait_for_js", BOOL),
])
CRAWL_SETTINGS = _struct([("workers", INT), ("delay", STR), ("depth", INT)])
CRAWL_RESULT = _struct([
    ("id", STR), ("target_url", STR), ("crawled_at", TS), ("duration", STR), ("total_urls", INT),
    ("urls_per_second", STR), ("settings", CRAWL_SETTINGS), ("urls", STRINGS),
])
TIER_STATS = _struct([
    ("job_id", STR), ("sitemap_urls", LONG), ("html_urls", LONG), ("headless_urls", LONG), ("total_tiers_used", INT),
])
JOB = _struct([
    ("id", STR), ("status", STR), ("progress", STR), ("result", CRAWL_RESULT), ("error", STR),
    ("created_at", TS), ("updated_at", TS), ("request", CRAWL_REQUEST),
])
CRAWL_EVENT = _struct([
    ("type", STR), ("job_id", STR), ("url", STR), ("depth", INT), ("progress", STR), ("timestamp", TS),
    ("total", INT), ("page_count", INT), ("error", STR), ("tier", STR),
])
CONTENT_REQUEST = _struct([("url", STR), ("urls", STRINGS), ("concurrency", INT)])
CONTENT_RESPONSE = _struct([
    ("url", STR), ("status_code", INT), ("content_type", STR), ("markdown", STR),
    ("sizes", _struct([("markdown", INT)])), ("headers", HEADERS), ("error", STR),
])
SITEMAP_DOC = _struct([
    ("url", T.ArrayType(_struct([("loc", STR), ("lastmod", STR), ("changefreq", STR), ("priority", STR)]))),
    ("sitemap", T.ArrayType(_struct([("loc", STR), ("lastmod", STR)]))),
])
FETCH = _struct([
    ("url", STR), ("method", STR), ("tier", INT), ("attempt", INT), ("status_code", INT), ("content_type", STR),
    ("headers", HEADERS), ("body", STR), ("error", STR), ("fetched_at", TS),
])
ACCESS_LOG = _struct([
    ("ts", TS), ("method", STR), ("path", STR), ("query", STR), ("xff", STR), ("x_real_ip", STR),
    ("remote_addr", STR), ("user_agent", STR), ("status", INT), ("duration_s", DBL), ("size", LONG),
    ("req_body", STR), ("resp_body", STR),
])

# The event types, those delivered to clients, tiers and job states.
EVENT_TYPES = ["progress", "url_discovered", "completed", "error", "sitemap_discovered", "tier_switch"]
DELIVERED_TYPES = ["url_discovered", "progress", "completed", "error"]
TIERS = ["sitemap", "html", "headless"]
JOB_STATUSES = ["running", "completed", "failed"]
