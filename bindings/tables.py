"""Input tables of the registered queries.

Tables that have no file of their own are derived from the given ones by plain
arithmetic, with one SQL text that Spark and DuckDB both run. ``{pages}`` and the like
name the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SITE_SIZE = 10  # pages of one derived site, so every derived document is small

_BASE = """
p AS (
  SELECT page_id, url, html,
    regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
    regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
    regexp_extract(url, '^[a-z]+://[^/?#]+(.*)$', 1) AS tail
  FROM {pages})"""

_SITE = f"""
site AS (
  SELECT page_id, html, CAST(floor(page_id / {SITE_SIZE}.0) AS BIGINT) AS s, page_id % {SITE_SIZE} AS k,
    'https://s' || CAST(CAST(floor(page_id / {SITE_SIZE}.0) AS BIGINT) AS STRING) || '.example.org' AS root
  FROM {{pages}}),
site_page AS (
  SELECT page_id, s, k, root, root || '/p/' || CAST(k AS STRING) AS url,
    '<html><body><a href="/p/' || CAST(2 * k + 1 AS STRING) || '">a</a><p><a href="' || CAST(2 * k + 2 AS STRING)
    || '">b</a> <a href="/p/0#top">skip</a><a href="../p/0">home</a><a href="/p/' || CAST((3 * k) % {SITE_SIZE} AS STRING)
    || '">c</a><a href="https://other.example.org/">d</a></body></html>' AS html
  FROM site),
site_edge AS (
  SELECT url AS src, 0 AS pos, root || '/p/' || CAST(2 * k + 1 AS STRING) AS dst FROM site_page
  UNION ALL SELECT url, 1, root || '/p/' || CAST(2 * k + 2 AS STRING) FROM site_page
  UNION ALL SELECT url, 3, root || '/p/0' FROM site_page
  UNION ALL SELECT url, 4, root || '/p/' || CAST((3 * k) % {SITE_SIZE} AS STRING) FROM site_page),
request AS (
  SELECT 'job-' || CAST(page_id AS STRING) AS job_id, page_id, s, root,
    root || '/p/' || CAST(k AS STRING) AS url, CAST(1 + page_id % 3 AS INT) AS depth,
    CAST(5 + page_id % 7 AS INT) AS workers,
    CASE page_id % 3 WHEN 0 THEN '200ms' WHEN 1 THEN '1.5s' ELSE 'soon' END AS delay,
    CAST(CASE page_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 7 WHEN 2 THEN 12 ELSE CASE WHEN page_id % 8 = 3 THEN 1000 END END AS INT) AS max_urls,
    page_id % 5 = 1 AS enable_sitemap, page_id % 5 = 2 AS enable_html, page_id % 11 = 5 AS enable_headless
  FROM site_page)"""

_CHILD = "'<sitemap><loc>' || root || '/sm/{k}.xml</loc><lastmod>2024-01-0{d}</lastmod></sitemap>'"
_CHILDREN = " || ".join(
    f"coalesce(max(CASE WHEN k = {k} THEN {_CHILD.format(k=k, d=1 + k % 9)} END), '')" for k in range(SITE_SIZE)
)
_ENTRY = "'<url><loc>' || root || '/{0}</loc></url>'"
_LINK = "'<sitemap><loc>' || root || '/{0}.xml</loc></sitemap>'"
_DENSE = 5  # indexes of a site that all list each other
# Documents that cannot be read to their end: what is wrong, where, and the part in front of it that can.
_SITEMAPS = f"""
bad_body AS (
  SELECT root || '/sm/bad.xml' AS url, s % 5 AS kind, '<urlset>' || {_ENTRY.format("early")} AS head,
    CASE s % 5 WHEN 0 THEN {_ENTRY.format("second")} || '<url><loc>' || root || '/cut'
      WHEN 1 THEN '<url><loc>' || root || '/a?x=1&y=2</loc></url>' || {_ENTRY.format("late")} || '</urlset>'
      WHEN 4 THEN chr(10) || '<url><loc>x</url>' || {_ENTRY.format("late")} || '</urlset>' ELSE '' END AS rest, s, root
  FROM site_page GROUP BY s, root),
bad_doc AS (
  SELECT url, CASE kind WHEN 2 THEN 'Service unavailable ' || CAST(s AS STRING) WHEN 3 THEN '<rss>' || {_ENTRY.format("early")} || '</rss>' ELSE head || rest END AS body,
    CASE kind WHEN 0 THEN head || {_ENTRY.format("second")} WHEN 1 THEN head WHEN 4 THEN head ELSE '' END AS good,
    CASE kind WHEN 0 THEN 'no element found' WHEN 1 THEN 'not well-formed (invalid token)' WHEN 2 THEN 'syntax error'
      WHEN 3 THEN 'root element is rss' ELSE 'mismatched tag' END AS reason,
    CAST(CASE kind WHEN 3 THEN NULL WHEN 4 THEN 2 ELSE 1 END AS INT) AS line,
    CAST(CASE kind WHEN 0 THEN length(head || rest) WHEN 1 THEN length(head || split_part(rest, '&', 1)) + 2 WHEN 2 THEN 0
      WHEN 4 THEN length(head) + 14 END AS BIGINT) AS place
  FROM bad_body
  UNION ALL
  SELECT root || '/sitemaps.xml', '<html><body>not found</body></html>', '', 'root element is html', NULL, NULL FROM site_page GROUP BY s, root),
sitemap_doc AS (
  SELECT root || '/sm/' || CAST(k AS STRING) || '.xml' AS url,
    '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>' || url
    || '</loc><lastmod>2024-02-03</lastmod><priority>0.5</priority></url><url><loc></loc></url><url><loc>' || root
    || '/only?id=' || CAST(page_id AS STRING) || '&amp;x=1</loc></url><url><loc>' || root || '/shared</loc></url></urlset>' AS body
  FROM site_page
  UNION ALL
  SELECT root || CASE s % 4 WHEN 0 THEN '/sitemap.xml' WHEN 1 THEN '/sitemap_index.xml' ELSE '/maps/all.xml' END,
    '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || {_CHILDREN}
    || {_LINK.format("sm/bad")} || {_LINK.format("sm/gone")} || '</sitemapindex>'
  FROM site_page GROUP BY s, root
  UNION ALL
  SELECT root || '/dense/' || CAST(k AS STRING) || '.xml', '<sitemapindex>' || {" || ".join(_LINK.format(f"dense/{k}") for k in range(_DENSE))}
    || '<sitemap><loc>' || root || '/sm/' || CAST(k AS STRING) || '.xml</loc></sitemap></sitemapindex>'
  FROM site_page WHERE k < {_DENSE}
  UNION ALL
  SELECT url, body FROM bad_doc),
robots_doc AS (
  SELECT root AS base_url, s,
    'User-agent: *' || chr(10) || 'Disallow: /p/1' || chr(13) || chr(10) || 'Allow: /p/1' || CAST(s % 10 AS STRING) || chr(10)
    || CASE WHEN s % 4 = 0 OR s % 8 = 7 THEN '' WHEN s % 4 = 1 THEN 'SITEMAP:' || chr(10)
       WHEN s % 4 = 2 THEN '  Sitemap: ' || root || '/maps/all.xml  ' || chr(13) || chr(10) || 'sitemap: /sm/1.xml' || chr(10)
       ELSE 'Sitemap: /sm/2.xml' || chr(10) || 'sitemap:' || root || '/sm/3.xml' END AS body
  FROM site_page GROUP BY s, root),
site_fetch AS (
  SELECT url, CASE WHEN s % 4 = 3 THEN 403 WHEN page_id % 13 = 4 THEN 503 ELSE 200 END AS status_code,
    CASE WHEN s % 8 = 7 THEN 'connection reset' END AS error
  FROM site_page
  UNION ALL
  SELECT 'https://www.' || substr(url, 9), 200, NULL FROM site_page WHERE s % 4 <> 3
  UNION ALL
  SELECT url, CASE WHEN url LIKE '%/sm/3.xml' THEN 404 ELSE 200 END, NULL FROM sitemap_doc)"""

_FETCHES = """
attempt AS (
  SELECT page_id, url, html, CAST(a.attempt AS INT) AS attempt, CAST(1 + (page_id + a.attempt) % 2 AS INT) AS tier,
    CAST(CASE (page_id * 7 + a.attempt) % 11 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 500 WHEN 4 THEN 301
      WHEN 5 THEN 429 WHEN 6 THEN 204 WHEN 7 THEN 503 ELSE 200 END AS INT) AS status_code,
    CASE (page_id + a.attempt) % 4 WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN 'application/json' ELSE 'text/html' END AS content_type,
    CASE WHEN (page_id * 3 + a.attempt) % 7 = 2 THEN 'timeout' END AS error,
    CASE WHEN (page_id + a.attempt) % 9 = 0 THEN '  tiny ' ELSE html END AS body
  FROM {pages} {attempts}),
probe AS (
  SELECT url, CAST(CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 200 WHEN 3 THEN 302 ELSE 500 END AS INT) AS status_code,
    CASE WHEN page_id % 11 = 3 THEN 'connection refused' END AS error, 1 AS attempt
  FROM p
  UNION ALL
  SELECT 'https://' || host || tail, CAST(CASE WHEN page_id % 3 = 0 THEN 200 ELSE 410 END AS INT), NULL, 2 FROM p WHERE scheme = 'http'
  UNION ALL
  SELECT scheme || '://' || CASE WHEN host LIKE 'www.%' THEN substr(host, 5) ELSE 'www.' || host END || tail,
    CAST(CASE WHEN page_id % 2 = 0 THEN 200 ELSE 404 END AS INT), NULL, 3 FROM p)"""

_EVENTS = """
ev AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS timestamp, 'job-' || CAST(user_id AS STRING) AS job_id,
    CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'tier_switch' ELSE 'progress' END
      WHEN 'click' THEN 'url_discovered' WHEN 'view' THEN 'sitemap_discovered' WHEN 'purchase' THEN 'completed' ELSE 'error' END AS type,
    CASE WHEN event_type IN ('click', 'view') THEN 'https://site' || CAST(user_id AS STRING) || '.example.com/p/' || CAST(event_id AS STRING) END AS url,
    CAST(CASE WHEN event_type = 'click' THEN 1 + event_id % 3 END AS INT) AS depth,
    CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN
        CASE WHEN event_id % 5 = 4 THEN 'Tier done' ELSE 'Starting Tier ' || CAST(1 + event_id % 3 AS STRING) || ': next' END
      WHEN event_type = 'signup' THEN
        CASE WHEN event_id % 3 = 0 THEN 'looking' ELSE 'crawling added ' || CAST(event_id % 40 AS STRING) || ' new URLs (total: 50)' END
      WHEN event_type = 'purchase' THEN 'Crawl completed' END AS progress,
    CAST(CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN floor(value) ELSE 0 END AS INT) AS total,
    CAST(CASE WHEN event_type = 'view' THEN event_id % 50 ELSE 0 END AS INT) AS page_count,
    CASE WHEN event_type = 'error' THEN 'HTTP ' || CAST(400 + event_id % 200 AS STRING) END AS error,
    CASE event_id % 4 WHEN 0 THEN 'sitemap' WHEN 1 THEN 'html' WHEN 2 THEN 'headless' END AS tier
  FROM {events}),
access_log AS (
  SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method,
    CASE event_id % 5 WHEN 0 THEN '/health' WHEN 1 THEN '/jobs' ELSE '/' || event_type END AS path,
    CASE WHEN event_id % 2 = 0 THEN '' ELSE '10.0.' || CAST(event_id % 9 AS STRING) || '.1, 10.1.1.1' END AS xff,
    CASE WHEN event_id % 3 = 0 THEN '192.168.0.' || CAST(event_id % 7 AS STRING) END AS x_real_ip,
    '172.16.0.1:' || CAST(1000 + event_id % 100 AS STRING) AS remote_addr,
    CAST(CASE event_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 399 WHEN 3 THEN 400 ELSE 200 END AS INT) AS status,
    value / 10.0 AS duration_s, repeat(props, CAST(30 + event_id % 30 AS INT)) AS req_body,
    repeat(event_type, CAST(60 + event_id % 40 AS INT)) AS resp_body
  FROM {events})"""

_JOBS = """
job AS (
  SELECT CAST(o_orderkey AS STRING) AS id,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS progress,
    CASE WHEN o_orderstatus = 'P' THEN 'HTTP 500' END AS error,
    CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 5 MINUTES AS updated_at
  FROM {orders}),
job_update AS (
  SELECT CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'failed' END AS status,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'step ' || CAST(o_orderkey % 5 AS STRING) END AS progress,
    CASE WHEN o_orderkey % 2 = 1 THEN 'late error' ELSE '' END AS error,
    CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 9 MINUTES AS updated_at
  FROM {orders} WHERE o_orderstatus = 'O'),
crawl_run AS (
  SELECT CAST(o_orderkey AS STRING) AS id, 'https://c' || CAST(o_custkey AS STRING) || '.example.com' AS target_url,
    CAST(o_orderdate AS TIMESTAMP) AS crawled_at, CAST(floor(o_totalprice) AS INT) AS total_urls, CAST(1 + o_orderkey % 4 AS INT) AS depth
  FROM {orders})"""

GROUPS = {"p": _BASE, "site": _SITE, "sitemaps": _SITEMAPS, "fetches": _FETCHES, "events": _EVENTS, "jobs": _JOBS}
OF_TABLE = {
    "p": ["p"], "attempt": ["p", "fetches"], "probe": ["p", "fetches"],
    "site": ["site"], "site_page": ["site"], "site_edge": ["site"], "request": ["site"],
    "sitemap_doc": ["site", "sitemaps"], "bad_doc": ["site", "sitemaps"], "robots_doc": ["site", "sitemaps"], "site_fetch": ["site", "sitemaps"],
    "ev": ["events"], "access_log": ["events"], "job": ["jobs"], "job_update": ["jobs"], "crawl_run": ["jobs"],
}
GIVEN = ["pages", "documents", "events", "orders"]
_SPARK_ATTEMPTS = "LATERAL VIEW explode(array(1, 2, 3, 4, 5)) a AS attempt"
_DUCK_ATTEMPTS = ", unnest([1, 2, 3, 4, 5]) a(attempt)"


def _with(groups: list[str]) -> str:
    return "WITH RECURSIVE " + ",".join(GROUPS[g] for g in groups)


def duck(sql: str, *tables: str) -> str:
    """``sql`` for DuckDB, with the derived ``tables`` in front. ``sql`` may begin with
    more common tables (``name AS (...), ... SELECT``)."""
    groups = list(dict.fromkeys(g for t in tables for g in OF_TABLE[t]))
    head = _with(groups) if groups else "WITH RECURSIVE dummy AS (SELECT 1)"
    names = {g: g for g in GIVEN}
    head = head.format(**names, attempts=_DUCK_ATTEMPTS)
    body = sql.strip()
    return head + (" " if body[:6].upper() == "SELECT" else ",\n") + body


class Tables:
    """Given and derived tables of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def derived(self, name: str) -> DataFrame:
        text = "WITH " + ",".join(GROUPS[g] for g in OF_TABLE[name]) + f" SELECT * FROM {name}"
        text = text.replace("{attempts}", _SPARK_ATTEMPTS)
        used = [g for g in GIVEN if "{" + g + "}" in text]
        return self.spark.sql(text, **{g: self.given(g) for g in used})

    def __getattr__(self, name: str) -> DataFrame:
        return self.given(name) if name in GIVEN else self.derived(name)
