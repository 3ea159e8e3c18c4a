"""URL functions, link filters, and pages to links."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetrail.functions import checks, text, urls
from pagetrail.operators import links, robots

from .registry import query

WS = r"[\t\n\x{0B}\f\r\x{85}\p{Z}]+"
TRIM = rf"^{WS}|{WS}\z"

# -- text of an address -------------------------------------------------------------

_DIRTY = """SELECT page_id, CASE page_id % 5
    WHEN 0 THEN chr(160) || ' ' || url || chr(10) || chr(9) WHEN 1 THEN substr(url, 1, 12) || chr(10) || chr(7) || substr(url, 13)
    WHEN 2 THEN '　' || substr(url, 1, 15) || ' x ' || substr(url, 16) || chr(13) WHEN 3 THEN chr(9) || chr(127) || ' ' ELSE url END AS raw
  FROM {pages}"""


def _dirty(t):
    return t.spark.sql(_DIRTY, pages=t.pages)


@query("clean_url", f"""
dirty AS ({_DIRTY.format(pages="pages")})
SELECT page_id, regexp_replace(regexp_replace(raw, '\\p{{Cc}}', '', 'g'), '{TRIM}', '', 'g') AS cleaned FROM dirty""")
def clean_url(t):
    return _dirty(t).select("page_id", urls.clean_url(F.col("raw")).alias("cleaned"))


@query("trim_unicode", f"""
dirty AS ({_DIRTY.format(pages="pages")})
SELECT page_id, regexp_replace(raw, '{TRIM}', '', 'g') AS trimmed FROM dirty""")
def trim_unicode(t):
    return _dirty(t).select("page_id", text.trim_u(F.col("raw")).alias("trimmed"))


@query("strip_control", f"""
dirty AS ({_DIRTY.format(pages="pages")})
SELECT page_id, regexp_replace(raw, '\\p{{Cc}}', '', 'g') AS stripped FROM dirty""")
def strip_control(t):
    return _dirty(t).select("page_id", text.strip_control(F.col("raw")).alias("stripped"))


@query("string_scalars", """
SELECT page_id, starts_with(url, 'https://') AS is_https, ends_with(url, '.html') AS is_file, contains(url, '?') AS has_query,
  lower(html) AS low, replace(url, 'example', 'sample') AS swapped FROM pages""")
def string_scalars(t):
    url = F.col("url")
    return t.pages.select(
        "page_id", url.startswith("https://").alias("is_https"), url.endswith(".html").alias("is_file"),
        url.contains("?").alias("has_query"), F.lower("html").alias("low"),
        F.replace(url, F.lit("example"), F.lit("sample")).alias("swapped"),
    )


@query("split_lines", """
SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, string_split(text, chr(10))[1] AS first_line FROM documents""")
def split_lines(t):
    lines = text.split_lines(F.col("text"))
    return t.documents.select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), lines[0].alias("first_line"))


# -- resolving and canonical form ---------------------------------------------------

_REFS = [
    "/a/../b/./c", "../x?y=1", "./n.html#top", "sub/page", "?q=2", "#frag", "", "//other.example.net/z?k",
    "HTTPS://U:p@Other.Example.com:8080/A%20b/..", "mailto:a@example.com", "../../../up/", "a b/%C3%A9", "x/%zz",
    "/a%FE", "/a%FF",
]
_REFS_SQL = "[" + ", ".join(f"'{r}'" for r in _REFS) + "]"
# With path "/lang/name" or "/lang/name/": the directory and its parent.
_RESOLVED = f"""
page AS (SELECT *, regexp_extract(tail, '^([^?#]*)', 1) AS path, regexp_extract(tail, '^[^?#]*([?][^#]*)', 1) AS query FROM p),
dirs AS (SELECT *, regexp_extract(path, '^(.*/)', 1) AS dir FROM page),
refs AS (SELECT page_id, scheme || '://' || host AS root, path, query, dir, regexp_replace(dir, '[^/]+/$', '') AS parent, r.ref AS ref
  FROM dirs, unnest({_REFS_SQL}) r(ref)),
resolved AS (SELECT page_id, ref, CASE ref
    WHEN '/a/../b/./c' THEN root || '/b/c' WHEN '../x?y=1' THEN root || parent || 'x?y=1' WHEN './n.html#top' THEN root || dir || 'n.html'
    WHEN 'sub/page' THEN root || dir || 'sub/page' WHEN '?q=2' THEN root || path || '?q=2' WHEN '#frag' THEN ''
    WHEN '' THEN root || path || query WHEN '//other.example.net/z?k' THEN split_part(root, ':', 1) || '://other.example.net/z?k'
    WHEN 'HTTPS://U:p@Other.Example.com:8080/A%20b/..' THEN 'https://U:p@Other.Example.com:8080/'
    WHEN 'mailto:a@example.com' THEN 'mailto:a@example.com' WHEN '../../../up/' THEN root || '/up/'
    WHEN 'a b/%C3%A9' THEN root || dir || 'a b/%C3%A9' WHEN '/a%FE' THEN root || '/a%FE' WHEN '/a%FF' THEN root || '/a%FF' ELSE root || dir || 'x/%zz' END AS absolute FROM refs)"""


def _resolved(t):
    refs = t.pages.select("page_id", "url", F.explode(F.array(*[F.lit(r) for r in _REFS])).alias("ref"))
    return refs.select("page_id", "ref", urls.resolve_url(F.col("url"), F.col("ref")).alias("absolute"))


@query("resolve_url", _RESOLVED + " SELECT page_id, ref, absolute FROM resolved", ("p",))
def resolve_url(t):
    return _resolved(t)


@query("canonical_url", _RESOLVED + """,
joined AS (SELECT page_id, ref, replace(replace(replace(absolute, 'U:p@', ''), '%20', ' '), '%C3%A9', 'é') AS c FROM resolved)
SELECT page_id, ref, CASE ref WHEN 'x/%zz' THEN NULL WHEN '#frag' THEN '://' WHEN 'mailto:a@example.com' THEN 'mailto://a@example.com'
  ELSE c END AS canonical FROM joined""", ("p",))
def canonical_url(t):
    return _resolved(t).select("page_id", "ref", urls.canonical_url(F.col("absolute")).alias("canonical"))


@query("canonical_page_url", "SELECT page_id, split_part(url, '#', 1) AS canonical FROM pages")
def canonical_page_url(t):
    return t.pages.select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("site_hosts", """
SELECT page_id, host, CASE WHEN host LIKE 'www.%' THEN substr(host, 5) ELSE 'www.' || host END AS twin FROM p""", ("p",))
def site_hosts(t):
    hosts = urls.site_hosts(F.col("url"))
    return t.pages.select("page_id", hosts[0].alias("host"), hosts[1].alias("twin"))


_FALLBACKS = """
alt AS (SELECT page_id, scheme, host, tail, CASE WHEN host LIKE 'www.%' THEN substr(host, 5) ELSE 'www.' || host END AS twin FROM p),
fallback AS (
  SELECT page_id, 0 AS pos, scheme || '://' || twin || tail AS url FROM alt
  UNION ALL SELECT page_id, 1, 'https://' || host || tail FROM alt WHERE scheme = 'http'
  UNION ALL SELECT page_id, 2, 'https://' || twin || tail FROM alt WHERE scheme = 'http')"""


@query("fallback_urls", _FALLBACKS + " SELECT page_id, pos, url FROM fallback", ("p",))
def fallback_urls(t):
    return t.pages.select("page_id", F.posexplode(urls.fallback_urls(F.col("url"))).alias("pos", "url"))


@query("sitemap_candidates", """
SELECT page_id, CAST(i - 1 AS INT) AS pos, scheme || '://' || host || ['/sitemap.xml', '/sitemap_index.xml', '/sitemaps.xml', '/sitemap/sitemap.xml'][i] AS url
FROM p, unnest([1, 2, 3, 4]) n(i)""", ("p",))
def sitemap_candidates(t):
    return t.pages.select("page_id", F.posexplode(urls.sitemap_candidates(F.col("url"))).alias("pos", "url"))


@query("robots_url", "SELECT page_id, scheme || '://' || host || '/robots.txt' AS robots FROM p", ("p",))
def robots_url(t):
    return t.pages.select("page_id", urls.robots_url(F.col("url")).alias("robots"))


# -- links of the stored pages ------------------------------------------------------

# All links of these pages are written <a href="...">, outside comments and scripts.
LINKS = """
hrefs AS (SELECT page_id, scheme, host, tail, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS list, url FROM p),
link AS (SELECT page_id, url, scheme, host, CAST(i - 1 AS INT) AS pos,
    replace(replace(list[i], '&quot;', '"'), '&amp;', '&') AS href FROM hrefs, unnest(range(1, len(list) + 1)) n(i))"""
SKIP = (
    r"\.(css|js|jpg|jpeg|png|gif|svg|ico|pdf|zip|tar|gz|mp4|mp3|avi|mov|wmv|flv|swf|doc|docx|xls|xlsx|ppt|pptx)\z"
    r"|/admin|/login|/logout|/register|/signin|/signup|/auth|/api/|/assets/|/static/|/images/|/img/|/css/|/js/|/fonts/"
    r"|mailto:|tel:|javascript:|#"
)
FOUND = LINKS + f""",
found AS (SELECT page_id, split_part(url, '#', 1) AS src, pos, scheme || '://' || host || href AS dst FROM link
  WHERE href <> '' AND NOT regexp_matches(lower(href), '{SKIP}'))"""


@query("extract_links", LINKS + " SELECT page_id, pos, href FROM link", ("p",))
def extract_links(t):
    return links.extract_links(t.pages).select("page_id", "pos", "href")


@query("non_empty_link", LINKS + " SELECT page_id, pos, href FROM link WHERE href <> ''", ("p",))
def non_empty_link(t):
    return links.non_empty_link(links.extract_links(t.pages)).select("page_id", "pos", "href")


@query("absolute_links", LINKS + " SELECT page_id, pos, scheme || '://' || host || href AS absolute FROM link", ("p",))
def absolute_links(t):
    return links.absolute_links(t.pages).select("page_id", "pos", "absolute")


@query("discover_links", FOUND + " SELECT page_id, src, pos, dst FROM found", ("p",))
def discover_links(t):
    return links.discover_links(t.pages)


@query("site_links", FOUND + """,
chosen AS (SELECT split_part(url, '#', 1) AS src, min(page_id) AS page_id FROM pages GROUP BY 1)
SELECT f.src, f.pos, f.dst FROM found f JOIN chosen c ON f.page_id = c.page_id""", ("p",))
def site_links(t):
    return links.site_links(t.pages)


@query("first_seen_links", FOUND + """
SELECT split_part(dst, '/', 3) AS host, dst, min(page_id * 1000000 + pos) AS first_seen FROM found GROUP BY 1, 2""", ("p",))
def first_seen_links(t):
    from pagetrail.operators.ordering import first_seen_distinct

    found = links.discover_links(t.pages).withColumn("first_seen", F.col("page_id") * 1000000 + F.col("pos"))
    return first_seen_distinct(found.withColumn("host", urls.host_of(F.col("dst"))), ["host", "dst"], "first_seen")


@query("links_per_host", FOUND + """
SELECT split_part(dst, '/', 3) AS host, count(DISTINCT page_id) AS n_pages, count(*) AS n_links, count(DISTINCT dst) AS n_urls FROM found GROUP BY 1""", ("p",))
def links_per_host(t):
    return links.links_per_host(t.pages)


@query("link_counts", LINKS + """
SELECT pages.page_id, count(link.page_id) AS n_links FROM pages LEFT JOIN link ON pages.page_id = link.page_id GROUP BY 1""", ("p",))
def link_counts(t):
    return links.link_counts(t.pages).withColumn("n_links", F.col("n_links").cast("bigint"))


# -- filters ------------------------------------------------------------------------

_VARIANTS = """
raw AS (SELECT page_id, pos, CASE (page_id + pos) % 9 WHEN 0 THEN href || '.PDF' WHEN 1 THEN href || '.pdf?x=1' WHEN 2 THEN '/auth' || href
    WHEN 3 THEN 'admin' || href WHEN 4 THEN href || '#top' WHEN 5 THEN 'hotel:' || href WHEN 6 THEN '/IMG' || href || '/' WHEN 7 THEN href || '.css/'
    ELSE href END AS href FROM link)"""


@query("is_skippable", LINKS + "," + _VARIANTS + f"""
SELECT page_id, pos, href, regexp_matches(lower(href), '{SKIP}') AS skippable FROM raw""", ("p",))
def is_skippable(t):
    href, n = F.col("href"), (F.col("page_id") + F.col("pos")) % 9
    variant = (
        F.when(n == 0, F.concat(href, F.lit(".PDF"))).when(n == 1, F.concat(href, F.lit(".pdf?x=1")))
        .when(n == 2, F.concat(F.lit("/auth"), href)).when(n == 3, F.concat(F.lit("admin"), href))
        .when(n == 4, F.concat(href, F.lit("#top"))).when(n == 5, F.concat(F.lit("hotel:"), href))
        .when(n == 6, F.concat(F.lit("/IMG"), href, F.lit("/"))).when(n == 7, F.concat(href, F.lit(".css/"))).otherwise(href)
    )
    raw = links.extract_links(t.pages).select("page_id", "pos", variant.alias("href"))
    return raw.withColumn("skippable", urls.is_skippable(F.col("href")))


@query("same_site", """
q AS (SELECT page_id, host, scheme, CASE page_id % 5 WHEN 0 THEN 'https://' || host || '/x' WHEN 1 THEN 'http://www.' || host || '?a' WHEN 2 THEN 'https://sub.' || host
    WHEN 3 THEN 'https://' || host || ':8080/' ELSE 'https://' || upper(host) || '/' END AS dst FROM p)
SELECT page_id, dst, CASE page_id % 5 WHEN 0 THEN true WHEN 1 THEN host NOT LIKE 'www.%' ELSE false END AS same FROM q""", ("p",))
def same_site(t):
    host, n = F.col("host"), F.col("page_id") % 5
    dst = (
        F.when(n == 0, F.concat(F.lit("https://"), host, F.lit("/x"))).when(n == 1, F.concat(F.lit("http://www."), host, F.lit("?a")))
        .when(n == 2, F.concat(F.lit("https://sub."), host)).when(n == 3, F.concat(F.lit("https://"), host, F.lit(":8080/")))
        .otherwise(F.concat(F.lit("https://"), F.upper(host), F.lit("/")))
    )
    return t.p.select("page_id", "url", dst.alias("dst")).select(
        "page_id", "dst", urls.same_site(F.col("dst"), F.col("url")).alias("same")
    )


@query("url_patterns", """
SELECT page_id, url FROM pages WHERE (contains(url, '/en/') OR contains(url, '/de/')) AND NOT (contains(url, 'utm_source') OR contains(url, 'spam'))""")
def url_patterns(t):
    return t.pages.select("page_id", "url").filter(urls.url_patterns(F.col("url"), ["/en/", "/de/"], ["utm_source", "spam"]))


@query("allowed_domains", """
SELECT page_id, url FROM p WHERE host IN (SELECT host FROM p GROUP BY host HAVING count(*) >= 5)""", ("p",))
def allowed_domains(t):
    busy = t.pages.groupBy(urls.host_of(F.col("url")).alias("domain")).count().filter("count >= 5")
    return links.allowed_domains(t.pages.select("page_id", "url"), busy)


@query("robots_allowed", """
https AS (SELECT page_id, s, root, url || '/' || CAST(page_id AS STRING) AS url FROM site_page),
u AS (SELECT * FROM https UNION ALL SELECT page_id, s, 'http' || substr(root, 6), 'http' || substr(url, 6) FROM https)
SELECT page_id, url, CASE WHEN starts_with(url, 'http:') THEN NOT starts_with(url, root || '/p/2') WHEN NOT starts_with(url, root || '/p/1') THEN true
  WHEN starts_with(url, root || '/p/1' || CAST(s % 10 AS STRING)) THEN true ELSE false END AS allowed FROM u""", ("site",))
def robots_allowed(t):
    pages = t.site_page.select("page_id", F.concat("url", F.lit("/"), F.col("page_id").cast("string")).alias("url"))
    plain = F.regexp_replace("url", "^https", "http").alias("url")
    files = t.robots_doc.select("base_url", "body")
    other = files.select(F.regexp_replace("base_url", "^https", "http"), F.lit("User-agent: *\nDisallow: /p/2"))
    return robots.robots_allowed(pages.union(pages.select("page_id", plain)), files.union(other))


# -- statuses and requests ----------------------------------------------------------

_ERROR = """CASE WHEN coalesce(error, '') <> '' THEN error WHEN status_code BETWEEN 200 AND 399 THEN NULL
    WHEN status_code = 403 THEN 'HTTP 403: Forbidden (may need different approach)'
    WHEN status_code = 404 THEN 'HTTP 404: 404 Not Found' WHEN status_code = 429 THEN 'HTTP 429: 429 Too Many Requests'
    WHEN status_code = 410 THEN 'HTTP 410: 410 Gone' WHEN status_code = 500 THEN 'HTTP 500: 500 Internal Server Error'
    WHEN status_code = 503 THEN 'HTTP 503: 503 Service Unavailable' END"""


@query("status_predicates", """
SELECT page_id, attempt, status_code BETWEEN 200 AND 399 AS accessible, status_code IN (403, 429) AS blocked,
  status_code BETWEEN 200 AND 299 AS success_2xx, status_code = 200 AS sitemap_there FROM attempt""", ("attempt",))
def status_predicates(t):
    s = F.col("status_code")
    return t.attempt.select(
        "page_id", "attempt", checks.is_accessible(s).alias("accessible"), checks.is_blocked(s).alias("blocked"),
        checks.is_success_2xx(s).alias("success_2xx"), checks.sitemap_exists(s).alias("sitemap_there"),
    )


@query("access_error", f"SELECT page_id, attempt, {_ERROR} AS access_error FROM attempt", ("attempt",))
def access_error(t):
    return t.attempt.select("page_id", "attempt", checks.access_error(F.col("status_code"), F.col("error")).alias("access_error"))


@query("enough_content", rf"""
SELECT page_id, attempt, strlen(regexp_replace(body, '{TRIM}', '', 'g')) > 100 AND coalesce(error, '') = '' AS enough_markdown,
  strlen(regexp_replace(body, '{TRIM}', '', 'g')) >= 100 AS enough_html FROM attempt""", ("attempt",))
def enough_content(t):
    body = F.col("body")
    return t.attempt.select(
        "page_id", "attempt", text.enough_markdown(body, F.col("error")).alias("enough_markdown"), text.enough_html(body).alias("enough_html")
    )


@query("valid_job_id", r"""
q AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'ab' WHEN 1 THEN repeat('x', 50) WHEN 2 THEN repeat('y', 51) WHEN 3 THEN 'a b c'
  WHEN 4 THEN 'job_' || CAST(page_id AS STRING) ELSE 'abc' || chr(10) END AS job_id FROM pages)
SELECT page_id, regexp_matches(job_id, '\A[A-Za-z0-9_-]{3,50}\z') AS valid FROM q""")
def valid_job_id(t):
    n = F.col("page_id") % 6
    job_id = (
        F.when(n == 0, "ab").when(n == 1, F.repeat(F.lit("x"), F.lit(50))).when(n == 2, F.repeat(F.lit("y"), F.lit(51)))
        .when(n == 3, "a b c").when(n == 4, F.concat(F.lit("job_"), F.col("page_id").cast("string"))).otherwise("abc\n")
    )
    return t.pages.select("page_id", checks.valid_job_id(job_id).alias("valid"))


@query("tier_enabled", """
SELECT job_id, enable_sitemap OR NOT (enable_sitemap OR enable_html OR enable_headless) AS use_sitemap,
  enable_html OR NOT (enable_sitemap OR enable_html OR enable_headless) AS use_html FROM request""", ("request",))
def tier_enabled(t):
    flags = [F.col(c) for c in ("enable_sitemap", "enable_html", "enable_headless")]
    return t.request.select(
        "job_id", checks.sitemap_tier_enabled(*flags).alias("use_sitemap"), checks.html_tier_enabled(*flags).alias("use_html")
    )


@query("needed_tiers", """
SELECT host, count(*) AS n_urls, count(*) < 10 AS needs_html, count(*) < 5 AS needs_headless FROM p GROUP BY host""", ("p",))
def needed_tiers(t):
    n = F.col("n_urls")
    return t.pages.groupBy(urls.host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n_urls")).select(
        "host", "n_urls", checks.needs_html_tier(n).alias("needs_html"), checks.needs_headless_tier(n).alias("needs_headless")
    )


@query("duration_seconds", """
q AS (SELECT page_id, page_id % 60 AS m, page_id % 7 AS n FROM pages)
SELECT page_id, CASE n WHEN 0 THEN m * 60.0 + 2.5 WHEN 1 THEN m / 1000.0 WHEN 2 THEN 0.2 WHEN 3 THEN -1.0 * m WHEN 4 THEN m * 3600.0 + 60.0
  WHEN 5 THEN 0.0 ELSE 0.2 END::DOUBLE AS seconds FROM q""")
def duration_seconds(t):
    m, n = (F.col("page_id") % 60).cast("string"), F.col("page_id") % 7
    delay = (
        F.when(n == 0, F.concat(m, F.lit("m2.5s"))).when(n == 1, F.concat(m, F.lit("ms"))).when(n == 2, F.concat(m, F.lit("5")))
        .when(n == 3, F.concat(F.lit("-"), m, F.lit("s"))).when(n == 4, F.concat(m, F.lit("h1m"))).when(n == 5, "0")
        .otherwise(F.concat(m, F.lit("s x")))
    )
    seconds = checks.duration_seconds(delay)
    return t.pages.select("page_id", F.when(seconds == 0, 0.0).otherwise(seconds).alias("seconds"))


@query("rate", "SELECT o_orderkey, o_totalprice / 7.0 AS rate, printf('%.2f', o_totalprice / 7.0) AS shown FROM orders")
def rate(t):
    per_day = F.try_divide("o_totalprice", F.lit(7.0))
    return t.orders.select("o_orderkey", per_day.alias("rate"), text.rate_text(per_day).alias("shown"))


def start_sql(s: str, n: int, marker: str) -> str:
    """SQL for ``s``, or plus ``marker`` the most characters of it that take at most ``n`` bytes."""
    most = f"left({s}, len(list_filter(range(1, {n} + 1), lambda i: strlen(left({s}, i)) <= {n})))"
    return f"CASE WHEN strlen({s}) <= {n} THEN {s} WHEN strlen(left({s}, {n})) = {n} THEN left({s}, {n}) || '{marker}' ELSE {most} || '{marker}' END"


@query("truncate_text", f"""
texts AS (SELECT doc_id, text AS s FROM documents UNION ALL SELECT -1 - doc_id, 'a' || replace(left(text, 300), 'e', 'é€') FROM documents)
SELECT doc_id, {start_sql("s", 200, "...")} AS short, {start_sql("s", 500, "... [truncated]")} AS longer FROM texts""")
def truncate_text(t):
    wide = F.concat(F.lit("a"), F.replace(F.left("text", F.lit(300)), F.lit("e"), F.lit("é€")))
    texts = t.documents.select("doc_id", "text").unionAll(t.documents.select(-1 - F.col("doc_id"), wide))
    return texts.select(
        "doc_id", text.truncate(F.col("text"), 200).alias("short"), text.truncate(F.col("text"), 500, "... [truncated]").alias("longer")
    )


@query("first_header_values", """
SELECT page_id, attempt, content_type AS content_type, CAST(status_code AS STRING) AS first_status FROM attempt""", ("attempt",))
def first_header_values(t):
    headers = F.create_map(
        F.lit("Content-Type"), F.array("content_type", F.lit("second")),
        F.lit("X-Status"), F.array(F.col("status_code").cast("string"), F.lit("0")),
    )
    first = checks.first_header_values(headers)
    return t.attempt.select("page_id", "attempt", first["Content-Type"].alias("content_type"), first["X-Status"].alias("first_status"))


@query("client_ip", """
SELECT event_id, coalesce(nullif(xff, ''), nullif(x_real_ip, ''), remote_addr) AS client_ip FROM access_log""", ("access_log",))
def client_ip(t):
    return t.access_log.select("event_id", checks.client_ip(F.col("xff"), F.col("x_real_ip"), F.col("remote_addr")).alias("client_ip"))


@query("parse_added", r"""
SELECT event_id, TRY_CAST(nullif(regexp_extract(progress, 'added ([0-9]+) new URLs', 1), '') AS INTEGER) AS added FROM ev""", ("ev",))
def parse_added(t):
    return t.ev.select("event_id", text.parse_added(F.col("progress")).alias("added"))


@query("json_round_trip", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{"k":' || CAST(json_extract(props, '$.k') AS STRING) || '}' AS body FROM events""")
def json_round_trip(t):
    decoded = F.from_json("props", "struct<k: int>")
    return t.events.select("event_id", decoded["k"].alias("k"), F.to_json(decoded).alias("body"))


@query("timestamps", """
SELECT o_orderkey, (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(CAST(o_orderdate AS TIMESTAMP))) / 1000000.0 AS age_s,
  strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d') AS day FROM orders""")
def timestamps(t):
    created = checks.parse_rfc3339(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    now = F.to_timestamp(F.lit("2002-01-01 00:00:00"))
    return t.orders.select(
        "o_orderkey", checks.elapsed_seconds(created, now).alias("age_s"), F.date_format(created, "yyyy-MM-dd").alias("day")
    )
