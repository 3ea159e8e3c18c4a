"""Sitemaps, robots files and the crawl itself, over derived sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetrail.functions.urls import canonical_url, site_root
from pagetrail.operators import fetching, links, ordering, robots, sitemaps
from pagetrail.plans import crawl
from pagetrail.session import materialize
from pagetrail.sources import inputs

from .registry import query
from .urls import FOUND

# -- sitemaps and robots ------------------------------------------------------------

_LISTED = r"""
doc_kind AS (SELECT d.url, reason, contains(d.body, '<sitemapindex') AS is_index, regexp_extract_all(coalesce(good, d.body), '<loc>([^<]*)</loc>', 1) AS locs
  FROM sitemap_doc d LEFT JOIN bad_doc b ON d.url = b.url),
listed AS (SELECT url, is_index, CAST(i - 1 AS INT) AS pos, replace(locs[i], '&amp;', '&') AS loc
  FROM doc_kind, unnest(range(1, len(locs) + 1)) n(i) WHERE locs[i] <> '')"""
_ROBOT_LINES = rf"""
robot_line AS (SELECT base_url, CAST(i - 1 AS INT) AS pos, regexp_replace(string_split(body, chr(10))[i], '^[\s]+|[\s]+$', '', 'g') AS line
  FROM robots_doc, unnest(range(1, len(string_split(body, chr(10))) + 1)) n(i)),
robot_map AS (SELECT base_url, pos, regexp_replace(substr(line, 9), '^\s+', '') AS url FROM robot_line
  WHERE lower(line) LIKE 'sitemap:%' AND trim(substr(line, 9)) <> '')"""
# Documents reachable from any document, with the first path of positions that leads there.
_WALK = """
walk AS (SELECT url AS root, CAST([] AS INTEGER[]) AS path, url, [url] AS above FROM sitemap_doc
  UNION ALL SELECT w.root, list_append(w.path, l.pos), l.loc, list_append(w.above, l.loc) FROM walk w JOIN listed l ON l.url = w.url AND l.is_index
    WHERE NOT list_contains(w.above, l.loc)),
opened AS (SELECT root, min(path) AS path, url FROM walk GROUP BY root, url),
tree AS (SELECT w.root, list_append(w.path, l.pos) AS path, l.loc FROM opened w JOIN listed l ON l.url = w.url AND NOT l.is_index)"""


def _path(column: str):
    return F.array_join(F.transform(column, lambda i: i.cast("string")), "/")


_PATH = "array_to_string(path, '/')"


def _docs(t):
    return t.sitemap_doc


def _robots(t):
    return t.robots_doc.select("base_url", "body")


def _fetches(t):
    return t.site_fetch.withColumns({"tier": F.lit(1), "attempt": F.lit(1)})


@query("robots_docs", "SELECT base_url, body FROM robots_doc", ("robots_doc",))
def robots_docs(t):
    fetched = _robots(t).select(F.concat("base_url", F.lit("/robots.txt")).alias("url"), F.lit(200).alias("status_code"), "body")
    others = t.site_page.select("url", F.lit(200).alias("status_code"), F.col("html").alias("body"))
    return inputs.robots_docs(fetched.unionByName(others))


@query("sitemap_docs", "SELECT d.url, d.body FROM sitemap_doc d JOIN site_fetch f ON d.url = f.url WHERE f.status_code = 200", ("sitemap_doc",))
def sitemap_docs(t):
    return inputs.sitemap_docs(_docs(t).join(t.site_fetch, "url")).select("url", "body")


@query("robots_sitemaps", _ROBOT_LINES + " SELECT base_url, pos, url FROM robot_map", ("robots_doc",))
def robots_sitemaps(t):
    return robots.robots_sitemaps(_robots(t))


@query("robots_sitemaps_absolute", _ROBOT_LINES + """
SELECT base_url, pos, CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN url ELSE base_url || url END AS url FROM robot_map""", ("robots_doc",))
def robots_sitemaps_absolute(t):
    return robots.robots_sitemaps(_robots(t), "absolute")


@query("robots_counts", _ROBOT_LINES + """
SELECT d.base_url, count(m.url) AS n_sitemaps FROM robots_doc d LEFT JOIN robot_map m ON d.base_url = m.base_url GROUP BY 1""", ("robots_doc",))
def robots_counts(t):
    return robots.robots_counts(_robots(t))


@query("parse_sitemap_docs", _LISTED + " SELECT url, is_index, pos, loc FROM listed", ("sitemap_doc",))
def parse_sitemap_docs(t):
    return sitemaps.parse_sitemap_docs(_docs(t))


@query("expand_sitemap_index", _LISTED + "," + _WALK + f" SELECT root, {_PATH} AS path, url FROM opened", ("sitemap_doc",))
def expand_sitemap_index(t):
    listing, _ = materialize(sitemaps.parse_sitemap_docs(_docs(t)))
    opened = sitemaps.expand_sitemap_index(_docs(t).select("url"), listing.filter("is_index"))
    return opened.select("root", _path("path").alias("path"), "url")


@query("parse_sitemaps", _LISTED + "," + _WALK + f" SELECT root, {_PATH} AS path, loc FROM tree", ("sitemap_doc",))
def parse_sitemaps(t):
    return sitemaps.parse_sitemaps(_docs(t).select("url"), _docs(t)).select("root", _path("path").alias("path"), "loc")


@query("sitemap_counts", _LISTED + """
SELECT d.url, count(l.loc) FILTER (NOT d.is_index) AS n_urls, count(l.loc) FILTER (d.is_index) AS n_sitemaps, any_value(reason) AS reason
FROM doc_kind d LEFT JOIN listed l ON d.url = l.url GROUP BY 1""", ("sitemap_doc",))
def sitemap_counts(t):
    return sitemaps.sitemap_counts(_docs(t))


@query("sitemap_errors", _LISTED + """
SELECT b.url, b.reason, line, place, count(l.loc) AS n_kept FROM bad_doc b LEFT JOIN listed l ON b.url = l.url GROUP BY ALL""", ("sitemap_doc",))
def sitemap_errors(t):
    return sitemaps.sitemap_errors(_docs(t))


# A gzip file whose text is stored as it is: header, one stored block, checksum and length.
_GZIPPED = """
SELECT url, unhex('1F8B080000000000000301') AS head, concat(unhex(concat(substr(n, 7, 2), substr(n, 5, 2), substr(m, 7, 2), substr(m, 5, 2))), raw) AS block,
  unhex(concat(substr(c, 7, 2), substr(c, 5, 2), substr(c, 3, 2), substr(c, 1, 2))) AS crc,
  unhex(concat(substr(n, 7, 2), substr(n, 5, 2), '0000')) AS size, kind
FROM (SELECT url, raw, lpad(hex(length(raw)), 8, '0') AS n, lpad(hex(65535 - length(raw)), 8, '0') AS m, lpad(hex(crc32(raw)), 8, '0') AS c, length(raw) % 5 AS kind
  FROM (SELECT url, encode(body, 'UTF-8') AS raw FROM {docs}))"""


def _packed(t):
    """Sitemaps as gzip files, some cut short, with a wrong checksum, with a strange header, or with bytes behind the end."""
    kind, whole = F.col("kind"), F.concat("head", "block", "crc", "size")
    sent = (
        F.when(kind == 1, F.substring(whole, 1, 100))
        .when(kind == 2, F.concat("head", "block", F.unhex(F.lit("00000000")), "size"))
        .when(kind == 3, F.concat(F.unhex(F.lit("1F8B09")), F.substring(whole, 4, 1_000_000)))
        .when(kind == 4, F.concat(whole, F.encode(F.lit("more"), "UTF-8")))
        .otherwise(whole)
    )
    files = t.spark.sql(_GZIPPED, docs=_docs(t))
    return files.select("url", F.lit(200).alias("status_code"), F.lit(None).cast("map<string,string>").alias("headers"), sent.alias("body"))


@query("gzip_sitemaps", """
SELECT url, CASE length(body) % 5 WHEN 1 THEN substr(body, 1, 85) WHEN 3 THEN '' ELSE body END AS body FROM sitemap_doc""", ("sitemap_doc",))
def gzip_sitemaps(t):
    return inputs.sitemap_docs_binary(_packed(t)).select("url", "body")


@query("gzip_rejects", """
file AS (SELECT url, length(body) AS n, length(body) % 5 AS kind FROM sitemap_doc WHERE length(body) % 5 <> 0)
SELECT url, CASE kind WHEN 1 THEN 'truncated' WHEN 2 THEN 'incorrect data check' WHEN 3 THEN 'unknown compression method' ELSE 'bytes after the end' END AS reason,
  CAST(CASE kind WHEN 1 THEN least(100, n + 23) WHEN 2 THEN n + 18 WHEN 3 THEN 3 ELSE n + 23 END AS BIGINT) AS place,
  CAST(CASE kind WHEN 1 THEN least(n, 85) WHEN 3 THEN 0 ELSE n END AS INT) AS n_chars FROM file WHERE kind <> 1 OR n + 23 > 100""", ("sitemap_doc",))
def gzip_rejects(t):
    return inputs.gzip_rejects(_packed(t))


_CANDIDATES = """
usual AS (SELECT job_id, CAST(i - 1 AS INT) AS ord, root || ['/sitemap.xml', '/sitemap_index.xml', '/sitemaps.xml', '/sitemap/sitemap.xml'][i] AS url
  FROM request, unnest([1, 2, 3, 4]) n(i)),
candidate AS (SELECT * FROM usual UNION ALL SELECT r.job_id, m.pos + 4, m.url FROM request r JOIN robot_map m ON r.root = m.base_url),
there AS (SELECT c.* FROM candidate c WHERE c.url IN (SELECT url FROM site_fetch WHERE status_code = 200))"""


@query("existing_sitemaps", """
usual AS (SELECT job_id, CAST(i - 1 AS INT) AS pos, root || ['/sitemap.xml', '/sitemap_index.xml', '/sitemaps.xml', '/sitemap/sitemap.xml'][i] AS url
  FROM request, unnest([1, 2, 3, 4]) n(i))
SELECT job_id, pos, url FROM usual WHERE url IN (SELECT url FROM site_fetch WHERE status_code = 200)""", ("request", "site_fetch"))
def existing_sitemaps(t):
    from pagetrail.functions.urls import sitemap_candidates

    candidates = t.request.select("job_id", F.posexplode(sitemap_candidates(F.col("url"))).alias("pos", "url"))
    return sitemaps.existing_sitemaps(candidates, t.site_fetch)


@query("discover_sitemaps", _ROBOT_LINES + "," + _CANDIDATES + " SELECT job_id, ord, url FROM there", ("request", "robots_doc"))
def discover_sitemaps(t):
    return sitemaps.discover_sitemaps(t.request, t.site_fetch, _robots(t))


_SITEMAP_CRAWL = """
placed AS (SELECT t.job_id, list_prepend(t.ord, tree.path) AS path, tree.loc AS url FROM there t JOIN tree ON tree.root = t.url),
first_seen AS (SELECT job_id, url, min(path) AS path FROM placed GROUP BY 1, 2),
sm AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY path) AS ord, url FROM first_seen)"""


@query("crawl_sitemaps", ",".join([_ROBOT_LINES, _LISTED, _WALK, _CANDIDATES, _SITEMAP_CRAWL]) + " SELECT job_id, ord, url FROM sm", ("request", "robots_doc"))
def crawl_sitemaps(t):
    return sitemaps.crawl_sitemaps(t.request, t.site_fetch, _robots(t), _docs(t))


_DOCUMENTS = """
own_doc AS (SELECT t.job_id, o.url, min(list_prepend(t.ord, o.path)) AS path FROM there t JOIN opened o ON o.root = t.url GROUP BY 1, 2),
kept AS (SELECT url, count(*) AS n FROM listed GROUP BY url),
job_doc AS (SELECT j.*, coalesce(k.is_index, false) AS is_index, coalesce(c.n, 0) AS n_kept, CASE WHEN k.url IS NULL THEN 'not fetched' ELSE b.reason END AS reason, b.line, b.place
  FROM own_doc j LEFT JOIN doc_kind k ON k.url = j.url LEFT JOIN bad_doc b ON b.url = j.url LEFT JOIN kept c ON c.url = j.url)"""


def _opened(t):
    found, _ = materialize(sitemaps.discover_sitemaps(t.request, t.site_fetch, _robots(t)))
    return found, sitemaps.open_sitemaps(found.select("url").distinct(), _docs(t))


@query("sitemap_documents", ",".join([_ROBOT_LINES, _LISTED, _WALK, _CANDIDATES, _DOCUMENTS]) + """
SELECT job_id, array_to_string(path, '/') AS path, url, is_index, n_kept, reason, line, place FROM job_doc""", ("request", "robots_doc"))
def sitemap_documents(t):
    return sitemaps.sitemap_documents(*_opened(t)).withColumn("path", _path("path"))


@query("sitemap_failures", ",".join([_ROBOT_LINES, _LISTED, _WALK, _CANDIDATES, _DOCUMENTS]) + """
SELECT job_id, array_to_string(path, '/') AS path, url, n_kept, reason, line, place FROM job_doc WHERE reason IS NOT NULL""", ("request", "robots_doc"))
def sitemap_failures(t):
    return sitemaps.sitemap_failures(*_opened(t)).withColumn("path", _path("path"))


@query("unique_sitemap_urls", ",".join([_ROBOT_LINES, _LISTED, _WALK, _CANDIDATES, _SITEMAP_CRAWL]) + """
SELECT job_id, count(DISTINCT url) AS n_urls FROM placed GROUP BY 1""", ("request", "robots_doc"))
def unique_sitemap_urls(t):
    return sitemaps.unique_per_job(sitemaps.crawl_sitemaps(t.request, t.site_fetch, _robots(t), _docs(t)))


@query("union_all_sitemaps", _LISTED + """
SELECT url, loc FROM listed WHERE NOT is_index UNION ALL SELECT url, loc FROM listed WHERE is_index""", ("sitemap_doc",))
def union_all_sitemaps(t):
    listed = sitemaps.parse_sitemap_docs(_docs(t))
    return ordering.union_all_sitemaps(listed.filter("NOT is_index"), listed.filter("is_index")).select("url", "loc")


# -- link graph ---------------------------------------------------------------------


def _bfs(jobs: str) -> str:
    """All walks from the seeds up to the depth; the smallest (length, path) per URL wins."""
    return f"""
hop AS (SELECT job_id, 0 AS depth, CAST([] AS INTEGER[]) AS path, url FROM {jobs}
  UNION ALL SELECT h.job_id, h.depth + 1, list_append(h.path, e.pos), e.dst FROM hop h
    JOIN {jobs} r ON r.job_id = h.job_id JOIN site_edge e ON e.src = h.url WHERE h.depth < r.depth),
reached AS (SELECT job_id, url, min(depth) AS depth, arg_min(path, (depth, path)) AS path FROM hop WHERE depth > 0 GROUP BY 1, 2),
numbered AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY depth, path) AS ord, CAST(depth AS INT) AS depth, url FROM reached),
html AS (SELECT n.* FROM numbered n JOIN {jobs} r ON n.job_id = r.job_id WHERE n.ord <= coalesce(r.max_urls, 1000000000))"""


def _site_links(t):
    return materialize(links.site_links(t.site_page.select("page_id", "url", "html")))[0]


@query("site_edges", "SELECT src, pos, dst FROM site_edge", ("site_edge",))
def site_edges(t):
    return links.site_links(t.site_page)


@query("crawl_html", _bfs("request") + " SELECT job_id, ord, depth, url FROM html", ("request",))
def crawl_html(t):
    return crawl.crawl_html(t.request, _site_links(t))


def _pages(jobs: str) -> str:
    """Pages that the walk of ``jobs`` reads, by the rows of :func:`_bfs`."""
    return f"""
walked AS (SELECT h.*, r.path FROM html h JOIN reached r ON r.job_id = h.job_id AND r.url = h.url),
ended AS (SELECT a.job_id, coalesce(p.ord, 0) AS last FROM walked a JOIN {jobs} t ON t.job_id = a.job_id AND a.ord = t.max_urls
  LEFT JOIN walked p ON p.job_id = a.job_id AND p.path = a.path[1:len(a.path) - 1]),
visit AS (SELECT job_id, 1 AS page_count, 1 AS depth, url FROM {jobs}
  UNION ALL SELECT h.job_id, 1 + row_number() OVER (PARTITION BY h.job_id ORDER BY h.ord), h.depth + 1, h.url FROM walked h JOIN {jobs} t ON t.job_id = h.job_id
  LEFT JOIN ended e ON e.job_id = h.job_id WHERE h.depth < t.depth AND h.url <> t.url AND (e.last IS NULL OR h.ord <= e.last))"""


@query("crawl_visits", _bfs("request") + "," + _pages("request") + " SELECT job_id, page_count, depth, url FROM visit", ("request",))
def crawl_visits(t):
    return crawl.walk(t.request, _site_links(t)).visits


@query("pages_per_job", _bfs("request") + "," + _pages("request") + " SELECT job_id, count(*) AS n_pages FROM visit GROUP BY 1", ("request",))
def pages_per_job(t):
    return crawl.pages_per_job(crawl.walk(t.request, _site_links(t)).visits)


@query("crawl_stored_pages", FOUND + """,
chosen AS (SELECT split_part(url, '#', 1) AS src, min(page_id) AS page_id FROM pages GROUP BY 1),
reached AS (SELECT g.page_id, f.dst AS url, min(f.pos) AS pos FROM pages g JOIN chosen c ON c.src = split_part(g.url, '#', 1)
  JOIN found f ON f.page_id = c.page_id GROUP BY 1, 2)
SELECT 'page-' || CAST(page_id AS STRING) AS job_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS ord, CAST(1 AS INT) AS depth, url FROM reached""", ("p",))
def crawl_stored_pages(t):
    """Each stored page is the seed of a job; its links reach no other stored page. Of several
    snapshots of one address the first is read."""
    jobs = t.pages.select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("job_id"), "url", F.lit(2).alias("depth"), F.lit(1000).alias("max_urls")
    )
    return crawl.crawl_html(jobs, materialize(links.site_links(t.pages))[0])


@query("expand_frontier", """
SELECT r.job_id, e.pos, e.dst FROM request r JOIN site_edge e ON e.src = r.url""", ("request",))
def expand_frontier(t):
    return links.expand_frontier(t.request.select("job_id", "url"), links.site_links(t.site_page)).select("job_id", "pos", "dst")


@query("new_only", """
SELECT DISTINCT r.job_id, e.dst AS url FROM request r JOIN site_edge e ON e.src = r.url WHERE e.dst <> r.url""", ("request",))
def new_only(t):
    found = links.expand_frontier(t.request.select("job_id", "url"), links.site_links(t.site_page))
    return links.new_only(found.select("job_id", F.col("dst").alias("url")).distinct(), t.request)


@query("running_total", _bfs("request") + " SELECT job_id, url, ord AS total FROM html", ("request",))
def running_total(t):
    found = crawl.crawl_html(t.request, _site_links(t)).withColumn("place", F.col("ord") * 3)
    return ordering.running_total(found, ["place"]).select("job_id", "url", "total")


@query("page_counter", """
SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY timestamp, event_id) AS page_count FROM ev""", ("ev",))
def page_counter(t):
    return ordering.page_counter(t.ev.select("job_id", "timestamp", "event_id"), ["timestamp", "event_id"]).select("job_id", "event_id", "page_count")


@query("truncate_urls", """
u AS (SELECT r.job_id, e.src || '>' || CAST(e.pos AS STRING) AS url, row_number() OVER (PARTITION BY r.job_id ORDER BY e.src, e.pos) AS ord, r.max_urls
  FROM request r JOIN site_page p ON p.s = r.s JOIN site_edge e ON e.src = p.url)
SELECT job_id, ord, url FROM u WHERE ord <= coalesce(max_urls, 1000000000)""", ("request",))
def truncate_urls(t):
    pages = t.site_page.select("s", F.col("url").alias("src"))
    rows = t.request.select("job_id", "s").join(pages, "s").join(t.site_edge, "src")
    rows = rows.withColumn("url", F.concat("src", F.lit(">"), F.col("pos").cast("string")))
    numbered = ordering.ordinal(rows.select("job_id", "url", "src", "pos"), ["job_id"], ["src", "pos"])
    return ordering.truncate_urls(numbered, t.request).select("job_id", "ord", "url")


@query("merge_tiers", _bfs("request") + ",".join(["", _ROBOT_LINES, _LISTED, _WALK, _CANDIDATES, _SITEMAP_CRAWL]) + """,
ranked AS (SELECT job_id, url, 1 AS rank, ord FROM sm UNION ALL SELECT job_id, url, 2, ord FROM html)
SELECT job_id, url, CASE min(rank) WHEN 1 THEN 'sitemap' ELSE 'html' END AS tier, arg_min(ord, rank) AS tier_ord FROM ranked GROUP BY 1, 2""", ("request", "robots_doc"))
def merge_tiers(t):
    sm = sitemaps.crawl_sitemaps(t.request, t.site_fetch, _robots(t), _docs(t))
    return ordering.merge_tiers(sm, crawl.crawl_html(t.request, _site_links(t)))


@query("merge_counts", _bfs("request") + ",".join(["", _ROBOT_LINES, _LISTED, _WALK, _CANDIDATES, _SITEMAP_CRAWL]) + """,
ranked AS (SELECT job_id, url, 1 AS rank FROM sm UNION ALL SELECT job_id, url, 2 FROM html),
first AS (SELECT job_id, url, min(rank) AS rank FROM ranked GROUP BY 1, 2)
SELECT job_id, count(*) FILTER (rank = 1) AS n_before, count(*) FILTER (rank = 2) AS n_new, count(*) AS total FROM first GROUP BY 1""", ("request", "robots_doc"))
def merge_counts(t):
    return ordering.merge_counts(merge_tiers(t))


# -- all tiers ----------------------------------------------------------------------

_TIERS = ",".join([_ROBOT_LINES, _LISTED, _WALK, """
probed AS (SELECT r.*, f.error AS ferr, f.status_code AS st, coalesce(f.error, '') = '' AND f.status_code BETWEEN 200 AND 399 AS ok0,
    w.url IS NOT NULL AS ok1 FROM request r LEFT JOIN site_fetch f ON f.url = r.url LEFT JOIN site_fetch w ON w.url = 'https://www.' || substr(r.url, 9)),
saved_list AS (SELECT q.job_id, m.pos, CASE WHEN m.url LIKE 'http://%' OR m.url LIKE 'https://%' THEN m.url ELSE m.base_url || m.url END AS url
  FROM probed q JOIN robot_map m ON m.base_url = q.root WHERE NOT q.ok0 AND NOT q.ok1),
flagged AS (SELECT q.*, ok0 OR ok1 AS success, q.job_id IN (SELECT job_id FROM saved_list) AS saved,
    CASE WHEN ok0 OR NOT ok1 THEN url ELSE 'https://www.' || substr(url, 9) END AS target,
    CASE WHEN ok0 THEN NULL WHEN ferr IS NOT NULL THEN ferr WHEN st = 403 THEN 'HTTP 403: Forbidden (may need different approach)'
      WHEN st = 503 THEN 'HTTP 503: 503 Service Unavailable' END AS err,
    enable_sitemap OR NOT (enable_sitemap OR enable_html OR enable_headless) AS want1,
    enable_html OR NOT (enable_sitemap OR enable_html OR enable_headless) AS want2 FROM probed q),
alive AS (SELECT * FROM flagged WHERE success OR saved),
troot AS (SELECT *, regexp_extract(target, '^(https://[^/]*)', 1) AS tr FROM alive),
maps AS (SELECT a.job_id, CAST(i - 1 AS INT) AS ord, tr || ['/sitemap.xml', '/sitemap_index.xml', '/sitemaps.xml', '/sitemap/sitemap.xml'][i] AS url
    FROM troot a, unnest([1, 2, 3, 4]) n(i) WHERE want1 AND success
  UNION ALL SELECT a.job_id, m.pos + 4, m.url FROM troot a JOIN robot_map m ON m.base_url = a.tr WHERE want1 AND success),
there AS (SELECT * FROM maps WHERE url IN (SELECT url FROM site_fetch WHERE status_code = 200)
  UNION ALL SELECT l.job_id, l.pos, l.url FROM saved_list l JOIN alive a ON a.job_id = l.job_id WHERE a.want1)""",
_SITEMAP_CRAWL, """
counted AS (SELECT a.*, coalesce(c.n, 0) AS n_sm FROM alive a LEFT JOIN (SELECT job_id, count(*) AS n FROM sm GROUP BY 1) c ON a.job_id = c.job_id),
tier2 AS (SELECT job_id, target AS url, depth, max_urls, n_sm FROM counted WHERE want2 AND success AND n_sm < 10)""",
_bfs("tier2").replace("e.src = h.url", "e.src = h.url AND regexp_extract(e.dst, '^https://([^/]*)', 1) IN (regexp_extract(r.url, '^https://([^/]*)', 1), substr(regexp_extract(r.url, '^https://([^/]*)', 1), 5))"), """
added AS (SELECT h.job_id, t2.n_sm + row_number() OVER (PARTITION BY h.job_id ORDER BY h.ord) AS ord, h.url, 'html' AS tier
  FROM html h JOIN tier2 t2 ON t2.job_id = h.job_id WHERE NOT EXISTS (SELECT 1 FROM sm WHERE sm.job_id = h.job_id AND sm.url = h.url)),
merged AS (SELECT job_id, ord, url, 'sitemap' AS tier FROM sm UNION ALL SELECT * FROM added),
final AS (SELECT m.* FROM merged m JOIN request r ON r.job_id = m.job_id WHERE coalesce(r.max_urls, 0) <= 0 OR m.ord <= r.max_urls)"""])


def _crawl(t):
    return crawl.crawl_tiers(t.request.drop("page_id", "s", "root"), _fetches(t), _robots(t), _docs(t), _site_links(t))


@query("crawl_tiers", _TIERS + " SELECT job_id, ord, url, tier FROM final", ("request", "robots_doc"))
def crawl_tiers(t):
    return _crawl(t).urls.select("job_id", "ord", "url", "tier")


@query("crawl_jobs", _TIERS + """
SELECT job_id, target AS target_url, success, saved, err AS error, CASE WHEN success OR saved THEN 'completed' ELSE 'failed' END AS status FROM flagged""", ("request", "robots_doc"))
def crawl_jobs(t):
    return _crawl(t).jobs.select("job_id", "target_url", "success", "saved", "error", "status")


@query("tier_stats", _TIERS + """
SELECT a.job_id, count(m.url) FILTER (tier = 'sitemap') AS sitemap_urls, count(m.url) FILTER (tier = 'html') AS html_urls, CAST(0 AS BIGINT) AS headless_urls,
  CAST((count(m.url) FILTER (tier = 'sitemap') > 0) AS INT) + CAST((count(m.url) FILTER (tier = 'html') > 0) AS INT) AS total_tiers_used
FROM alive a LEFT JOIN merged m ON m.job_id = a.job_id GROUP BY 1""", ("request", "robots_doc"))
def tier_stats(t):
    return _crawl(t).stats


@query("crawl_result", _TIERS + """
SELECT a.job_id AS id, 0 AS part, a.target AS target_url, count(f.url) AS total_urls, count(f.url) / (10.0 + a.page_id % 7) AS urls_per_second,
  coalesce(string_agg(f.url, ' ' ORDER BY f.ord), '') AS urls, a.workers, a.delay, a.depth
FROM alive a LEFT JOIN final f ON f.job_id = a.job_id GROUP BY a.job_id, a.target, a.page_id, a.workers, a.delay, a.depth""", ("request", "robots_doc"))
def crawl_result(t):
    done = _crawl(t)
    n = F.regexp_extract("job_id", "([0-9]+)", 1).cast("bigint") % 7
    start = F.to_timestamp(F.lit("2024-05-01 10:00:00"))
    jobs = done.jobs.filter("status = 'completed'").withColumns(
        {"started_at": start, "finished_at": F.timestamp_micros(F.unix_micros(start) + (n + 10) * 1_000_000)}
    )
    return crawl.crawl_result(jobs, done.urls).select(
        "id", "part", "target_url", "total_urls", "urls_per_second", F.array_join("urls", " ").alias("urls"), "settings.workers", "settings.delay", "settings.depth"
    )


@query("crawl_event_log", _TIERS + "," + _pages("tier2") + "," + _DOCUMENTS + """,
per_job AS (SELECT c.*, (SELECT count(*) FROM added x WHERE x.job_id = c.job_id) AS n_html FROM counted c),
ending AS (SELECT *, n_sm + n_html AS n_all, CASE WHEN max_urls > 0 AND n_sm + n_html > max_urls THEN max_urls ELSE n_sm + n_html END AS n_left,
  (n_sm > 0)::INT + (n_html > 0)::INT AS tiers FROM per_job),
doc_n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY path) AS n FROM job_doc),
level AS (SELECT job_id, depth, sum(p) AS p, sum(u) AS u FROM (SELECT job_id, depth, 1 AS p, 0 AS u FROM visit UNION ALL SELECT job_id, depth, 0, 1 FROM html) GROUP BY 1, 2),
before AS (SELECT job_id, depth, sum(p) OVER w AS pages, sum(u) OVER w - u AS urls FROM level WINDOW w AS (PARTITION BY job_id ORDER BY depth)),
log AS (SELECT job_id, 0 AS micro, 'progress' AS type, NULL::TEXT AS url, NULL::INT AS depth, 'Crawl begins' AS progress, NULL::INT AS total, NULL::INT AS page_count,
    NULL::TEXT AS error, NULL::TEXT AS tier FROM flagged
  UNION ALL BY NAME SELECT job_id, 1000000 AS micro, 'error' AS type, 'No address of the site answers: ' || coalesce(err, '') AS progress, err AS error FROM flagged WHERE NOT success AND NOT saved
  UNION ALL BY NAME SELECT job_id, 1000000 AS micro, 'progress' AS type, 'No address answers, going on with the sitemaps of robots.txt' AS progress, 'sitemap' AS tier FROM alive WHERE saved
  UNION ALL BY NAME SELECT job_id, 1000000 AS micro, 'progress' AS type, 'Reading ' || target || ' in place of ' || url AS progress FROM alive WHERE target <> url
  UNION ALL BY NAME SELECT job_id, 2000000 AS micro, 'tier_switch' AS type, 'Starting Tier 1: sitemaps' AS progress, 'sitemap' AS tier FROM alive WHERE want1
  UNION ALL BY NAME SELECT job_id, 3000000 + ord AS micro, 'sitemap_discovered' AS type, url, 'Sitemap at ' || url AS progress, 'sitemap' AS tier FROM there
  UNION ALL BY NAME SELECT job_id, 3000000 AS micro, 'progress' AS type, 'The site has no sitemaps' AS progress, 'sitemap' AS tier FROM alive WHERE want1 AND job_id NOT IN (SELECT job_id FROM there)
  UNION ALL BY NAME SELECT job_id, 3999999 + 2 * n AS micro, 'progress' AS type, 'Reading sitemap ' || url AS progress, 'sitemap' AS tier FROM doc_n
  UNION ALL BY NAME SELECT job_id, 4000000 + 2 * n AS micro, 'progress' AS type, 'Sitemap ' || url || ' lists ' || n_kept::TEXT || CASE WHEN is_index THEN ' sitemaps' ELSE ' URLs' END AS progress,
    CASE WHEN NOT is_index THEN nullif(n_kept, 0) END::INT AS total, 'sitemap' AS tier FROM doc_n WHERE reason IS NULL
  UNION ALL BY NAME SELECT job_id, 4000000 + 2 * n AS micro, 'error' AS type, 'Sitemap ' || url || ' cannot be read: ' || reason AS progress, reason AS error, 'sitemap' AS tier FROM doc_n WHERE reason IS NOT NULL AND len(path) = 1
  UNION ALL BY NAME SELECT job_id, 5000000 AS micro, 'progress' AS type, 'Sitemaps read, ' || n_sm::TEXT || ' different URLs' AS progress, nullif(n_sm, 0)::INT AS total, 'sitemap' AS tier
    FROM counted WHERE want1 AND job_id IN (SELECT job_id FROM there)
  UNION ALL BY NAME SELECT job_id, 6000000 AS micro, 'tier_switch' AS type, 'Starting Tier 2: links of pages' AS progress, 'html' AS tier FROM counted WHERE want2 AND n_sm < 10
  UNION ALL BY NAME SELECT job_id, 7000000 AS micro, 'error' AS type, 'Links cannot be read: ' || err AS progress, err AS error, 'html' AS tier FROM counted WHERE want2 AND n_sm < 10 AND NOT success
  UNION ALL BY NAME SELECT v.job_id, 7000000 + v.page_count + b.urls AS micro, 'progress' AS type, 'Reading page ' || v.page_count::TEXT || ' at depth ' || v.depth::TEXT || ': ' || v.url AS progress, v.page_count::INT AS page_count
    FROM visit v JOIN before b ON b.job_id = v.job_id AND b.depth = v.depth
  UNION ALL BY NAME SELECT h.job_id, 7000000 + h.ord + b.pages AS micro, 'url_discovered' AS type, h.url, h.depth::INT AS depth, h.ord::INT AS total
    FROM html h JOIN request r ON r.job_id = h.job_id JOIN before b ON b.job_id = h.job_id AND b.depth = h.depth WHERE h.ord < coalesce(r.max_urls, 1000000000)
  UNION ALL BY NAME SELECT job_id, 8000000 AS micro, 'progress' AS type, 'Links of pages added ' || n_html::TEXT || ' new URLs, ' || n_all::TEXT || ' in all' AS progress, nullif(n_all, 0)::INT AS total, 'html' AS tier
    FROM ending WHERE want2 AND n_sm < 10 AND success
  UNION ALL BY NAME SELECT job_id, 9000000 AS micro, 'progress' AS type, 'Kept the first ' || max_urls::TEXT || ' URLs, as asked for' AS progress FROM ending WHERE n_left < n_all
  UNION ALL BY NAME SELECT job_id, 10000000 AS micro, 'completed' AS type, n_left::TEXT || ' URLs by ' || tiers::TEXT || ' tiers' AS progress, nullif(n_left, 0)::INT AS total FROM ending
  UNION ALL BY NAME SELECT job_id, 10000001 AS micro, 'completed' AS type, 'Crawl ends with ' || n_left::TEXT || ' URLs' AS progress, nullif(n_left, 0)::INT AS total FROM ending)
SELECT type, job_id, url, depth, progress, TIMESTAMP '2024-05-01 10:00:00' + to_microseconds(micro::BIGINT) AS timestamp, total, page_count, error, tier FROM log""", ("request", "robots_doc"))
def crawl_event_log(t):
    done = _crawl(t)
    started = t.request.select("job_id", F.to_timestamp(F.lit("2024-05-01 10:00:00")).alias("started_at"))
    return crawl.crawl_event_log(done, started).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("fetch_plan", _bfs("request") + """
SELECT h.job_id, h.url, (h.ord - 1) % r.workers AS slot,
  floor((h.ord - 1) / r.workers) * CASE r.delay WHEN '1.5s' THEN 1.5 ELSE 0.2 END::DOUBLE AS earliest_s
FROM html h JOIN request r ON r.job_id = h.job_id""", ("request",))
def fetch_plan(t):
    return fetching.fetch_plan(crawl.crawl_html(t.request, _site_links(t)), t.request)
