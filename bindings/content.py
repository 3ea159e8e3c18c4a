"""Pages and fetch attempts to Markdown, text and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetrail.functions import html, text
from pagetrail.functions.checks import is_html
from pagetrail.operators import access_log, content, fallback, fetching
from pagetrail.session import materialize
from pagetrail.sources import inputs

from .registry import query
from .urls import LINKS, TRIM, _ERROR, _FALLBACKS, start_sql

W = r"[\t\n\f\r ]"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '{TRIM}', '', 'g')"


def _clean_markdown(x: str) -> str:
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    x = rf"regexp_replace({x}, '\n{W}*\n{W}*(#{{1,6}})', chr(10) || chr(10) || '\1', 'g')"
    x = rf"regexp_replace({x}, '(#{{1,6}}[^\n]*)\n{W}*\n{W}*', '\1' || chr(10) || chr(10), 'g')"
    x = rf"regexp_replace({x}, ' +', ' ', 'g')"
    return _trim(x)


def _unescape(x: str) -> str:
    for ref, char in [("&quot;", '"'), ("&#x27;", "''"), ("&lt;", "<"), ("&gt;", ">")]:
        x = f"replace({x}, '{ref}', '{char}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


# These pages hold one template: title, then an article of one h1 and paragraphs, in which
# only b and br occur. Everything else of the body is boilerplate.
def _markdown(source: str, body: str, keys: str) -> str:
    return rf"""
part AS (SELECT {keys}, {_trim(_unescape(f"regexp_extract({body}, '<title>(.*?)</title>', 1, 's')"))} AS title,
    {_trim(_unescape(f"regexp_extract({body}, '<h1>(.*?)</h1>', 1, 's')"))} AS h1,
    string_split_regex(regexp_extract({body}, '</h1>(.*?)</article>', 1, 's'), '<p>|</p>') AS pieces FROM {source}),
para AS (SELECT {keys}, title, h1, list_filter(list_transform(pieces, lambda x: {_trim(_unescape("regexp_replace(x, '<[^>]*>', '', 'g')"))}), lambda x: x <> '') AS ps FROM part),
joined AS (SELECT {keys}, title, '# ' || title || repeat(chr(10), 4) || '# ' || h1 || repeat(chr(10), 4)
    || array_to_string(ps, repeat(chr(10), 4)) AS md FROM para),
page_md AS (SELECT {keys}, title, {_clean_markdown("md")} AS markdown FROM joined)"""


@query("html_to_markdown", _markdown("pages", "html", "page_id") + """
SELECT page_id, title, markdown, CAST(strlen(markdown) AS INTEGER) AS size FROM page_md""")
def html_to_markdown(t):
    return content.with_page(t.pages.select("page_id", "html")).select("page_id", "title", "markdown", "size")


@query("page_metadata", f"""
SELECT page_id, {_trim(_unescape("regexp_extract(html, '<title>(.*?)</title>', 1, 's')"))} AS title, CAST(NULL AS STRING) AS meta_description FROM pages""")
def page_metadata(t):
    return content.with_page(t.pages.select("page_id", "html")).select("page_id", "title", "meta_description")


@query("described_pages", r"""
SELECT page_id, 'Page ' || CAST(page_id AS STRING) AS title, 'About ' || url AS meta_description,
  '# Page ' || CAST(page_id AS STRING) || chr(10) || chr(10) || '*About ' || url || '*' || chr(10) || chr(10) || '## Top' || chr(10) || chr(10)
  || '- one' || chr(10) || '- two' || chr(10) || chr(10) || '1. first' || chr(10) || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10)
  || '| c | d |' || chr(10) || chr(10) || '> quoted' || chr(10) || '> twice' || chr(10) || chr(10) || '```' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || chr(10)
  || '[' || url || '](/to?a=1&b=2)**bold***slanted*`code`![pic](/p.png)' AS markdown FROM pages""")
def described_pages(t):
    """Every Markdown rule, with boilerplate of each kind that must go."""
    url = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    page = F.concat(
        F.lit("<html><head><title>Page "), F.col("page_id").cast("string"), F.lit('</title><meta name="description" content=" About '), url,
        F.lit(' "></head><body class=x><nav>menu</nav><div class="a sidebar">side</div><p id=comment>c</p><div class="my-cookie-box">k</div><h2> Top </h2>'
              "<ul><li>one<li>two</ul><ol><li>first</ol><table><tr><td>a<th>b<tr><td>c<td>d</table><blockquote>quoted\n\n twice</blockquote>"
              '<pre>x  = 1</pre><div><span><a href="/to?a=1&amp;b=2">'), url,
        F.lit('</a></span><b> bold</b><em>slanted </em><code>code</code><img src="data:x" alt=no><img alt=pic src=/p.png><button>go</button>'
              "<span class=share>s</span></div><noscript><p>n</p></noscript><footer>f</footer></body></html>"),
    )
    pages = t.pages.select("page_id", page.alias("html"))
    return content.with_page(pages).select("page_id", "title", "meta_description", "markdown")


@query("parse_page", LINKS + ",\n" + _markdown("pages", "html", "page_id") + r"""
SELECT pages.page_id, coalesce(nl.n, 0) AS n_links, 2 * CAST(length(regexp_extract(html, '<h1>', 0)) > 0 AS BIGINT) - 1 AS n_headings, false AS failed
FROM pages LEFT JOIN (SELECT page_id, count(*) AS n FROM link GROUP BY 1) nl ON pages.page_id = nl.page_id""", ("p",))
def parse_page(t):
    parsed = t.pages.select("page_id", html.parse_page(F.col("html")).alias("_p"))
    return parsed.select(
        "page_id",
        F.size("_p.links").cast("bigint").alias("n_links"),
        F.size(F.filter("_p.blocks", lambda b: b["tag"] == "h1")).cast("bigint").alias("n_headings"),
        F.col("_p.error").isNotNull().alias("failed"),
    )


@query("clean_markdown", f"SELECT doc_id, {_clean_markdown('text')} AS markdown FROM documents")
def clean_markdown(t):
    return t.documents.select("doc_id", text.clean_markdown(F.col("text")).alias("markdown"))


def _outline(x: str) -> str:
    return f"replace(replace({x}, '. ', '.' || chr(10) || ' ' || chr(10) || chr(10)), ',', '  ' || chr(10) || chr(9) || chr(10) || '## ')"


@query("clean_markdown_outline", f"""
q AS (SELECT doc_id, {_outline('text')} AS md FROM documents)
SELECT doc_id, {_clean_markdown('md')} AS markdown FROM q""")
def clean_markdown_outline(t):
    md = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\n \n\n")), F.lit(","), F.lit("  \n\t\n## "))
    return t.documents.select("doc_id", text.clean_markdown(md).alias("markdown"))


def _clean_text(x: str) -> str:
    x = _trim(rf"regexp_replace({x}, '{W}+', ' ', 'g')")
    for p in text.BOILERPLATE_PHRASES:
        x = f"regexp_replace({x}, '(?i){p}', '', 'g')"
    return _trim(rf"regexp_replace({x}, '\[.*?\]\(#[^)]*\)', '', 'gs')")


_PHRASES = "['Cookie Policy', 'privacy  policy', 'Book a Demo', 'KNOW MORE', '[up](#top)', 'data:image/gif;base64,R0lG+/=', 'know know more more', 'Follow us on']"


@query("clean_text", f"""
q AS (SELECT doc_id, replace(text, '. ', '. ' || {_PHRASES}[1 + doc_id % 8] || chr(10)) AS text FROM documents)
SELECT doc_id, {_clean_text('text')} AS cleaned FROM q""")
def clean_text(t):
    phrases = F.expr("array" + _PHRASES.replace("[", "(", 1)[:-1] + ")")
    phrase = F.get(phrases, (F.col("doc_id") % 8).cast("int"))
    seeded = F.replace(F.col("text"), F.lit(". "), F.concat(F.lit(". "), phrase, F.lit("\n")))
    seeded_docs = t.documents.select("doc_id", seeded.alias("text"))
    return content.with_clean_text(seeded_docs).select("doc_id", F.col("clean_text").alias("cleaned"))


@query("clean_text_plain", f"SELECT doc_id, {_clean_text('text')} AS cleaned FROM documents")
def clean_text_plain(t):
    return content.with_clean_text(t.documents.select("doc_id", "text")).select("doc_id", F.col("clean_text").alias("cleaned"))


@query("markdown_size", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS size FROM documents")
def markdown_size(t):
    return t.documents.select("doc_id", text.markdown_size(F.col("text")).alias("size"))


# -- fetch attempts -----------------------------------------------------------------


@query("html_pages", "SELECT page_id, attempt FROM attempt WHERE contains(lower(content_type), 'text/html')", ("attempt",))
def html_pages(t):
    return inputs.html_pages(t.attempt).select("page_id", "attempt")


@query("first_accessible", _FALLBACKS + f""",
candidate AS (SELECT page_id, -1 AS pos, url FROM p UNION ALL SELECT page_id, pos, url FROM fallback),
first_probe AS (SELECT * FROM probe QUALIFY row_number() OVER (PARTITION BY url ORDER BY attempt) = 1),
seen AS (SELECT c.page_id, c.pos, c.url, coalesce(b.error, '') = '' AND b.status_code BETWEEN 200 AND 399 AS ok,
    CASE WHEN b.url IS NULL THEN 'no fetch recorded' ELSE {_ERROR.replace('error', 'b.error').replace('status_code', 'b.status_code')} END AS err
  FROM candidate c LEFT JOIN first_probe b ON c.url = b.url),
best AS (SELECT page_id, arg_min(url, pos) FILTER (ok) AS found, coalesce(bool_or(ok), false) AS success, max(err) FILTER (pos = -1 AND NOT coalesce(ok, false)) AS error FROM seen GROUP BY 1)
SELECT p.url AS original_url, coalesce(found, p.url) AS fallback_url, success, error FROM best JOIN p ON p.page_id = best.page_id""", ("probe",))
def first_accessible(t):
    fetches = t.probe.withColumn("tier", F.lit(1))
    return fallback.first_accessible(t.pages.select("url"), fetches)


@query("first_success", """
ok AS (SELECT * FROM attempt WHERE status_code BETWEEN 200 AND 299 AND coalesce(error, '') = ''),
won AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY url ORDER BY attempt) = 1)
SELECT p.url, won.attempt, won.status_code, won.content_type, won.body,
  CASE WHEN won.url IS NULL THEN 'All aggressive HTTP attempts failed (browser not available in this environment)' ELSE '' END AS error
FROM p LEFT JOIN won ON p.url = won.url""", ("attempt",))
def first_success(t):
    return content.first_success(t.attempt)


_RESPONSE = _markdown("attempt", "body", "page_id, attempt") + rf""",
response AS (SELECT a.page_id, a.url, a.tier, a.attempt,
    CASE WHEN coalesce(error, '') <> '' OR status_code IN (403, 429) THEN 0 ELSE status_code END AS status_code,
    CASE WHEN coalesce(error, '') <> '' THEN error WHEN status_code IN (403, 429) THEN 'HTTP ' || CAST(status_code AS STRING) || ': ' || CAST(status_code AS STRING)
      || CASE status_code WHEN 403 THEN ' Forbidden' ELSE ' Too Many Requests' END || ' (blocked by server, trying browser fallback)' ELSE '' END AS error,
    CASE WHEN coalesce(error, '') <> '' OR status_code IN (403, 429) THEN '' WHEN content_type = 'application/json' THEN body
      WHEN body = '  tiny ' THEN 'tiny' ELSE markdown END AS markdown,
    'tier' || CAST(a.tier AS STRING) || '-attempt' || CAST(a.attempt AS STRING) AS via
  FROM attempt a JOIN page_md m ON a.page_id = m.page_id AND a.attempt = m.attempt)"""


def _fetches(t):
    return t.attempt.withColumn("headers", F.create_map(F.lit("Content-Type"), F.col("content_type"), F.lit("Attempt"), F.col("attempt").cast("string")))


def _responses(t):
    return content.content_response(_fetches(t), "page_id")


@query("content_response", _RESPONSE + """
SELECT page_id, url, tier, attempt, status_code, error, markdown, via, CAST(strlen(markdown) AS INTEGER) AS size, CASE WHEN error = '' THEN a.content_type ELSE '' END AS content_type,
  CASE WHEN error = '' THEN a.content_type END AS header_type, CASE WHEN error = '' THEN CAST(attempt AS STRING) END AS header_attempt
FROM response JOIN (SELECT page_id, attempt, content_type FROM attempt) a USING (page_id, attempt)""", ("attempt",))
def content_response(t):
    headers = [F.col("headers")[h].alias(n) for h, n in (("Content-Type", "header_type"), ("Attempt", "header_attempt"))]
    return _responses(t).select(
        "page_id", "url", "tier", "attempt", "status_code", "error", "markdown", "via", F.col("sizes.markdown").alias("size"), "content_type", *headers
    )


_BEST = _RESPONSE + rf""",
t1 AS (SELECT * FROM response WHERE tier = 1 QUALIFY row_number() OVER (PARTITION BY url ORDER BY attempt DESC) = 1),
t2 AS (SELECT * FROM response WHERE tier = 2 QUALIFY row_number() OVER (PARTITION BY url ORDER BY attempt DESC) = 1),
both_tiers AS (SELECT t1.url, t1.page_id, t1.error AS e1, t2.error AS e2, t1.markdown AS m1, t2.markdown AS m2, t1.via AS v1, t2.via AS v2,
    t1.error = '' AND strlen({_trim("t1.markdown")}) > 100 AS good1 FROM t1 JOIN t2 ON t1.url = t2.url),
best AS (SELECT url, page_id, CASE WHEN good1 OR (e2 <> '' AND e1 <> '') THEN 1 ELSE 2 END AS tier,
    CASE WHEN good1 OR (e2 <> '' AND e1 <> '') THEN m1 ELSE m2 END AS markdown,
    CASE WHEN good1 OR (e2 <> '' AND e1 <> '') THEN v1 ELSE v2 END AS via,
    CASE WHEN good1 THEN '' WHEN e2 = '' THEN '' WHEN e1 <> '' THEN e1 || ' (Browser fallback also failed: ' || e2 || ')' ELSE e2 END AS error FROM both_tiers)"""


def _best(t):
    return content.best_responses(_fetches(t), "page_id")


@query("best_attempt", _BEST + " SELECT url, tier, markdown, via, error FROM best", ("attempt",))
def best_attempt(t):
    """From responses that are stored."""
    return content.best_attempt(materialize(_responses(t))[0]).select("url", "tier", "markdown", "via", "error")


@query("best_responses", _BEST + " SELECT url, page_id, tier, markdown, via, error FROM best", ("attempt",))
def best_responses(t):
    """From fetches, of which only what is needed is converted."""
    return _best(t).select("url", "page_id", "tier", "markdown", "via", "error")


_REQUESTS = """SELECT CAST(floor(page_id / 8.0) AS BIGINT) AS req_id, page_id,
  CASE page_id % 5 WHEN 0 THEN '{{"url":"' || url || '"}}' WHEN 1 THEN '{{"urls":["' || url || '","https://missing.example.org/"],"url":"x","concurrency":50}}'
    WHEN 2 THEN '{{"urls":[],"url":"' || url || '"}}' WHEN 3 THEN '{{"urls":[]}}' ELSE '{{"urls":["' || url || '","' || url || '"]}}' END AS value FROM {pages}"""
_TARGETS = f"""
body AS ({_REQUESTS.format(pages='pages').replace('{{', '{').replace('}}', '}')}),
target AS (SELECT page_id AS req_id, 0 AS idx, url FROM pages WHERE page_id % 5 <> 3
  UNION ALL SELECT page_id, 1, CASE page_id % 5 WHEN 1 THEN 'https://missing.example.org/' ELSE url END FROM pages WHERE page_id % 5 IN (1, 4))"""


def _targets(t):
    raw = t.spark.sql(_REQUESTS, pages=t.pages).select(F.col("page_id").alias("req_id"), "value")
    return inputs.content_targets(raw)


@query("content_targets", _TARGETS + " SELECT req_id, idx, url FROM target")
def content_targets(t):
    return _targets(t)


_BATCH = _BEST + "," + _TARGETS + """,
batch AS (SELECT g.req_id, g.idx, g.url, b.markdown, CASE WHEN b.url IS NULL THEN 'no response' ELSE b.error END AS error
  FROM target g LEFT JOIN best b ON g.url = b.url)"""


@query("content_batch", _BATCH + " SELECT req_id, idx, url, markdown, error FROM batch", ("attempt",))
def content_batch(t):
    return content.content_batch(_targets(t), _best(t)).select("req_id", "idx", "url", "markdown", "error")


@query("batch_counts", _BATCH + """
SELECT req_id, count(*) AS total, count(*) FILTER (error = '') AS success, count(*) FILTER (error <> '') AS failed FROM batch GROUP BY 1""", ("attempt",))
def batch_counts(t):
    return content.batch_counts(content.content_batch(_targets(t), _best(t)))


@query("content_batch_rows", _BATCH + """
SELECT req_id, 0 AS part, string_agg(url || '=' || error, '|' ORDER BY idx) AS results, count(*) AS total FROM batch GROUP BY 1""", ("attempt",))
def content_batch_rows(t):
    rows = content.content_batch_rows(content.content_batch(_targets(t), _best(t)))
    listed = F.array_join(F.transform("results", lambda r: F.concat(r["url"], F.lit("="), r["error"])), "|")
    return rows.select("req_id", "part", listed.alias("results"), "total")


@query("content_batch_parts", """
piece AS (SELECT CAST(floor(page_id / 50.0) AS BIGINT) AS req_id, CAST(page_id % 50 AS INT) AS idx, strlen(url) * (1 + page_id % 7 * 400) AS n FROM pages),
ended AS (SELECT *, sum(n) OVER w AS upto, sum((n > 32000)::INT) OVER w AS alone FROM piece WINDOW w AS (PARTITION BY req_id ORDER BY idx)),
keyed AS (SELECT *, (idx // 20, (upto - 1) // 32000, alone, n > 32000) AS cut FROM ended),
part AS (SELECT req_id, cut, min(idx) AS first, sum(n) AS bytes, count(*) AS n_results FROM keyed GROUP BY ALL)
SELECT req_id, CAST(row_number() OVER (PARTITION BY req_id ORDER BY first) - 1 AS INT) AS part, first, bytes::BIGINT AS bytes, n_results FROM part""")
def content_batch_parts(t):
    """Pages as long texts of a request of fifty, in parts of at most 20 results and 64,000 bytes."""
    text = F.expr("repeat(url, cast(1 + page_id % 7 * 400 as int))")
    batch = t.pages.select(
        F.floor(F.col("page_id") / 50).alias("req_id"), (F.col("page_id") % 50).cast("int").alias("idx"), text.alias("markdown"), F.lit("").alias("error")
    )
    rows = content.content_batch_rows(batch, 20, 64_000)
    return rows.select(
        "req_id", "part", F.col("results")[0]["idx"].alias("first"),
        F.aggregate("results", F.lit(0).cast("bigint"), lambda a, r: a + F.octet_length(r["markdown"])).alias("bytes"), F.size("results").cast("bigint").alias("n_results"),
    )


@query("order_by_index", _TARGETS + " SELECT req_id, idx, url FROM target ORDER BY req_id, idx")
def order_by_index(t):
    from pagetrail.operators.ordering import order_by_index

    return order_by_index(_targets(t))


@query("fetch_preview", LINKS + f""",
n AS (SELECT page_id, count(*) AS n FROM link GROUP BY 1)
SELECT a.page_id, a.attempt, CAST(strlen(body) AS INTEGER) AS n_bytes, status_code, content_type,
  {start_sql("body", 200, "...")} AS preview,
  CAST(CASE WHEN body = '  tiny ' THEN 0 ELSE coalesce(n.n, 0) END AS INTEGER) AS n_links
FROM attempt a LEFT JOIN n ON a.page_id = n.page_id""", ("attempt",))
def fetch_preview(t):
    key = F.concat(F.col("page_id").cast("string"), F.lit("/"), F.col("attempt").cast("string"))
    out = fetching.fetch_preview(t.attempt.withColumn("url", key))
    return out.select(
        F.split("url", "/")[0].cast("bigint").alias("page_id"), F.split("url", "/")[1].cast("int").alias("attempt"),
        "n_bytes", "status_code", "content_type", "preview", "n_links",
    )


# -- request log --------------------------------------------------------------------


@query("enrich_access_log", """
SELECT event_id, coalesce(nullif(xff, ''), nullif(x_real_ip, ''), remote_addr) AS client_ip,
  CASE WHEN method IN ('POST', 'PUT') THEN CASE WHEN strlen(req_body) > 500 THEN left(req_body, 500) || '... [truncated]' ELSE req_body END END AS req_body,
  CASE WHEN status >= 400 OR path IN ('/health', '/jobs') THEN CASE WHEN strlen(resp_body) > 500 THEN left(resp_body, 500) || '... [truncated]' ELSE resp_body END END AS resp_body
FROM access_log""", ("access_log",))
def enrich_access_log(t):
    return access_log.enrich_access_log(t.access_log).select("event_id", "client_ip", "req_body", "resp_body")


@query("slow_requests", "SELECT event_id, path, status, duration_s FROM access_log WHERE duration_s > 5", ("access_log",))
def slow_requests(t):
    return access_log.slow_requests(t.access_log).select("event_id", "path", "status", "duration_s")
