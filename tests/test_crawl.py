"""The crawl against plain Python on random graphs, and its composition rules."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from pagetrail.operators import ordering, robots, sitemaps
from pagetrail.plans import crawl

SITE = "https://x.com"
REQUEST = (
    "job_id string, url string, depth int, workers int, delay string, max_urls int, "
    "enable_sitemap boolean, enable_html boolean, enable_headless boolean"
)
LINK = "src string, pos int, dst string"


def bfs(edges, seed, depth, cap, pages=None):
    """Listed URLs in order, as (url, depth); pages read go to ``pages`` alike."""
    listed, seen, queue, read = [], set(), deque([(seed, 1)]), {seed}
    while queue and len(listed) < cap:
        page, d = queue.popleft()
        if pages is not None:
            pages.append((page, d))
        for dst in edges.get(page, []):
            if dst in seen or len(listed) >= cap:
                continue
            seen.add(dst)
            listed.append((dst, d))
            if d < depth and dst not in read:
                read.add(dst)
                queue.append((dst, d + 1))
    return listed


@pytest.mark.parametrize("seed, partitions", [(1, 1), (1, 8), (2, 8)])
def test_crawl_html_is_breadth_first(spark, seed, partitions):
    rnd = random.Random(seed)
    n = 40
    edges = {
        f"{SITE}/{i}": [f"{SITE}/{rnd.randrange(n)}" for _ in range(rnd.randrange(5))] + ([f"https://y.com/{i}"] if i % 3 == 0 else [])
        for i in range(n) if i % 7
    }
    links = spark.createDataFrame([(s, p, d) for s, ds in edges.items() for p, d in enumerate(ds)], LINK).repartition(partitions)
    jobs = [(f"j{i}", f"{SITE}/{rnd.randrange(n)}", rnd.randrange(0, 7), rnd.choice([1, 2, 3, 5, 8, 13, 1000])) for i in range(60)]
    requests = spark.createDataFrame(jobs, "job_id string, url string, depth int, max_urls int").repartition(partitions)
    inside = {s: [d for d in ds if d.startswith(SITE + "/")] for s, ds in edges.items()}
    walk = crawl.walk(requests, links)
    rows = walk.urls.orderBy("job_id", "ord").collect()
    read = {}
    for r in walk.visits.orderBy("job_id", "page_count").collect():
        read.setdefault(r["job_id"], []).append((r["url"], r["depth"]))
        assert r["page_count"] == len(read[r["job_id"]])
    got = {}
    for r in rows:
        got.setdefault(r["job_id"], []).append((r["url"], r["depth"]))
        assert r["ord"] == len(got[r["job_id"]])
    for job_id, url, depth, cap in jobs:
        pages = []
        assert got.get(job_id, []) == bfs(inside, url, max(depth, 1), cap, pages), job_id
        assert read[job_id] == pages, job_id


@pytest.mark.parametrize("hot", [2, 1000])
def test_crawl_html_with_heavy_and_hot_pages(spark, monkeypatch, hot):
    """A hub with far more links than any job may list, repeated, and read by most jobs."""
    monkeypatch.setattr(crawl, "HOT_PAGE", hot)
    rnd = random.Random(7)
    hosts = ["https://x.com", "https://www.x.com", "https://y.com"]
    edges = {SITE + "/": [f"{rnd.choice(hosts)}/{rnd.randrange(150)}" for _ in range(400)], "https://www.x.com/3": [f"{SITE}/{rnd.randrange(300)}" for _ in range(200)]}
    edges |= {f"{SITE}/{i}": [f"{SITE}/{rnd.randrange(150)}", f"https://www.x.com/{i + 1}", SITE + "/"] for i in range(150)}
    links = spark.createDataFrame([(s, p, d) for s, ds in edges.items() for p, d in enumerate(ds)], LINK)
    jobs = [(f"j{i}", SITE + "/" if i % 3 else f"{SITE}/{i}", rnd.randrange(1, 5), rnd.choice([1, 4, 9, 12])) for i in range(30)] + [("large", SITE + "/", 3, 10**8)]
    requests = spark.createDataFrame(jobs, "job_id string, url string, depth int, max_urls int")
    inside = {s: [d for d in ds if "x.com" in d] for s, ds in edges.items()}
    got = {}
    for r in crawl.crawl_html(requests, links).orderBy("job_id", "ord").collect():
        got.setdefault(r["job_id"], []).append((r["url"], r["depth"]))
    for job_id, url, depth, cap in jobs:
        assert got.get(job_id, []) == bfs(inside, url, depth, cap), job_id


def test_crawl_html_edges(spark):
    links = spark.createDataFrame([(SITE + "/", 0, SITE + "/"), (SITE + "/", 1, "https://www.x.com/w"), ("https://www.x.com/w", 0, SITE + "/z")], LINK)
    jobs = [("self", SITE + "/#frag", 3, 10), ("missing", SITE + "/none", 3, 10), ("none", SITE + "/", 3, 0), ("minus", SITE + "/", 3, -1)]
    requests = spark.createDataFrame(jobs, "job_id string, url string, depth int, max_urls int")
    rows = [(r["job_id"], r["depth"], r["url"]) for r in crawl.crawl_html(requests, links).orderBy("job_id", "ord").collect()]
    assert rows == [("self", 1, SITE + "/"), ("self", 1, "https://www.x.com/w"), ("self", 2, SITE + "/z")]
    assert crawl.crawl_html(requests.limit(0), links).collect() == []


def test_ordinal_spreads_a_hot_group(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("g"), F.hash("id").alias("h"), "id")
    from pyspark.sql import Window

    expected = rows.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")))
    got = ordering.ordinal(rows, ["g"], ["h", "id"])
    assert got.count() == 60_000
    assert got.join(expected, ["g", "h", "id"]).filter("ord <> want").count() == 0
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, o int")
    assert sorted((r["g"] or "", r["o"], r["ord"]) for r in ordering.ordinal(nulls, ["g"], ["o"]).collect()) == [("", 1, 1), ("", 2, 2), ("a", 1, 1)]


def docs(spark):
    def index(*locs):
        return "<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"

    def urlset(*locs):
        return "<?xml version='1.0'?><urlset>" + "".join(f"<url><loc>{x}</loc><lastmod>2024-01</lastmod></url>" for x in locs) + "</urlset>"

    rows = [
        ("root", index("a", "nested", "missing", "b")), ("nested", index("root", "b", "c")), ("a", urlset("u1", "", "u2&amp;x")), ("b", urlset("u3", "u1")),
        ("c", urlset("u4")), ("self", index("self", "c")), ("html", "<html><body>no"), ("broken", "<urlset><url><loc>x"), ("none", None), ("text", "plain"),
        ("both", "<x>" + urlset("u9")[21:] + "</x>"),
    ]
    return spark.createDataFrame(rows, "url string, body string")


def test_parse_sitemaps(spark):
    d = docs(spark)
    got = {}
    for r in sitemaps.parse_sitemaps(d.select("url"), d).orderBy("root", "path").collect():
        got.setdefault(r["root"], []).append(r["loc"])
    assert got["root"] == ["u1", "u2&x", "u3", "u1", "u4"]  # "b" is linked twice and opened once
    assert got["a"] == ["u1", "u2&x"] and got["self"] == ["u4"] and got["nested"][-3:] == ["u3", "u1", "u4"]
    assert not {"html", "none", "text"} & set(got)


def test_sitemap_counts(spark):
    counts = {r["url"]: (r["n_urls"], r["n_sitemaps"]) for r in sitemaps.sitemap_counts(docs(spark)).collect()}
    assert counts["root"] == (0, 4) and counts["a"] == (2, 0) and counts["html"] == (0, 0) and counts["none"] == (0, 0)


def test_robots(spark):
    body = "User-agent: *\nDisallow: /p\nAllow: /p/q\n\nUser-agent: Bot\nUser-agent: b2\nDisallow: / # all\nDisallow:\nSITEMAP:  /s.xml \r\nSitemap: https://x.com/t.xml # c\nsitemap:\n sitemap:r.xml"
    files = spark.createDataFrame([(SITE, body), ("https://y.com", "")], "base_url string, body string")
    assert [r["url"] for r in robots.robots_sitemaps(files).orderBy("pos").collect()] == ["/s.xml", "https://x.com/t.xml # c", "r.xml"]
    assert [r["url"] for r in robots.robots_sitemaps(files, "absolute").orderBy("pos").collect()] == [SITE + "/s.xml", "https://x.com/t.xml # c", SITE + "r.xml"]
    assert {r["base_url"]: r["n_sitemaps"] for r in robots.robots_counts(files).collect()} == {SITE: 3, "https://y.com": 0}
    urls = spark.createDataFrame([(SITE + "/p/1",), (SITE + "/p/q/1",), (SITE,), ("https://z.com/p",)], "url string")
    allowed = lambda ua: {r["url"]: r["allowed"] for r in robots.robots_allowed(urls, files, ua).collect()}
    assert allowed("*") == {SITE + "/p/1": False, SITE + "/p/q/1": True, SITE: True, "https://z.com/p": True}
    assert allowed("B2") == {SITE + "/p/1": False, SITE + "/p/q/1": False, SITE: False, "https://z.com/p": True}


def test_robots_of_very_many_rules(spark):
    """Against a scan of all rules; and no rules on the rows of URLs."""
    rnd = random.Random(3)
    rules = [(rnd.choice(["Allow", "Disallow"]), "/" + "/".join(rnd.choice("abcde") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 6)))) for _ in range(10_000)]
    body = "User-agent: other\nDisallow: /\n\nUser-agent: x\nCrawl-delay: 3\nUser-agent: *\n" + "\n".join(f"{k}: {p}" for k, p in rules) + "\nDisallow:\n"
    files = spark.createDataFrame([(SITE, body), ("http://x.com", "User-agent: *\nDisallow: /a\nAllow: /a")], "base_url string, body string")
    paths = ["/" + "/".join(rnd.choice("abcdef") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 7))) for _ in range(500)]
    urls = spark.createDataFrame([(k, SITE + p) for k, p in enumerate(paths)] + [(998, None), (999, "http://x.com/ab")], "k int, url string")
    checked = robots.robots_allowed(urls, files)
    got = {r["k"]: r["allowed"] for r in checked.collect()}
    for k, path in enumerate(paths):
        best = max(((len(p), kind == "Allow") for kind, p in rules if path.startswith(p)), default=(0, True))
        assert got[k] == best[1], path
    assert got[998] and got[999] and len(got) == 502
    last = checked._jdf.queryExecution().optimizedPlan().toString().split("\n")[1]
    assert "Join" in last and "array" not in last


def tiers(spark, n_listed, **settings):
    host = SITE
    request = {"job_id": "j", "url": host + "/", "depth": 1, "workers": 1, "delay": "", "max_urls": 100, "enable_sitemap": False, "enable_html": False, "enable_headless": False}
    extra_fetches = settings.pop("fetches", [(host + "/", 200, None)])
    robots_body = settings.pop("robots", "")
    request.update(settings)
    requests = spark.createDataFrame([tuple(request.values())], REQUEST)
    fetches = spark.createDataFrame([(*f, 1, 1) for f in extra_fetches + [(host + "/sitemap.xml", 200, None)]], "url string, status_code int, error string, tier int, attempt int")
    robot_files = spark.createDataFrame([(host, robots_body)], "base_url string, body string")
    body = "<urlset>" + "".join(f"<url><loc>{host}/s{i}</loc></url>" for i in range(n_listed)) + "</urlset>"
    documents = spark.createDataFrame([(host + "/sitemap.xml", body), (host + "/alt.xml", "<urlset><url><loc>alt</loc></url></urlset>")], "url string, body string")
    links = spark.createDataFrame([(host + "/", 0, host + "/s0"), (host + "/", 1, host + "/h1"), (host + "/", 2, host + "/h2")], LINK)
    return crawl.crawl_tiers(requests, fetches, robot_files, documents, links)


def listed(result):
    return [(r["url"].rsplit("/", 1)[1] if "/" in r["url"] else r["url"], r["tier"]) for r in result.urls.orderBy("ord").collect()]


def test_tier_thresholds(spark):
    nine = tiers(spark, 9)
    assert listed(nine) == [(f"s{i}", "sitemap") for i in range(9)] + [("h1", "html"), ("h2", "html")]
    assert nine.stats.collect()[0].asDict() == {"job_id": "j", "sitemap_urls": 9, "html_urls": 2, "headless_urls": 0, "total_tiers_used": 2}
    assert listed(tiers(spark, 10)) == [(f"s{i}", "sitemap") for i in range(10)]


def test_tier_flags_and_limits(spark):
    assert listed(tiers(spark, 2, enable_sitemap=True)) == [("s0", "sitemap"), ("s1", "sitemap")]
    assert listed(tiers(spark, 2, enable_html=True)) == [("s0", "html"), ("h1", "html"), ("h2", "html")]
    assert listed(tiers(spark, 2, enable_headless=True)) == []
    cut = tiers(spark, 9, max_urls=3)
    assert listed(cut) == [("s0", "sitemap"), ("s1", "sitemap"), ("s2", "sitemap")]
    assert cut.stats.collect()[0]["sitemap_urls"] == 9


def test_saved_and_failed_jobs(spark):
    blocked = [(SITE + "/", 403, None)]
    saved = tiers(spark, 3, fetches=blocked, robots="Sitemap: /alt.xml")
    assert listed(saved) == [("alt", "sitemap")]
    assert saved.jobs.select("status", "saved", "error").collect()[0] == ("completed", True, "HTTP 403: Forbidden (may need different approach)")
    failed = tiers(spark, 3, fetches=blocked)
    assert listed(failed) == [] and failed.stats.collect() == []
    assert failed.jobs.select("status").collect()[0][0] == "failed"
    started = failed.jobs.select("job_id", F.current_timestamp().alias("started_at"))
    assert [r["type"] for r in crawl.crawl_event_log(failed, started).orderBy("timestamp").collect()] == ["progress", "error"]


def test_event_log_feeds_the_live_counters(spark):
    from pagetrail.streaming import events

    done = tiers(spark, 9)
    started = done.jobs.select("job_id", F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("started_at"))
    log = crawl.crawl_event_log(done, started)
    stats = events.live_stats(log).collect()[0].asDict()
    assert stats == {
        "job_id": "j", "url_count": 11, "sitemap_count": 9, "html_count": 2, "headless_count": 0, "tiers_used": 2, "error_count": 0, "finished": True,
    }
    assert log.filter("type = 'completed'").count() == 2
    assert events.dedupe_completed(log, ["progress"]).filter("type = 'completed'").count() == 1
    assert events.job_state(log).collect()[0]["status"] == "completed"


def test_crawl_result_parts(spark):
    jobs = spark.createDataFrame([("j", "t", 1, "d", 1), ("k", "t", 1, "d", 1)], "job_id string, target_url string, workers int, delay string, depth int")
    jobs = jobs.withColumns({"started_at": F.to_timestamp(F.lit("2024-01-01 00:00:00")), "finished_at": F.to_timestamp(F.lit("2024-01-01 00:00:02"))})
    urls = spark.range(1, 8).select(F.lit("j").alias("job_id"), F.col("id").alias("ord"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    rows = {(r["id"], r["part"]): r for r in crawl.crawl_result(jobs, urls, per_part=3).collect()}
    assert [rows["j", p]["urls"] for p in range(3)] == [["u1", "u2", "u3"], ["u4", "u5", "u6"], ["u7"]]
    assert rows["j", 0]["urls_per_second"] == 3.5 and rows["j", 0]["total_urls"] == 7
    assert rows["k", 0]["urls"] == [] and rows["k", 0]["total_urls"] == 0


def test_deep_index_and_prefixed_sitemap(spark):
    """A chain of 15 indexes ends in a file whose elements carry a prefix."""
    from pagetrail.operators import sitemaps

    docs = [(f"s{k}", f"<sitemapindex><sitemap><loc>s{k + 1}</loc></sitemap></sitemapindex>") for k in range(15)]
    docs.append(("s15", '<sm:urlset xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9"><sm:url><sm:loc>u</sm:loc></sm:url></sm:urlset>'))
    docs = spark.createDataFrame(docs, "url string, body string")
    roots = spark.createDataFrame([("s0",)], "url string")
    assert [r.loc for r in sitemaps.parse_sitemaps(roots, docs).collect()] == ["u"]
    assert sitemaps.parse_sitemaps(roots, docs, max_depth=3).count() == 0


def test_null_max_urls_is_no_limit(spark):
    from pagetrail.plans.crawl import crawl_html

    request = spark.createDataFrame([("j", SITE + "/", 1, None)], "job_id string, url string, depth int, max_urls int")
    links = spark.createDataFrame([(SITE + "/", k, f"{SITE}/p{k}") for k in range(1500)], LINK)
    assert crawl_html(request, links).count() == 1500


@pytest.mark.parametrize("hot", [2, 10**6])
def test_level_moves_neither_links_nor_visited_rows(spark, monkeypatch, hot):
    """In the plan of a level, links and known URLs are read in their buckets and reach the join without an exchange."""
    monkeypatch.setattr(crawl, "HOT_PAGE", hot)
    rows = [(f"{SITE}/{i}", p, f"{SITE}/{(i * 7 + p) % 500}") for i in range(500) for p in range(3)]
    links = crawl.Buckets(spark, "src", "host")
    links.append(spark.createDataFrame(rows, LINK).withColumn("host", F.lit("x.com")))
    known = crawl.Buckets(spark, "job_id", "url", by="depth")
    listed = spark.range(3000).select(
        F.concat(F.lit("j"), F.col("id") % 30).alias("job_id"), F.concat(F.lit(SITE + "/"), F.col("id") % 499).alias("url"),
        F.array(F.col("id").cast("int")).alias("_path"), F.lit(5).alias("_depth"), F.lit(10**6).alias("_max"),
        F.array(F.lit("x.com")).alias("_site"), F.col("id").alias("ord"), F.lit(100).cast("bigint").alias("_listed"), F.lit(1).alias("depth"),
    ).dropDuplicates(["job_id", "url"])
    known.append(listed)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = crawl._found(known.table().filter("depth = 1"), links.table(), known.table(), 3000)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # from each scan upwards to the next join; the frontier is the scan of known URLs that reads paths
    above, still = [], set()
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-|"))
        above = [(d, x) for d, x in above if d < depth] + [(depth, line)]
        if "FileScan" in line and (links.name in line or known.name in line and "_path#" not in line and "_site#" not in line):
            way = [x for _, x in above][::-1]
            assert not any("Exchange" in x for x in way[: next(i for i, x in enumerate(way) if "Join" in x)]), plan
            still.add(links.name if links.name in line else known.name)
    assert still == {links.name, known.name}, plan
    links.forget()
    known.forget()


def test_null_limit_lists_and_announces_all(spark):
    links = spark.createDataFrame([(SITE + "/", p, f"{SITE}/{p}") for p in range(40)], LINK)
    requests = spark.createDataFrame([("j", SITE + "/", 1, None), ("k", SITE + "/", 1, 7)], "job_id string, url string, depth int, max_urls int")
    assert crawl.crawl_html(requests, links).groupBy("job_id").count().orderBy("job_id").collect() == [("j", 40), ("k", 7)]
