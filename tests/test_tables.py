"""Sources, sinks, content, jobs, events: golden rows, streams against batches, plans."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from pagetrail.functions.checks import is_html
from pagetrail.operators import access_log, content, fallback, fetching, jobs, links, ordering
from pagetrail.schemas import CRAWL_EVENT, FETCH
from pagetrail.session import spread
from pagetrail.sources import inputs, sinks
from pagetrail.streaming import events as ev

EVENT = "type string, job_id string, url string, depth int, progress string, timestamp timestamp, total int, page_count int, error string, tier string"


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_read_requests(spark):
    texts = [
        '{"url":"https://a.b"}', '{"url":"https://a.b","depth":-2,"max_urls":5001,"delay":"1s","job_id":"abc","enable_html":true}', "{bad", '{"url":""}', "{}",
        '{"url":"u","job_id":"a"}', '{"url":"u","depth":"x"}', "null", "",
    ]
    good, bad = inputs.read_requests(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string"))
    assert rows(good.orderBy("i"), "i", "depth", "workers", "delay", "max_urls", "headless_timeout", "enable_html") == [
        (0, 1, 10, "200ms", 1000, 30, False), (1, -2, 10, "1s", 5000, 30, True),
    ]
    reasons = dict(rows(bad, "i", "reason"))
    assert reasons[2] == reasons[6] == "Invalid JSON" and reasons[3] == reasons[4] == "URL is required" and reasons[5] == "Invalid job_id format"
    assert set(reasons) == {2, 3, 4, 5, 6, 7, 8}


def test_content_targets(spark):
    texts = ['{"urls":["a","b"],"url":"c"}', '{"url":"c","urls":[]}', "{}", '{"urls":null}']
    got = inputs.content_targets(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "req_id int, value string"))
    assert sorted(rows(got, "req_id", "idx", "url")) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]


def test_sitemap_sources(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<urlset/>")
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "b.xml.gz").write_bytes(gzip.compress(b"<zipped/>"))
    (tmp_path / "c.xml.gz").write_bytes(gzip.compress(b"<zipped/>")[:-9])
    files = inputs.read_sitemap_files(spark, str(tmp_path), "https://h.org/maps/")
    got = dict(rows(inputs.sitemap_docs_binary(files), "url", "body"))
    top = "https://h.org/maps/"
    assert got == {f"{top}a.xml": "<urlset/>", f"{top}sub%20dir/b.xml.gz": "<zipped/>", f"{top}c.xml.gz": "<zipped/>"}
    assert rows(inputs.gzip_rejects(files), "url", "reason") == [(f"{top}c.xml.gz", "truncated")]
    assert all(u.startswith("file:") for (u,) in rows(inputs.read_sitemap_files(spark, str(tmp_path)), "url"))
    z = gzip.compress("é".encode())
    data = [("h", 200, {"Content-Encoding": "gzip"}, z), ("m", 200, {}, z), ("p", 200, None, "é".encode()), ("x", 404, {}, b"no"), ("b", 200, {"Content-Encoding": "gzip"}, b"junk")]
    binary = spark.createDataFrame(data, "url string, status_code int, headers map<string,string>, body binary")
    assert dict(rows(inputs.sitemap_docs_binary(binary), "url", "body")) == {"h": "é", "m": "é", "p": "é", "b": ""}


def test_events_in_and_out(spark):
    data = [("progress", "j", "", 0, "p", None, 0, 3, None, "html")]
    event = spark.createDataFrame(data, EVENT).withColumn("timestamp", F.to_timestamp(F.lit("2024-01-01 00:00:00.5")))
    key, body = rows(sinks.event_envelope(event), "routing_key", "body")[0]
    assert key == "crawler.j.progress"
    assert json.loads(body) == {"type": "progress", "job_id": "j", "progress": "p", "timestamp": "2024-01-01T00:00:00.500000Z", "page_count": 3, "tier": "html"}
    raw = spark.createDataFrame([(body,), ("{x",), (None,)], "value string")
    back = inputs.read_events(raw)
    assert back.schema.fieldNames() == CRAWL_EVENT.fieldNames() and rows(back, "page_count", "tier") == [(3, "html")]
    assert inputs.dead_letters(raw).count() == 2


def test_upsert_jobs(spark):
    schema = "id string, status string, progress string, error string, created_at timestamp, updated_at timestamp"
    at = lambda s: F.to_timestamp(F.lit(f"2024-01-01 00:00:{s:02d}"))

    def job(id_, status, progress, error, created, updated):
        return spark.createDataFrame([(id_, status, progress, error, None, None)], schema).withColumns({"created_at": at(created), "updated_at": at(updated)})

    base = job("a", "running", "p1", None, 1, 1).union(job("b", "running", "x", None, 1, 1))
    updates = job("a", "completed", "", "", 1, 9).union(job("a", "running", "p2", None, 1, 5)).union(job("c", "failed", "", "e", 3, 3))
    got = {r["id"]: r for r in jobs.upsert_jobs(base, updates).collect()}
    assert (got["a"]["status"], got["a"]["progress"], got["a"]["error"], got["a"]["updated_at"].second) == ("completed", "p2", None, 9)
    assert got["b"]["progress"] == "x" and got["c"]["error"] == "e"
    assert jobs.upsert_jobs(updates.limit(0), updates.union(base)).count() == 3


def test_job_lists(spark):
    assert [jobs.parse_limit(x) for x in (None, "", "7", "x", "-3")] == [10, 10, 7, 10, -3]
    many = spark.range(30).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "running").otherwise("failed").alias("status"),
        F.timestamp_seconds(F.col("id") % 5).alias("created_at"), F.lit(None).cast("string").alias("error"), F.timestamp_seconds(F.lit(0)).alias("updated_at"),
    )
    assert [r[0] for r in rows(jobs.recent_jobs(many, 3), "id")] == ["14", "19", "24"]
    assert jobs.recent_jobs(many, "zz", "failed").count() == 10 and jobs.recent_jobs(many, 0).count() == 30 and jobs.recent_jobs(many, -4).count() == 4
    assert jobs.expire_jobs(many, F.timestamp_seconds(F.lit(86402))).count() == 12
    recovered = jobs.recover_jobs(many, F.timestamp_seconds(F.lit(9)))
    assert recovered.filter("status = 'failed'").count() == 30 and recovered.filter(F.col("error") == jobs.INTERRUPTED).count() == 15
    assert dict(rows(jobs.jobs_summary(many), "status", "n_jobs")) == {"running": 15, "failed": 15}
    asked = spark.createDataFrame([("1", 0), ("99", 2), ("99", 1), (None, 3), (None, 4)], "job_id string, at int")
    accepted, conflicts = jobs.reject_duplicate_jobs(asked, many, ["at"])
    assert sorted(r["at"] for r in accepted.collect()) == [1, 3, 4] and sorted(r["at"] for r in conflicts.collect()) == [0, 2]


def fetch(url, tier, attempt, status, ctype="text/html", body="", error=None):
    return (url, "GET", tier, attempt, status, ctype, {"Content-Type": ctype}, body, error, None)


LONG = "<p>" + "word " * 40 + "</p>"


def test_best_attempt_branches(spark):
    data = [
        fetch("t1", 1, 1, 200, body=LONG), fetch("t1", 2, 1, 200, body="<p>b</p>"),
        fetch("t2", 1, 1, 200, body="<p>short</p>"), fetch("t2", 2, 1, 200, body="<p>rendered</p>"),
        fetch("both", 1, 1, 403), fetch("both", 2, 1, None, error="boom"),
        fetch("gone", 1, 1, 429), fetch("gone", 2, 1, None, error="headless browser not available here"),
        fetch("quirk", 1, 1, 200, body="<p>short</p>"), fetch("quirk", 2, 1, None, error="boom"),
        fetch("plain", 1, 1, 500, "Application/JSON", '{"a":  1}' * 20), fetch("plain", 2, 1, 200, body="x"),
    ]
    responses = content.content_response(spark.createDataFrame(data, FETCH))
    best = {r["url"]: r for r in content.best_attempt(responses).collect()}
    assert best["t1"]["tier"] == 1 and best["t2"]["markdown"] == "rendered"
    assert best["both"]["error"] == "HTTP 403: 403 Forbidden (blocked by server, trying browser fallback) (Browser fallback also failed: boom)"
    assert best["gone"]["error"].endswith(content.BROWSER_UNAVAILABLE)
    assert best["quirk"]["tier"] == 2 and best["quirk"]["error"] == "boom"
    assert best["plain"]["markdown"] == '{"a":  1}' * 20 and best["plain"]["status_code"] == 500


def test_best_responses_equal_best_attempt(spark):
    rnd = random.Random(6)
    bodies = [LONG, "<p>short</p>", "", None]
    data = [
        fetch(f"u{u}", tier, attempt, rnd.choice([200, 403, 500]), body=rnd.choice(bodies), error=rnd.choice(["", "", "boom"]))
        for u in range(60) for tier in (1, 2) for attempt in range(1, 1 + rnd.randint(0, 3))
    ]
    fetches = spark.createDataFrame(data, FETCH)
    want = {tuple(r) for r in content.best_attempt(content.content_response(fetches)).drop("headers").collect()}
    got = {tuple(r) for r in content.best_responses(fetches).drop("headers").collect()}
    assert got == want and len(want) == len({d[0] for d in data})


def wide_nodes(df, column):
    """Sorts and aggregates of the plan that hold ``column``."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name, output = node.nodeName(), node.output()
        if ("Sort" in name or "Aggregate" in name) and any(output.apply(i).name() == column for i in range(output.size())):
            found.append(name)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_bodies_are_neither_sorted_nor_gathered(spark, tmp_path):
    spark.createDataFrame([fetch("a", 1, 1, 200, body=LONG), fetch("a", 2, 1, 200, body=LONG)], FETCH).write.parquet(str(tmp_path / "f"))
    fetches = spark.read.schema(FETCH).parquet(str(tmp_path / "f"))
    stored = content.content_response(fetches)
    stored.write.parquet(str(tmp_path / "r"))
    responses = spark.read.schema(stored.schema).parquet(str(tmp_path / "r"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert wide_nodes(content.first_success(fetches), "body") == []
        assert wide_nodes(content.best_attempt(responses), "markdown") == []
        assert wide_nodes(fetches.orderBy("url"), "body") == ["Sort"]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_batch_parts_stay_under_their_bytes(spark):
    rnd = random.Random(8)
    texts = [(r, i, "x" * rnd.choice([0, 10, 900, 1_000_000, 300_000]), "") for r in range(4) for i in range(30)]
    batch = spark.createDataFrame(texts, "req_id int, idx int, markdown string, error string")
    parts = content.content_batch_rows(batch, 25, 1_500_000).orderBy("req_id", "part").collect()
    back = [(p["req_id"], r["idx"], r["markdown"], r["error"]) for p in parts for r in p["results"]]
    assert back == texts
    for p in parts:
        assert len(p["results"]) <= 25 and (sum(len(r["markdown"]) for r in p["results"]) <= 1_500_000 or len(p["results"]) == 1)
    assert [p["part"] for p in parts if p["req_id"] == 0] == list(range(sum(p["req_id"] == 0 for p in parts))) and len(parts) > 20
    assert content.content_batch_rows(batch.limit(0)).count() == 0


def test_prefix_sum_of_a_hot_group(spark):
    data = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(-1).alias("g"), F.hash("id").alias("o"), (F.col("id") % 11).alias("v"))
    from pyspark.sql import Window

    want = data.withColumn("w", F.sum("v").over(Window.partitionBy("g").orderBy("o")))
    got = ordering.prefix_sum(data, ["g"], ["o"], "v", "s")
    assert got.count() == 20_000 and got.join(want, ["g", "o", "v"]).filter("s <> w").count() == 0


def test_first_success_and_accessible(spark):
    data = [fetch("a", 1, 1, 500), fetch("a", 1, 2, 204, body="b2"), fetch("a", 1, 3, 200, body="b3"), fetch("b", 1, 1, 404)]
    got = {r["url"]: r for r in content.first_success(spark.createDataFrame(data, FETCH)).collect()}
    assert got["a"]["attempt"] == 2 and got["a"]["body"] == "b2" and got["b"]["error"] == content.ALL_ATTEMPTS_FAILED
    data = [fetch("http://o.k", 1, 1, 302), fetch("http://s.e", 1, 1, 403), fetch("https://s.e", 1, 1, 200), fetch("http://n.o", 1, 1, None, error="refused")]
    urls = spark.createDataFrame([("http://o.k",), ("http://s.e",), ("http://n.o",), ("http://un.known",), ("http://o.k",)], "url string")
    got = {r["original_url"]: tuple(r)[1:] for r in fallback.first_accessible(urls, spark.createDataFrame(data, FETCH)).collect()}
    assert got == {
        "http://o.k": ("http://o.k", True, None), "http://s.e": ("https://s.e", True, "HTTP 403: Forbidden (may need different approach)"),
        "http://n.o": ("http://n.o", False, "refused"), "http://un.known": ("http://un.known", False, fallback.NOT_FETCHED),
    }


def test_batch_rows_split_large_requests(spark):
    targets = spark.range(5).select(F.lit(1).alias("req_id"), F.col("id").cast("int").alias("idx"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    responses = content.content_response(spark.createDataFrame([fetch(f"u{i}", 1, 1, 200, body=f"<p>{i}</p>") for i in range(4)], FETCH))
    parts = content.content_batch_rows(content.content_batch(targets, responses), per_part=2).orderBy("part").collect()
    assert [[r["markdown"] for r in p["results"]] for p in parts] == [["0", "1"], ["2", "3"], [None]]
    assert (parts[0]["total"], parts[0]["success"], parts[0]["failed"]) == (5, 4, 1)


def test_access_log(spark):
    schema = "method string, path string, xff string, x_real_ip string, remote_addr string, status int, duration_s double, req_body string, resp_body string"
    data = [("POST", "/x", "", None, "r", 399, 5.0, "q" * 500, "p"), ("GET", "/jobs", "f", None, "r", 200, 5.01, "q", "p" * 501), ("PUT", "/jobs/1", None, "i", "r", 400, 1.0, "q" * 501, "p")]
    log = spark.createDataFrame(data, schema)
    got = rows(access_log.enrich_access_log(log), "client_ip", "req_body", "resp_body")
    assert got == [("r", "q" * 500, None), ("f", None, "p" * 500 + "... [truncated]"), ("i", "q" * 500 + "... [truncated]", "p")]
    assert access_log.slow_requests(log).count() == 1


def test_fetch_plan(spark):
    urls = spark.range(1, 6).select(F.lit("j").alias("job_id"), F.col("id").alias("ord"), F.col("id").cast("string").alias("url"))
    requests = spark.createDataFrame([("j", 2, "1.5s")], "job_id string, workers int, delay string")
    got = rows(fetching.fetch_plan(urls, requests).orderBy("url"), "url", "slot", "earliest_s")
    assert got == [("1", 0, 0.0), ("2", 1, 0.0), ("3", 0, 1.5), ("4", 1, 1.5), ("5", 0, 3.0)]


# -- streams ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def event_rows(spark):
    rnd = random.Random(5)
    data = []
    for i in range(600):
        kind = rnd.choice(["progress", "url_discovered", "completed", "error", "sitemap_discovered", "tier_switch"])
        progress = {"tier_switch": f"Starting Tier {rnd.randrange(1, 4)}: x", "progress": f"added {i} new URLs"}.get(kind)
        data.append((kind, f"j{rnd.randrange(7)}", "u" if kind == "url_discovered" else None, 1, progress, i * 3, rnd.randrange(5), i, "e" if kind == "error" else None, rnd.choice(["sitemap", "html", "headless", None])))
    rnd.shuffle(data)
    raw = spark.createDataFrame(data, EVENT.replace("timestamp timestamp", "timestamp int"))
    return raw.withColumn("timestamp", F.timestamp_seconds(F.col("timestamp") + 1_700_000_000)).select(*CRAWL_EVENT.fieldNames()).cache()


def run_stream(spark, folder, source, fold, mode):
    source.repartition(6).write.mode("overwrite").json(f"{folder}/in")
    lines = spark.readStream.option("maxFilesPerTrigger", 2).text(f"{folder}/in")
    query = fold(inputs.read_events(lines)).writeStream.outputMode(mode).format("memory").queryName("streamed").trigger(availableNow=True)
    query.option("checkpointLocation", f"{folder}/cp").start().awaitTermination()
    return spark.table("streamed")


@pytest.mark.parametrize("fold", [ev.live_stats, ev.job_state, ev.current_tier])
def test_stream_equals_batch(spark, tmp_path, event_rows, fold):
    streamed = run_stream(spark, str(tmp_path), event_rows, fold, "complete")
    assert sorted(map(str, streamed.collect())) == sorted(map(str, fold(event_rows).collect()))


def test_dedupe_stream(spark, tmp_path, event_rows):
    streamed = run_stream(spark, str(tmp_path), event_rows, lambda s: ev.dedupe_completed(ev.drop_stale(s)), "append")
    batch = ev.dedupe_completed(event_rows)
    assert streamed.filter("type = 'completed'").count() == batch.filter("type = 'completed'").count() == 7
    assert streamed.count() == batch.count()


def test_job_updates_through_foreach_batch(spark, tmp_path, event_rows):
    event_rows.repartition(6).write.json(str(tmp_path / "in"))
    lines = inputs.stream_event_files(spark, str(tmp_path / "in"), 2)
    sink = sinks.append_job_updates(str(tmp_path / "jobs"))
    ev.update_query(ev.job_state(inputs.read_events(lines)), sink, str(tmp_path / "cp")).awaitTermination()
    assert sinks.current_jobs(spark, str(tmp_path / "jobs")).count() == 7


def test_event_filters(spark, event_rows):
    assert ev.subscribe(event_rows, "j1", delivered_only=True).filter("type = 'tier_switch' OR job_id <> 'j1'").count() == 0
    assert ev.to_client_message(event_rows, keep_tier=False).filter("tier IS NOT NULL").count() == 0
    greeted = ev.connected_message(ev.to_client_message(event_rows), spark.createDataFrame([("j1",)], "job_id string"), F.current_timestamp())
    assert greeted.filter("type = 'connected'").count() == 1 and greeted.count() == 601
    recent = ev.drop_stale(event_rows)
    assert recent.count() == 600 and ordering.last_n_events(event_rows, 5).count() == 35
    late = event_rows.withColumn("timestamp", F.when(F.col("page_count") == 0, F.col("timestamp") - F.expr("INTERVAL 2 HOURS")).otherwise(F.col("timestamp")))
    assert ev.drop_stale(late).count() == 599
    done = ev.job_elapsed(event_rows, F.current_timestamp())
    assert done.filter("elapsed_s < 0 OR elapsed_s > 1800").count() == 0


# -- plans --------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.001/pages.parquet")


def test_parser_runs_once(spark, pages, monkeypatch):
    for df in [links.discover_links(pages), links.extract_links(pages), content.with_page(pages), links.links_per_host(pages), links.link_counts(pages)]:
        assert plan(df).count("ArrowEvalPython") == 1
    fetches = spark.createDataFrame([fetch("a", 1, 1, 200)], FETCH)
    assert plan(content.content_response(fetches)).count("ArrowEvalPython") == 1


def test_narrow_plans_have_no_shuffle_beyond_the_deal(spark, pages, monkeypatch):
    monkeypatch.setattr("pagetrail.operators.links.spread", lambda df: df)
    text = plan(links.discover_links(pages))
    assert "Exchange" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_scan_reads_only_what_it_needs(spark, pages):
    text = plan(pages.select("url", "html").filter(F.col("page_id") > 3).select("url"))
    assert "html" not in text.split("ReadSchema")[1] and "PushedFilters: [IsNotNull(page_id), GreaterThan(page_id,3)]" in text
    assert "html" not in plan(inputs.html_pages(pages.withColumn("content_type", F.lit("text/html"))).filter(is_html(F.col("content_type"))).select("url")).split("ReadSchema")[1]


def test_spread_leaves_large_input_alone(spark, pages):
    assert "Exchange" in plan(spread(pages))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert "Exchange" not in plan(spread(pages))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
