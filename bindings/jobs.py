"""Requests, the job table, results and the event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagetrail.functions.checks import job_status_filter
from pagetrail.operators import jobs, ordering
from pagetrail.schemas import CRAWL_EVENT
from pagetrail.session import scratch_dir
from pagetrail.sources import inputs, sinks
from pagetrail.sources.job_log import JobLog
from pagetrail.streaming import events as ev
from pagetrail.streaming import state

from .registry import query

# -- requests -----------------------------------------------------------------------

_REQUEST_JSON = """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN '{{"url":"https://a.example.com","depth":0}}' WHEN 1 THEN '{{"url":""}}' WHEN 2 THEN '{{not json'
  WHEN 3 THEN '{{"url":"https://b.example.com","max_urls":9000,"job_id":"ab"}}' WHEN 4 THEN '{{"url":"https://c.example.com","max_urls":-5,"workers":3,"delay":"1s","job_id":"job-' || CAST(o_orderkey AS STRING) || '"}}'
  WHEN 5 THEN '{{}}' WHEN 6 THEN '{{"url":"https://d.example.com","max_urls":5001,"enable_html":true,"headless_timeout":5}}' WHEN 7 THEN '{{"url":7,"depth":"x"}}'
  ELSE '{{"url":"https://e.example.com","depth":' || CAST(o_orderkey % 4 AS STRING) || ',"max_urls":' || CAST(o_orderkey % 7000 AS STRING) || '}}' END AS value FROM {orders}"""
_REQUESTS = """
req AS (SELECT o_orderkey, o_orderkey % 9 AS n FROM orders),
r AS (SELECT o_orderkey, 'https://' || ['a', '', '', '', 'c', '', 'd', '', 'e'][1 + n] || '.example.com' AS url,
  CASE n WHEN 4 THEN 'job-' || CAST(o_orderkey AS STRING) END AS job_id,
  CASE n WHEN 8 THEN coalesce(nullif(o_orderkey % 4, 0), 1) ELSE 1 END::INT AS depth, CASE n WHEN 4 THEN 3 ELSE 10 END::INT AS workers,
  CASE n WHEN 4 THEN '1s' ELSE '200ms' END AS delay,
  CASE n WHEN 4 THEN -5 WHEN 6 THEN 5000 WHEN 8 THEN least(coalesce(nullif(o_orderkey % 7000, 0), 1000), 5000) ELSE 1000 END::INT AS max_urls,
  n = 6 AS enable_html, CASE n WHEN 6 THEN 5 ELSE 30 END::INT AS headless_timeout FROM req WHERE n IN (0, 4, 6, 8))"""


def _requests(t):
    return inputs.read_requests(t.spark.sql(_REQUEST_JSON, orders=t.orders))


@query("read_requests", _REQUESTS + " SELECT * FROM r")
def read_requests(t):
    return _requests(t)[0].select("o_orderkey", "url", "job_id", "depth", "workers", "delay", "max_urls", "enable_html", "headless_timeout")


@query("request_defaults", """
SELECT CAST(o_orderkey AS STRING) AS job_id, coalesce(nullif(CAST(o_orderkey % 3 AS INT), 0), 1) AS depth, coalesce(nullif(CAST(o_orderkey % 12 AS INT), 0), 10) AS workers,
  least(coalesce(nullif(CAST(o_custkey * 7 - 10 AS INT), 0), 1000), 5000) AS max_urls, CASE WHEN o_orderkey % 2 = 0 THEN '200ms' ELSE '3s' END AS delay, false AS wait_for_js FROM orders""")
def request_defaults(t):
    key = F.col("o_orderkey")
    raw = t.orders.select(
        key.cast("string").alias("job_id"), (key % 3).cast("int").alias("depth"), (key % 12).cast("int").alias("workers"),
        (F.col("o_custkey") * 7 - 10).cast("int").alias("max_urls"), F.when(key % 2 == 0, "").otherwise("3s").alias("delay"),
        *[F.lit(None).cast("boolean").alias(f) for f in inputs.FLAGS], F.lit(0).alias("headless_timeout"),
    )
    return inputs.with_defaults(raw).select("job_id", "depth", "workers", "max_urls", "delay", "wait_for_js")


@query("rejected_requests", """
SELECT o_orderkey, CASE o_orderkey % 9 WHEN 1 THEN 'URL is required' WHEN 5 THEN 'URL is required' WHEN 3 THEN 'Invalid job_id format' ELSE 'Invalid JSON' END AS reason
FROM orders WHERE o_orderkey % 9 IN (1, 2, 3, 5, 7)""")
def rejected_requests(t):
    return _requests(t)[1].select("o_orderkey", "reason")


_ASKED = """
asked AS (SELECT CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey * 2 + o_custkey % 7 AS STRING) END AS job_id, o_orderkey FROM orders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY o_orderkey) AS n FROM asked),
judged AS (SELECT job_id, o_orderkey, job_id IS NOT NULL AND (n > 1 OR job_id IN (SELECT id FROM job)) AS clash FROM ranked)"""


def _judged(t):
    key = (F.col("o_orderkey") * 2 + F.col("o_custkey") % 7).cast("string")
    asked = t.orders.select(F.when(F.col("o_orderkey") % 11 != 0, key).alias("job_id"), "o_orderkey")
    return jobs.reject_duplicate_jobs(asked, t.job, ["o_orderkey"])


@query("accepted_requests", _ASKED + " SELECT job_id, o_orderkey FROM judged WHERE NOT clash", ("job",))
def accepted_requests(t):
    return _judged(t)[0]


@query("conflicting_requests", _ASKED + " SELECT job_id, o_orderkey FROM judged WHERE clash", ("job",))
def conflicting_requests(t):
    return _judged(t)[1]


# -- job table ----------------------------------------------------------------------

_UPSERTED = """
up AS (SELECT j.id, coalesce(u.status, j.status) AS status, coalesce(nullif(u.progress, ''), nullif(j.progress, '')) AS progress,
  coalesce(nullif(u.error, ''), j.error) AS error, j.created_at, coalesce(u.updated_at, j.updated_at) AS updated_at
  FROM job j LEFT JOIN job_update u ON j.id = u.id)"""
_STAMPS = ["created_at", "updated_at"]


def _plain(df):
    """Timestamps without zone, as the given tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, d in df.dtypes if d == "timestamp"})


@query("upsert_jobs", _UPSERTED + " SELECT id, status, progress, error, created_at, updated_at FROM up", ("job",))
def upsert_jobs(t):
    return _plain(jobs.upsert_jobs(t.job, t.job_update))


def _job_log(t):
    """Jobs as the first batch of a log, their updates as three more."""
    log = JobLog(t.spark, f"{scratch_dir(t.spark).rstrip('/')}/jobs-{uuid.uuid4().hex}", buckets=16)
    log.append(t.job, 0)
    for k in range(3):
        log.append(t.job_update.where(F.col("id").cast("long") % 3 == k), k + 1)
    return log


_CURRENT = _UPSERTED + " SELECT id, status, progress, error, created_at, updated_at FROM up"


@query("current_jobs", _CURRENT, ("job",))
def current_jobs(t):
    """Base from two compactions, and one open delta."""
    log = _job_log(t)
    log.compact(1)
    log.compact()
    return _plain(log.current())


@query("current_jobs_uncompacted", _CURRENT, ("job",))
def current_jobs_uncompacted(t):
    return _plain(_job_log(t).current())


@query("current_jobs_compacting", _CURRENT, ("job",))
def current_jobs_compacting(t):
    """While a compaction has written its buckets and not switched over."""
    log = _job_log(t)
    log.compact(0)
    log.prepare(3)
    return _plain(log.current())


@query("job_lookup", _UPSERTED + " SELECT id, status, progress FROM up WHERE id = '42'", ("job",))
def job_lookup(t):
    return jobs.job_lookup(jobs.upsert_jobs(t.job, t.job_update), "42").select("id", "status", "progress")


@query("lookup_jobs", """
SELECT id, status FROM job WHERE id IN (SELECT CAST(o_custkey AS STRING) FROM orders)""", ("job",))
def lookup_jobs(t):
    return jobs.lookup_jobs(t.job, t.orders.select(F.col("o_custkey").cast("string").alias("id"))).select("id", "status")


@query("recent_jobs", "SELECT id, status, created_at FROM job ORDER BY created_at DESC, id LIMIT 10", ("job",))
def recent_jobs(t):
    return _plain(jobs.recent_jobs(t.job).select("id", "status", "created_at"))


@query("recent_failed_jobs", "SELECT id, created_at FROM job WHERE status = 'failed' ORDER BY created_at DESC, id LIMIT 25", ("job",))
def recent_failed_jobs(t):
    return _plain(jobs.recent_jobs(t.job, "25", "failed").select("id", "created_at"))


@query("job_status_filter", "SELECT id, status FROM job WHERE status = 'failed'", ("job",))
def job_status(t):
    return t.job.filter(job_status_filter(F.col("status"), "failed")).select("id", "status")


@query("jobs_summary", "SELECT status, count(*) AS n_jobs FROM job GROUP BY 1", ("job",))
def jobs_summary(t):
    return jobs.jobs_summary(t.job)


@query("expire_jobs", "SELECT id, created_at FROM job WHERE created_at > TIMESTAMP '2000-06-02 12:00:00' - INTERVAL 86400 SECONDS", ("job",))
def expire_jobs(t):
    return _plain(jobs.expire_jobs(t.job, F.to_timestamp(F.lit("2000-06-02 12:00:00"))).select("id", "created_at"))


@query("recover_jobs", """
SELECT id, CASE status WHEN 'running' THEN 'failed' ELSE status END AS status, CASE status WHEN 'running' THEN 'Job interrupted by server restart' ELSE error END AS error,
  CASE status WHEN 'running' THEN TIMESTAMP '2002-01-01' ELSE updated_at END AS updated_at FROM job""", ("job",))
def recover_jobs(t):
    return _plain(jobs.recover_jobs(t.job, F.to_timestamp(F.lit("2002-01-01 00:00:00"))).select("id", "status", "error", "updated_at"))


def _results(t):
    return t.crawl_run.withColumn("settings", F.struct("depth"))


@query("latest_crawl_per_target", """
SELECT target_url, arg_max(id, (crawled_at, id)) AS id, max(crawled_at) AS crawled_at FROM crawl_run GROUP BY 1""", ("crawl_run",))
def latest_crawl_per_target(t):
    return _plain(ordering.latest_crawl_per_target(_results(t)).select("target_url", "id", "crawled_at"))


@query("largest_crawls", "SELECT id, total_urls FROM crawl_run WHERE depth = 2 ORDER BY total_urls DESC, id LIMIT 20", ("crawl_run",))
def largest_crawls(t):
    return ordering.largest_crawls(_results(t), 2, 20).select("id", "total_urls")


@query("result_json", """
SELECT id, '{"id":"' || id || '","total_urls":' || CAST(total_urls AS STRING) || ',"depth":' || CAST(depth AS STRING) || '}' AS body FROM crawl_run""", ("crawl_run",))
def result_json(t):
    return sinks.result_json(t.crawl_run.select("id", "total_urls", "depth"))


@query("write_results", "SELECT id, target_url, total_urls FROM crawl_run", ("crawl_run",))
def write_results(t):
    """Written as JSON and read back with the fixed schema."""
    rows = t.crawl_run.select("id", "target_url", "total_urls")
    path = f"{scratch_dir(t.spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    sinks.write_results(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


# -- events -------------------------------------------------------------------------

_COLUMNS = "event_id, type, job_id, url, depth, progress, timestamp, total, page_count, error, tier"


def _events(t):
    return t.ev


def _raw(t):
    """Events as JSON texts, some of them cut short."""
    body = F.to_json(F.struct(*CRAWL_EVENT.fieldNames()))
    broken = F.col("event_id") % 10 == 3
    return t.ev.select("event_id", F.when(broken, F.concat(F.lit("{"), body)).otherwise(body).alias("value"))


@query("read_events", "SELECT job_id, type, url, depth, total, timestamp FROM ev WHERE event_id % 10 <> 3", ("ev",))
def read_events(t):
    millis = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    raw = t.ev.select("event_id", F.to_json(F.struct(*CRAWL_EVENT.fieldNames()), {"timestampFormat": millis}).alias("value"))
    raw = raw.select(F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{"), "value")).otherwise(F.col("value")).alias("value"))
    return _plain(inputs.read_events(raw).select("job_id", "type", "url", "depth", "total", "timestamp"))


@query("dead_letters", "SELECT event_id FROM ev WHERE event_id % 10 = 3", ("ev",))
def dead_letters(t):
    return inputs.dead_letters(_raw(t)).select("event_id")


@query("event_envelope", """
SELECT 'crawler.' || job_id || '.' || type AS routing_key, '{"type":"' || type || '","job_id":"' || job_id || '"'
  || CASE WHEN url IS NULL THEN '' ELSE ',"url":"' || url || '"' END || CASE WHEN coalesce(depth, 0) = 0 THEN '' ELSE ',"depth":' || CAST(depth AS STRING) END
  || CASE WHEN progress IS NULL THEN '' ELSE ',"progress":"' || progress || '"' END || ',"timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"'
  || CASE WHEN total = 0 THEN '' ELSE ',"total":' || CAST(total AS STRING) END || CASE WHEN page_count = 0 THEN '' ELSE ',"page_count":' || CAST(page_count AS STRING) END
  || CASE WHEN error IS NULL THEN '' ELSE ',"error":"' || error || '"' END || CASE WHEN tier IS NULL THEN '' ELSE ',"tier":"' || tier || '"' END || '}' AS body FROM ev""", ("ev",))
def event_envelope(t):
    return sinks.event_envelope(_events(t))


@query("subscribe", "SELECT event_id, type FROM ev WHERE job_id = 'job-7'", ("ev",))
def subscribe(t):
    return ev.subscribe(_events(t), "job-7").select("event_id", "type")


@query("subscribe_delivered", "SELECT event_id, job_id, type FROM ev WHERE type IN ('url_discovered', 'progress', 'completed', 'error')", ("ev",))
def subscribe_delivered(t):
    return ev.subscribe(_events(t), delivered_only=True).select("event_id", "job_id", "type")


@query("to_client_message", """
SELECT type, job_id, url, depth, progress, timestamp, total, page_count, error, tier FROM ev""", ("ev",))
def to_client_message(t):
    return _plain(ev.to_client_message(_events(t)))


@query("connected_message", """
SELECT type, job_id, progress FROM ev UNION ALL SELECT DISTINCT 'connected', job_id, 'Connected to live updates' FROM ev""", ("ev",))
def connected_message(t):
    messages = ev.to_client_message(_events(t))
    return ev.connected_message(messages, messages.select("job_id").distinct(), F.current_timestamp()).select("type", "job_id", "progress")


@query("drop_stale", "SELECT event_id FROM ev WHERE timestamp >= (SELECT max(timestamp) FROM ev) - INTERVAL 1 HOUR", ("ev",))
def drop_stale(t):
    return ev.drop_stale(_events(t)).select("event_id")


@query("last_n_events", """
SELECT job_id, event_id, rn AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY timestamp DESC, event_id DESC) AS INT) AS rn FROM ev) WHERE rn <= 100""", ("ev",))
def last_n_events(t):
    return ordering.last_n_events(_events(t), tie=["event_id"]).select("job_id", "event_id", "rank")


@query("live_stats", r"""
SELECT job_id, coalesce(arg_max(total, (timestamp, event_id)) FILTER (total <> 0), 0) AS url_count,
  coalesce(arg_max(total, (timestamp, event_id)) FILTER (total <> 0 AND tier = 'sitemap' AND type <> 'error'), 0) AS sitemap_count,
  coalesce(arg_max(added, (timestamp, event_id)) FILTER (added IS NOT NULL AND tier = 'html'), 0) AS html_count,
  coalesce(arg_max(added, (timestamp, event_id)) FILTER (added IS NOT NULL AND tier = 'headless'), 0) AS headless_count,
  count(*) FILTER (type = 'tier_switch' AND contains(progress, 'Starting Tier')) AS tiers_used, count(*) FILTER (type = 'error') AS error_count,
  bool_or(type = 'completed') AS finished
FROM (SELECT *, TRY_CAST(nullif(regexp_extract(progress, 'added ([0-9]+) new URLs', 1), '') AS INTEGER) AS added FROM ev) GROUP BY 1""", ("ev",))
def live_stats(t):
    return ev.live_stats(_events(t), ["event_id"])


@query("current_tier", """
SELECT job_id, n AS tier_no, ['Tier 1: sitemap discovery', 'Tier 2: HTML link discovery', 'Tier 3: headless browser'][n] AS label FROM (
  SELECT job_id, arg_max(TRY_CAST(nullif(regexp_extract(progress, 'Starting Tier ([0-9]+)', 1), '') AS INTEGER), (timestamp, event_id))
    FILTER (type = 'tier_switch' AND contains(progress, 'Starting Tier')) AS n FROM ev GROUP BY 1)""", ("ev",))
def current_tier(t):
    return ev.current_tier(_events(t), ["event_id"])


@query("job_elapsed", """
SELECT job_id, CAST(floor((epoch_us(coalesce(max(timestamp) FILTER (type = 'completed'), TIMESTAMP '2024-02-02')) - epoch_us(min(timestamp))) / 1000000) AS BIGINT) AS elapsed_s
FROM ev GROUP BY 1""", ("ev",))
def job_elapsed(t):
    return ev.job_elapsed(_events(t), F.to_timestamp(F.lit("2024-02-02 00:00:00")))


@query("dedupe_completed", """
SELECT event_id, job_id, type FROM ev WHERE type <> 'completed' UNION ALL
SELECT arg_min(event_id, (timestamp, event_id)), job_id, 'completed' FROM ev WHERE type = 'completed' GROUP BY job_id""", ("ev",))
def dedupe_completed(t):
    return ev.dedupe_completed(_events(t), ["event_id"]).select("event_id", "job_id", "type")


@query("job_state", """
e AS (SELECT *, CASE WHEN type = 'completed' THEN 'completed' WHEN type = 'error' AND tier IS NULL THEN 'failed' END AS ends FROM ev),
s AS (SELECT job_id AS id, coalesce(arg_max(ends, (timestamp, event_id)) FILTER (ends IS NOT NULL), 'running') AS status,
  arg_max(progress, (timestamp, event_id)) FILTER (progress IS NOT NULL) AS progress, arg_max(error, (timestamp, event_id)) FILTER (ends = 'failed') AS err,
  arg_max(total, (timestamp, event_id)) FILTER (type = 'completed') AS tot, min(timestamp) AS created_at, max(timestamp) FILTER (ends IS NOT NULL) AS ended FROM e GROUP BY 1)
SELECT id, status, progress, CASE status WHEN 'failed' THEN err END AS error, CASE status WHEN 'completed' THEN tot END AS total_urls, created_at,
  coalesce(ended, created_at) AS updated_at FROM s""", ("ev",))
def job_state(t):
    return _plain(ev.job_state(_events(t), ["event_id"]))


DAYS = 5  # of events that arrive as one file; a job of a stream lives as long


def _streamed(t, rows, order, fold, keys=None):
    """Give ``rows`` to ``fold`` as a stream that has one file for each value of the column ``order``, and read back what the
    ``foreachBatch`` sink wrote; with ``keys`` only the last row of each."""
    folder = f"{scratch_dir(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows.write.partitionBy(order).parquet(f"{folder}/all")
    parts = t.spark.read.schema(rows.schema).parquet(f"{folder}/all")
    for (part,) in parts.select(order).distinct().orderBy(order).collect():
        parts.where(F.col(order) == part).drop(order).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = t.spark.readStream.schema(rows.drop(order).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def keep(rows, batch_id):
        rows.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    folded = fold(source)
    ev.update_query(folded, keep, f"{folder}/checkpoint", mode="update" if keys else "append").awaitTermination()
    out = t.spark.read.schema(f"{', '.join(f'{c} {d}' for c, d in folded.dtypes)}, _batch long").parquet(f"{folder}/out").drop("batch")
    if keys is None:
        return out.drop("_batch")
    rest = [c for c in out.columns if c not in (*keys, "_batch")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


def _period(column="timestamp"):
    return F.floor(F.datediff(F.col(column), F.lit("2000-01-01")) / DAYS).cast("int")


_PERIOD = f"floor(date_diff('day', DATE '2000-01-01', timestamp::DATE) / {DAYS})::INT"


@query("live_stats_stream", f"""
own AS (SELECT * REPLACE (job_id || '-' || ({_PERIOD})::STRING AS job_id), TRY_CAST(nullif(regexp_extract(progress, 'added ([0-9]+) new URLs', 1), '') AS INTEGER) AS added FROM ev)
SELECT job_id, coalesce(arg_max(total, (timestamp, event_id)) FILTER (total <> 0), 0)::BIGINT AS url_count,
  coalesce(arg_max(total, (timestamp, event_id)) FILTER (total <> 0 AND tier = 'sitemap' AND type <> 'error'), 0)::BIGINT AS sitemap_count,
  coalesce(arg_max(added, (timestamp, event_id)) FILTER (added IS NOT NULL AND tier = 'html'), 0)::BIGINT AS html_count,
  coalesce(arg_max(added, (timestamp, event_id)) FILTER (added IS NOT NULL AND tier = 'headless'), 0)::BIGINT AS headless_count,
  count(*) FILTER (type = 'tier_switch' AND contains(progress, 'Starting Tier')) AS tiers_used, count(*) FILTER (type = 'error') AS error_count,
  bool_or(type = 'completed') AS finished FROM own GROUP BY 1""", ("ev",))
def live_stats_stream(t):
    job = F.concat_ws("-", "job_id", _period().cast("string"))
    rows = t.ev.withColumn("period", _period()).withColumn("job_id", job)
    return _streamed(t, rows, "period", lambda s: state.live_stats(s, "event_id"), ["job_id"])


@query("drop_stale_stream", f"""
sent AS (SELECT event_id, timestamp, {_PERIOD} + (event_id % 10 = 3)::INT AS batch FROM ev),
mark AS (SELECT batch, max(max(epoch_ms(timestamp))) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000 AS ms FROM sent GROUP BY 1)
SELECT event_id FROM sent JOIN mark USING (batch) WHERE ms IS NULL OR epoch_us(timestamp) >= ms * 1000""", ("ev",))
def drop_stale_stream(t):
    """Every tenth event arrives a file later than the others of its time."""
    rows = t.ev.withColumn("batch", _period() + (F.col("event_id") % 10 == 3).cast("int"))
    return _streamed(t, rows, "batch", state.drop_stale).select("event_id")


@query("expire_jobs_stream", """
SELECT id, created_at FROM job WHERE epoch_ms(created_at) + 86400000 < (SELECT max(epoch_ms(created_at)) - 3600000 FROM job)""", ("job",))
def expire_jobs_stream(t):
    """Jobs arrive by the year; each is given back once the clock has passed its day."""
    rows = t.job.select("id", "created_at").withColumn("year", F.year("created_at"))
    return _plain(_streamed(t, rows, "year", state.expirations))
