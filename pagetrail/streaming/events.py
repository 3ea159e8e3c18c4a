"""Crawl events: subscription, staleness, live counters and job state.

Every function takes a batch or a streaming DataFrame of ``schemas.CRAWL_EVENT`` rows.
State per job is one row of running aggregates; no event list is ever kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_added
from ..schemas import DELIVERED_TYPES

STALE_AFTER = "1 hour"
STALE_SECONDS = 3600
# Our wording of the tier labels.
TIER_LABELS = {1: "Tier 1: sitemap discovery", 2: "Tier 2: HTML link discovery", 3: "Tier 3: headless browser"}


def subscribe(events: DataFrame, job_id: str | None = None, types: list[str] | None = None, delivered_only: bool = False) -> DataFrame:
    """Events of one job (or of all) and of some types. ``delivered_only`` keeps the four
    types that reach clients of the live channel."""
    out = events if job_id is None else events.filter(F.col("job_id") == job_id)
    wanted = DELIVERED_TYPES if delivered_only and types is None else types
    return out.filter(F.col("type").isin(wanted)) if wanted else out


def to_client_message(events: DataFrame, keep_tier: bool = True) -> DataFrame:
    fields = ["type", "job_id", "url", "depth", "progress", "timestamp", "total", "page_count", "error"]
    return events.select(*fields, F.col("tier") if keep_tier else F.lit(None).cast("string").alias("tier"))


def connected_message(messages: DataFrame, subscriptions: DataFrame, now: Column) -> DataFrame:
    """Batch only: ``messages`` plus one greeting per ``subscriptions.job_id``."""
    hello = {"type": F.lit("connected"), "job_id": F.col("job_id"), "progress": F.lit("Connected to live updates"), "timestamp": now}
    types = {f.name: f.dataType for f in messages.schema.fields}
    greeting = subscriptions.select(
        *[hello.get(c, F.lit(None)).cast(types[c]).alias(c) for c in messages.columns]
    )
    return greeting.unionByName(messages)


def drop_stale(events: DataFrame) -> DataFrame:
    """Events older than one hour behind the newest are late and go. On a stream this sets the watermark, by which the
    stateful operators of Spark that follow drop them; :func:`.state.drop_stale` drops them where none follows, and
    :func:`.state.live_stats` does by itself."""
    if events.isStreaming:
        return events.withWatermark("timestamp", STALE_AFTER)
    newest = events.agg(F.max("timestamp")).scalar()
    return events.filter(F.col("timestamp") >= newest - F.expr(f"INTERVAL {STALE_AFTER}"))


def _order(tie: list[str] | None) -> Column:
    return F.struct("timestamp", *(tie or []))


def _last(value: Column, when: Column, tie: list[str] | None) -> Column:
    """Newest non-null ``value`` among the rows where ``when`` holds."""
    return F.max_by(value, F.when(when & value.isNotNull(), _order(tie)))


LATEST = ["url_count", "sitemap_count", "html_count", "headless_count"]
COUNTED = ["tiers_used", "error_count"]


def measures(events: DataFrame) -> DataFrame:
    """``events`` with what each tells about the counters of its job: ``LATEST`` hold a number or null, of which the newest
    counts, ``COUNTED`` whether it counts, ``finished`` whether it ends the job."""
    tier, kind = F.coalesce("tier", F.lit("")), F.col("type")
    total, added = F.nullif(F.col("total"), F.lit(0)), parse_added(F.col("progress"))
    return events.withColumns(
        {
            "url_count": total,
            "sitemap_count": F.when((tier == "sitemap") & (kind != "error"), total),
            "html_count": F.when(tier == "html", added),
            "headless_count": F.when(tier == "headless", added),
            "tiers_used": (kind == "tier_switch") & F.coalesce(F.col("progress").contains("Starting Tier"), F.lit(False)),
            "error_count": F.coalesce(kind == "error", F.lit(False)),
            "finished": F.coalesce(kind == "completed", F.lit(False)),
        }
    )


def live_stats(events: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """One row of counters per job. Event time decides what is last; ``tie`` breaks ties. :func:`.state.live_stats` is the
    form for streams."""
    return measures(events).groupBy("job_id").agg(
        *[F.coalesce(_last(F.col(c), F.lit(True), tie), F.lit(0)).alias(c) for c in LATEST],
        *[F.count_if(F.col(c)).alias(c) for c in COUNTED],
        F.bool_or("finished").alias("finished"),
    )


def current_tier(events: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """(job_id, tier_no, label) by the last tier switch of each job."""
    number = F.regexp_extract("progress", r"Starting Tier ([0-9]+)", 1).try_cast("int")
    labels = F.create_map(*[F.lit(x) for kv in TIER_LABELS.items() for x in kv])
    last = _last(number, F.col("type") == "tier_switch", tie).alias("tier_no")
    return events.groupBy("job_id").agg(last).select("job_id", "tier_no", F.try_element_at(labels, F.col("tier_no")).alias("label"))


def job_elapsed(events: DataFrame, now: Column) -> DataFrame:
    """(job_id, elapsed_s): whole seconds from the first event to ``completed``, else to ``now``."""
    done = F.max(F.when(F.col("type") == "completed", F.col("timestamp")))
    spans = events.groupBy("job_id").agg(F.min("timestamp").alias("_start"), done.alias("_done"))
    micros = F.unix_micros(F.coalesce("_done", now)) - F.unix_micros("_start")
    return spans.select("job_id", F.floor(micros / 1_000_000).alias("elapsed_s"))


def dedupe_completed(events: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """One ``completed`` event per job; other events pass."""
    done, others = events.filter(F.col("type") == "completed"), events.filter(F.col("type") != "completed")
    if events.isStreaming:
        return others.unionByName(done.dropDuplicatesWithinWatermark(["job_id", "type"]))
    first = done.groupBy("job_id").agg(F.min_by(F.struct(*events.columns), _order(tie)).alias("_e"))
    return others.unionByName(first.select("_e.*"))


def job_state(events: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """(id, status, progress, error, total_urls, created_at, updated_at) folded from events.

    ``completed`` ends a job; so does an ``error`` that belongs to no tier and no URL.
    Errors of one tier or one fetch leave it running.
    """
    kind = F.col("type")
    fatal = (kind == "error") & (F.coalesce("tier", F.lit("")) == "") & (F.coalesce("url", F.lit("")) == "")
    ends = F.when(kind == "completed", "completed").when(fatal, "failed")
    text = F.nullif(F.col("progress"), F.lit(""))
    folded = events.groupBy("job_id").agg(
        _last(ends, F.lit(True), tie).alias("_end"),
        F.max(F.when(ends.isNotNull(), F.col("timestamp"))).alias("_ended"),
        _last(text, F.lit(True), tie).alias("progress"),
        _last(F.col("error"), fatal, tie).alias("_error"),
        _last(F.col("total"), kind == "completed", tie).alias("total_urls"),
        F.min("timestamp").alias("created_at"),
    )
    status = F.coalesce("_end", F.lit("running"))
    return folded.select(
        F.col("job_id").alias("id"),
        status.alias("status"),
        "progress",
        F.when(status == "failed", F.col("_error")).alias("error"),
        F.when(status == "completed", F.col("total_urls")).alias("total_urls"),
        "created_at",
        F.coalesce("_ended", "created_at").alias("updated_at"),
    )


def update_query(df: DataFrame, batch_function, checkpoint: str, trigger: dict | None = None, mode: str = "update"):
    """Start ``df`` with a ``foreachBatch`` sink. The checkpoint folder must be shared storage on a cluster."""
    writer = df.writeStream.outputMode(mode).foreachBatch(batch_function).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
