"""The job table: upserts, look-ups, listings, expiry and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import job_status_filter

DEFAULT_LIST_LIMIT = 10
TTL_SECONDS = 86400
INTERRUPTED = "Job interrupted by server restart"


def upsert_jobs(base: DataFrame, updates: DataFrame, key: str = "id", version: str = "updated_at") -> DataFrame:
    """One row per id: for each field the newest set value. Null or empty text means
    "not set", so the older value stays."""
    rows = base.unionByName(updates)

    def newest(name: str) -> Column:
        value = F.col(name)
        if dict(rows.dtypes)[name] == "string":
            value = F.nullif(value, F.lit(""))
        return F.max_by(value, F.when(value.isNotNull(), F.col(version))).alias(name)

    fields = [c for c in rows.columns if c not in (key, version, "created_at")]
    created = [F.min("created_at").alias("created_at")] if "created_at" in rows.columns else []
    merged = rows.groupBy(key).agg(*[newest(f) for f in fields], *created, F.max(version).alias(version))
    return merged.select(*rows.columns)


def job_lookup(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("id") == job_id)


def lookup_jobs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Many look-ups at once: the jobs whose id is in ``ids(id)``."""
    return jobs.join(ids.select("id").distinct(), "id", "left_semi").select(*jobs.columns)


def reject_duplicate_jobs(requests: DataFrame, jobs: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicts): a caller's job_id that is known already is a conflict, and so is one that an earlier
    request of the batch has taken. ``order`` names the columns of arrival, unique per request. No job_id, no conflict."""
    known = jobs.select(F.col("id").alias("job_id"), F.lit(True).alias("_known")).distinct()
    first = requests.groupBy("job_id").agg(F.min(F.struct(*order)).alias("_first"))
    marked = requests.join(known, "job_id", "left").join(first, "job_id", "left")
    taken = F.coalesce("_known", F.lit(False)) | ~F.struct(*order).eqNullSafe(F.col("_first"))
    clash = F.col("job_id").isNotNull() & taken
    return marked.filter(~clash).select(*requests.columns), marked.filter(clash).select(*requests.columns)


def parse_limit(text: str | None) -> int:
    """Row limit of a listing; 10 when the text is no number."""
    try:
        return int(text) if text else DEFAULT_LIST_LIMIT
    except ValueError:
        return DEFAULT_LIST_LIMIT


def recent_jobs(jobs: DataFrame, limit: int | str | None = DEFAULT_LIST_LIMIT, status: str | None = None) -> DataFrame:
    """Newest jobs first. 0 means no limit, and the sign does not count."""
    n = abs(limit if isinstance(limit, int) else parse_limit(limit))
    newest = jobs.filter(job_status_filter(F.col("status"), status)).orderBy(F.desc("created_at"), "id")
    return newest.limit(n) if n else newest


def jobs_summary(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n_jobs"))


def expire_jobs(jobs: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Jobs created within the last ``ttl_seconds``."""
    return jobs.filter(F.col("created_at") > now - F.make_dt_interval(secs=F.lit(float(ttl_seconds)).cast("decimal(18,6)")))


def recover_jobs(jobs: DataFrame, restart_ts: Column) -> DataFrame:
    """After a restart: jobs still running have failed."""
    running = F.col("status") == "running"
    return jobs.withColumns(
        {
            "error": F.when(running, INTERRUPTED).otherwise(F.col("error")),
            "updated_at": F.when(running, restart_ts).otherwise(F.col("updated_at")),
            "status": F.when(running, "failed").otherwise(F.col("status")),
        }
    )
