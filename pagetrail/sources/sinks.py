"""Results, events and job states to storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CRAWL_EVENT
from .job_log import JobLog


def write_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Append crawl results; the executors write, one file per partition."""
    df.write.mode("append").format(fmt).save(path)


def result_json(results: DataFrame) -> DataFrame:
    """(id, body): each result row as one JSON text."""
    return results.select("id", F.to_json(F.struct(*results.columns)).alias("body"))


def event_envelope(events: DataFrame) -> DataFrame:
    """(routing_key, body) per event. Zero counts and empty texts are left out of the body."""
    kept = []
    for field in CRAWL_EVENT.fields:
        value = F.col(field.name)
        if field.name not in ("type", "job_id", "timestamp"):
            value = F.nullif(value, F.lit("") if field.dataType.simpleString() == "string" else F.lit(0))
        kept.append(value.alias(field.name))
    body = F.to_json(F.struct(*kept), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return events.select(F.concat(F.lit("crawler."), F.col("job_id"), F.lit("."), F.col("type")).alias("routing_key"), body.alias("body"))


def append_job_updates(path: str):
    """``foreachBatch`` function: each micro-batch adds its job updates to the :class:`.job_log.JobLog` under ``path``."""

    def run(updates: DataFrame, batch_id: int) -> None:
        JobLog(updates.sparkSession, path).append(updates, batch_id)

    return run


def current_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The job table as of all updates appended so far: last update wins per field."""
    return JobLog(spark, path).current()
