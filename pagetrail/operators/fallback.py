"""Which address of a site answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import access_error, is_accessible
from ..functions.urls import fallback_urls

NOT_FETCHED = "no fetch recorded"


def probes(fetches: DataFrame) -> DataFrame:
    """(url, ok, error) of the first recorded attempt per URL."""
    first = F.min(F.struct("tier", "attempt", "status_code", "error")).alias("_f")
    status, error = F.col("_f.status_code"), F.col("_f.error")
    return (
        fetches.groupBy("url")
        .agg(first)
        .select(
            "url",
            ((F.coalesce(error, F.lit("")) == "") & is_accessible(status)).alias("ok"),
            access_error(status, error).alias("error"),
        )
    )


def first_accessible(urls: DataFrame, fetches: DataFrame) -> DataFrame:
    """(original_url, fallback_url, success, error), one row per distinct ``urls.url``.

    The original is tried first, then its alternatives in order. When none answers the
    original stays, with its own error; that error is also kept when an alternative answers.
    """
    originals = urls.select(F.col("url").alias("original_url")).distinct()
    tried = originals.select(
        "original_url",
        F.posexplode(F.concat(F.array("original_url"), fallback_urls(F.col("original_url")))).alias("pos", "candidate"),
    )
    seen = tried.join(probes(fetches).withColumnRenamed("url", "candidate"), "candidate", "left")
    ok = F.coalesce(F.col("ok"), F.lit(False))
    error = F.when(ok, F.lit(None)).otherwise(F.coalesce("error", F.lit(NOT_FETCHED)))
    best = seen.groupBy("original_url").agg(
        F.min_by("candidate", F.when(ok, F.col("pos"))).alias("found"),
        F.bool_or(ok).alias("success"),
        F.max(F.when(F.col("pos") == 0, error)).alias("error"),
    )
    return best.select(
        "original_url", F.coalesce("found", "original_url").alias("fallback_url"), "success", "error"
    )
