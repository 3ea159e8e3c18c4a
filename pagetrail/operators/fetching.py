"""What to fetch when, and a look at what came back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import DEFAULT_WORKERS, duration_seconds
from ..functions.html import parse_links
from ..functions.text import truncate
from ..session import spread
from .ordering import ordinal

PREVIEW_BYTES = 200


def fetch_plan(urls: DataFrame, requests: DataFrame, max_group: int | None = None) -> DataFrame:
    """(job_id, url, slot, earliest_s) from ``urls(job_id, ord, url)``: URLs go to ``workers``
    slots in turn, and a slot starts one URL per ``delay``."""
    numbered = ordinal(urls.select("job_id", "ord", "url"), ["job_id"], ["ord"], "_n", max_group)
    pace = requests.select(
        "job_id",
        F.greatest(F.coalesce("workers", F.lit(DEFAULT_WORKERS)), F.lit(1)).alias("_workers"),
        duration_seconds(F.coalesce("delay", F.lit(""))).alias("_delay"),
    )
    n = F.col("_n") - 1
    return numbered.join(pace, "job_id").select(
        "job_id", "url", (n % F.col("_workers")).alias("slot"),
        (F.floor(n / F.col("_workers")) * F.col("_delay")).alias("earliest_s"),
    )


def fetch_preview(fetches: DataFrame) -> DataFrame:
    """(url, n_bytes, status_code, content_type, preview, n_links) per fetch."""
    return spread(fetches).select(
        "url",
        F.octet_length("body").alias("n_bytes"),
        "status_code",
        "content_type",
        truncate(F.col("body"), PREVIEW_BYTES).alias("preview"),
        F.coalesce(F.size(parse_links(F.col("body"))["links"]), F.lit(0)).alias("n_links"),
    )
