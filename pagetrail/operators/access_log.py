"""Request log: what is kept of each entry, and slow requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import client_ip
from ..functions.text import truncate

# Fixed values.
BODY_LIMIT = 500
BODY_MARKER = "... [truncated]"
BODY_METHODS = ["POST", "PUT"]
BODY_PATHS = ["/health", "/jobs"]
SLOW_SECONDS = 5.0


def enrich_access_log(log: DataFrame) -> DataFrame:
    """Adds ``client_ip``; bodies are cut, the request body stays for POST and PUT only, the
    response body for errors and two paths only."""
    keep_request = F.col("method").isin(BODY_METHODS)
    keep_response = (F.col("status") >= 400) | F.col("path").isin(BODY_PATHS)
    return log.withColumns(
        {
            "client_ip": client_ip(F.col("xff"), F.col("x_real_ip"), F.col("remote_addr")),
            "req_body": F.when(keep_request, truncate(F.col("req_body"), BODY_LIMIT, BODY_MARKER)),
            "resp_body": F.when(keep_response, truncate(F.col("resp_body"), BODY_LIMIT, BODY_MARKER)),
        }
    )


def slow_requests(log: DataFrame, seconds: float = SLOW_SECONDS) -> DataFrame:
    return log.filter(F.col("duration_s") > seconds)
