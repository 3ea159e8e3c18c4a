"""Raw inputs to typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import (
    DEFAULT_DELAY, DEFAULT_DEPTH, DEFAULT_HEADLESS_TIMEOUT, DEFAULT_MAX_URLS, DEFAULT_WORKERS, MAX_URLS_LIMIT,
    is_html, valid_job_id, zero_default,
)
from ..functions.urls import site_root
from ..schemas import CONTENT_REQUEST, CRAWL_EVENT, CRAWL_REQUEST
from .unpack import MAGIC, UNPACKED, unpack_array

FLAGS = ["enable_sitemap", "enable_html", "enable_headless", "wait_for_js"]
GZIP = "gzip"


def with_defaults(requests: DataFrame) -> DataFrame:
    """Zero and missing settings get their defaults; ``max_urls`` is capped. Negatives pass."""
    max_urls = F.least(zero_default(F.col("max_urls"), DEFAULT_MAX_URLS), F.lit(MAX_URLS_LIMIT))
    return requests.withColumns(
        {
            "depth": zero_default(F.col("depth"), DEFAULT_DEPTH),
            "workers": zero_default(F.col("workers"), DEFAULT_WORKERS),
            "delay": zero_default(F.col("delay"), DEFAULT_DELAY),
            "max_urls": max_urls,
            "headless_timeout": zero_default(F.col("headless_timeout"), DEFAULT_HEADLESS_TIMEOUT),
            **{f: F.coalesce(f, F.lit(False)) for f in FLAGS},
        }
    )


def _decode(column: str, schema: T.StructType) -> Column:
    """JSON by a fixed schema; ``_bad`` holds a text that does not fit it."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    return F.from_json(column, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def read_requests(json_df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(requests, rejects) of one JSON request per row. A reject names its reason."""
    decoded = json_df.withColumn("_r", _decode(column, CRAWL_REQUEST))
    malformed = F.col("_r").isNull() | F.col("_r._bad").isNotNull()
    job_id = F.coalesce("_r.job_id", F.lit(""))
    reason = (
        F.when(malformed, "Invalid JSON")
        .when(F.coalesce("_r.url", F.lit("")) == "", "URL is required")
        .when((job_id != "") & ~valid_job_id(job_id), "Invalid job_id format")
    )
    judged = decoded.withColumn("reason", reason)
    others = [c for c in json_df.columns if c != column]
    good = judged.filter(F.col("reason").isNull()).select(*others, "_r.*").drop("_bad")
    return with_defaults(good), judged.filter(F.col("reason").isNotNull()).select(*json_df.columns, "reason")


def content_targets(json_df: DataFrame, column: str = "value", key: str = "req_id") -> DataFrame:
    """(req_id, idx, url): ``urls`` when not empty, else the single ``url``; else no row."""
    decoded = json_df.select(key, F.from_json(column, CONTENT_REQUEST).alias("_r"))
    urls = F.when(F.coalesce(F.size("_r.urls"), F.lit(0)) > 0, F.col("_r.urls")).when(
        F.coalesce("_r.url", F.lit("")) != "", F.array("_r.url")
    )
    return decoded.select(key, F.posexplode_outer(urls).alias("idx", "url")).filter(F.col("url").isNotNull())


def html_pages(fetches: DataFrame) -> DataFrame:
    """Fetches whose body is HTML; the filter runs before any parser sees a body."""
    return fetches.filter(is_html(F.col("content_type")))


def sitemap_docs(fetches: DataFrame) -> DataFrame:
    """(url, status_code, body) of sitemap fetches with status 200."""
    return fetches.filter(F.col("status_code") == 200).select("url", "status_code", "body")


def unpack_sitemaps(fetches: DataFrame) -> DataFrame:
    """(url, status_code, body, reason, place) of sitemap fetches with status 200 and ``body`` as bytes.

    Gzip is told by the header, or by the first two bytes where the header is missing. Of a broken gzip body the text
    before the first byte that does not fit is kept, ``reason`` says what is wrong and ``place`` is that byte. Bytes that
    are not UTF-8 become U+FFFD.
    """
    ok = fetches.filter(F.col("status_code") == 200)
    packed = (F.lower(F.coalesce(F.col("headers")["Content-Encoding"], F.lit(""))) == GZIP) | (
        F.hex(F.substring("body", 1, 2)) == MAGIC.hex().upper()
    )
    unpacked = ok.withColumn("_u", F.arrow_udf(unpack_array, UNPACKED)(F.when(packed, F.col("body"))))
    plain = F.make_valid_utf8(F.col("body").cast("string"))
    body = F.when(F.col("_u").isNotNull(), F.col("_u.body")).otherwise(plain)
    return unpacked.select("url", "status_code", body.alias("body"), F.col("_u.reason").alias("reason"), F.col("_u.place").alias("place"))


def sitemap_docs_binary(fetches: DataFrame) -> DataFrame:
    """As :func:`sitemap_docs` for ``body`` as bytes, gzip or not."""
    return unpack_sitemaps(fetches).select("url", "status_code", "body")


def gzip_rejects(fetches: DataFrame) -> DataFrame:
    """(url, reason, place, n_chars): the gzip bodies that are broken, and how much text comes before the bad spot."""
    broken = unpack_sitemaps(fetches).filter(F.col("reason").isNotNull())
    return broken.select("url", "reason", "place", F.length("body").alias("n_chars"))


def read_sitemap_files(spark: SparkSession, folder: str, base: str | None = None) -> DataFrame:
    """Fetches (url, status_code, headers, body as bytes) for :func:`unpack_sitemaps`, of all files below ``folder``.

    With ``base``, a file's url is its place below ``folder`` put after ``base``, so that the files of a mirrored site are
    found by the addresses their indexes list; else the url is the file's own address.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    own = F.col("_metadata.file_path")
    if base is not None:
        # addresses of files differ in the slashes after the scheme
        plain = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
        top = plain(F.lit(folder.rstrip("/")))
        own = F.concat(F.lit(base.rstrip("/")), F.substr(plain(own), F.length(top) + 1))
    empty = F.lit(None).cast("map<string,string>")
    return files.select(own.alias("url"), F.lit(200).alias("status_code"), empty.alias("headers"), F.col("content").alias("body"))


def robots_docs(fetches: DataFrame) -> DataFrame:
    """(base_url, body) of robots.txt fetches with status 200."""
    is_robots = F.col("url") == F.concat(site_root(F.col("url")), F.lit("/robots.txt"))
    return fetches.filter((F.col("status_code") == 200) & is_robots).select(site_root(F.col("url")).alias("base_url"), "body")


def decode_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Every raw row with its event in ``event``; null when the text is malformed. Works on
    batch and streaming DataFrames alike."""
    decoded = raw.withColumn("_e", _decode(column, CRAWL_EVENT))
    ok = F.col("_e").isNotNull() & F.col("_e._bad").isNull()
    event = F.struct(*[F.col(f"_e.{f}").alias(f) for f in CRAWL_EVENT.fieldNames()])
    return decoded.withColumn("event", F.when(ok, event)).drop("_e")


def read_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Well-formed events; the rest is dropped."""
    return decode_events(raw, column).filter(F.col("event").isNotNull()).select("event.*")


def dead_letters(raw: DataFrame, column: str = "value") -> DataFrame:
    return decode_events(raw, column).filter(F.col("event").isNull()).drop("event")


def stream_event_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Raw JSON event lines from a growing folder. ``max_files`` is the back-pressure."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def stream_event_topic(spark: SparkSession, servers: str, topic: str, max_offsets: int = 1_000_000) -> DataFrame:
    """Raw JSON events from Kafka; needs Spark's Kafka package on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
        .select(F.col("value").cast("string").alias("value"))
    )
