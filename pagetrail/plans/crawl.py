"""The crawl itself: a bounded walk of the link graph, and the tiers around it.

All jobs run at once; ``job_id`` is a key column. Loops go over depth levels only, and
each level is cut by a written table, so plans stay short and a lost executor costs one
level at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import (
    HTML_TIER_BELOW, MAX_URLS_LIMIT, html_tier_enabled, needs_headless_tier, needs_html_tier, sitemap_tier_enabled,
)
from ..functions.urls import canonical_url, host_of, site_hosts, site_root
from ..operators.fallback import first_accessible
from ..operators.links import new_only
from ..operators.ordering import ordinal, truncate_urls
from ..operators.robots import robots_sitemaps
from ..operators.sitemaps import discover_sitemaps, inventory, open_sitemaps, sitemap_documents
from ..session import Buckets, materialize

RESULT_PART = MAX_URLS_LIMIT
HOT_PAGE = 1000  # jobs that read one page at one level, beyond which the page is read in shares
NO_LIMIT = (1 << 31) - 1  # what a null max_urls stands for


def crawl_html(requests: DataFrame, links: DataFrame) -> DataFrame:
    """(job_id, ord, depth, url) from ``requests(job_id, url, depth, max_urls)`` and
    ``links(src, pos, dst)``, breadth first in the order (depth, parent, position).

    The seed is read at depth 1 and listed only when linked. A URL found at depth d is
    followed while d < ``depth``. A job stops at ``max_urls`` (null: no limit); the URL that reaches the
    cap is listed and nothing after it is read.
    """
    return walk(requests, links).urls


@dataclass(frozen=True)
class Walk:
    """Outcome of :func:`walk`. ``urls``: job_id, ord, depth, url as :func:`crawl_html`; ``visits``: job_id, page_count,
    depth, url of the pages that were read, in the order of ``page_count`` 1, 2, ...; ``largest``: URLs of the largest job."""

    urls: DataFrame
    visits: DataFrame
    largest: int


def walk(requests: DataFrame, links: DataFrame) -> Walk:
    """:func:`crawl_html` with the pages it read. A page counts when it is asked for, whether or not it is stored."""
    limits = requests.select(
        "job_id",
        canonical_url(F.col("url")).alias("url"),
        F.greatest(F.coalesce("depth", F.lit(1)), F.lit(1)).alias("_depth"),
        F.coalesce("max_urls", F.lit(NO_LIMIT)).alias("_max"),
    ).filter((F.col("_max") > 0) & F.col("url").isNotNull())
    seeds, info = materialize(
        limits.withColumns(
            {
                "_site": site_hosts(F.col("url")),
                "_path": F.expr("cast(array() as array<int>)"),
                "_listed": F.lit(0).cast("bigint"),
            }
        ),
        deepest=F.max("_depth"),
    )
    found, largest = None, 0
    if info["rows"]:
        # written once, so that a level neither parses pages nor takes addresses apart, and in the buckets a level asks for
        by_host = Buckets(links.sparkSession, "src", "host")
        by_host.append(links.select("src", "pos", "dst", host_of(F.col("dst")).alias("host")))
        found, largest = _levels(seeds, info["rows"], by_host, info["deepest"])
        by_host.forget()
    if found is None:
        empty = seeds.limit(0)
        urls = empty.select("job_id", F.col("_listed").alias("ord"), F.col("_depth").alias("depth"), "url")
        return Walk(urls, empty.select("job_id", F.col("_listed").alias("page_count"), F.col("_depth").alias("depth"), "url"), 0)
    return Walk(found.select("job_id", "ord", "depth", "url"), _visits(seeds, found), largest)


def _visits(seeds: DataFrame, found: DataFrame) -> DataFrame:
    """Pages read: the seed, then what was listed in its order, down to the job's depth and to the page whose link filled
    the job. A seed that is linked is not read again."""
    parent = F.slice("_path", 1, F.size("_path") - 1)
    filled = found.filter(F.col("ord") == F.col("_max")).select("job_id", parent.alias("_path"))
    pages = found.select("job_id", "_path", F.col("ord").alias("_page"))
    last = filled.join(pages, ["job_id", "_path"], "left").select("job_id", F.coalesce("_page", F.lit(0)).alias("_last"))
    again = found.select("job_id", "url", F.col("ord").alias("_again")).join(seeds.select("job_id", "url"), ["job_id", "url"])
    ends = last.join(again.select("job_id", "_again"), "job_id", "full_outer")
    rows = found.filter(F.col("depth") < F.col("_depth")).join(ends, "job_id", "left")
    read = rows.filter((F.col("_last").isNull() | (F.col("ord") <= F.col("_last"))) & (F.col("_again").isNull() | (F.col("ord") != F.col("_again"))))
    number = F.col("ord") + 1 - F.coalesce((F.col("_again") < F.col("ord")).cast("int"), F.lit(0))
    first = seeds.select("job_id", F.lit(1).cast("bigint").alias("page_count"), F.lit(1).alias("depth"), "url")
    return first.unionByName(read.select("job_id", number.alias("page_count"), (F.col("depth") + 1).alias("depth"), "url"))


def pages_per_job(visits: DataFrame) -> DataFrame:
    """(job_id, n_pages): pages read."""
    return visits.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_pages"))


def _levels(seeds: DataFrame, at_most: int, links: Buckets, deepest: int) -> tuple[DataFrame, int]:
    """The listed URLs of all levels, and the URL count of the largest job. One table in buckets of (job_id, url) is the
    result, what is known, and the frontier in one; a level moves the frontier and what it found, nothing that lies there."""
    listed, largest = Buckets(seeds.sparkSession, "job_id", "url", by="depth"), 0
    frontier, known = seeds, None
    for depth in range(1, deepest + 1):
        level = _admit(_found(frontier, links.table(), known, at_most)).withColumn("depth", F.lit(depth))
        seen = listed.append(level, largest=F.max("_listed"))
        if not seen["rows"]:
            break
        largest, at_most = max(largest, seen["largest"]), seen["rows"]
        known = listed.table()
        # The URL that reaches the cap ends its job.
        frontier = known.filter((F.col("depth") == depth) & (F.col("_listed") < F.col("_max")) & (F.col("_depth") > depth))
    rows = listed.rows()
    listed.forget()
    return rows, largest


def _found(frontier: DataFrame, links: DataFrame, known: DataFrame | None, at_most: int) -> DataFrame:
    """New URLs on the pages of ``frontier``, each with its first path."""
    found = _read_pages(frontier, links, at_most).groupBy("job_id", F.col("dst").alias("url")).agg(
        F.min(F.array_append("_path", F.col("pos"))).alias("_path"),
        *[F.any_value(c).alias(c) for c in ("_depth", "_max", "_site", "_listed")],
    )
    return found if known is None else new_only(found, known)


def _read_pages(frontier: DataFrame, links: DataFrame, at_most: int) -> DataFrame:
    """Frontier rows with the links of their page to the hosts of their job. The links of a
    page that very many jobs read at once are copied, and each copy serves its share of them.
    The frontier has ``at_most`` rows, so only beyond ``HOT_PAGE`` can there be such a page."""
    readers = frontier.drop("ord", "depth").withColumn("host", F.explode("_site")).withColumnRenamed("url", "src")
    on = ["src", "host"]
    if at_most <= HOT_PAGE:
        return readers.join(links, on)
    jobs = readers.groupBy(*on).agg(F.count(F.lit(1)).alias("_jobs"))
    hot, seen = materialize(
        jobs.filter(F.col("_jobs") > HOT_PAGE).select(*on, F.ceil(F.col("_jobs") / HOT_PAGE).cast("int").alias("_shares"))
    )
    if not seen["rows"]:
        return readers.join(links, on)
    # links stay in their buckets: the few of hot pages are copied, the others joined as they lie
    shared = readers.join(hot, on).withColumn("_share", F.pmod(F.hash("job_id"), F.col("_shares"))).drop("_shares")
    pages, _ = materialize(links.join(hot, on))
    copies = F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share")
    together = shared.join(pages.select(*links.columns, copies), [*on, "_share"]).drop("_share")
    return readers.join(hot, on, "left_anti").join(links, on).unionByName(together)


def _admit(found: DataFrame) -> DataFrame:
    """Numbers what a level found after what the job lists already, drops what is over the job's cap, and counts it
    all in ``_listed``. No job is ever gathered in one task."""
    ranked = ordinal(found, ["job_id"], ["_path"], "_rank").filter(F.col("_rank") <= F.col("_max") - F.col("_listed"))
    counts = ranked.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(counts, "job_id").select(
        "job_id", "url", "_path", "_depth", "_max", "_site",
        (F.col("_listed") + F.col("_rank")).alias("ord"),
        (F.col("_listed") + F.col("_n")).alias("_listed"),
    )


@dataclass(frozen=True)
class Crawl:
    """Outcome of :func:`crawl_tiers`.

    ``jobs``: job_id, status, error, target_url, success, flags and settings;
    ``urls``: job_id, ord, url, tier after the URL limit; ``stats``: per-job tier counts
    before it; ``sitemaps``: job_id, ord, url; ``documents``: the sitemap documents of each job as
    :func:`..operators.sitemaps.sitemap_documents` gives them; ``html``: job_id, ord, depth, url; ``visits``: pages read.
    """

    jobs: DataFrame
    urls: DataFrame
    stats: DataFrame
    sitemaps: DataFrame
    documents: DataFrame
    html: DataFrame
    visits: DataFrame


def crawl_tiers(requests: DataFrame, fetches: DataFrame, robots: DataFrame, docs: DataFrame, links: DataFrame) -> Crawl:
    """URL inventory of every job: sitemaps first, then HTML links where they gave too few.

    A job whose addresses all fail is saved by the sitemaps of its robots.txt, else it
    fails. Which tiers run is a flag per job, so all jobs share each Spark job.
    """
    flags = [F.col(c) for c in ("enable_sitemap", "enable_html", "enable_headless")]
    probe = first_accessible(requests.select("url"), fetches)
    judged, _ = materialize(requests.withColumnRenamed("url", "original_url").join(probe, "original_url"))
    # Only sites of failed jobs are looked up; one row per robots line of such a site.
    saved_by, _ = materialize(
        judged.filter(~F.col("success"))
        .select("job_id", site_root(F.col("original_url")).alias("base_url"))
        .join(robots_sitemaps(robots, "absolute"), "base_url")
        .select("job_id", "pos", "url")
    )
    saved = saved_by.select("job_id").distinct().withColumn("_saved", F.lit(True))
    alive = F.col("success") | F.col("saved")
    jobs = judged.join(saved, "job_id", "left").withColumn("saved", F.coalesce("_saved", F.lit(False)))
    jobs = jobs.withColumns(
        {
            "target_url": F.col("fallback_url"),
            "use_sitemap": alive & sitemap_tier_enabled(*flags),
            "want_html": alive & html_tier_enabled(*flags),
            "failed": ~alive,
            "status": F.when(alive, "completed").otherwise("failed"),
        }
    ).drop("_saved", "fallback_url")
    tier1 = jobs.filter("use_sitemap").select("job_id", F.col("target_url").alias("url"))
    sitemaps, _ = materialize(
        discover_sitemaps(tier1, fetches, robots, saved_by.join(tier1, "job_id", "left_semi"))
    )
    opened = open_sitemaps(sitemaps.select("url").distinct(), docs)
    # a job keeps max_urls of them; where there are few, all are needed to tell which links are new
    limit = F.when(F.col("max_urls") > 0, F.greatest("max_urls", F.lit(HTML_TIER_BELOW)))
    found = inventory(sitemaps, opened, requests.select("job_id", limit.alias("limit")))
    listed, n_listed = found.urls, found.counts.withColumnRenamed("n_urls", "sitemap_urls")
    jobs, _ = materialize(
        jobs.join(n_listed, "job_id", "left")
        .withColumn("sitemap_urls", F.coalesce("sitemap_urls", F.lit(0)))
        .withColumn("use_html", F.col("want_html") & needs_html_tier(F.col("sitemap_urls")))
        .withColumn("headless_hint", needs_headless_tier(F.col("sitemap_urls")))
    )
    # A job saved by robots.txt has no address to read HTML from.
    tier2 = jobs.filter(F.col("use_html") & F.col("success"))
    walked = walk(tier2.select("job_id", F.col("target_url").alias("url"), "depth", "max_urls"), links)
    added = ordinal(new_only(walked.urls, listed).select("job_id", "url", "ord"), ["job_id"], ["ord"], "_n", walked.largest)
    added = added.join(jobs.select("job_id", "sitemap_urls"), "job_id").select(
        "job_id", (F.col("sitemap_urls") + F.col("_n")).alias("ord"), "url", F.lit("html").alias("tier")
    )
    merged = listed.select("job_id", "ord", "url", F.lit("sitemap").alias("tier")).unionByName(added)
    return Crawl(
        jobs=jobs,
        urls=truncate_urls(merged, requests),
        stats=_stats(jobs.filter(~F.col("failed")), added),
        sitemaps=sitemaps,
        documents=sitemap_documents(sitemaps, opened),
        html=walked.urls,
        visits=walked.visits,
    )


def _stats(jobs: DataFrame, added: DataFrame) -> DataFrame:
    """As :func:`tier_stats`, where sitemap URLs are counted already and need not be unfolded."""
    n_added = added.groupBy("job_id").agg(F.count(F.lit(1)).alias("html_urls"))
    counted = jobs.select("job_id", "sitemap_urls").join(n_added, "job_id", "left").withColumn("html_urls", F.coalesce("html_urls", F.lit(0)))
    used = (F.col("sitemap_urls") > 0).cast("int") + (F.col("html_urls") > 0).cast("int")
    return counted.select("job_id", "sitemap_urls", "html_urls", F.lit(0).cast("bigint").alias("headless_urls"), used.alias("total_tiers_used"))


def tier_stats(merged: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, sitemap_urls, html_urls, headless_urls, total_tiers_used), zeros included."""
    by_tier = merged.groupBy("job_id").agg(
        *[F.count_if(F.col("tier") == t).alias(f"{t}_urls") for t in ("sitemap", "html", "headless")]
    )
    counts = ["sitemap_urls", "html_urls", "headless_urls"]
    all_jobs = jobs.select("job_id").join(by_tier, "job_id", "left")
    used = sum((F.coalesce(F.col(c), F.lit(0)) > 0).cast("int") for c in counts)
    return all_jobs.select("job_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], used.alias("total_tiers_used"))


def crawl_result(jobs: DataFrame, urls: DataFrame, per_part: int = RESULT_PART) -> DataFrame:
    """(id, part, target_url, crawled_at, duration_s, total_urls, urls_per_second, settings, urls).

    ``jobs`` holds job_id, target_url, started_at, finished_at, workers, delay and depth.
    A job of up to ``per_part`` URLs is one row; a larger one continues in further parts.
    """
    parts = urls.groupBy("job_id", F.floor((F.col("ord") - 1) / per_part).cast("int").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "url"))).alias("_rows")
    )
    totals = urls.groupBy("job_id").agg(F.count(F.lit(1)).alias("_total"))
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / F.lit(1e6)
    total = F.coalesce("_total", F.lit(0))
    return (
        jobs.join(totals, "job_id", "left")
        .join(parts, "job_id", "left")
        .select(
            F.col("job_id").alias("id"),
            F.coalesce("part", F.lit(0)).alias("part"),
            "target_url",
            F.col("finished_at").alias("crawled_at"),
            seconds.alias("duration_s"),
            total.alias("total_urls"),
            F.try_divide(total, seconds).alias("urls_per_second"),
            F.struct("workers", "delay", "depth").alias("settings"),
            F.coalesce(F.transform("_rows", lambda r: r["url"]), F.expr("cast(array() as array<string>)")).alias("urls"),
        )
    )


# The two message texts that readers of the events take apart (:mod:`..streaming.events`).
TIER_STARTS = "Starting Tier {}: {}"
ADDED = ("added ", " new URLs")


def crawl_event_log(crawl: Crawl, started: DataFrame) -> DataFrame:
    """The events a live crawl would have sent, in ``schemas.CRAWL_EVENT`` form.

    ``started(job_id, started_at)`` gives each job's clock; a step of the job is one
    second after the step before it, and rows inside a step are microseconds apart.
    Sitemap documents come in document order, each when it is read and, if it could be, with what it lists; only a job's own
    sitemaps report errors. Pages come level by level, those of a level before the URLs found on them.
    A finished job sends ``completed`` twice, as its readers expect to have to handle.
    """
    blank = {
        "type": F.lit(None).cast("string"), "url": F.lit(None).cast("string"), "depth": F.lit(None).cast("int"),
        "progress": F.lit(None).cast("string"), "total": F.lit(None).cast("int"), "page_count": F.lit(None).cast("int"),
        "error": F.lit(None).cast("string"), "tier": F.lit(None).cast("string"),
    }

    def rows(source: DataFrame, step: int, type_: str, micro=F.lit(0), **fields) -> DataFrame:
        values = {**blank, "type": F.lit(type_), **fields}
        return source.select(
            "job_id", (F.lit(step) * 1_000_000 + micro).cast("bigint").alias("_at"),
            *[v.cast({"depth": "int", "total": "int", "page_count": "int"}.get(k, "string")).alias(k) for k, v in values.items()],
        )

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    jobs, alive = crawl.jobs, crawl.jobs.filter(~F.col("failed"))
    stats = crawl.stats.select("job_id", "html_urls", "total_tiers_used")
    done = alive.join(stats, "job_id").withColumn("_all", F.col("sitemap_urls") + F.col("html_urls"))
    cut = (F.col("max_urls") > 0) & (F.col("_all") > F.col("max_urls"))
    done = done.withColumn("_left", F.when(cut, F.col("max_urls")).otherwise(F.col("_all")))
    with_html = done.filter(F.col("use_html") & F.col("success"))
    tier1 = alive.filter("use_sitemap")
    none_found = tier1.join(crawl.sitemaps, "job_id", "left_anti")
    some_found = tier1.join(crawl.sitemaps, "job_id", "left_semi")
    numbered = ordinal(crawl.documents, ["job_id"], ["path"], "_n")
    spoilt, own = F.col("reason").isNotNull(), F.size("path") == 1
    lists = text("Sitemap ", F.col("url"), " lists ", F.col("n_kept"), F.when(F.col("is_index"), " sitemaps").otherwise(" URLs"))
    pages, found = _by_level(crawl.visits, crawl.html)
    # The URL that reaches the cap is listed but not announced.
    announced = found.join(jobs.select("job_id", "max_urls"), "job_id").filter(F.col("ord") < F.coalesce("max_urls", F.lit(NO_LIMIT)))
    sitemap = {"tier": F.lit("sitemap")}
    html = {"tier": F.lit("html")}
    parts = [
        rows(jobs, 0, "progress", progress=F.lit("Crawl begins")),
        rows(jobs.filter("failed"), 1, "error", progress=text("No address of the site answers: ", F.coalesce("error", F.lit(""))), error=F.col("error")),
        rows(jobs.filter("saved"), 1, "progress", progress=F.lit("No address answers, going on with the sitemaps of robots.txt"), **sitemap),
        rows(
            alive.filter(F.col("target_url") != F.col("original_url")), 1, "progress",
            progress=text("Reading ", F.col("target_url"), " in place of ", F.col("original_url")),
        ),
        rows(tier1, 2, "tier_switch", progress=F.lit(TIER_STARTS.format(1, "sitemaps")), **sitemap),
        rows(crawl.sitemaps, 3, "sitemap_discovered", F.col("ord"), url=F.col("url"), progress=text("Sitemap at ", F.col("url")), **sitemap),
        rows(none_found, 3, "progress", progress=F.lit("The site has no sitemaps"), **sitemap),
        rows(numbered, 4, "progress", 2 * F.col("_n") - 1, progress=text("Reading sitemap ", F.col("url")), **sitemap),
        rows(
            numbered.filter(~spoilt), 4, "progress", 2 * F.col("_n"), progress=lists,
            total=F.when(~F.col("is_index"), F.nullif(F.col("n_kept"), F.lit(0))), **sitemap,
        ),
        rows(
            numbered.filter(spoilt & own), 4, "error", 2 * F.col("_n"),
            progress=text("Sitemap ", F.col("url"), " cannot be read: ", F.col("reason")), error=F.col("reason"), **sitemap,
        ),
        rows(
            some_found, 5, "progress", progress=text("Sitemaps read, ", F.col("sitemap_urls"), " different URLs"),
            total=F.nullif(F.col("sitemap_urls"), F.lit(0)), **sitemap,
        ),
        rows(alive.filter("use_html"), 6, "tier_switch", progress=F.lit(TIER_STARTS.format(2, "links of pages")), **html),
        rows(alive.filter(F.col("use_html") & ~F.col("success")), 7, "error", progress=text("Links cannot be read: ", F.col("error")), error=F.col("error"), **html),
        rows(pages, 7, "progress", F.col("_micro"), progress=text("Reading page ", F.col("page_count"), " at depth ", F.col("depth"), ": ", F.col("url")), page_count=F.col("page_count")),
        rows(announced, 7, "url_discovered", F.col("_micro"), url=F.col("url"), depth=F.col("depth"), total=F.col("ord")),
        rows(
            with_html, 8, "progress",
            progress=text("Links of pages ", ADDED[0], F.col("html_urls"), ADDED[1], ", ", F.col("_all"), " in all"),
            total=F.nullif(F.col("_all"), F.lit(0)), **html,
        ),
        rows(done.filter(F.col("_left") < F.col("_all")), 9, "progress", progress=text("Kept the first ", F.col("max_urls"), " URLs, as asked for")),
        rows(done, 10, "completed", progress=text(F.col("_left"), " URLs by ", F.col("total_tiers_used"), " tiers"), total=F.nullif(F.col("_left"), F.lit(0))),
        rows(done, 10, "completed", F.lit(1), progress=text("Crawl ends with ", F.col("_left"), " URLs"), total=F.nullif(F.col("_left"), F.lit(0))),
    ]
    log = parts[0]
    for p in parts[1:]:
        log = log.unionByName(p)
    clock = F.timestamp_micros(F.unix_micros("started_at") + F.col("_at"))
    return log.join(started.select("job_id", "started_at"), "job_id").select(
        "type", "job_id", "url", "depth", "progress", clock.alias("timestamp"), "total", "page_count", "error", "tier"
    )


def _by_level(visits: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``visits`` and ``found`` with ``_micro``: their places in one sequence per job, level by level, pages first."""
    n_pages = visits.groupBy("job_id", "depth").agg(F.count(F.lit(1)).alias("_pages"))
    n_urls = found.groupBy("job_id", "depth").agg(F.count(F.lit(1)).alias("_urls"))
    # one row for a job and level
    so_far = Window.partitionBy("job_id").orderBy("depth")
    counts = n_pages.join(n_urls, ["job_id", "depth"], "full_outer").select(
        "job_id", "depth", F.sum(F.coalesce("_pages", F.lit(0))).over(so_far).alias("_pages"),
        (F.sum(F.coalesce("_urls", F.lit(0))).over(so_far) - F.coalesce("_urls", F.lit(0))).alias("_urls"),
    )
    placed = lambda df, micro: df.join(counts, ["job_id", "depth"]).withColumn("_micro", micro).drop("_pages", "_urls")
    return placed(visits, F.col("page_count") + F.col("_urls")), placed(found, F.col("ord") + F.col("_pages"))
