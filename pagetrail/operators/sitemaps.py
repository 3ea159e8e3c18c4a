"""Sitemaps: discovery, parsing, and the URLs they list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import sitemap_exists
from ..functions.sitemap_xml import ROOTS, SCANNED, scan_array
from ..functions.urls import SITEMAP_PATHS, site_root, sitemap_candidates
from ..schemas import SITEMAP_DOC
from ..session import materialize, spread
from .ordering import first_seen_distinct, prefix_sum
from .robots import robots_sitemaps

#: Local names count, whatever prefix a file gives them.
XML = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "columnNameOfCorruptRecord": "_bad"}
#: Begins like a sitemap; what does not is looked at by :mod:`..functions.sitemap_xml`.
SITEMAP_ROOT = (
    r"^\uFEFF?(?:\s++|<\?(?s:.*?)\?>|<!--(?s:.*?)-->|<!DOCTYPE[^>\[]*+(?:\[[^\]]*+\])?[^>]*+>)*+"
    rf"<(?:[^\s<>/:]++:)?(?:{'|'.join(ROOTS)})[\s/>]"
)
NO_BODY, MISSING = "no body", "not fetched"
#: Rounds of the expansion after which their results are made one table.
FOLD = 8
#: Jobs that are served by one copy of what they share, and what stands for no limit.
SHARE, NO_LIMIT = 1000, 1 << 62


def existing_sitemaps(candidates: DataFrame, fetches: DataFrame) -> DataFrame:
    """Candidates whose address answered 200; all their columns, order columns included, stay."""
    ok = fetches.filter(sitemap_exists(F.col("status_code"))).select("url").distinct()
    return candidates.join(ok, "url", "left_semi").select(*candidates.columns)


def discover_sitemaps(
    requests: DataFrame, fetches: DataFrame, robots: DataFrame, fallback: DataFrame | None = None
) -> DataFrame:
    """(job_id, ord, url): where each job's sitemaps are; duplicates stay.

    The usual places come first, then the robots.txt lines as written; both are checked.
    A job found in ``fallback(job_id, pos, url)`` uses that list alone, unchecked.
    """
    jobs = requests.select("job_id", "url")
    if fallback is not None:
        jobs = jobs.join(fallback.select("job_id").distinct(), "job_id", "left_anti")
    usual = jobs.select("job_id", F.posexplode(sitemap_candidates(F.col("url"))).alias("ord", "url"))
    listed = robots_sitemaps(robots, "raw").select(
        "base_url", (F.col("pos") + len(SITEMAP_PATHS)).alias("ord"), F.col("url")
    )
    listed = jobs.select("job_id", site_root(F.col("url")).alias("base_url")).join(listed, "base_url")
    found = existing_sitemaps(usual.unionByName(listed.select("job_id", "ord", "url")), fetches)
    if fallback is not None:
        found = found.unionByName(fallback.select("job_id", F.col("pos").alias("ord"), "url"))
    return found


def read_sitemap_docs(docs: DataFrame) -> DataFrame:
    """(url, is_index, locs, reason, line, place): every one of ``docs(url, body)`` once.

    A document with children is an index and lists no entries of its own. A ``lastmod`` that is no timestamp does not
    spoil the file. Where a document is not well-formed, or no sitemap at all, ``reason`` says why, ``line`` (from 1) and
    ``place`` (byte, from 0) where, and ``locs`` are those of the entries that end before.
    """
    fields = T.StructType([*SITEMAP_DOC.fields, T.StructField("_bad", T.StringType())])
    parsed = spread(docs.select("url", "body")).withColumn("_d", F.from_xml("body", fields, XML))
    broken = F.col("body").isNotNull() & (~F.col("body").rlike(SITEMAP_ROOT) | F.col("_d._bad").isNotNull())
    scanned = parsed.withColumn("_r", F.arrow_udf(scan_array, SCANNED)(F.when(broken, F.col("body"))))
    is_index = F.coalesce(F.size("_d.sitemap"), F.lit(0)) > 0
    locs = F.when(is_index, F.col("_d.sitemap.loc")).otherwise(F.col("_d.url.loc"))
    spoilt = F.col("_r").isNotNull()
    return scanned.select(
        "url",
        F.when(spoilt, F.col("_r.is_index")).otherwise(is_index).alias("is_index"),
        F.when(spoilt, F.col("_r.locs")).otherwise(locs).alias("locs"),
        F.when(F.col("body").isNull(), NO_BODY).otherwise(F.col("_r.reason")).alias("reason"),
        F.col("_r.line").alias("line"),
        F.col("_r.place").alias("place"),
    )


def listing(read: DataFrame) -> DataFrame:
    """(url, is_index, pos, loc) of documents as :func:`read_sitemap_docs` gives them."""
    rows = read.select("url", "is_index", F.posexplode_outer("locs").alias("pos", "loc"))
    return rows.filter(F.coalesce(F.col("loc"), F.lit("")) != "")


def parse_sitemap_docs(docs: DataFrame) -> DataFrame:
    """(url, is_index, pos, loc): what each of ``docs(url, body)`` lists, up to its bad spot if it has one."""
    return listing(read_sitemap_docs(docs))


def _kept() -> Column:
    return F.coalesce(F.size(F.filter("locs", lambda s: F.coalesce(s, F.lit("")) != "")), F.lit(0)).cast("bigint")


def sitemap_errors(docs: DataFrame) -> DataFrame:
    """(url, reason, line, place, n_kept): the documents that could not be read to their end."""
    return _errors(read_sitemap_docs(docs))


def _errors(read: DataFrame) -> DataFrame:
    return read.filter(F.col("reason").isNotNull()).select("url", "reason", "line", "place", _kept().alias("n_kept"))


def expand_sitemap_index(roots: DataFrame, children: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, path, url): the roots and every document below them, each once for a root.

    ``path`` is the list of positions from the root at which the document comes first in document order; sorting by it
    gives that order. Every round follows the children of documents whose path the round before made smaller, and the
    rounds end when none does. A path round a cycle only makes the path to its start longer, so cycles end by themselves,
    and shared children do not multiply. ``max_depth`` bounds the rounds, and with them the length of paths. Runs a job
    for each round.
    """
    start = roots.select(F.col("url").alias("root"), "url", F.expr("cast(array() as array<int>)").alias("path")).distinct()
    edges = children.select(F.col("url").alias("_parent"), "pos", F.col("loc").alias("_child"))
    none = F.lit(None).cast("array<int>")
    rounds, changed, n = [start], start, 0
    while max_depth is None or n < max_depth:
        n += 1
        found = changed.join(edges, changed["url"] == edges["_parent"]).select(
            "root", F.col("_child").alias("url"), F.array_append("path", F.col("pos")).alias("_new"), none.alias("_old")
        )
        known = _union(rounds).select("root", "url", none.alias("_new"), F.col("path").alias("_old"))
        best = found.unionByName(known).groupBy("root", "url").agg(F.min("_new").alias("path"), F.min("_old").alias("_old"))
        smaller = best.filter(F.col("path").isNotNull() & (F.col("_old").isNull() | (F.col("path") < F.col("_old"))))
        changed, seen = materialize(smaller.select("root", "url", "path"))
        if not seen["rows"]:
            break
        rounds.append(changed)
        if len(rounds) > FOLD:
            rounds = [materialize(_smallest(rounds))[0]]
    return _smallest(rounds).select("root", "path", "url")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _smallest(rounds: list[DataFrame]) -> DataFrame:
    return first_seen_distinct(_union(rounds), ["root", "url"], "path")


@dataclass(frozen=True)
class Opened:
    """Outcome of :func:`open_sitemaps`. ``entries``: root, path, loc; ``documents``: root, path, url, is_index, n_kept,
    reason, line, place, where ``reason`` is null for documents that are there and could be read to their end."""

    entries: DataFrame
    documents: DataFrame


def open_sitemaps(roots: DataFrame, docs: DataFrame, max_depth: int | None = None) -> Opened:
    """Every URL listed below each root, in document order of ``path``, and the documents that were opened for it."""
    # XML is parsed once; every round of the expansion then reads the narrow listing.
    read, _ = materialize(read_sitemap_docs(docs))
    listed = listing(read)
    opened = expand_sitemap_index(roots, listed.filter("is_index").drop("is_index"), max_depth)
    opened, _ = materialize(opened)
    entries = listed.filter(~F.col("is_index")).withColumnRenamed("url", "_url")
    rows = opened.join(entries, opened["url"] == entries["_url"]).select(
        "root", F.array_append("path", F.col("pos")).alias("path"), "loc"
    )
    state = read.select(F.col("url").alias("_url"), F.lit(True).alias("_there"), "is_index", _kept().alias("n_kept"), "reason", "line", "place")
    judged = opened.join(state, opened["url"] == state["_url"], "left")
    documents = judged.select(
        "root", "path", "url", F.coalesce("is_index", F.lit(False)).alias("is_index"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"),
        F.when(F.col("_there").isNull(), MISSING).otherwise(F.col("reason")).alias("reason"), "line", "place",
    )
    return Opened(rows, documents)


def parse_sitemaps(roots: DataFrame, docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, path, loc): every URL listed below each root, in document order of ``path``."""
    return open_sitemaps(roots, docs, max_depth).entries


def crawl_sitemaps(
    requests: DataFrame, fetches: DataFrame, robots: DataFrame, docs: DataFrame,
    fallback: DataFrame | None = None, max_depth: int | None = None,
) -> DataFrame:
    """(job_id, ord, url): the distinct URLs of all the job's sitemaps, first place wins.
    No clean-up, skip or same-site rule applies to them."""
    found, _ = materialize(discover_sitemaps(requests, fetches, robots, fallback))
    return sitemap_urls(found, docs, max_depth)


def sitemap_urls(found: DataFrame, docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """As :func:`crawl_sitemaps`, from sitemaps ``found(job_id, ord, url)`` already."""
    return urls_of_sitemaps(found, open_sitemaps(found.select("url").distinct(), docs, max_depth))


def urls_of_sitemaps(found: DataFrame, opened: Opened) -> DataFrame:
    """(job_id, ord, url) of the sitemaps ``found(job_id, ord, url)``, which are among the roots that were opened."""
    return inventory(found, opened).urls


@dataclass(frozen=True)
class Inventory:
    """Outcome of :func:`inventory`. ``urls``: job_id, ord, url; ``counts``: job_id, n_urls, of all different URLs."""

    urls: DataFrame
    counts: DataFrame


def inventory(found: DataFrame, opened: Opened, limits: DataFrame | None = None) -> Inventory:
    """The first URLs of each job's sitemaps, up to the job's ``limits(job_id, limit)``, and how many there are in all.

    Jobs that found the same sitemaps in the same places are one class, and what lies below is merged, counted and numbered
    once for the class. The number of a URL is how many the documents before its own brought first, and its place among
    those its own did; so only documents that begin within the largest limit of a class are numbered, nothing is sorted as a
    whole, and a job's rows are unfolded up to its own limit only.
    """
    lists = found.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ord", "url"))).alias("_roots"))
    jobs = lists.select("job_id", F.sha2(F.to_json("_roots"), 256).alias("_class"), "_roots")
    none = F.lit(NO_LIMIT).cast("bigint")
    if limits is not None:
        jobs = jobs.join(limits.select("job_id", F.col("limit").cast("bigint").alias("_limit")), "job_id", "left")
    else:
        jobs = jobs.withColumn("_limit", none)
    jobs, _ = materialize(jobs.withColumn("_limit", F.coalesce("_limit", none)))
    classes, _ = materialize(
        jobs.groupBy("_class").agg(
            F.any_value("_roots").alias("_roots"), F.max("_limit").alias("_most"), F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("_shares")
        )
    )
    rooted = classes.select(F.col("_class").alias("job_id"), F.inline("_roots"))
    placed = _placed(rooted, opened.entries).select(F.col("job_id").alias("_class"), F.col("loc").alias("url"), "path")
    firsts, _ = materialize(
        first_seen_distinct(placed, ["_class", "url"], "path").withColumn("_doc", F.slice("path", 1, F.size("path") - 1))
    )
    brought, _ = materialize(firsts.groupBy("_class", "_doc").agg(F.count(F.lit(1)).alias("_n")))
    upto = prefix_sum(brought, ["_class"], ["_doc"], "_n", "_upto").withColumn("_before", F.col("_upto") - F.col("_n"))
    needed = upto.join(classes.select("_class", "_most", "_shares"), "_class").filter(F.col("_before") < F.col("_most"))
    # one document's entries meet in a window
    own = F.row_number().over(Window.partitionBy("_class", "_doc").orderBy("path"))
    rows = firsts.join(needed.select("_class", "_doc", "_before", "_most", "_shares"), ["_class", "_doc"])
    rows = rows.withColumn("ord", F.col("_before") + own).filter(F.col("ord") <= F.col("_most"))
    numbered, _ = materialize(rows.select("_class", "ord", "url", "_shares"))
    # the rows of a class that very many jobs have are copied, and each copy serves its share of them
    copies = numbered.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    asking = jobs.join(classes.select("_class", "_shares"), "_class").select(
        "job_id", "_class", "_limit", F.pmod(F.hash("job_id"), F.col("_shares")).alias("_share")
    )
    urls = asking.join(copies, ["_class", "_share"]).filter(F.col("ord") <= F.col("_limit")).select("job_id", "ord", "url")
    totals = brought.groupBy("_class").agg(F.sum("_n").alias("n_urls"))
    return Inventory(urls, jobs.join(totals, "_class").select("job_id", "n_urls"))


def sitemap_documents(found: DataFrame, opened: Opened) -> DataFrame:
    """(job_id, path, url, is_index, n_kept, reason, line, place): every document a job opened, once; of several places in
    its sitemaps the first."""
    placed = _placed(found, opened.documents)
    return first_seen_distinct(placed, ["job_id", "url"], "path", "is_index", "n_kept", "reason", "line", "place").select(*placed.columns)


def sitemap_failures(found: DataFrame, opened: Opened) -> DataFrame:
    """Those of :func:`sitemap_documents` that are missing or could not be read to their end."""
    return sitemap_documents(found, opened).filter(F.col("reason").isNotNull()).drop("is_index")


def _placed(found: DataFrame, below: DataFrame) -> DataFrame:
    """``below(root, path, ...)`` for every job that found the root, the root's place in front of the path."""
    per_job = found.select("job_id", "ord", F.col("url").alias("root")).join(below, "root")
    rest = [c for c in below.columns if c not in ("root", "path")]
    return per_job.select("job_id", F.concat(F.array(F.col("ord").cast("int")), "path").alias("path"), *rest)


def sitemap_counts(docs: DataFrame) -> DataFrame:
    """(url, n_urls, n_sitemaps, reason) per document, zeros included; counted inside the row. Of a document that could not
    be read to its end, what comes before the bad spot counts, and ``reason`` is set."""
    n = _kept()
    return read_sitemap_docs(docs).select(
        "url",
        F.when(F.col("is_index"), 0).otherwise(n).cast("bigint").alias("n_urls"),
        F.when(F.col("is_index"), n).otherwise(0).cast("bigint").alias("n_sitemaps"),
        "reason",
    )


def unique_per_job(urls: DataFrame) -> DataFrame:
    """(job_id, n_urls): distinct URLs per job."""
    return urls.groupBy("job_id").agg(F.count_distinct("url").alias("n_urls"))
