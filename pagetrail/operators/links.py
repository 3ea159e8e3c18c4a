"""Pages to links, and joins of links with what is known already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import parse_links
from ..functions.urls import (
    UrlParts, canonical_parts, canonical_url, clean_url, drop_userinfo, host_of, is_skippable, join_parts,
    resolve_parts, site_hosts_of, url_parts,
)
from ..session import spread


def _parts_struct(p: UrlParts):
    return F.struct(
        p.scheme.alias("scheme"), p.authority.alias("authority"), p.path.alias("path"), p.query.alias("query")
    )


def _parts_of(column: str) -> UrlParts:
    return UrlParts(*[F.col(f"{column}.{f}") for f in ("scheme", "authority", "path", "query")])


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, base_href, pos, href) for every ``a[href]`` of the whole document.

    The outer form keeps Spark from adding a "list is not empty" filter below the
    generator, which would run the parser a second time.
    """
    pages = spread(pages.select("page_id", "url", "html"))
    return pages.select("page_id", "url", parse_links(F.col("html")).alias("_p")).select(
        "page_id", "url", F.col("_p.base_href").alias("base_href"), F.inline_outer("_p.links")
    ).filter(F.col("pos").isNotNull())


def non_empty_link(links: DataFrame, column: str = "href") -> DataFrame:
    return links.filter(F.length(column) > 0)


def discover_links(pages: DataFrame) -> DataFrame:
    """(page_id, src, pos, dst): clean, followable, same-site links in canonical form.

    Narrow from scan to result: no shuffle, one Python stage. The page's own address is
    taken apart once per page, before its links are unfolded.
    """
    pages = spread(pages.select("page_id", "url", "html"))
    parsed = pages.select("page_id", "url", parse_links(F.col("html")).alias("_p"))
    based = parsed.select(
        "page_id",
        canonical_url(F.col("url")).alias("src"),
        _parts_struct(
            resolve_parts(url_parts(F.col("url")), url_parts(F.coalesce(clean_url(F.col("_p.base_href")), F.lit(""))))
        ).alias("_base"),
        site_hosts_of(host_of(F.col("url"))).alias("_site"),
        F.col("_p.links").alias("_links"),
    )
    hrefs = based.select("page_id", "src", "_base", "_site", F.inline_outer("_links"))
    hrefs = hrefs.withColumn("href", clean_url(F.col("href")))
    hrefs = non_empty_link(hrefs).filter(~is_skippable(F.col("href")))
    resolved = hrefs.withColumn("_ref", _parts_struct(url_parts(F.col("href"))))
    resolved = resolved.withColumn("_abs", _parts_struct(resolve_parts(_parts_of("_base"), _parts_of("_ref"))))
    absolute = _parts_of("_abs")
    return (
        resolved.filter(F.array_contains("_site", drop_userinfo(absolute.authority)))
        .select("page_id", "src", "pos", canonical_parts(absolute).alias("dst"))
        .filter(F.col("dst").isNotNull() & F.col("src").isNotNull())
    )


def absolute_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, absolute): every non-empty link resolved, on any site."""
    links = extract_links(pages).withColumn("href", clean_url(F.col("href")))
    base = resolve_parts(url_parts(F.col("url")), url_parts(F.coalesce(clean_url(F.col("base_href")), F.lit(""))))
    links = non_empty_link(links).withColumn("_base", _parts_struct(base))
    target = join_parts(resolve_parts(_parts_of("_base"), url_parts(F.col("href"))))
    return links.select(
        "page_id", "pos", "href", F.when(F.col("href").startswith("#"), "").otherwise(target).alias("absolute")
    )


def site_links(pages: DataFrame) -> DataFrame:
    """(src, pos, dst) of one snapshot per address: where an address was stored more than
    once, the smallest page_id counts. Only the narrow link rows are joined, never HTML."""
    chosen = (
        pages.select("page_id", canonical_url(F.col("url")).alias("_src"))
        .groupBy("_src")
        .agg(F.min("page_id").alias("page_id"))
        .select("page_id")
    )
    return discover_links(pages).join(chosen, "page_id", "left_semi").select("src", "pos", "dst")


def new_only(found: DataFrame, visited: DataFrame) -> DataFrame:
    """Found URLs that the job did not know yet."""
    return found.join(visited.select("job_id", "url"), ["job_id", "url"], "left_anti")


def expand_frontier(frontier: DataFrame, links: DataFrame) -> DataFrame:
    """Frontier rows with every link of their page. AQE broadcasts a small frontier and
    splits a page that holds very many of the links."""
    return frontier.join(links, frontier["url"] == links["src"]).drop("src")


def allowed_domains(urls: DataFrame, domains: DataFrame, column: str = "url") -> DataFrame:
    """URLs whose host is listed in ``domains(domain)``. Spark broadcasts a small list by itself."""
    listed = domains.select(F.col("domain").alias("_host"))
    return urls.withColumn("_host", host_of(F.col(column))).join(listed, "_host", "left_semi").drop("_host")


def link_counts(pages: DataFrame) -> DataFrame:
    """(page_id, n_links), zero included. The list size is known without unfolding it."""
    links = parse_links(F.col("html"))["links"]
    return pages.select("page_id", F.coalesce(F.size(links), F.lit(0)).alias("n_links"))


def links_per_host(pages: DataFrame) -> DataFrame:
    """(host, n_pages, n_links, n_urls): the link inventory of every site; ``n_pages`` are those that link to it."""
    links = discover_links(pages).select(host_of(F.col("dst")).alias("host"), "dst", "page_id")
    return links.groupBy("host").agg(
        F.count_distinct("page_id").alias("n_pages"), F.count(F.lit(1)).alias("n_links"), F.count_distinct("dst").alias("n_urls")
    )
