"""robots.txt: sitemap lines and access rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_lines, trim_u
from ..functions.urls import site_root, url_parts


def robots_sitemaps(robots: DataFrame, mode: str = "raw") -> DataFrame:
    """(base_url, pos, url) for every sitemap line of ``robots(base_url, body)``.

    ``raw`` keeps the text; ``absolute`` puts the site in front unless the text starts
    with http:// or https://.
    """
    if mode not in ("raw", "absolute"):
        raise ValueError(f"unknown mode {mode!r}")
    lines = robots.select("base_url", F.posexplode_outer(split_lines(F.col("body"))).alias("pos", "line"))
    lines = lines.withColumn("line", trim_u(F.col("line"))).filter(F.col("line").rlike("(?i)^sitemap:"))
    url = trim_u(F.substring("line", 9, 2147483647))
    out = lines.select("base_url", "pos", url.alias("url")).filter(F.col("url") != "")
    if mode == "absolute":
        is_absolute = F.col("url").startswith("http://") | F.col("url").startswith("https://")
        out = out.withColumn(
            "url", F.when(is_absolute, F.col("url")).otherwise(F.concat(F.col("base_url"), F.col("url")))
        )
    return out


def robots_counts(robots: DataFrame, mode: str = "raw") -> DataFrame:
    """(base_url, n_sitemaps), zero included."""
    found = robots_sitemaps(robots, mode).groupBy("base_url").agg(F.count(F.lit(1)).alias("_n"))
    return (
        robots.select("base_url")
        .distinct()
        .join(found, "base_url", "left")
        .select("base_url", F.coalesce("_n", F.lit(0)).alias("n_sitemaps"))
    )


def robots_rules(robots: DataFrame, user_agent: str = "*") -> DataFrame:
    """(base_url, prefix, allow): the Allow/Disallow lines of the groups for ``user_agent``, else of ``*``; of equal
    prefixes Allow counts. ``base_url`` is unique. A run of user-agent lines opens a group, and the rules after it belong to
    all of them. A window holds the lines of one file."""
    directive = r"^(?i)\s*(user-agent|allow|disallow)\s*:\s*(.*?)\s*(?:#.*)?$"
    listed = F.filter(split_lines(F.col("body")), lambda s: s.rlike(directive))
    lines = robots.select("base_url", F.posexplode(listed).alias("pos", "_line")).select(
        "base_url", "pos", F.lower(F.regexp_extract("_line", directive, 1)).alias("_key"), F.regexp_extract("_line", directive, 2).alias("prefix")
    )
    file = Window.partitionBy("base_url")
    is_agent = F.col("_key") == "user-agent"
    opens = is_agent & (F.coalesce(F.lag("_key").over(file.orderBy("pos")), F.lit("")) != "user-agent")
    wanted = user_agent.lower()
    marked = lines.withColumns({"_opens": opens, "_named": F.max(is_agent & (F.lower("prefix") == wanted)).over(file)})
    marked = marked.withColumn("_group", F.sum(F.col("_opens").cast("int")).over(file.orderBy("pos")))
    meant = is_agent & (F.lower("prefix") == F.when(F.col("_named"), wanted).otherwise("*"))
    rules = marked.withColumn("_meant", F.max(meant).over(Window.partitionBy("base_url", "_group")))
    rules = rules.filter(F.col("_meant") & ~is_agent & (F.col("prefix") != ""))
    return rules.groupBy("base_url", "prefix").agg(F.max(F.col("_key") == "allow").alias("allow"))


def robots_allowed(urls: DataFrame, robots: DataFrame, user_agent: str = "*") -> DataFrame:
    """``urls`` with ``allowed``: the longest matching prefix decides, Allow on a tie; a URL
    without a matching rule is allowed. Rules belong to a site, which is scheme and host; of several files of a site the one
    whose text sorts last counts.

    A URL is looked up once for each length that rules of its site have, by site and its start of that length; so its rows
    carry those lengths and never the rules, however many a site has.
    """
    files = robots.groupBy(site_root(F.col("base_url")).alias("base_url")).agg(F.max("body").alias("body"))
    rules = robots_rules(files, user_agent).withColumnRenamed("base_url", "_site")
    lengths = rules.groupBy("_site").agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    parts = url_parts(F.col("url"))
    path = F.when(parts.path == "", "/").otherwise(parts.path)
    target = F.concat(path, F.coalesce(F.concat(F.lit("?"), parts.query), F.lit("")))
    placed = urls.withColumns({"_site": site_root(F.col("url")), "_target": target})
    asked = placed.select("_site", "_target").distinct().join(lengths, "_site")
    fitting = F.filter("_lengths", lambda n: n <= F.length("_target"))
    starts = F.explode(F.transform(fitting, lambda n: F.substr(F.col("_target"), F.lit(1), n))).alias("prefix")
    hits = asked.select("_site", "_target", starts).join(rules, ["_site", "prefix"])
    decided = hits.groupBy("_site", "_target").agg(F.max(F.struct(F.length("prefix").alias("n"), "allow")).alias("_hit"))
    joined = placed.join(decided, ["_site", "_target"], "left")
    return joined.select(*urls.columns, F.coalesce(F.col("_hit")["allow"], F.lit(True)).alias("allowed"))
