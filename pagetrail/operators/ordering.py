"""Order, first-seen distinct, limits and unions. Rows have no order of their own in
Spark, so every operator carries it in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import MAX_URLS_LIMIT
from ..session import materialize

# A window sorts one group in one task. That is fine for groups known to be this small.
SMALL_GROUP = 2 * MAX_URLS_LIMIT
_ROW_BITS = 33  # monotonically_increasing_id: partition in the upper bits, row in the lower 33


def _columns(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def ordinal(
    df: DataFrame, group: list[str], order: list[str | Column], name: str = "ord", max_group: int | None = None
) -> DataFrame:
    """Number the rows of each group 1, 2, ... in ``order`` (which must be unique per group).

    With ``max_group`` at most ``SMALL_GROUP`` this is a plain window. Otherwise the rows
    are range-partitioned on (group, order), so that one huge group spreads over many
    partitions; each partition numbers its own rows and the counts of the partitions
    before it are added. No task ever holds a whole group.
    """
    if max_group is not None and max_group <= SMALL_GROUP:
        w = Window.partitionBy(*group).orderBy(*_columns(order))
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))
    keys = _columns(group) + _columns(order)
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed, _ = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", _ROW_BITS))
    share = placed.groupBy(*group, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = share.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col("_part").alias("_p"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return placed.join(offsets, same).select(
        *df.columns, (F.col("_id") + F.col("_shift")).cast("bigint").alias(name)
    )


def prefix_sum(df: DataFrame, group: list[str], order: list[str | Column], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of the group up to this one in ``order`` (unique per group).

    As in :func:`ordinal` the rows are range-partitioned on (group, order); each partition sums up its own rows of a group and
    adds the sums of the partitions before it, so no task holds a whole group.
    """
    keys = _columns(group) + _columns(order)
    placed, _ = materialize(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    share = placed.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = share.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")
    )
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    own = Window.partitionBy(*group, "_part").orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_own", F.sum(value).over(own))
    return summed.join(offsets, same).select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def first_seen_distinct(df: DataFrame, keys: list[str], order: str, *carry: str) -> DataFrame:
    """First occurrence per key by ``order``; ``carry`` columns come from that row.

    An aggregate, so repeated keys shrink on the map side already.
    """
    if not carry:
        return df.groupBy(*keys).agg(F.min(order).alias(order))
    first = F.min(F.struct(F.col(order), *[F.col(c) for c in carry])).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*")


def running_total(df: DataFrame, order: list[str | Column], group: str = "job_id", max_group: int | None = None) -> DataFrame:
    """``total``: how many URLs the job knew once this one was found."""
    return ordinal(df, [group], order, "total", max_group)


def page_counter(df: DataFrame, order: list[str | Column], group: str = "job_id", max_group: int | None = None) -> DataFrame:
    """``page_count``: this is the job's n-th fetched page."""
    return ordinal(df, [group], order, "page_count", max_group)


def last_n_events(events: DataFrame, n: int = 100, tie: list[str] | None = None) -> DataFrame:
    """Newest ``n`` events per job as ``rank`` 1..n. The constant bound lets Spark cut each
    group on the map side before the shuffle."""
    w = Window.partitionBy("job_id").orderBy(F.desc("timestamp"), *[F.desc(t) for t in tie or []])
    return events.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def latest_crawl_per_target(results: DataFrame) -> DataFrame:
    rest = [c for c in results.columns if c != "target_url"]
    newest = F.max_by(F.struct(*rest), F.struct("crawled_at", "id")).alias("_r")
    return results.groupBy("target_url").agg(newest).select("target_url", "_r.*").select(*results.columns)


def largest_crawls(results: DataFrame, depth: int, limit: int = 10) -> DataFrame:
    """Top crawls of one depth by URL count."""
    return results.filter(F.col("settings.depth") == depth).orderBy(F.desc("total_urls"), "id").limit(limit)


def truncate_urls(urls: DataFrame, requests: DataFrame) -> DataFrame:
    """First ``max_urls`` of each job in merged order; no limit unless ``max_urls`` > 0."""
    limits = requests.select(F.col("job_id"), F.col("max_urls").alias("_max"))
    keep = (F.coalesce(F.col("_max"), F.lit(0)) <= 0) | (F.col("ord") <= F.col("_max"))
    return urls.join(limits, "job_id", "left").filter(keep).drop("_max")


def order_by_index(df: DataFrame) -> DataFrame:
    return df.orderBy("req_id", "idx")


def union_all_sitemaps(*parts: DataFrame) -> DataFrame:
    """Concatenation; duplicates stay."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_tiers(sitemap_urls: DataFrame, html_urls: DataFrame) -> DataFrame:
    """(job_id, url, tier, tier_ord): union distinct, the first tier wins, order kept."""
    ranked = sitemap_urls.select("job_id", "url", F.lit(1).alias("rank"), F.col("ord").cast("bigint").alias("tier_ord")).unionByName(
        html_urls.select("job_id", "url", F.lit(2).alias("rank"), F.col("ord").cast("bigint").alias("tier_ord"))
    )
    first = ranked.groupBy("job_id", "url").agg(F.min(F.struct("rank", "tier_ord")).alias("_f"))
    tier = F.when(F.col("_f.rank") == 1, "sitemap").otherwise("html")
    return first.select("job_id", "url", tier.alias("tier"), F.col("_f.tier_ord").alias("tier_ord"))


def merge_counts(merged: DataFrame) -> DataFrame:
    """(job_id, n_before, n_new, total): what the first tier had, and what merging the second in has added."""
    later = F.count_if(F.col("tier") != "sitemap")
    return merged.groupBy("job_id").agg((F.count(F.lit(1)) - later).alias("n_before"), later.alias("n_new"), F.count(F.lit(1)).alias("total"))
