"""Site counters and merges of partial results: single-pass conditional aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of a site by condition on its URLs. The resources mask 4198399 is bits 0-11 and 22 (fixed value of the data model).
SITE_COUNTERS = {
    "resources": "crawled > 0 and (error_mask & 4198399) = 0",
    "contents": "processed > 0",
    "collected_urls": "true",
    "new_urls": "status = 1",
    "errors": "error_mask > 0",
    "deleted_urls": "state = 1",
}
#: Rows whose crawl belongs to this node.
THIS_NODE = "not (status = 4 and crawled = 0)"


def recalculated(urls: DataFrame, key: str, counters: Mapping[str, str] = SITE_COUNTERS, overrides: Mapping[str, Column] | None = None, partition_only: bool = False) -> DataFrame:
    """All counters of every site in one scan; ``overrides`` replaces single conditions, a partition recalculation leaves collected_urls out."""
    names = [n for n in counters if not (partition_only and n == "collected_urls")]
    conditions = {n: (overrides or {}).get(n, F.expr(counters[n])) for n in names}
    return urls.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def cleanup_fields(urls: DataFrame, key: str, size: str, errors: str, crawling_time: str) -> DataFrame:
    """size (sum), errors (count), error_mask (or), avg_speed (bytes a second) of every site."""
    speed = F.when(F.col(crawling_time) > 0, F.col(size) / F.col(crawling_time) * 1000)
    return urls.groupBy(key).agg(F.sum(size).alias("size"), F.count_if(F.col(errors) > 0).alias("errors"), F.bit_or(errors).alias("error_mask"), F.avg(speed).alias("avg_speed"))


def refreshed(sites: DataFrame, fresh: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Sites with new values; a site or value that was not counted keeps its old one."""
    new = fresh.select(key, *[F.col(n).alias(f"_{n}") for n in names])
    return sites.join(new, key, "left").withColumns({n: F.coalesce(f"_{n}", n) for n in names}).drop(*[f"_{n}" for n in names])


def merged_sites(parts: DataFrame, key: str, summed: Sequence[str], largest: Sequence[str], ored: Sequence[str], least: Sequence[str]) -> DataFrame:
    """One row a site from the rows of several nodes."""
    return parts.groupBy(key).agg(*[F.sum(c).alias(c) for c in summed], *[F.max(c).alias(c) for c in largest], *[F.bit_or(c).alias(c) for c in ored], *[F.min(c).alias(c) for c in least])


def operation_counts(log: DataFrame, keys: Sequence[str], op: str, names: Mapping[str, object]) -> DataFrame:
    """A column for each operation with its number of log rows."""
    return log.groupBy(*keys).agg(*[F.count_if(F.col(op) == v).alias(n) for n, v in names.items()])


def running_mean(mean: Column, n: Column, x: Column) -> Column:
    """The mean of n + 1 values from that of n."""
    return (mean * n + x) / (n + 1)


def link_frequency(pages: DataFrame, page: str, links: str) -> DataFrame:
    """In how many other pages each link stands."""
    each = pages.select(F.col(page).alias("page"), F.explode(F.array_distinct(links)).alias("link")).where("link <> page")
    return each.groupBy("link").agg(F.count_distinct("page").alias("freq"))


def integrity(items: DataFrame, key: str, host: str) -> DataFrame:
    """How many items stand on how many hosts."""
    return items.groupBy(key).agg(F.count_distinct(host).alias("hosts")).groupBy("hosts").agg(F.count("*").alias("items"))


def stat_fields(ops: DataFrame, keys: Sequence[str], order: str, op: str, value: str) -> DataFrame:
    """Named counters after a run of INIT, SET, ADD and SUB operations: what the last INIT (0) or SET left, and the sums since.

    Two aggregations with partial results instead of a walk in order.
    """
    last = ops.where(F.col(op).isin("INIT", "SET")).groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("at"), F.when(F.col(op) == "SET", F.col(value)).otherwise(0).alias("v"))).alias("_l"))
    signed = F.when(F.col(op) == "ADD", F.col(value)).when(F.col(op) == "SUB", -F.col(value)).otherwise(0)
    since = ops.join(last, list(keys), "left").where(F.col("_l").isNull() | (F.col(order) >= F.col("_l.at")))
    return since.groupBy(*keys).agg((F.coalesce(F.max("_l")["v"], F.lit(0)) + F.sum(signed)).alias("value"))
