"""Fair selection of URLs over sites, and ranked limits. All are partial top-k by key, then one distributed top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def proportional_fetch(urls: DataFrame, sites: DataFrame, key: str, site_order: Sequence[Column], url_order: Sequence[Column], max_urls: int) -> DataFrame:
    """Round-robin pages of max(max_urls // sites, 1) rows a site, in site order, up to ``max_urls`` rows in all.

    Adds ``rn`` (place in its site) and ``page``. Sites carry their sort columns to the rows, so no global rank is made.
    """
    quota = F.broadcast(sites.agg(F.greatest(F.expr(f"{max_urls} div greatest(count(*), 1)"), F.lit(1)).alias("_quota")))
    ranked_sites = sites.select(F.col(key).alias("_site"), F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(_plain(site_order))]).alias("_order"))
    rows = urls.join(ranked_sites, F.col(key) == F.col("_site"))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("_site").orderBy(*url_order))).where(F.col("rn") <= max_urls).join(quota)
    rows = rows.withColumn("page", F.floor((F.col("rn") - 1) / F.col("_quota")))
    order = [_directed(c, F.col(f"_order._o{i}")) for i, c in enumerate(site_order)]
    return rows.orderBy("page", *order, "_site", "rn").limit(max_urls).drop("_site", "_order", "_quota")


def simple_fetch(urls: DataFrame, sites: DataFrame, key: str, site_order: Sequence[Column], url_order: Sequence[Column], per_site: int, max_urls: int) -> DataFrame:
    """At most ``per_site`` rows of each site, sites one after another, cut at ``max_urls``."""
    ranked_sites = sites.select(F.col(key).alias("_site"), F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(_plain(site_order))]).alias("_order"))
    rows = urls.join(ranked_sites, F.col(key) == F.col("_site"))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("_site").orderBy(*url_order))).where(F.col("rn") <= per_site)
    order = [_directed(c, F.col(f"_order._o{i}")) for i, c in enumerate(site_order)]
    return rows.orderBy(*order, "_site", "rn").limit(max_urls).drop("_site", "_order")


def _text(c: Column) -> str:
    return c._jc.toString()


def _plain(order: Sequence[Column]) -> list[Column]:
    """Sort columns without their direction; an order is given as ``F.col(name)``, ``.asc()`` or ``.desc()`` of one."""
    return [F.expr(_text(c).split(" ASC")[0].split(" DESC")[0]) for c in order]


def _directed(c: Column, value: Column) -> Column:
    return value.desc() if " DESC" in _text(c) else value.asc()


def page_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column], offset: int, count: int) -> DataFrame:
    """Rows offset .. offset + count of every group (URL limits, per-pattern limits)."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rn", rn).where((F.col("rn") > offset) & (F.col("rn") <= offset + count))


def capped(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int, bit: int, mask: str = "error_mask") -> DataFrame:
    """The first ``cap`` rows of each group; the last one kept of a group that was cut carries ``bit`` in its mask."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap + 1).withColumn("_more", F.lead("_rn").over(w).isNotNull())
    return rows.where(F.col("_rn") <= cap).withColumn(mask, F.when((F.col("_rn") == cap) & F.col("_more"), F.col(mask).bitwiseOR(bit)).otherwise(F.col(mask))).drop("_rn", "_more")


def within_size(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: str, cap: int) -> DataFrame:
    """Rows of each group while the running sum of ``size`` stays within ``cap``."""
    run = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", run).where(F.col("running") <= cap)


def split_top(df: DataFrame, order: Sequence[Column], n: int, key: str) -> tuple[DataFrame, DataFrame]:
    """(the first n rows, the rest): auto-remove."""
    top = df.orderBy(*order).limit(n)
    return top, df.join(top.select(key), key, "left_anti")


def two_level(df: DataFrame, key: str, order: Sequence[Column], per_key: int, overall: int) -> DataFrame:
    """Aging: at most ``per_key`` rows a site, then ``overall`` in all."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("rn", rn).where(F.col("rn") <= per_key).orderBy("rn", key).limit(overall)


def site_slice(df: DataFrame, key: str, offset: int, count: int) -> DataFrame:
    """Rows of the sites offset .. offset + count by key (purge over all tables)."""
    sites = df.select(key).distinct().orderBy(key).offset(offset).limit(count)
    return df.join(F.broadcast(sites), key, "left_semi")  # count rows


def metric_sorted(df: DataFrame, metric: str, position: str) -> DataFrame:
    """Rows with the metric first, descending; the others after them in their order."""
    return df.orderBy(F.col(metric).desc_nulls_last(), position)


def metric_range(df: DataFrame, metric: str, low: float, high: float | None) -> DataFrame:
    """Rows with metric >= low, and <= high if there is one."""
    return df.where((F.col(metric) >= low) & (F.lit(True) if not high else F.col(metric) <= high))


def best_template(df: DataFrame, keys: Sequence[str], mode: str = "first_nonempty") -> DataFrame:
    """One template a group: the most contents (or the longest); a template that lacks mandatory content is out; ties to the first."""
    score = F.col("contents_count" if mode == "first_nonempty" else "contents_len")
    return df.where("not mandatory_empty").groupBy(*keys).agg(F.max_by("template", F.struct(score, -F.col("pos"))).alias("template"), F.max(score).alias("score"))


def lowest_used(df: DataFrame, keys: Sequence[str], value: str, freq: Column) -> DataFrame:
    """The least used value of each group (ties to the smaller value): header rotation, schema parameters, proxies by freq * priority."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(freq, F.col(value))).alias(value), F.min(freq).alias("freq"))


def due_tasks(tasks: DataFrame, slot_end, planned: int, n: int) -> DataFrame:
    """Planned tasks due before the end of a slot, earliest, most important and most tried first."""
    return tasks.where((F.col("r_time") < slot_end) & (F.col("state") == planned)).orderBy("r_time", F.desc("priority"), F.desc("tries"), "id").limit(n)


def slot_counts(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Rows in each time slot floor(t / seconds) * seconds."""
    return df.groupBy((F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds) * seconds).cast("long").alias("slot")).agg(F.count("*").alias("n"))


def incremental(urls: DataFrame, now: Column, age_s: int, max_depth: int, n: int, key: str) -> DataFrame:
    """Processed URLs untouched for a time and not too deep: shallow ones first, then the highest modification rate, then the latest update."""
    due = urls.where((F.col("status") == 7) & (F.col("depth") <= max_depth) & (F.col("tc_date") < now - F.make_interval(secs=F.lit(age_s))))
    return due.orderBy("depth", F.desc("m_rate"), F.desc("u_date"), key).limit(n)


def before_deadline(items: DataFrame, keys: Sequence[str], order: Sequence[Column], cost: Column, deadline: Column, keep: Column) -> DataFrame:
    """Items of a batch with their ``outcome``: done while the costs so far stay within the deadline, the rest kept or dropped."""
    spent = F.sum(cost).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("outcome", F.when(spent <= deadline, "done").when(keep, "kept").otherwise("dropped"))
