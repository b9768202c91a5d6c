"""State transitions as pure functions: tables in, new tables and log rows out.

A snapshot is read by one plan, so nothing needs a lock. ``now`` is a timestamp column or literal, never the clock.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.merge import first_wins, patched, upsert

#: Operation codes of the log (fixed values).
OPERATIONS = {"insert": 20, "delete": 21, "update": 22, "content_update": 23, "new_status": 1, "crawled": 4, "processed": 7, "aged": 24, "deleted": 25, "purged": 26}


@dataclass
class Change:
    """The table after a request, the rows it moved (if any) and the log rows it makes."""

    table: DataFrame
    moved: DataFrame | None = None
    log: DataFrame | None = None


def logged(rows: DataFrame, site: str, key: str, operation: str, now: Column) -> DataFrame:
    return rows.select(F.col(site).alias("site_id"), F.col(key).alias("url_md5"), F.lit(OPERATIONS[operation]).alias("op_code"), F.to_json(F.struct(*rows.columns)).alias("object"), now.alias("o_date"))


def log_enabled(log: DataFrame, properties: DataFrame, name: str = "STATS_LOG") -> DataFrame:
    """Log rows of the sites that have the log switched on by a property."""
    on = properties.where((F.col("name") == name) & (F.col("value") != "0")).select("site_id")
    return log.join(on, "site_id", "left_semi")


def inserted(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(the table with new rows, the request's rows with ``status`` 0 inserted or 1 exists): insert-ignore by key."""
    new = first_wins(rows.join(table.select(*keys), list(keys), "left_anti"), keys, order)
    known = table.select(*keys).withColumn("_known", F.lit(1))
    return table.unionByName(new.select(*table.columns)), rows.join(known, list(keys), "left").withColumn("status", F.coalesce("_known", F.lit(0))).drop("_known")


def updated(table: DataFrame, changes: DataFrame, keys: Sequence[str], fixed: Sequence[str] = ("url", "url_md5")) -> DataFrame:
    """Partial update by key: null fields stay, key fields never change."""
    names = [c for c in changes.columns if c in keys or c not in fixed]
    return patched(table, changes.select(*names), keys)


def updated_where(table: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """Update by criterion."""
    return table.withColumns({n: F.when(condition, v).otherwise(F.col(n)) for n, v in values.items()})


def deleted(table: DataFrame, tombstones: DataFrame, condition: Column, now: Column, delayed: bool = True, tc_date: str = "tc_date") -> Change:
    """Rows under a condition leave the table; a delayed delete keeps copies among the tombstones."""
    gone = F.coalesce(condition, F.lit(False))
    moved = table.where(gone).withColumn(tc_date, now) if tc_date in table.columns else table.where(gone)
    return Change(table.where(~gone), tombstones.unionByName(moved) if delayed else tombstones)


def cleaned(table: DataFrame, condition: Column, state: int, status: int, now: Column, period_s: Column, new_status: int = 1) -> DataFrame:
    """State and status set; rows that become new are dated back by the recrawl period, so they are due at once."""
    return updated_where(table, condition, {"state": F.lit(state), "status": F.lit(status), "tc_date": now, "u_date": F.when(F.lit(status == new_status), F.col("u_date") - F.make_interval(secs=period_s)).otherwise(now)})


def purged(tombstones: DataFrame, live: DataFrame, key: str, tc_date: str, order: Sequence[Column], n: int) -> tuple[DataFrame, DataFrame]:
    """(tombstones left, contents to delete): the first n tombstones go; their content too unless a live row was touched at another date."""
    out = tombstones.orderBy(*order).limit(n)
    dates = tombstones.select(F.col(key).alias("_k"), F.col(tc_date).alias("_d"))
    newer = live.join(dates, (F.col(key) == F.col("_k")) & (F.col(tc_date) == F.col("_d")), "left_anti").select(key)
    return tombstones.join(out.select(key), key, "left_anti"), out.select(key).distinct().join(newer, key, "left_anti")


def overwritten(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """All rows of the given sites replaced."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.select(*table.columns))


def restarted(sites: DataFrame, condition: Column) -> DataFrame:
    """Restart of sites: one more iteration, no errors, active."""
    return updated_where(sites, condition, {"iterations": F.col("iterations") + 1, "errors": F.lit(0).cast("long"), "error_mask": F.lit(0).cast("long"), "state": F.lit(1)})


def with_site_defaults(urls: DataFrame, sites: DataFrame, key: str, names: Mapping[str, str]) -> DataFrame:
    """URL fields that are null from their site; ``names`` maps URL fields to site fields."""
    defaults = sites.select(key, *[F.col(s).alias(f"_{u}") for u, s in names.items()])
    return urls.join(defaults, key, "left").withColumns({u: F.coalesce(u, f"_{u}") for u in names}).drop(*[f"_{u}" for u in names])


def marked(table: DataFrame, selected: DataFrame, key: str, status: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """(selected rows, the table with them marked): fetch-and-mark."""
    hit = selected.select(key).distinct().withColumn("_hit", F.lit(True))
    out = table.join(hit, key, "left")
    return selected, out.withColumns({"status": F.when(F.col("_hit"), status).otherwise(F.col("status")), "tc_date": F.when(F.col("_hit"), now).otherwise(F.col("tc_date"))}).drop("_hit")


def returned(urls: DataFrame, now: Column, ttl_minutes: int, cap: int, order: Sequence[Column], key: str) -> DataFrame:
    """Stuck URLs (being selected, crawled or processed for longer than a time) set back a step, ``cap`` at most."""
    stuck = urls.where(F.col("status").isin(2, 3, 5, 6) & (F.col("u_date") < now - F.make_interval(mins=F.lit(ttl_minutes)))).orderBy(*order).limit(cap).select(key)
    out = urls.join(stuck.withColumn("_hit", F.lit(True)), key, "left")
    back = F.when(F.col("status") < 4, 1).otherwise(4)
    return out.withColumn("status", F.when(F.col("_hit"), back).otherwise(F.col("status"))).drop("_hit")


def recrawl_due(sites: DataFrame, now: Column, n: int) -> DataFrame:
    """Active sites whose recrawl date has come, earliest first."""
    return sites.where((F.col("state") == 1) & (F.col("recrawl_period") > 0) & (F.col("recrawl_date") <= now)).orderBy("recrawl_date", "id").limit(n)


def next_recrawl(date: Column, period_min: Column, now: Column) -> Column:
    """The first date after ``now`` at a whole number of periods from the last."""
    step = F.greatest(F.ceil((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(date.cast("timestamp"))) / (period_min * 60)), F.lit(1))
    return date + F.make_interval(mins=(step * period_min).cast("int"))


def tuned_period(period: Column, backlog: Column, step: int, least: int, most: int) -> Column:
    """A period grows by a step while a backlog remains and shrinks by one when there is none."""
    return F.when(backlog > 0, F.least(period + step, F.lit(most))).otherwise(F.greatest(period - step, F.lit(least)))


def node_quota(total: Column, nodes: int) -> Column:
    return F.greatest(F.ceil(total / nodes), F.lit(1))


def cached(table: DataFrame, rows: DataFrame, keys: Sequence[str], date: str, now: Column, ttl_s: int) -> DataFrame:
    """A cache with new rows put in and obsolete ones removed."""
    return upsert(table, rows, keys).where(F.col(date) >= now - F.make_interval(secs=F.lit(ttl_s)))


def latest(rows: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """The newest row of each key (last write wins)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), date).alias("_r")).select(*keys, "_r.*")


def raw_content(rows: DataFrame, keys: Sequence[str], mode: str = "last") -> DataFrame:
    """Raw contents of a URL: the newest, the oldest, or all by time."""
    if mode == "all":
        return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("ctime", "body"))), lambda x: x["body"]).alias("body"))
    pick = F.max_by if mode == "last" else F.min_by
    return rows.groupBy(*keys).agg(pick("body", F.struct("ctime", "body")).alias("body"))


def first_match(table: DataFrame, condition: Column, order: Sequence[Column], key: str) -> DataFrame:
    """The key of the first row under a condition, by one distributed top-1."""
    return table.where(condition).orderBy(*order).limit(1).select(F.col(key).alias("_first"))


def updated_first(table: DataFrame, condition: Column, values: Mapping[str, Column], order: Sequence[Column], key: str) -> DataFrame:
    """Update of the first match only."""
    one = F.broadcast(first_match(table, condition, order, key))  # one row
    hit = table.join(one, F.col(key) == F.col("_first"), "left")
    return hit.withColumns({n: F.when(F.col("_first").isNotNull(), v).otherwise(F.col(n)) for n, v in values.items()}).drop("_first")


def deleted_first(table: DataFrame, condition: Column, order: Sequence[Column], key: str) -> DataFrame:
    """Delete of the first match only."""
    return table.join(F.broadcast(first_match(table, condition, order, key)), F.col(key) == F.col("_first"), "left_anti")  # one row
