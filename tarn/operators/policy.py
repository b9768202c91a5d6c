"""Admission policies and counters with state: rates, limits, cookies, media, modification checks, task admission."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rate(events: DataFrame, host: str, ts: str, max_freq: float) -> DataFrame:
    """Each request with the average rate of its host since the first one and whether it stays within ``max_freq`` a second."""
    w = Window.partitionBy(host).orderBy(ts, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("_tie", F.xxhash64(*events.columns)).withColumn("_n", F.count("*").over(w)).withColumn("_first", F.min(ts).over(w))
    age = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))
    rate = F.when(age > 0, F.col("_n") * 1e6 / age)
    return rows.withColumn("rate", rate).withColumn("within", F.coalesce(rate <= max_freq, F.lit(True))).drop("_tie", "_n", "_first")


def admitted(events: DataFrame, host: str, ts: str, min_gap: float) -> DataFrame:
    """Requests that a limiter admits, each at least ``min_gap`` seconds after the last admitted one of its host: sequential by host.

    Rows of a host stream through in time order, batch by batch, so a busy host needs no group in memory.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_host, last = None, None
        for b in batches:
            keep = []
            for h, t in zip(b[host], b[ts], strict=True):
                if h != last_host or (t - last).total_seconds() >= min_gap:
                    last_host, last = h, t
                    keep.append(True)
                else:
                    keep.append(False)
            yield b[keep]

    return events.repartition(host).sortWithinPartitions(host, ts, *[c for c in events.columns if c not in (host, ts)]).mapInPandas(run, events.schema)


def period_counts(usage: DataFrame, keys: Sequence[str], ts: str, period: str) -> DataFrame:
    """Uses of a proxy in each period; a new period starts from zero."""
    return usage.groupBy(*keys, F.window(F.col(ts).cast("timestamp"), period).alias("w")).agg(F.count("*").alias("uses")).withColumn("period", F.col("w.start").cast("timestamp_ntz")).drop("w")


def free_proxies(proxies: DataFrame, used: DataFrame, key: str, limit: Column, faults: Column, faults_max: Column) -> DataFrame:
    """Proxies with uses left in the period and not disabled by faults."""
    out = proxies.join(used.select(key, F.col("uses").alias("_uses")), key, "left")
    return out.where((F.coalesce("_uses", F.lit(0)) < limit) & ((faults_max == 0) | (faults < faults_max))).drop("_uses")


def cookie_applies(host: Column, path: Column, domain: Column, cookie_path: Column, expires: Column, now: Column, stages: Column, stage: int) -> Column:
    """Whether a cookie goes with a request: domain or parent of the host, path above it, not expired, bit of the stage set."""
    clean = F.ltrim(F.lower(domain), F.lit("."))
    same = (F.lower(host) == clean) | F.endswith(F.lower(host), F.concat(F.lit("."), clean))
    return same & F.startswith(path, F.coalesce(cookie_path, F.lit("/"))) & (expires.isNull() | (expires > now)) & (stages.bitwiseAND(stage) != 0)


def media_within(width: Column, height: Column, kind: Column, min_width: int = 0, max_width: int | None = None, min_height: int = 0, max_height: int | None = None, min_ratio: float = 0.0, max_ratio: float | None = None, kinds: Sequence[str] | None = None) -> Column:
    """Whether an image stays within limits of size, ratio and content type."""
    ratio = width / F.when(height != 0, height)
    out = (width >= min_width) & (height >= min_height) & (F.coalesce(ratio, F.lit(0.0)) >= min_ratio)
    for c, most in ((width, max_width), (height, max_height), (F.coalesce(ratio, F.lit(0.0)), max_ratio)):
        if most is not None:
            out = out & (c <= most)
    return out if kinds is None else out & kind.isin(*kinds)


def not_modified(mode: str, http_code: Column, last_modified: Column, since: Column, e_tag: Column, old_tag: Column, md5: Column, old_md5: Column, size: Column, old_size: Column) -> Column:
    """Whether a resource is as it was, by the mode: auto (304, tag, date), date, md5 or length."""
    by_date = F.coalesce(last_modified <= since, F.lit(False))
    return {"auto": (http_code == 304) | F.coalesce(e_tag == old_tag, F.lit(False)) | by_date, "date": by_date, "md5": F.coalesce(md5 == old_md5, F.lit(False)), "length": F.coalesce(size == old_size, F.lit(False))}[mode]


#: Error bits of a response (fixed values).
EMPTY, TOO_LARGE, HTTP_4XX, HTTP_5XX, FORBIDDEN = 1 << 9, 1 << 10, 1 << 11, 1 << 12, 1 << 13


def response_errors(http_code: Column, size: Column, max_size: Column) -> Column:
    """Error bits of a response, joined by OR."""
    bit = lambda c, b: F.when(c, b).otherwise(0)
    out = bit(size == 0, EMPTY).bitwiseOR(bit((max_size > 0) & (size > max_size), TOO_LARGE))
    out = out.bitwiseOR(bit((http_code >= 400) & (http_code < 500), HTTP_4XX)).bitwiseOR(bit(http_code >= 500, HTTP_5XX))
    return out.bitwiseOR(bit(http_code == 403, FORBIDDEN))


def crawlable(site_state: Column, url_state: Column, is_root: Column, errors: Column, max_errors: Column) -> Column:
    """Whether a URL may be crawled: its site active, the URL enabled, errors within the limit; a root URL is exempt from the limit."""
    return (site_state == 1) & (url_state == 0) & (is_root | (max_errors == 0) | (errors <= max_errors))


def admits(node: DataFrame, tasks: DataFrame, max_threads: float, max_load: float, max_io: float, min_ram: float) -> DataFrame:
    """Tasks, if the one row of node averages leaves room for them."""
    ok = node.select((F.col("threads") / F.greatest("cores", F.lit(1)) <= max_threads).__and__(F.col("load") <= max_load).__and__(F.col("io") <= max_io).__and__(F.col("ram") >= min_ram).alias("_ok"))
    return tasks.join(F.broadcast(ok), F.lit(True)).where("_ok").drop("_ok")


def retried(tasks: DataFrame, retry: int, delay_s: int, closed: int, planned: int) -> DataFrame:
    """Failed tasks tried once more later, or closed after ``retry`` tries."""
    tries = F.col("tries") + 1
    done = tries >= retry
    return tasks.withColumns({"state": F.when(done, closed).otherwise(planned), "r_time": F.when(done, F.col("r_time")).otherwise(F.col("r_time") + F.make_interval(secs=F.lit(delay_s))), "tries": tries})


def scheduled(kind: Column, is_root: Column, last: Column, at: Column, step_s: Column, now: Column) -> Column:
    """Template schedules: 0 root only, 1 always, 2 once at a time, 3 every step."""
    due = last.isNull() | (last + F.make_interval(secs=step_s) <= now)
    return F.when(kind == 0, is_root).when(kind == 1, True).when(kind == 2, last.isNull() & (at <= now)).when(kind == 3, (at <= now) & due).otherwise(False)


def admitted_requests(requests: DataFrame, host: str, ts: str, max_freq: float, media: Column, used: DataFrame, limit: Column) -> DataFrame:
    """Requests with ``admitted``: the rate of their host, the media limits and the proxy of the host (uses below ``limit``) all allow them."""
    rated = average_rate(requests, host, ts, max_freq).join(used.select(host, F.col("uses").alias("_uses")), host, "left")
    return rated.withColumn("admitted", F.col("within") & F.coalesce(media, F.lit(False)) & (F.coalesce("_uses", F.lit(0)) < limit)).drop("_uses", "rate", "within")
