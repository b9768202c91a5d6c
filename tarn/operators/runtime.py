"""Runtime tables: task queue, node resources, batches, URL sync, feeds, comparison of outputs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of task states; a late update never moves a task back (fixed values).
STATE_ORDER = {"new": 1, "planned": 2, "in_progress": 3, "finished": 4, "crashed": 4, "terminated": 4, "undefined": 0}


def task_status(backlog: DataFrame, log: DataFrame, ids: DataFrame) -> DataFrame:
    """Backlog rows of the ids, and log rows of those that are not in it."""
    live = backlog.join(ids, "id", "left_semi")
    return live.unionByName(log.join(ids.join(live, "id", "left_anti"), "id", "left_semi"))


def between_filters(rows: DataFrame, limits: dict[str, tuple[object, object]]) -> DataFrame:
    """Rows within all (from, to) limits; None is open."""
    for name, (low, high) in limits.items():
        rows = rows if low is None else rows.where(F.col(name) >= low)
        rows = rows if high is None else rows.where(F.col(name) <= high)
    return rows


def guarded(old: Column, new: Column) -> Column:
    """The new state unless it lies before the old one."""
    m = F.create_map(*[x for k, v in STATE_ORDER.items() for x in (F.lit(k), F.lit(v))])
    return F.when(F.coalesce(m[new], F.lit(0)) >= F.coalesce(m[old], F.lit(0)), new).otherwise(old)


def archived(backlog: DataFrame, log: DataFrame, done: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(backlog, log) after finished tasks have moved with a finish date."""
    moved = backlog.join(done, "id", "left_semi").withColumn("finished", now)
    return backlog.join(done, "id", "left_anti"), log.join(done, "id", "left_anti").unionByName(moved)


def to_clean(tasks: DataFrame, now: Column) -> DataFrame:
    """Tasks in the state they are to be removed in, or past their time."""
    return tasks.where((F.col("state") == F.col("cleanup_state")) | (F.col("started") + F.make_interval(secs=F.col("ttl")) < now))


def metric_sections(c: Column, names: Sequence[str]) -> Column:
    """Fields of a command's output whose sections are ``[name] a b c`` lines, as a map of arrays."""
    entries = [F.struct(F.lit(n), F.split(F.trim(F.regexp_extract(c, rf"(?m)^\[{n}\]\s*(.*)$", 1)), r"\s+")) for n in names]
    return F.map_from_entries(F.array(*entries))


def cluster_nodes(schema: DataFrame, column: str) -> DataFrame:
    """Nodes of a cluster description in JSON: (role, host, port)."""
    kind = "struct<cluster:struct<nodes:array<struct<role:string,host:string,ports:array<int>>>>>"
    nodes = F.from_json(column, kind)["cluster"]["nodes"]
    return schema.select(F.explode(nodes).alias("n")).select("n.role", "n.host", F.explode("n.ports").alias("port"))


def node_of(position: Column, nodes: int) -> Column:
    """Batch split: item i goes to node i mod n."""
    return F.pmod(position, F.lit(nodes))


def chain_items(chains: DataFrame, text: str, key: str, urls: DataFrame) -> DataFrame:
    """Items of chains, whose text is a list of URL hashes line by line, with their status."""
    items = chains.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "url_md5")).where("trim(url_md5) <> ''")
    return items.join(urls, "url_md5", "left")


def processable(items: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """Items of sites that are not disabled and have room for contents, or that have been processed before."""
    return items.join(sites.select(key, "state", "contents", "max_resources"), key).where("state <> 2 and (max_resources = 0 or contents <= max_resources or processed > 0)").select(*items.columns)


def feed_rows(urls: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """URLs with the first feed entry whose link is theirs: date and size."""
    first = entries.groupBy("link").agg(F.min_by(F.struct("date", "summary"), "pos").alias("e"))
    return urls.join(first, F.col("url") == F.col("link"), "left").select(*urls.columns, F.coalesce(F.try_to_timestamp(F.col("e.date")).cast("timestamp_ntz"), now).alias("p_date"), F.coalesce(F.length(F.to_json("e")), F.lit(0)).alias("size"))


#: Redirects that are looked up within each row; more are joined.
LISTED = 64


def resolved_links(rows: DataFrame, column: str, separator: str, redirects: DataFrame) -> DataFrame:
    """A field of links with each one replaced by its redirect target (source, target; of several targets the least).

    A few redirects are looked up where the rows are read, so that nothing moves. Many are joined to the distinct links of
    each row; the row itself moves with one of them only, and links without a redirect go no further.
    """
    known = redirects.where("source is not null and target is not null").groupBy("source").agg(F.min("target").alias("target"))
    few, rest = known.limit(LISTED + 1).collect(), [c for c in rows.columns if c != column]
    parts = F.split(F.col(f"`{column}`"), re.escape(separator))
    swapped = lambda links, found: F.array_join(F.transform(links, lambda x: F.coalesce(F.try_element_at(found, x), x)), separator)
    if len(few) <= LISTED:
        found = F.create_map(*[F.lit(x) for r in few for x in (r["source"], r["target"])]).cast("map<string,string>")
        return rows.select(*[F.col(f"`{c}`") for c in rest], swapped(parts, found).alias(column))
    none = F.lit(None).cast("string")
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_r"), F.array_distinct(parts).alias("_d"), F.monotonically_increasing_id().alias("_row"))
    each = keyed.select("_row", "_r", F.explode(F.concat(F.array(none), F.coalesce("_d", F.array().cast("array<string>")))).alias("_l"))
    # rows go by their number, not all to the place of null
    each = each.select("_row", "_l", F.when(F.col("_l").isNull(), F.col("_r")).alias("_r"), F.coalesce("_l", F.col("_row").cast("string")).alias("_k"), F.col("_l").isNotNull().alias("_n"))
    met = each.join(known.select(F.col("source").alias("_k"), F.lit(True).alias("_n"), F.col("target").alias("_t")), ["_k", "_n"], "left").where("not _n or _t is not null")
    hits = F.map_from_entries(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_l", "_t"))))
    out = met.groupBy("_row").agg(F.first("_r", ignorenulls=True).alias("_r"), hits.alias("_m")).select("_r.*", "_m")
    return out.select(*[F.col(f"`{c}`") for c in rest], swapped(parts, F.col("_m")).alias(column))


def differences(a: DataFrame, b: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Rows of one output that the other lacks, but for ignored fields, with the side they stand on."""
    names = [c for c in a.columns if c not in ignore]
    a, b = a.select(*names), b.select(*names)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def synced(urls: DataFrame, new: DataFrame, sites: DataFrame, key: str, active: Column) -> DataFrame:
    """New URLs that their site takes: unknown, site active, errors and active URLs within its limits."""
    counts = urls.groupBy(key).agg(F.count_if(active).alias("_active"))
    room = sites.join(counts, key, "left").where("state = 1 and (max_errors = 0 or errors <= max_errors) and (max_urls = 0 or coalesce(_active, 0) < max_urls)").select(key)
    return new.join(urls.select(key, "url_md5"), [key, "url_md5"], "left_anti").join(room, key, "left_semi")


def commanded(tasks: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id and answer of each command, the tasks after them). Commands by task id:

    set starts a task, check tells its state, terminate ends one that is not finished, get gives the result of a finished one, which then
    leaves, delete removes it. Tasks without a command stay as they are; commands to unknown tasks but set have a null answer.
    """
    both = tasks.join(commands, "id", "full_outer")
    c, state = F.col("command"), F.col("state")
    after = F.when(c == "set", "in_progress").when((c == "terminate") & (state != "finished"), "terminated").otherwise(state)
    answer = F.when(c == "get", F.when(state == "finished", state)).when(c != "delete", after)
    gone = F.coalesce((c == "delete") | ((c == "get") & (state == "finished")), F.lit(False)) | after.isNull()
    return both.where("command is not null").select("id", answer.alias("answer")), both.where(~gone).select("id", after.alias("state"))


def structure(nodes: DataFrame, cluster: str) -> DataFrame:
    """Nodes of each cluster by role (router, manager, replica; ``up`` tells which run), and the problems of its structure."""
    role = F.col("role")
    counts = nodes.groupBy(cluster).agg(F.count_if(role == "router").alias("routers"), F.count_if(role == "manager").alias("managers"), F.count_if(role == "replica").alias("replicas"), F.count_if((role == "replica") & ~F.col("up")).alias("down"))
    few = F.col("replicas") - F.col("down") < F.col("managers")
    found = F.array(F.when(F.col("routers") == 0, "no router"), F.when(F.col("managers") == 0, "no manager"), F.when(few, "too few replicas"))
    return counts.withColumn("problems", F.array_compact(found))
