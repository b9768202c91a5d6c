"""Dedup and merge of partial results by exact rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.lineage import checkpointed


def first_wins(df: DataFrame, keys: Sequence[str], position: Sequence[Column]) -> DataFrame:
    """The first row of each key in order of position."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*position))).where("_rn = 1").drop("_rn")


def url_replaces(old: dict, new: dict) -> bool:
    """Whether a URL row replaces the one kept: a status not lower with crawl, processing and batch done; or, at equal status, the first crawl; or a newer update of two crawled ones."""
    if old["status"] <= new["status"] and min(new["crawled"], new["processed"], new["batch_id"]) > 0:
        return True
    if old["status"] != new["status"] or new["crawled"] <= 0:
        return False
    return old["crawled"] == 0 or (old["crawled"] > 0 and new["u_date"] > old["u_date"])


def content_replaces(old: dict, new: dict) -> bool:
    """Whether a content row replaces the one kept: a batch where there was none, a higher status, or a newer update."""
    return (old["batch_id"] == 0 and new["batch_id"] != 0) or new["status"] > old["status"] or new["u_date"] > old["u_date"]


def folded(df: DataFrame, keys: Sequence[str], order: Sequence[str], replaces: Callable[[dict, dict], bool]) -> DataFrame:
    """One row a key by an order-dependent fold over its rows, which stream by in order: a task holds one row, however many a key has."""
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, None
        for b in batches:
            done = []
            for row in b.to_dict("records"):
                key = tuple(None if pd.isna(row[k]) else row[k] for k in keys)
                if kept is None or key != last:
                    if kept is not None:
                        done.append(kept)
                    last, kept = key, row
                elif replaces(kept, row):
                    kept = row
            yield pd.DataFrame(done, columns=names)
        if kept is not None:
            yield pd.DataFrame([kept], columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, df.schema)


def latest_by_total_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The variant of the URL merge that is a total order: status, crawled or not, update time, position from the end."""
    best = F.struct("status", (F.col("crawled") > 0).alias("c"), "u_date", -F.col("pos"))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), best).alias("_r")).select(*keys, "_r.*")


def same_contents(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Groups of content rows of one site that share a URL, a raw content or a content URL hash, transitively: column ``entity`` (least position).

    Rows are tied to the least row of each group they are in; the ties are contracted by smallest neighbours and pointer jumping, so
    a chain takes rounds as the logarithm of its length. Each round is written.
    """
    keys = [("site_id", "url_md5"), ("site_id", "raw_content_md5"), ("site_id", "content_url_md5")]
    node = F.col(pos).cast("long").alias("a")
    ties = None
    for site, k in keys:
        rows = df.where(F.coalesce(F.col(k), F.lit("")) != "").select(site, k, node)
        least = rows.groupBy(site, k).agg(F.min("a").alias("b"))
        one = rows.join(least, [site, k]).where("a <> b").select("a", "b")
        ties = one if ties is None else ties.unionAll(one)
    live = checkpointed(ties.unionAll(ties.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        up = checkpointed(live.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up")))
        while True:  # to the root that the smallest neighbours lead to
            above = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
            up2 = checkpointed(up.join(above, "up").select("a", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            up = up2.select("a", "up")
            if up2.where("moved").isEmpty():
                break
        rounds.append(up)
        half = live.join(up.select("a", F.col("up").alias("x")), "a").select("x", "b")
        both = half.join(up.select(F.col("a").alias("b"), F.col("up").alias("y")), "b").where("x <> y")
        live = checkpointed(both.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    label = None
    for up in reversed(rounds):  # a root of one round may have a root of its own in the next
        label = up if label is None else checkpointed(up.join(label.select(F.col("a").alias("up"), F.col("up").alias("top")), "up", "left").select("a", F.coalesce("top", "up").alias("up")))
    if label is None:
        return df.withColumn("entity", F.col(pos).cast("long"))
    own = label.select(F.col("a").alias("_a"), F.col("up").alias("_up"))
    return df.join(own, F.col(pos).cast("long") == F.col("_a"), "left").withColumn("entity", F.coalesce("_up", F.col(pos).cast("long"))).select(*df.columns, "entity")


def without_repeats(lines: Column, trim: bool = True) -> Column:
    """Lines of a text array without those equal to the line before."""
    key = (lambda x: F.trim(x)) if trim else (lambda x: x)
    return F.filter(lines, lambda x, i: (i == 0) | (key(x) != key(F.element_at(lines, i))))


def filled(left: Column, right: Column) -> Column:
    """The left value unless it is null or blank, else the right."""
    return F.when(F.trim(F.coalesce(left, F.lit(""))) != "", left).otherwise(right)


def merged_maps(left: Column, right: Column) -> Column:
    """Fill-if-empty merge of two maps of strings."""
    return F.map_zip_with(F.coalesce(left, F.create_map()), F.coalesce(right, F.create_map()), lambda k, a, b: filled(a, b))


def extended(base: DataFrame, more: DataFrame, key: str, order: Sequence[Column], cap: int) -> DataFrame:
    """A batch with the new items of another, first ones first, up to ``cap`` items in all."""
    room = F.broadcast(base.agg(F.greatest(F.lit(cap) - F.count("*"), F.lit(0)).alias("_room")))
    new = first_wins(more.join(base.select(key), key, "left_anti"), [key], order).withColumn("_p", F.struct(*order))
    # of at most ``cap`` new rows the place is known after one distributed top-k
    top = new.orderBy("_p").limit(cap).withColumn("_n", F.row_number().over(Window.orderBy("_p")))
    return base.unionByName(top.join(room).where(F.col("_n") <= F.col("_room")).select(*base.columns))


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current rows with those of ``changes`` put in or over them by key."""
    return current.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes.select(*current.columns))


def patched(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial update: only fields that are not null in ``changes`` are written."""
    names = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in names])
    out = current.join(new, list(keys), "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in current.columns])
