"""Lookups and enrichments between sites, URLs and their side tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.rows import per_row


def longest_prefix(rows: DataFrame, url: str, sites: DataFrame, prefix: str, value: str, separators: str = "/") -> DataFrame:
    """The site with the longest stored URL that prefixes each row's URL, as an equi-join on the URL's own prefixes.

    Prefixes are cut after every separator and at the end, so stored URLs must end there too.
    """
    parts = F.split(F.col(url), f"(?<=[{separators}])")
    candidates = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "")), F.array(url)))
    known = sites.select(F.col(prefix).alias("_prefix"), F.col(value).alias("_value"))
    best = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(F.length("_prefix"), F.col("_value"))))
    return per_row(rows, lambda keyed: keyed.withColumn("_prefix", F.explode(candidates)).join(known, "_prefix", "left"), **{value: best})


def with_lists(rows: DataFrame, key: str, many: DataFrame, name: str, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each row with the sorted list of its rows in another table (empty if none)."""
    lists = many.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))
    kind = lists.schema[name].dataType.simpleString()
    return rows.join(lists, key, "left").withColumn(name, F.coalesce(name, F.expr(f"cast(array() as {kind})")))


def not_in(rows: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """NOT IN with its null semantics: a null on the other side leaves nothing, a null key passes only against an empty list.

    An anti-join by key and one row about the other side, so neither side has to fit into a task.
    """
    values = other.select(F.col(other_key).alias("_other"))
    about = values.agg(F.count("*").alias("_n"), F.count_if(F.col("_other").isNull()).alias("_nulls"))
    left = rows.join(values.where("_other is not null").distinct(), F.col(key) == F.col("_other"), "left_anti")
    return left.join(F.broadcast(about), F.lit(True)).where((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(key).isNotNull())).drop("_n", "_nulls")  # one row


def property_value(rows: DataFrame, key: str, properties: DataFrame, name: str, default: Column | None = None) -> DataFrame:
    """Rows with a site property as column ``name``, or its default."""
    one = properties.where(F.col("name") == name).groupBy(key).agg(F.max("value").alias(name))
    out = rows.join(one, key, "left")
    return out if default is None else out.withColumn(name, F.coalesce(name, default))


def chained(rows: DataFrame, keys: Sequence[str], order: str, text: str, joiner: str = "\n") -> DataFrame:
    """The texts of each chain joined in order."""
    lists = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(text))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(lists, lambda x: x[text]), joiner).alias(text))
