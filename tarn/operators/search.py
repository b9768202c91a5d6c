"""Weighted full-text search over an inverted index held as a table."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.lineage import checkpointed

#: Weights of the fields (fixed values).
WEIGHTS = {"title": 8, "h": 7, "bodys": 6, "bodyn": 5, "ref": 4, "alt": 3, "meta": 2, "url": 1}


def tokens(c: Column) -> Column:
    """Lowered words of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


@dataclass(frozen=True)
class Tokeniser:
    """Settings of an index: characters of a word beside letters and digits, the least length, stop words, forms of words, and suffixes to cut (longest first)."""

    more_chars: str = ""
    least: int = 1
    stop: Sequence[str] = ()
    forms: Mapping[str, str] | None = None
    suffixes: Sequence[str] = ()

    def tokens(self, c: Column) -> Column:
        out = F.filter(F.split(F.lower(c), rf"[^\p{{L}}\p{{N}}{re.escape(self.more_chars)}]+"), lambda w: (F.length(w) >= max(1, self.least)) & ~w.isin(*self.stop, ""))
        if self.forms:
            known = F.create_map(*[F.lit(x) for pair in self.forms.items() for x in pair])
            out = F.transform(out, lambda w: F.coalesce(known[w], w))
        if self.suffixes:
            out = F.transform(out, lambda w: F.regexp_replace(w, "(?<=.{3})(?:" + "|".join(map(re.escape, self.suffixes)) + ")$", ""))
        return out


def index(docs: DataFrame, key: str, fields: Mapping[str, str]) -> DataFrame:
    """(term, field, key, tf); ``fields`` maps index fields to columns."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("text")) for f, c in fields.items()])
    rows = docs.select(key, F.explode(parts).alias("p")).select(key, "p.field", F.explode(tokens(F.col("p.text"))).alias("term"))
    return rows.groupBy("term", "field", key).agg(F.count("*").alias("tf"))


def merged(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """An index with the documents of another in place of its own."""
    return without(a, b.select(key).distinct(), key).unionByName(b)


def without(idx: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return idx.join(keys, key, "left_anti")


@dataclass(frozen=True)
class Filter:
    """Values (0), numeric range (1), float range (2) or text (3) of an attribute; ``exclude`` turns it round."""

    kind: int
    attribute: str
    values: Sequence
    exclude: bool = False

    def column(self) -> Column:
        c = F.col(self.attribute)
        out = c.isin(*self.values) if self.kind in (0, 3) else c.between(self.values[0], self.values[1])
        return ~out if self.exclude else out


def search(idx: DataFrame, docs: DataFrame, key: str, query: str, filters: Sequence[Filter] = (), weights: Mapping[str, int] = WEIGHTS, order: Sequence[Column] = (), offset: int = 0, limit: int = 10, any_term: bool = False) -> DataFrame:
    """Matches of all terms (or any): key, weight = sum of field weight * tf, hits (terms found), ordered by weight or ``order``."""
    terms = sorted(set(query.lower().split()))
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    found = idx.where(F.col("term").isin(*terms)).groupBy(key).agg(F.sum(F.coalesce(w[F.col("field")], F.lit(1)) * F.col("tf")).alias("weight"), F.count_distinct("term").alias("hits"))
    if not any_term:
        found = found.where(F.col("hits") == len(terms))
    out = found.join(docs, key)
    for f in filters:
        out = out.where(f.column())
    out = out.orderBy(*(order or [F.desc("weight"), F.col(key)]))
    return (out.offset(offset) if offset else out).limit(limit)


def word_info(idx: DataFrame, key: str, query: str) -> DataFrame:
    """For each word of a query, its documents and hits."""
    return idx.where(F.col("term").isin(*query.lower().split())).groupBy("term").agg(F.count_distinct(key).alias("docs"), F.sum("tf").alias("hits"))


def in_turn(df: DataFrame, order: Sequence[str], nodes: int) -> DataFrame:
    """Rows with the ``node`` they go to when they are dealt one after another in an order.

    Places come from the counts of a range partition, so no task holds more than its share.
    """
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    before, shifts = 0, []
    for r in sorted(ranged.groupBy(part.alias("p")).agg(F.min("_m").alias("low"), F.count("*").alias("n")).collect()):  # one row a partition
        shifts.append((r["p"], before - r["low"]))
        before += r["n"]
    moved = df.sparkSession.createDataFrame(shifts, "_p long, _shift long")
    return ranged.withColumn("_p", part).join(F.broadcast(moved), "_p").withColumn("node", F.pmod(F.col("_m") + F.col("_shift"), F.lit(nodes)).cast("int")).drop("_p", "_m", "_shift")


def routed(df: DataFrame, mode: str, nodes: int, *keys: str) -> DataFrame:
    """Rows dealt to nodes: round robin, random, or by key."""
    if mode == "round_robin":
        return df.repartition(nodes)
    return df.repartition(nodes, F.rand(seed=1)) if mode == "random" else df.repartition(nodes, *keys)
