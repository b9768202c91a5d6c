"""Connected components by minimum labels and pointer jumping, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import Staged


def components(edges: DataFrame, store: Staged) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b longs): the smallest node of its component.

    Each round replaces every edge's ends by their labels, so a component shrinks at least by the pairs it holds; a round
    writes its tables, no lineage grows. Minima are combined before the shuffle, so a hub is one row a task.
    """
    pairs = edges.select("a", "b").where("a <> b")
    live = store.put(pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    hooks: list[DataFrame] = []
    while not live.isEmpty():
        # every node hooks to its smallest neighbour if that is smaller than itself
        up = store.put(live.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        while True:  # to the root of the tree that the hooks make
            jump = store.put(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            up = jump.select("node", "up")
            if jump.where("moved").isEmpty():
                break
        hooks.append(up)
        one = live.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").select("x", "b")
        both = one.join(up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b").select("x", "y").where("x <> y")
        live = store.put(both.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if not hooks:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    label = hooks[-1]
    for h in reversed(hooks[:-1]):  # a root of one round may have hooked to another in the next
        label = store.put(h.join(label.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("up")))
    return label.select("node", F.col("up").alias("label"))
