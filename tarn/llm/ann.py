"""Approximate nearest neighbours by shifted Hilbert orderings.

Equal vectors are one class (the class keeps its smallest ids, all that can ever be reported), so a vector
that a third of all rows repeat is one point of the index. Each of ``curves`` orderings rotates and projects
the unit vectors to ``dims`` coordinates, shifts the grid, and sorts by Hilbert key with Spark's sampled range
partitioning. A query's candidates are the classes within ``window`` of all ranks around it on each curve;
blocks of consecutive ranks meet chunks of the queries whose windows reach into them, each meeting reports its best, and
the reports of all blocks and curves merge. Unit vectors travel in single precision; some more than ``k`` stay to the
end, where cosines are taken anew from the original vectors in double precision.

The window is a share of the rows, not a number, so recall does not sink as the table grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.common import Staged


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of grid cells (n, d) with ``bits`` bits a coordinate; d * bits <= 63 (Skilling's transform)."""
    x = cells.astype(np.int64).copy()
    n, d = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, 0)
            x[:, 0] ^= swap
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t[(x[:, d - 1] & q) != 0] ^= q - 1
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for k in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> k) & 1)
    return key


def projection(size: int, dims: int, curve: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """An orthonormal projection to ``dims`` coordinates and the shift of the grid, of one curve."""
    rng = np.random.default_rng([seed, curve])
    d = min(dims, size)
    basis = np.linalg.qr(rng.normal(size=(size, size)))[0][:, :d]
    return basis, rng.uniform(-0.5, 0.5, d)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest component first so that squares can't overflow."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query: str | None = None, k: int = 5, curves: int = 8, window: float = 0.2, dims: int = 8, bits: int = 6, block: int = 4096, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest cosines found for each query.

    ``query`` is a SQL condition on ``id`` (default: every row is a query). A vector that is null, empty, zero,
    holds a null or non-finite component, or has another length than most takes no part, nor does a null id. Of rows that
    repeat an id the smallest vector counts. Ties go to the smaller id; with fewer candidates than ``k`` all
    are given; an empty table gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    store = Staged(spark, "ann")
    number = F.col("v").cast("array<double>")
    sound = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).select("id", number.alias("v")).where(sound)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    size = int(sizes["n"])
    rows = rows.where(F.size("v") == size)
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("v"))).where("r = 1").drop("r")
    members = store.put(rows.withColumn("class", F.xxhash64("v")).withColumn("asks", F.expr(query) if query else F.lit(True)))
    # a class is a vector; its number is its hash, and vectors that share a hash are told apart by the vector itself
    of_class = Window.partitionBy("class", "v").orderBy("id")
    first = members.withColumn("r", F.row_number().over(of_class)).where(F.col("r") <= k + 1)
    classes = first.groupBy("class", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    asked = members.where("asks").select("class", "v").distinct().withColumn("asked", F.lit(True))
    points = store.put(classes.join(asked, ["class", "v"], "left").select(F.col("ids")[0].alias("p"), "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")))
    n = points.count()
    scale = spread(points, size, dims, curves, seed)
    half = int(-(-window * n // 2))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                u = unit(np.stack(b["v"].to_numpy()))
                for c in range(curves):
                    basis, shift = projection(size, dims, c, seed)
                    mean, sd = scale[c]
                    cell = np.clip(((u @ basis - mean) / sd + shift + 4) / 8, 0, 1 - 1e-9)
                    yield pd.DataFrame({"curve": c, "key": hilbert_keys((cell * (1 << bits)).astype(np.int64), bits), "p": b["p"], "v": list(u.astype(np.float32)), "asked": b["asked"]})

    id_type = points.schema["p"].dataType.simpleString()
    order = points.select("p", "v", "asked").mapInPandas(keyed, f"curve int, key long, p {id_type}, v array<float>, asked boolean")
    tasks = max(1, -(-curves * n // (8 * block)))
    ranged = store.put(order.repartitionByRange(tasks, "curve", "key", "p").sortWithinPartitions("curve", "key", "p").withColumn("m", F.monotonically_increasing_id()))
    # rank on its curve: position in its partition, and the rows of the curve in the partitions before it
    part = F.shiftright("m", 33)
    held = sorted((r["curve"], r["part"], r["low"], r["count"]) for r in ranged.groupBy("curve", part.alias("part")).agg(F.min("m").alias("low"), F.count("*").alias("count")).collect())
    starts, at = [], {}
    for c, p, low, count in held:  # one entry a partition and curve
        starts.append((c, p, at.get(c, 0) - low))
        at[c] = at.get(c, 0) + count
    offsets = spark.createDataFrame(starts, "curve int, part long, shift long")
    ranked = ranged.withColumn("part", part).join(F.broadcast(offsets), ["curve", "part"]).select("curve", (F.col("m") + F.col("shift")).alias("rank"), "p", "v", "asked")
    ranked = ranked.withColumn("block", F.expr(f"rank div {block}"))
    # a block of ranks meets a chunk of as many queries, more or less, so a meeting stays small whatever share of the rows asks
    chunk = block * max(1, n // max(1, points.where("asked").count()))
    reach = lambda size: F.sequence(F.expr(f"greatest(rank - {half}, 0) div {size}"), F.expr(f"least(rank + {half}, {n - 1}) div {size}"))
    asks = ranked.where("asked").withColumn("chunk", F.expr(f"rank div {chunk}")).select(F.col("curve").alias("c"), F.explode(reach(block)).alias("b"), F.col("chunk").alias("ch"), F.col("rank").alias("at"), F.col("p").alias("q"), F.col("v").alias("qv"))
    near_chunks = F.sequence(F.expr(f"greatest(block * {block} - {half}, 0) div {chunk}"), F.expr(f"least((block + 1) * {block} - 1 + {half}, {n - 1}) div {chunk}"))
    pools = ranked.select(F.col("curve").alias("pc"), F.col("block").alias("pb"), F.explode(near_chunks).alias("pch"), F.col("rank").alias("pr"), F.col("p").alias("pp"), F.col("v").alias("pv")).toDF("curve", "block", "chunk", "rank", "p", "v")
    most = k + 6  # single precision may swap near neighbours; the end sorts them out

    def best(key: tuple, pool: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(pool) or not len(ask):
            return pd.DataFrame({"q": ask["q"][:0], "p": pool["p"][:0], "score": np.zeros(0)})
        pool = pool.sort_values("p")
        u, rank, ids = np.stack(pool["v"].to_numpy()), pool["rank"].to_numpy(), pool["p"].to_numpy()
        out = []
        for lo in range(0, len(ask), 256):
            a = ask.iloc[lo : lo + 256]
            s = np.stack(a["qv"].to_numpy()) @ u.T
            s[np.abs(a["at"].to_numpy()[:, None] - rank[None, :]) > half] = -np.inf
            top = np.argpartition(-s, min(most, s.shape[1] - 1), axis=1)[:, :most]
            score = np.take_along_axis(s, top, 1)
            keep = np.isfinite(score)
            out.append(pd.DataFrame({"q": np.repeat(a["q"].to_numpy(), top.shape[1])[keep.ravel()], "p": ids[top][keep], "score": score[keep].astype(float)}))
        return pd.concat(out)

    found = pools.groupBy("curve", "block", "chunk").cogroup(asks.groupBy("c", "b", "ch")).applyInPandas(best, f"q {id_type}, p {id_type}, score double")
    found = found.groupBy("q", "p").agg(F.max("score").alias("score"))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "p"))).where(F.col("r") <= most)
    # to ids: a class gives its smallest ones, with the score recomputed from the original vectors
    own = points.select(F.col("p").alias("q"), F.col("v").alias("qv")).where("asked")
    near = found.join(own, "q").join(points.select("p", "v", "ids"), "p").select("q", "qv", "v", "ids")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = near.withColumn("score", dot("qv", "v") / (F.sqrt(dot("qv", "qv")) * F.sqrt(dot("v", "v")))).select("q", "score", F.explode("ids").alias("vec_id"))
    of_query = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("r", F.row_number().over(of_query)).where(F.col("r") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    who = members.where("asks").join(points.select(F.col("p").alias("q"), "v").where("asked"), "v").select(F.col("id").alias("query_id"), "q")
    mine = who.join(near, "q").select("query_id", F.expr(f"slice(filter(near, x -> x.vec_id <> query_id), 1, {k})").alias("near"))
    return mine.select("query_id", F.posexplode("near").alias("i", "x")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def spread(points: DataFrame, size: int, dims: int, curves: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of every projected coordinate over all points; the sums that reach the driver have a fixed size."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1, size + 1))
        for b in batches:
            if len(b):
                u = np.c_[unit(np.stack(b["v"].to_numpy())), np.ones(len(b))]
                total += u.T @ u
        yield pd.DataFrame({"i": np.arange(size + 1), "row": list(total)})

    got = points.select("v").mapInPandas(sums, "i int, row array<double>").select("i", F.posexplode("row")).groupBy("i", "pos").agg(F.sum("col").alias("x")).collect()
    m = np.zeros((size + 1, size + 1))
    for r in got:
        m[r["i"], r["pos"]] = r["x"]
    n = max(1.0, m[size, size])
    mean, second = m[size, :size] / n, m[:size, :size] / n
    out = []
    for c in range(curves):
        basis, _ = projection(size, dims, c, seed)
        mu = mean @ basis
        var = np.einsum("ij,ik,kj->j", basis, second, basis) - mu**2
        out.append((mu, np.sqrt(np.maximum(var, 1e-12))))
    return out


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), query="id % 50 = 0")
