"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. The input is staged once, each row with (source partition, position).
2. Every shard is cut into blocks of fixed, exact sizes. How many rows of source partition p go to
   block b is one draw of the multivariate hypergeometric law over the whole matrix. The matrix is never
   built: partitions are the leaves of a binary tree, an inner node splits its column totals between its
   children with a generator seeded by the node, and a task walks only the path to its own leaf.
3. Each partition permutes its rows locally and deals them by its matrix row, the exchange brings a
   block together, and a second permutation inside the block gives each row its slot.

The result is a uniformly random permutation, cut into shards whose row counts differ by one at most.
A shard is many blocks, so no task ever holds a shard, and keys play no part, so no key can be hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.common import Staged

NUMPY_LIMIT = 10**9  # numpy draws hypergeometric numbers from fewer marbles than this


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One exact draw; above numpy's limit by inversion over the window that holds all but 1e-18 of the mass."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    total = good + bad
    sd = math.sqrt(n * (good / total) * (bad / total) * (total - n) / max(1, total - 1)) + 1
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (total + 2)))
    a, b = max(lo, mode - int(10 * sd)), min(hi, mode + int(10 * sd))
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logs - logs.max()).cumsum()
    return a + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def split(rng: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """How many of each colour are among n marbles drawn without replacement."""
    total = int(colours.sum())
    if total < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(colours, n, method="marginals")
    out = np.zeros_like(colours)
    for i, c in enumerate(colours):
        total -= int(c)
        out[i] = x = hypergeometric(rng, int(c), total, n)
        n -= x
    return out


def matrix_row(counts: np.ndarray, sizes: np.ndarray, leaf: int, seed: int) -> np.ndarray:
    """Row ``leaf`` of the communication matrix with row sums ``counts`` and column sums ``sizes``."""
    before = np.concatenate([[0], np.cumsum(counts)])
    lo, hi, left = 0, len(counts), sizes.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        part = split(np.random.default_rng([seed, lo, hi]), left, int(before[mid] - before[lo]))
        if leaf < mid:
            hi, left = mid, part
        else:
            lo, left = mid, left - part
    return left


def exact_sizes(n: int, shards: int) -> list[int]:
    """Shard sizes at most one apart."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def block_plan(n: int, shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks in order: size, shard and first slot; those of one shard differ by a row at most."""
    size, shard, first = [], [], []
    for s, rows in enumerate(exact_sizes(n, shards)):
        at = 0
        for x in exact_sizes(rows, max(1, -(-rows // block_rows))):
            size.append(x), shard.append(s), first.append(at)
            at += x
    return np.array(size), np.array(shard), np.array(first)


def shuffle_shards(df: DataFrame, shards: int = 24, seed: int = 1, block_rows: int = 8192) -> DataFrame:
    """Every input row once, with ``shard`` int and ``slot`` long (gapless from 0 in its shard).

    Nulls, empty and very long texts are carried along unread; repeated rows each get a place of their own;
    an empty table gives no rows; with fewer rows than shards some shards stay empty. Input columns named
    ``shard`` or ``slot`` are replaced. ``block_rows`` grows to rows/50000 so the number of blocks stays bounded.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    store = Staged(spark, "shards")
    rows = store.put(df.select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias("_tarn_mid")))
    counted = sorted((r["p"], r["count"]) for r in rows.groupBy(F.shiftright("_tarn_mid", 33).alias("p")).count().collect())
    parts = {p: i for i, (p, _) in enumerate(counted)}
    counts = np.array([c for _, c in counted], dtype=np.int64)
    n = int(counts.sum())
    size, shard, first = block_plan(n, shards, max(block_rows, -(-n // 50000)))

    def dealt(p: int) -> tuple[np.ndarray, np.ndarray]:
        """Block and sort key of each position of source partition p."""
        leaf = parts[p]
        rng = np.random.default_rng([seed, 1, leaf])
        deal = np.repeat(np.arange(len(size), dtype=np.int32), matrix_row(counts, size, leaf, seed))
        return rng.permuted(deal), rng.integers(0, 2**63 - 1, len(deal))

    @F.pandas_udf("block int, key long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for mid in batches:
            v = mid.to_numpy()
            part, pos = v >> 33, v & ((1 << 33) - 1)
            block, key = np.empty(len(v), np.int32), np.empty(len(v), np.int64)
            for p in np.unique(part):
                m = part == p
                if p not in seen:
                    seen = {p: dealt(int(p))}
                b, k = seen[p]
                block[m], key[m] = b[pos[m]], k[pos[m]]
            yield pd.DataFrame({"block": block, "key": key})

    table = spark.createDataFrame(pd.DataFrame({"_tarn_block": np.arange(len(size), dtype=np.int32), "shard": shard.astype(np.int32), "_tarn_first": first.astype(np.int64)}))
    w = Window.partitionBy("_tarn_block").orderBy("_tarn_key", "_tarn_mid")
    placed = rows.withColumn("_tarn_at", place("_tarn_mid")).select(*[F.col(f"`{c}`") for c in kept], "_tarn_mid", F.col("_tarn_at.block").alias("_tarn_block"), F.col("_tarn_at.key").alias("_tarn_key"))
    return (
        placed.withColumn("_tarn_rank", F.row_number().over(w) - 1)
        .join(F.broadcast(table), "_tarn_block")  # at most 50000 rows more than there are shards
        .select(*[F.col(f"`{c}`") for c in kept], "shard", (F.col("_tarn_first") + F.col("_tarn_rank")).alias("slot"))
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return shuffle_shards(docs).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
