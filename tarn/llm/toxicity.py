"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of hashed words, word stems (first letters), neighbouring pairs and pairs
with one word between. Training takes a bounded sample of the labelled rows, in an order fixed by a hash, in one
executor task; per-coordinate rates and the L1 term leave few weights, which alone reach the driver and go
to the executors (at most 2**bits of them). Scoring is one pass over whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import chunks, fold64

WORD = re.compile(r"\w+")
STEMS = (4, 5)  # letters
CACHE = 1 << 18


class Words(dict):
    """Numbers of words, and by number the 64-bit ids of the word and its stems."""

    def __init__(self):
        super().__init__()
        self.table = np.zeros((1 << 12, 1 + len(STEMS)), np.uint64)

    def room(self) -> None:
        """Forget all words when there are too many; only between texts."""
        if len(self) > CACHE:
            self.clear()

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        h = lambda s, salt: zlib.crc32(s) | zlib.crc32(s, salt) << 32
        self.table[i] = (h(word.encode(), 77), *(h(word[:n].encode(), 90 + n) for n in STEMS))
        self[word] = i
        return i


def features(text: str, words: Words, bits: int) -> np.ndarray:
    """Sorted distinct buckets of a text."""
    words.room()
    got = WORD.findall(text.lower())
    if not got:
        return np.zeros(0, np.int32)
    at = np.fromiter(map(words.__getitem__, got), np.int64, len(got))
    w, *stems = words.table[at].T
    k = np.uint64(0x9E3779B97F4A7C15)
    keys = np.concatenate([w, *stems, w[:-1] * k + w[1:], (w[:-2] * k + w[2:]) ^ k])
    return np.unique((fold64(keys) >> np.uint64(64 - bits)).astype(np.int32))


@dataclass
class Ftrl:
    """FTRL-proximal over binary features; ``w`` is lazy, from z and n."""

    bits: int = 20
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 1.0

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Indices and values of the weights that aren't zero, and the bias."""
        z, n = np.zeros(1 << self.bits), np.zeros(1 << self.bits)
        bz, bn = 0.0, 0.0
        rng = np.random.default_rng(0)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                x = rows[i]
                zi, ni = z[x], n[x]
                root = np.sqrt(ni)
                w = np.where(np.abs(zi) <= self.l1, 0.0, -(zi - np.sign(zi) * self.l1) / ((self.beta + root) / self.alpha + self.l2))
                b = -bz / ((self.beta + np.sqrt(bn)) / self.alpha)
                p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
                g = p - y[i]
                z[x] = zi + g - (np.sqrt(ni + g * g) - root) / self.alpha * w
                n[x] = ni + g * g
                s = (np.sqrt(bn + g * g) - np.sqrt(bn)) / self.alpha
                bz, bn = bz + g - s * b, bn + g * g
        at = np.flatnonzero(np.abs(z) > self.l1)
        w = -(z[at] - np.sign(z[at]) * self.l1) / ((self.beta + np.sqrt(n[at])) / self.alpha + self.l2)
        return at.astype(np.int32), w, float(-bz / ((self.beta + np.sqrt(bn)) / self.alpha))


@dataclass
class Model:
    at: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that labels are never learned from: crc32 of the id as text leaves 2 modulo 4; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 32768, epochs: int = 6, params: Ftrl | None = None) -> Model:
    """A model from at most ``max_rows`` labelled rows that aren't held out (those with the smallest hash of doc_id).

    Several labels of one id count as the largest; of rows that repeat an id one text counts (that with the least features). Null
    ids, labels and texts give no example; an empty text is an example without features; texts are whole however long; other columns are not
    read. Without any example the model scores every text 0.
    """
    p = params or Ftrl()
    picked = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
    picked = picked.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")  # max_rows pairs of numbers
    bits = p.bits

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in chunks(batches):
            x = pa.array([features(t.as_py(), words, bits) for t in b.column(2)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), x], ["k", "y", "x"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        x, y = [np.asarray(v, np.int32) for b in got for v in b["x"]], np.concatenate([b["y"].to_numpy() for b in got]).astype(float)
        at, w, bias = p.fit(x, y, epochs)
        yield pd.DataFrame({"at": [at], "w": [w], "bias": [bias]})

    examples = rows.select(F.xxhash64("doc_id").alias("k"), "y", "text").mapInArrow(hashed, "k long, y int, x array<int>")
    once = examples.groupBy("k").agg(F.min("y").alias("y"), F.min("x").alias("x"))  # rows that repeat an id are one example
    got = once.select("k", "y", "x").repartition(1).sortWithinPartitions("k").mapInPandas(fit, "at array<int>, w array<double>, bias double").collect()
    if not got:
        return Model(np.zeros(0, np.int32), np.zeros(0), -100.0, bits)
    return Model(np.array(got[0]["at"], np.int32), np.array(got[0]["w"]), got[0]["bias"], bits)


def with_score(df: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``df`` with a column of scores from 0 to 1 of whole texts; a null text scores as the empty one, a very long one takes memory in proportion. Repeated rows are scored each, an empty table gives none. An input column of that name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast((model.at, model.weight, model.bias, model.bits))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, weight, bias, bits = shared.value
        w, words = np.zeros(1 << bits), Words()
        w[at] = weight
        for texts in batches:
            raw = np.array([w[features(t or "", words, bits)].sum() for t in texts]) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(raw, -35, 35))))

    return df.withColumn(name, score(F.col(f"`{text_col}`")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document; labels come only from rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
