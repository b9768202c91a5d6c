"""Corpus pipeline: raw documents to packed training sequences.

toxicity -> near duplicates -> benchmark decontamination -> personal data -> packing. Each stage calls one operator of
``tarn.llm`` on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.common import Staged
from tarn.llm.decontam import with_leaks
from tarn.llm.jaccard import similar_groups
from tarn.llm.packing import pack
from tarn.llm.pii import masked, with_personal
from tarn.llm.pii import train as train_personal
from tarn.llm.toxicity import train as train_toxicity
from tarn.llm.toxicity import with_score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3; the model learns from the labels of rows that aren't held out."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_score(docs.select(*COLUMNS), model, name="_score").where(F.col("_score") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id (a null one is the largest); of rows that repeat id and text one."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.xxhash64("text").alias("h"))  # texts under one id are told apart
    keyed = docs.select(*COLUMNS, row.alias("_row"))
    stays = similar_groups(keyed, "_row").where("_row = component_id").select("_row").distinct()
    same = Window.partitionBy("_row").orderBy("lang", "source", "n_chars")
    return keyed.join(stays, "_row", "left_semi").withColumn("_n", F.row_number().over(same)).where("_n = 1").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return with_leaks(docs.select(*COLUMNS), bench, name="_leaks").where(F.size("_leaks") == 0).select(*COLUMNS)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by [KIND]; n_chars is that of the new text (null stays null)."""
    found = with_personal(docs.select(*COLUMNS), train_personal(docs), name="_spans")
    text = F.when(F.size("_spans") > 0, masked(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal),
    ("packing", pack_sequences),
]

#: Trained scores, graph components and packing have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; a stage's table goes when the next one is written.

    Null and empty texts are clean, never near duplicates and packed as the END id; texts are whole however long; rows with a null doc_id
    are kept unless they are a near copy of another row; rows that repeat id and text are one from the second stage on, ties go to the
    smaller doc_id; columns beside those of documents are dropped, whatever their names; empty tables give no rows.
    """
    store, docs = Staged(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = store.final(stage(spark, docs, sf_dir))
    return docs
