"""Hierarchical residual packing of tokenised documents into sequences of bounded length.

A document is its token ids and one end id. Longer ones than a sequence are cut so that all pieces but the
first are full. Each input partition packs its pieces by best-fit decreasing and emits the bins that are
full but for ``slack`` tokens; underfull bins go up a tree as items: a round gathers the bins of ``fan_in``
partitions in one, packs them by best fit again and emits what has become nearly full. The last round emits
all. A task gets at most ``node_bins`` bins on average; when the tree can't narrow under that bound the rest
is emitted as it is, so no node grows with the input.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import Staged

END = 0  # the id that ends a document
END_OF_TEXT = 50256  # the vocabulary's one special token


@cache
def encoder(path: str):
    """The byte-level BPE of ``path`` (merge ranks); gives the ids of the JSON form of the same vocabulary about five times as fast."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": END_OF_TEXT})


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids of a text and END, as little-endian uint32."""
    ids = encoder(path).encode(text, allowed_special="all")
    ids.append(END)
    return np.array(ids, dtype="<u4")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit decreasing: the bin of each item, bins numbered from 0."""
    out = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms: list[int] = []  # those with bins, sorted
    bins = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = free[room].pop()
            if not free[room]:
                del rooms[at]
        else:
            room, b = capacity, bins
            bins += 1
        out[i] = b
        if room := room - n:
            if not free[room]:
                insort(rooms, room)
            free[room].append(b)
    return out


def item_type(id_type: T.DataType, with_ids: bool) -> T.StructType:
    fields = [("doc_id", id_type), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("offset", T.LongType())]
    return T.StructType([T.StructField(n, t) for n, t in [*fields, *([("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])]])


def merged(lengths: np.ndarray, items: pa.ListArray, capacity: int) -> tuple[np.ndarray, pa.ListArray]:
    """Units of given lengths, each with its items, packed: the fill and the items of each bin."""
    bin_of = best_fit(lengths, capacity)
    order = np.argsort(bin_of, kind="stable")
    sorted_bin, sorted_len = bin_of[order], lengths[order]
    ends = np.cumsum(sorted_len)
    heads = np.flatnonzero(np.r_[True, sorted_bin[1:] != sorted_bin[:-1]])
    base = (ends - sorted_len) - np.repeat((ends - sorted_len)[heads], np.diff(np.r_[heads, len(order)]))
    lists = items.take(pa.array(order))
    per_unit = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    names = [f.name for f in flat.type]
    columns = [flat.field(n) for n in names]
    at = names.index("offset")
    columns[at] = pa.array(columns[at].to_numpy() + np.repeat(base, per_unit))
    cut = np.r_[0, np.cumsum(per_unit)][np.r_[heads, len(order)]]
    fill = np.add.reduceat(sorted_len, heads)
    return fill, pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(flat.type)))


def bins_batch(fill: np.ndarray, items: pa.ListArray, done: np.ndarray, level: int) -> pa.RecordBatch:
    first = (level << 56) | (TaskContext.get().partitionId() << 28)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(fill), dtype=np.int64)), pa.array(fill.astype(np.int64)), pa.array(done), items], ["sequence_id", "fill", "done", "items"])


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, slack: int = 16, fan_in: int = 8, node_bins: int = 50000, with_ids: bool = False, vocab: str | None = None) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if ``with_ids``).

    A null text is the empty one, which is the END id alone; null ids are carried; repeated rows are packed
    each; columns other than the two named are not read; an empty table gives no rows. Ties go to the earlier row.
    """
    spark, path = df.sparkSession, vocab or vocabulary()
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    item = item_type(docs.schema["doc_id"].dataType, with_ids)
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("fill", T.LongType()), T.StructField("done", T.BooleanType()), T.StructField("items", T.ArrayType(item))])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of: list = []
        who, piece, start, length, crc = [], [], [], [], []
        id_kind = None
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = token_ids(text or "", path)
                cuts = [*range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                at = 0
                for k, end in enumerate(cuts):
                    part = ids[at:end]
                    who.append(d), piece.append(k), start.append(at), length.append(end - at), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids_of.append(part.astype(np.int32))
                    at = end
        if not who:
            return
        n = np.array(length, np.int64)
        fields = [pa.array(who, id_kind), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.zeros(len(n), np.int64))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "offset"]
        if with_ids:
            fields.append(pa.array(ids_of, pa.list_(pa.int32())))
            names.append("ids")
        units = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1), pa.int32()), pa.StructArray.from_arrays(fields, names))
        fill, items = merged(n, units, capacity)
        yield bins_batch(fill, items, fill >= capacity - slack, 0)

    def node(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if not got:
                return
            table = pa.Table.from_batches(got).combine_chunks()
            items = table["items"].chunk(0) if table["items"].num_chunks == 1 else pa.concat_arrays(table["items"].chunks)
            fill, items = merged(table["fill"].to_numpy(), items, capacity)
            yield bins_batch(fill, items, np.full(len(fill), True) if last else fill >= capacity - slack, level)

        return run

    store = Staged(spark, "packing")
    read = lambda p: spark.read.schema(schema).parquet(p)
    paths = [store.write(docs.mapInArrow(leaf, schema))]
    out = read(paths[0]).where("done")
    parts = 0
    for level in range(1, 64):
        left = read(paths[-1]).where("not done")
        n, tasks = left.agg(F.count("*"), F.count_distinct(F.shiftright("sequence_id", 28))).first()
        parts = parts or tasks
        width = max(-(-parts // fan_in), -(-n // node_bins))
        if not n:
            break
        if parts > 1 and width >= parts:  # the tree can't narrow
            out = out.unionByName(left)
            break
        last = width <= 1
        paths.append(store.write(left.repartition(width).mapInArrow(node(level, last), schema)))
        out = out.unionByName(read(paths[-1]).where("done"))
        parts = width
        if last:
            break
    return out.select("sequence_id", F.explode("items").alias("i")).select("i.doc_id", "i.piece", "i.start", "i.length", "i.ids_crc32", "sequence_id", "i.offset", *(["i.ids"] if with_ids else []))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
