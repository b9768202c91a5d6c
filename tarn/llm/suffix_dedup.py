"""Removal of every byte that a repeated string of ``width`` bytes covers, by sorted suffixes.

Only suffixes that can matter are sorted. Of the k-grams of a window of ``width`` bytes the one with the smallest hash is its
anchor; equal windows have equal anchors at equal places. Neighbouring windows with one anchor form a segment.

1. Anchors are counted over all texts (partial counts first); what no other place has is done with.
2. Segments of repeated anchors are range-partitioned, with sampled splitters, by the bytes that follow the anchor, then by
   anchor and content. A task sorts the suffixes that start at its anchors, and the reversed bytes before them, by multikey quicksort;
   windows are equal where both common prefixes reach far enough. Equal segments settle each other at once.
3. Groups that a splitter cuts are compared across the boundary: by aligned runs of windows whose common core
   meets another's, then by single windows, as counts of hashes; so an anchor that any share of all texts
   has is never gathered in one task.

Copies of a whole text are one text throughout. The same machinery finds repeated passages of words, on texts in which every
word is four bytes (the CRC-32 of its UTF-8 form) and a window is a number of words. A text is a row of units, bytes or words; places, widths
and spans count units.

Places and lengths are 32-bit numbers: a text holds at most 2 GB, as a Spark string does.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import Staged, chunks, fold64

BASE = 0x9E3779B97F4A7C15
RUN = 16  # windows of an aligned run
PAIRS = 12  # segments of a group that are compared pair by pair


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """64-bit polynomial hashes of all k-grams (k a power of two), by doubling."""
    h, span = b.astype(np.uint64) + np.uint64(1), 1
    while span < k:
        h = h[:-span] * np.uint64(pow(BASE, span, 1 << 64)) + h[span:]
        span *= 2
    return h


def segments(b: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with one anchor: the anchor's place and hash, and the first and last window."""
    if len(b) < width:
        return (np.zeros(0, np.int64),) * 4
    h = fold64(gram_hashes(b, k))
    low = np.uint64((1 << 32) - 1)
    least, span, w = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, width - k + 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(h) - w + 1], least[w - span :])
    place = (least & low).astype(np.int64)
    first = np.r_[0, np.flatnonzero(place[1:] != place[:-1]) + 1]
    return place[first], h[place[first]].astype(np.int64), first, np.r_[first[1:], len(place)] - 1


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian words by three-way quicksort on one word after another."""
    out: list[np.ndarray] = []
    todo = [(np.arange(len(words)), 0)]
    while todo:
        at, depth = todo.pop()
        if len(at) < 2 or depth == words.shape[1]:
            out.append(at)
            continue
        key = words[at, depth]
        pivot = key[len(key) // 2]
        todo += [(part, d) for part, d in ((at[key > pivot], depth), (at[key == pivot], depth + 1), (at[key < pivot], depth)) if len(part)]
    return np.concatenate(out)


def as_words(rows: list[bytes], size: int) -> np.ndarray:
    """Rows padded to ``size`` bytes, as big-endian 64-bit words."""
    size += -size % 8
    return np.frombuffer(b"".join(r.ljust(size, b"\0") for r in rows), ">u8").reshape(len(rows), size // 8)


def common_with_next(rows: list[bytes], order: np.ndarray, size: int) -> np.ndarray:
    """Length of the common prefix of each row with the one before it in order (the first: 0)."""
    size += -size % 8
    m = np.frombuffer(b"".join(rows[i].ljust(size, b"\0") for i in order), np.uint8).reshape(len(rows), size)
    lengths = np.array([len(rows[i]) for i in order])
    differ = m[1:] != m[:-1]
    first = np.where(differ.any(1), differ.argmax(1), size)
    return np.r_[0, np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))]


def common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    d = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(d.argmax())


def repeated(parts: list[tuple[bytes, bytes, int, int]], width: int, size: int = 1) -> list[np.ndarray]:
    """For distinct segments (reversed bytes before the anchor, bytes from it, least and most offset of the anchor in a window): which offsets have an equal window in another segment. A unit has ``size`` bytes."""
    out = [np.zeros(hi - lo + 1, bool) for _, _, lo, hi in parts]
    if len(parts) <= PAIRS:
        for i, (left, right, lo, hi) in enumerate(parts):
            for j in range(i):
                other = parts[j]
                a, b = max(lo, other[2], width - common(right, other[1]) // size), min(hi, other[3], common(left, other[0]) // size)
                if a <= b:
                    out[i][a - lo : b - lo + 1] = out[j][a - other[2] : b - other[2] + 1] = True
        return out
    groups = []
    for side in (0, 1):
        rows = [p[side] for p in parts]
        order = multikey_order(as_words(rows, width * size))
        groups.append((order, common_with_next(rows, order, width * size) // size))
    lo, hi = np.array([p[2] for p in parts]), np.array([p[3] for p in parts])
    for o in range(int(lo.min()), int(hi.max()) + 1):
        key = np.zeros(len(parts), np.int64)
        for (order, shared), need in zip(groups, (o, width - o), strict=True):
            ids = np.empty(len(parts), np.int64)
            ids[order] = np.cumsum(shared < need)
            key = key * (len(parts) + 1) + ids
        has = np.flatnonzero((lo <= o) & (o <= hi))
        _, back, count = np.unique(key[has], return_inverse=True, return_counts=True)
        for i in has[count[back] > 1].tolist():
            out[i][o - lo[i]] = True
    return out


def two_longs(data: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(data)
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    return sign(x >> 64), sign(x & (1 << 64) - 1)


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of True."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [(int(a), int(b) - 1) for a, b in edge.reshape(-1, 2)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (null as empty), and the two halves of a 128-bit key of the text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).select("id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"))


def as_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class Bytes:
    """Texts as rows of bytes."""

    size, kind = 1, np.uint8

    def __call__(self, text: str) -> bytes:
        return as_bytes(text)


class Words(dict):
    """Texts as rows of words, runs without ASCII white space, each as four bytes."""

    size, kind = 4, np.dtype("<u4")
    LIMIT = 1 << 18

    def __missing__(self, word: bytes) -> int:
        x = self[word] = zlib.crc32(word)
        return x

    def __call__(self, text: str) -> bytes:
        if len(self) > self.LIMIT:
            self.clear()
        words = as_bytes(text).split()
        return np.fromiter(map(self.__getitem__, words), self.kind, len(words)).tobytes()


def distinct_texts(docs: DataFrame, store: Staged) -> DataFrame:
    """(k1, k2, copies, rep) of every text of ``keyed`` documents."""
    return store.put(docs.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("id").alias("rep")))


def lost_spans(docs: DataFrame, texts: DataFrame, store: Staged, width: int, k: int, units: type[Bytes] | type[Words]) -> tuple[DataFrame, DataFrame]:
    """For ``keyed`` documents: one row (k1, k2, text) of each text that may lose bytes, and (k1, k2, spans) of those that do, unmerged.

    Widths and spans count units; k is a power of two.
    """
    spark, size = docs.sparkSession, units.size

    # 1. anchors
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        encode = units()
        for b in chunks(batches):
            t, s, m = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for text, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(text) * 4 >= width and key not in seen:  # a character has 4 bytes at most, and 1 word
                    seen.add(key)
                    found, times = np.unique(segments(np.frombuffer(encode(text), units.kind), width, k)[1], return_counts=True)
                    t.append(found), s.append(np.full(len(found), key)), m.append(np.minimum(times, 2))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (t, s, m)], ["t", "k1", "m"])

    rows = store.put(docs.select("text", "k1").mapInArrow(anchors, "t long, k1 long, m long"))
    shared = rows.groupBy("t").agg(F.min("k1").alias("x"), F.max("k1").alias("y"), F.max("m").alias("m")).where("x <> y or m > 1").select("t")
    wanted = rows.join(shared, "t").groupBy("k1").agg(F.collect_set("t").alias("anchors"))  # anchors of one text
    asked = texts.join(wanted, "k1").select("k1", "k2", F.col("rep").alias("id"), "anchors")
    # the id spreads the copies of a text; one of them (or rows that repeat it) finds its partner
    source = store.put(docs.join(asked.withColumnRenamed("id", "rep").withColumnRenamed("k1", "a1").withColumnRenamed("k2", "a2"), (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2")) & F.col("id").eqNullSafe(F.col("rep"))).select("k1", "k2", "text", "anchors"))

    # 2. segments of repeated anchors, sorted by what follows the anchor
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        encode = units()
        for b in chunks(batches, 64):
            out: dict[str, list] = defaultdict(list)
            for k1, k2, text, wanted_here in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                data = encode(text)
                place, t, lo, hi = segments(np.frombuffer(data, units.kind), width, k)
                same: dict[bytes, int] = {}
                for i in np.flatnonzero(np.isin(t, np.array(wanted_here))).tolist():
                    seg, left = data[lo[i] * size : (hi[i] + width) * size], int(place[i] - lo[i])
                    name = left.to_bytes(4) + seg
                    if name in same:
                        out["los"][same[name]].append(int(lo[i]))
                        continue
                    same[name] = len(out["los"])
                    for c, v in (("lead", int.from_bytes(seg[left * size : left * size + 8]) >> 1), ("t", int(t[i])), ("h", xxhash.xxh64_intdigest(name) >> 1), ("left", left), ("windows", int(hi[i] - lo[i])), ("seg", seg), ("k1", k1), ("k2", k2), ("los", [int(lo[i])])):
                        out[c].append(v)
            kinds = {"left": pa.int32(), "windows": pa.int32(), "seg": pa.binary(), "los": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(out[c], kinds.get(c, pa.int64())) for c in SEGMENT], list(SEGMENT))

    # written first: range partitioning reads its input twice
    segs = store.put(source.select("k1", "k2", "text", "anchors").mapInArrow(cut, ", ".join(f"{c} {v}" for c, v in SEGMENT.items())))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_segs = segs.repartitionByRange(tasks, "lead", "t", "h").sortWithinPartitions("lead", "t", "h")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans of the groups that lie in this task whole; rows of the first and the last, which others may share."""
        held: list[tuple] = []
        first = True
        names = list(SEGMENT)
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in names), strict=True))
            t = b.column("t").to_numpy()
            cuts = [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), len(t)]
            out: list[tuple] = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if held and x < y and held[-1][1] != rows[x][1]:
                    out += [(*r, None, None) for r in held] if first else spans_of(held, width, size)
                    first, held = False, []
                held += rows[x:y]
            yield spans_batch(out)
        yield spans_batch([(*r, None, None) for r in held])

    found = store.put(sorted_segs.mapInArrow(compare, ", ".join(f"{c} {v}" for c, v in (SEGMENT | SPAN).items())))
    spans = found.where("start is not null").select("k1", "k2", "start", "end")

    # 3. across boundaries
    edge = found.where("start is null")

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                for q in range((r.left - r.windows) // RUN, r.left // RUN + 1):
                    lo, hi = max(q * RUN, r.left - r.windows), min(q * RUN + RUN - 1, r.left)
                    core = r.seg[(r.left - q * RUN) * size : (r.left - q * RUN + width - RUN + 1) * size]
                    data = r.seg[(r.left - hi) * size : (r.left - lo + width) * size]
                    out.append((*two_longs(q.to_bytes(4) + core), *two_longs(lo.to_bytes(4) + hi.to_bytes(4) + data), lo, hi, data, r.k1, r.k2, [int(x) + r.left - hi for x in r.los]))
            yield pd.DataFrame(out, columns=["c1", "c2", "f1", "f2", "lo", "hi", "data", "k1", "k2", "at"])

    runs = store.put(edge.select("left", "windows", "seg", "k1", "k2", "los").mapInPandas(aligned, "c1 long, c2 long, f1 long, f2 long, lo int, hi int, data binary, k1 long, k2 long, at array<int>"))
    full = store.put(runs.groupBy("c1", "c2", "f1", "f2").agg(F.sum(F.size("at")).alias("n"), F.first("data").alias("data"), F.first("lo").alias("lo"), F.first("hi").alias("hi")))
    several = full.groupBy("c1", "c2").agg(F.count("*").alias("d")).where("d > 1").select("c1", "c2")

    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(r.f1, r.f2, i, *two_longs((r.hi - i).to_bytes(4) + r.data[i * size : (i + width) * size])) for r in b.itertuples() for i in range(r.hi - r.lo + 1)]
            yield pd.DataFrame(out, columns=["f1", "f2", "i", "w1", "w2"])

    windows = store.put(full.join(several, ["c1", "c2"]).select("f1", "f2", "lo", "hi", "data").mapInPandas(single, "f1 long, f2 long, i int, w1 long, w2 long"))
    equal = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    some = windows.join(equal, ["w1", "w2"]).groupBy("f1", "f2").agg(F.collect_set("i").alias("hits"))  # RUN at most
    whole = full.select("f1", "f2", (F.col("n") > 1).alias("twice")).distinct()
    marked = runs.join(whole, ["f1", "f2"]).join(some, ["f1", "f2"], "left").where("twice or hits is not null")

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for at, size, twice, hits in zip(b["at"], b["size"], b["twice"], b["hits"], strict=True):
                flags = np.zeros(size + 1, bool)
                flags[:] = twice
                if not twice:
                    flags[np.asarray(hits)] = True
                out.append([{"start": int(a) + x, "end": int(a) + y + width} for a in at for x, y in runs_of(flags)])
            yield pd.DataFrame({"k1": b["k1"], "k2": b["k2"], "spans": out})

    ranges = "array<struct<start:int,end:int>>"
    more = marked.select("k1", "k2", "at", (F.col("hi") - F.col("lo")).alias("size"), "twice", "hits").mapInPandas(places, f"k1 long, k2 long, spans {ranges}")
    here = spans.select("k1", "k2", F.array(F.struct("start", "end")).alias("spans"))
    lost = here.unionAll(more).groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # of one text

    return source.select("k1", "k2", "text"), lost


def kept_bytes(source: DataFrame, lost: DataFrame) -> DataFrame:
    """(k1, k2, spans, kept) of the texts that lose bytes: the maximal removed runs (start, end), and the remaining bytes."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in chunks(batches):
            out = []
            for k1, k2, text, cuts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                data, at, kept = as_bytes(text), 0, []
                gone = merged([(c["start"], c["end"]) for c in cuts])
                for x, y in gone:
                    kept.append(data[at:x])
                    at = y
                out.append((k1, k2, [{"start": x, "end": y} for x, y in gone], b"".join([*kept, data[at:]])))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["k1", "k2", "spans", "kept"])

    return source.join(lost, ["k1", "k2"]).mapInArrow(keep, "k1 long, k2 long, spans array<struct<start:int,end:int>>, kept binary")


def passage_runs(docs: DataFrame, texts: DataFrame, store: Staged, words: int) -> DataFrame:
    """(k1, k2, runs) of the texts that repeat passages of ``words`` words: how many maximal runs of words such passages cover."""
    _, lost = lost_spans(docs, texts, store, words, 8, Words)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k1": b["k1"], "k2": b["k2"], "runs": [len(merged([(c["start"], c["end"]) for c in spans])) for spans in b["spans"]]})

    return store.put(lost.mapInPandas(count, "k1 long, k2 long, runs long"))


SEGMENT = {"lead": "long", "t": "long", "h": "long", "left": "int", "windows": "int", "seg": "binary", "k1": "long", "k2": "long", "los": "array<int>"}
SPAN = {"start": "int", "end": "int"}


KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def spans_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of SEGMENT and SPAN as a batch."""
    names = SEGMENT | SPAN
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(columns, names.values(), strict=True)], list(names))


def spans_of(rows: list[tuple], width: int, size: int = 1) -> list[tuple]:
    """Removed spans, as rows of SEGMENT and SPAN, of a group of segments (rows of SEGMENT) with one anchor."""
    if len(rows) == 1 and len(rows[0][8]) == 1:
        return []
    which: dict[tuple[int, bytes], int] = {}
    of, times = [], []
    parts: list[tuple[bytes, bytes, int, int]] = []
    for _, _, _, left, windows, seg, _, _, los in rows:
        i = which.setdefault((left, seg), len(parts))
        if i == len(parts):
            parts.append((seg[: left * size][::-1], seg[left * size :], left - windows, left))
            times.append(0)
        of.append(i)
        times[i] += len(los)
    flags = repeated(parts, width, size) if len(parts) > 1 else [np.zeros(parts[0][3] - parts[0][2] + 1, bool)]
    hits = [[(0, len(f) - 1)] if t > 1 else runs_of(f[::-1]) for f, t in zip(flags, times, strict=True)]  # by window, the largest offset first
    return [(None, None, None, None, None, None, r[6], r[7], None, lo + a, lo + b + width) for i, r in zip(of, rows, strict=True) for lo in r[8] for a, b in hits[i]]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400) -> DataFrame:
    """Every row's id, n_bytes, spans (removed runs: start, end in bytes) and kept (remaining bytes).

    A string counts as repeated when it starts at any other place, in the same text or another. A null text is the empty one; texts
    under ``width`` bytes and empty tables lose nothing; texts are whole however long (2 GB at most); equal rows are copies of each
    other. Other columns are not read.
    """
    store = Staged(df.sparkSession, "suffixes")
    docs = keyed(df, id_col, text_col)
    texts = distinct_texts(docs, store)
    lost = kept_bytes(*lost_spans(docs, texts, store, width, 64, Bytes))
    data, n = F.encode("text", "UTF-8"), F.octet_length("text")
    whole = (F.col("copies") > 1) & (n >= width)
    rows = docs.join(texts.drop("rep"), ["k1", "k2"]).join(lost, ["k1", "k2"], "left")
    spans = F.when(whole, F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")))
    return rows.select(F.col("id").alias(id_col), n.cast("long").alias("n_bytes"), spans.alias("spans"), F.when(whole, F.lit(b"")).otherwise(F.coalesce("kept", data)).alias("kept"))


def many_words(text: str, words: int) -> F.Column:
    """Whether a text has so many words; reads no further."""
    return F.col(text).rlike(rf"^[ \t-\r]*+(?:[^ \t-\r]++[ \t-\r]++){{{words - 1}}}[^ \t-\r]")


def op4_suffixes(spark: SparkSession, sf_dir: str, width: int = 400, words: int = 51) -> DataFrame:
    """Every document without the bytes that repeated 400-byte strings cover, as digests; whole texts are digested before the join.

    ``n_passages`` counts the maximal runs of words that repeated passages of over 50 words cover; such a passage may have under 400 bytes, so
    a document can have some and lose nothing.
    """
    store = Staged(spark, "suffixes")
    docs = keyed(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    texts = distinct_texts(docs, store)
    lost = kept_bytes(*lost_spans(docs, texts, store, width, 64, Bytes))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    digests = store.put(lost.select("k1", "k2", removed.alias("removed"), F.size("spans").cast("long").alias("runs"), F.sha2("kept", 256).alias("kept_sha")))
    store.drop(*[f"{store.root}/{i}" for i in range(2, store.n)])  # all but the texts and the digests
    passages = passage_runs(docs, texts, store, words)
    light = docs.select(F.col("id").alias("doc_id"), "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), many_words("text", words).alias("many"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= width)
    rows = light.join(texts.drop("rep"), ["k1", "k2"]).join(digests, ["k1", "k2"], "left").join(passages.withColumnRenamed("runs", "passages"), ["k1", "k2"], "left")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return store.final(
        rows.select(
            "doc_id",
            "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
            F.when(whole, one).otherwise(F.coalesce("runs", zero)).alias("n_spans"),
            F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
            F.when((F.col("copies") > 1) & F.col("many"), one).otherwise(F.coalesce("passages", zero)).alias("n_passages"),
        )
    )
