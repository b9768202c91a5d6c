"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

A benchmark item is cut into segments of at most ``segment`` characters (overlapping by half). A segment of m
characters may occur with e = rate * m edits; by the q-gram lemma its occurrence then shares at least
m - q + 1 - e * q character q-grams with it, and those lie on diagonals at most e apart.

1. A bitmap of all q-grams of the segments of about one length marks the places of a text; only windows with at
   least the lemma's number of marks go on.
2. In them, shared q-grams are counted for each segment in diagonal bands of width 2w that overlap by w, so that
   every occurrence lies in one band whole; bands below the bound are dropped.
3. Banded alignment of the segment against the band's text decides, and gives the span and its edits.

The benchmark is collected in slices of at most ``slice_chars`` characters (longer items are cut into overlapping pieces) and each
slice is sent to all executors; a larger benchmark takes more passes over the documents, each written before the next begins, so
what is broadcast at once is bounded. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import Staged

BASE = np.uint32(0x01000193)
BITS = 22


def normal(text: str) -> np.ndarray:
    """Code points with A-Z in lower case and white space as a space; one for each character of the text."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    x[(x >= 65) & (x <= 90)] += 32
    x[((x >= 9) & (x <= 13)) | (x == 0xA0)] = 32
    return x


def grams(x: np.ndarray, q: int) -> np.ndarray:
    """32-bit polynomial hash of every q-gram, by doubling."""
    if len(x) < q:
        return np.zeros(0, np.uint32)
    out, done, h, span = None, 0, x.astype(np.uint32), 1
    while True:
        if q & span:
            out = h[: len(x) - span + 1] if out is None else out[: len(x) - done - span + 1] * power(span) + h[done : done + len(x) - done - span + 1]
            done += span
        if span * 2 > q:
            return out
        h = h[:-span] * power(span) + h[span:]
        span *= 2


def power(n: int) -> np.uint32:
    return np.uint32(pow(int(BASE), n, 1 << 32))


def slot(h: np.ndarray) -> np.ndarray:
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


@dataclass
class Segment:
    item: int  # index of the item
    start: int  # in the item
    chars: np.ndarray
    edits: int
    need: int  # shared q-grams


@dataclass
class Group:
    """Segments of about one length."""

    segments: list[Segment]
    window: int
    need: int
    marks: np.ndarray
    keys: np.ndarray  # sorted hashes of all q-grams
    of: np.ndarray  # segment of each
    place: np.ndarray  # and its place there


def groups_of(texts: list[str], q: int, rate: float, segment: int) -> list[Group]:
    found: dict[int, list[Segment]] = {}
    for i, text in enumerate(texts):
        x = normal(text.strip())
        if len(x) < q:
            continue
        starts = [0] if len(x) <= segment else [*range(0, len(x) - segment, segment // 2), len(x) - segment]
        for s in starts:
            part = x[s : s + segment]
            edits = int(rate * len(part))
            while edits and len(part) - q + 1 - edits * q < max(4, len(part) // 4):  # short ones: fewer edits, so that the lemma still says something
                edits -= 1
            found.setdefault(len(part).bit_length() * 4 + (len(part) >> (len(part).bit_length() - 3)) % 4, []).append(Segment(i, s, part, edits, len(part) - q + 1 - edits * q))
    out = []
    for segments in found.values():
        hashes = [grams(s.chars, q) for s in segments]
        keys, of, place = np.concatenate(hashes), np.repeat(np.arange(len(segments)), [len(h) for h in hashes]), np.concatenate([np.arange(len(h)) for h in hashes])
        order = np.argsort(keys, kind="stable")
        marks = np.zeros(1 << BITS, bool)
        marks[slot(keys)] = True
        out.append(Group(segments, max(len(s.chars) + s.edits for s in segments) - q + 1, max(1, min(s.need for s in segments)), marks, keys[order], of[order], place[order]))
    return out


def align(pattern: np.ndarray, text: np.ndarray, shift: int, half: int, most: int) -> tuple[int, int, int] | None:
    """The best match (edits, start, end) of the whole pattern in the text along diagonals shift +- half, if within ``most`` edits.

    Of the ends with the fewest edits the first is taken, and of its starts the last.
    """
    at = np.arange(-half, half + 1) + shift  # text place of diagonal k at row 0
    big = 1 << 20
    inside = (at >= 0) & (at <= len(text))
    cost, start = np.where(inside, 0, big), at.copy()  # free start
    ramp = np.arange(len(at))
    for i, c in enumerate(pattern):
        place = at + i  # text character compared on each diagonal
        ok = (place >= 0) & (place < len(text))
        differs = np.where(ok, text[np.clip(place, 0, max(0, len(text) - 1))] != c if len(text) else True, True)
        diag = np.where(ok, cost + differs, big)
        up = np.append(cost[1:] + 1, big)  # pattern character left out
        up_start = np.append(start[1:], 0)
        best = np.minimum(diag, up)
        begin = np.where((diag < up) | ((diag == up) & (start >= up_start)), start, up_start)
        # text characters put in: running minimum along the row
        key = (best - ramp) * (1 << 32) - begin
        origin = last_change(key, np.minimum.accumulate(key))
        start, cost = begin[origin], (best - ramp)[origin] + ramp
        valid = (at + i + 1 >= 0) & (at + i + 1 <= len(text))
        cost = np.where(valid, cost, big)
    k = int(cost.argmin())
    return (int(cost[k]), int(start[k]), int(at[k] + len(pattern))) if cost[k] <= most else None


def last_change(key: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Where each running minimum was reached."""
    return np.maximum.accumulate(np.where(key == run, np.arange(len(key)), 0))


def scan(x: np.ndarray, h: np.ndarray, g: Group, q: int) -> list[tuple[int, int, int, int]]:
    """(segment, start, end, edits) of the matches of a group in a text; h: the text's q-gram hashes."""
    if not len(h):
        return []
    hit = g.marks[slot(h)]
    if int(hit.sum()) < g.need:
        return []
    sums = np.r_[0, np.cumsum(hit, dtype=np.int32)]
    w = min(g.window, len(h))
    full = np.flatnonzero(sums[w:] - sums[:-w] >= g.need)
    if not len(full):
        return []
    out = []
    cuts = np.flatnonzero(np.diff(full) > w)
    for a, b in zip(np.r_[full[0], full[cuts + 1]], np.r_[full[cuts], full[-1]] + w, strict=True):
        at = np.flatnonzero(hit[a:b]) + a
        lo, hi = np.searchsorted(g.keys, h[at], "left"), np.searchsorted(g.keys, h[at], "right")
        n = hi - lo
        if not n.sum():
            continue
        row = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        seg, diagonal = g.of[row], np.repeat(at, n) - g.place[row]
        wide = np.array([2 * s.edits + 2 for s in g.segments])[seg]
        band = diagonal // wide
        both = np.concatenate([np.stack([seg, 2 * band], 1), np.stack([seg, 2 * ((diagonal + wide // 2) // wide) - 1], 1)])
        pairs, count = np.unique(both, axis=0, return_counts=True)
        for (s, k), c in zip(pairs.tolist(), count.tolist(), strict=True):
            p = g.segments[s]
            if c >= p.need:
                width = 2 * p.edits + 2
                first = k // 2 * width if k % 2 == 0 else (k + 1) // 2 * width - width // 2
                mid, half = first + width // 2, width // 2 + p.edits
                same, times = np.unique(diagonal[(seg == s) & (diagonal >= first) & (diagonal < first + width)], return_counts=True)
                d = int(same[times.argmax()])
                if d >= 0 and np.array_equal(x[d : d + len(p.chars)], p.chars):  # no edits: the best alignment there is
                    out.append((s, d, d + len(p.chars), 0))
                elif m := align(p.chars, x, mid, half, p.edits):
                    out.append((s, m[1], m[2], m[0]))
    return out


def joined(spans: Iterable[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Sorted (item, start, end, edits); spans of one item that touch are one, with the fewest edits of its parts."""
    out: list[tuple[int, int, int, int]] = []
    for item, a, b, e in sorted(spans):
        if out and out[-1][0] == item and a <= out[-1][2]:
            out[-1] = (item, out[-1][1], max(b, out[-1][2]), min(e, out[-1][3]))
        else:
            out.append((item, a, b, e))
    return out


def leaks_in(text: str, groups: list[Group], q: int) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of the leaked passages of a text."""
    x = normal(text)
    h = grams(x, q)
    return joined({(g.segments[s].item, a, b, e) for g in groups for s, a, b, e in scan(x, h, g, q)})


def searcher(shared: Broadcast, id_type: str, q: int, rate: float, segment: int) -> Callable[[Column], Column]:
    """A Pandas UDF that finds a slice of the benchmark in texts; ``item`` numbers the items that repeat an id apart."""

    @F.pandas_udf(f"array<struct<item_id:{id_type},item:long,start:long,end:long,edits:int>>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, numbers, texts = shared.value
        groups = groups_of(texts, q, rate, segment)
        for column in batches:
            yield pd.Series([[{"item_id": ids[i], "item": numbers[i], "start": s, "end": e, "edits": n} for i, s, e, n in leaks_in(t or "", groups, q)] for t in column])

    return search


def with_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text", name: str = "leaks", q: int = 8, rate: float = 0.08, segment: int = 160, slice_chars: int = 4_000_000) -> DataFrame:
    """``docs`` with array<struct<item_id, start, end, edits>> of the leaked passages of each row (start, end in code points).

    ``bench`` has item_id and text. Null and empty texts on either side, and items under ``q`` characters, match nothing; of items
    that repeat an id each counts; texts on either side are whole however long. Repeated document rows are searched each. An input
    column of that name is replaced.
    """
    spark = docs.sparkSession
    step = max(segment, slice_chars // 4 // segment * segment)  # a piece begins where a segment does, and holds those that start before the next
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length("text") - segment) / F.lit(step)).cast("int") - 1))
    items = bench.select("item_id", "text").where("text is not null").withColumn("item", F.xxhash64("item_id", "text"))
    pieces = items.select("item_id", "item", "text", F.explode(cuts).alias("cut")).select("item_id", "item", F.substr("text", F.col("cut") * step + 1, F.lit(step + segment)).alias("text"))
    chars = pieces.agg(F.sum(F.length("text") + F.lit(1))).first()[0] or 0
    slices = max(1, -(-2 * int(chars) // slice_chars)) if chars > slice_chars else 1  # hashes deal unevenly: half full on average
    id_type = items.schema["item_id"].dataType.simpleString()
    public = lambda c: F.transform(c, lambda x: F.struct(x["item_id"].alias("item_id"), x["start"].alias("start"), x["end"].alias("end"), x["edits"].alias("edits")))

    def slice_of(k: int) -> Broadcast:
        part = pieces.where(F.pmod(F.xxhash64("item_id", "text", F.lit(7)), F.lit(slices)) == k).orderBy("item_id", "text").collect()
        return spark.sparkContext.broadcast(([r["item_id"] for r in part], [r["item"] for r in part], [r["text"] for r in part]))

    if slices == 1:
        return docs.withColumn(name, public(searcher(slice_of(0), id_type, q, rate, segment)(F.col(f"`{text_col}`"))))
    store = Staged(spark, "leaks")
    kept = [c for c in docs.columns if c != name]
    rows = store.put(docs.select(*[F.col(f"`{c}`") for c in docs.columns]).withColumn("_tarn_row", F.monotonically_increasing_id()))
    found = None
    for k in range(slices):
        shared = slice_of(k)
        one = store.put(rows.select("_tarn_row", searcher(shared, id_type, q, rate, segment)(F.col(f"`{text_col}`")).alias("leaks")).where(F.size("leaks") > 0))
        shared.destroy()
        found = one if found is None else found.unionAll(one)
    kind = found.schema["leaks"].dataType

    @F.pandas_udf(kind)
    def united(column: pd.Series) -> pd.Series:
        out = []
        for leaks in column:
            ids = {x["item"]: x["item_id"] for x in leaks}
            out.append([{"item_id": ids[i], "item": i, "start": s, "end": e, "edits": n} for i, s, e, n in joined((x["item"], x["start"], x["end"], x["edits"]) for x in leaks)])
        return pd.Series(out)

    whole = found.groupBy(F.col("_tarn_row").alias("_tarn_at")).agg(F.flatten(F.collect_list("leaks")).alias("_tarn_leaks")).select("_tarn_at", united("_tarn_leaks").alias("_tarn_leaks"))  # of one document
    none = F.expr(f"cast(array() as {public_type(id_type)})")
    return rows.join(whole, F.col("_tarn_row") == F.col("_tarn_at"), "left").select(*[F.col(f"`{c}`") for c in kept], F.coalesce(public(F.col("_tarn_leaks")), none).alias(name))


def public_type(id_type: str) -> str:
    return f"array<struct<item_id:{id_type},start:bigint,end:bigint,edits:int>>"


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of ``benchmark`` in ``documents``: doc_id, item_id, start, end (code points), edits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.start", "x.end", "x.edits")
