"""Exact Jaccard self-join of n-gram sets by prefix trees, to connected components.

Shingles get one global order: frequent ones last (those that a hash sample of the documents repeats, a list
of bounded length; it steers cost only), the others by hash. Documents with equal sets are one class.

1. Prefix filter: linked sets share a shingle among the first n - ceil(0.8 n) + 1 of each. These (shingle, class) rows are
   range-partitioned by both, so a shingle that many classes share is dealt over many tasks.
2. A shingle's classes are tied to one of them, its centre, if the bound on their overlap that the two prefixes give
   allows a link. Connected ties are clusters; classes that share a prefix shingle across clusters are compared by
   prefixes, and a spanning forest of those that may link joins their clusters.
3. A cluster's whole sets are stored in a trie in the global order, and each set descends it: what paths share is counted
   once, and a subtree ends where the overlap so far and the remaining lengths can't reach the link.
   Sets that are already tied need no more comparison. Large clusters are dealt as pairs of blocks of bounded size.

No pair list of a group is ever made: a task returns a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import Staged, chunks, fold64
from tarn.llm.graph import components

HOT_BIT = np.int64(1) << np.int64(62)
CACHE = 1 << 18
MANY = 100_000  # rows of a shingle that wait for its last
PAIRED = 1000  # rows of a shingle that are held against each other
#: Fixed odd multipliers, one for each word of a shingle.
PLACES = fold64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class Words(dict):
    """64-bit hashes of words; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str, words: Words, size: int = 5) -> np.ndarray:
    """Sorted distinct 62-bit hashes of the runs of ``size`` words (A-Z lowered, split at ASCII white space); a shorter text is one run."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    if len(h) < size:
        h = np.array([(h * PLACES[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))])
    else:
        n = len(h) - size + 1
        h = sum((h[k : k + n] * PLACES[k] for k in range(1, size)), h[:n] * PLACES[0])
    return np.unique((fold64(h) >> np.uint64(2)).astype(np.int64))


def ordered(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Tokens in the global order, as numbers whose order it is: frequent ones carry a high bit."""
    if not len(hot) or not len(tokens):
        return tokens
    at = np.searchsorted(hot, tokens)
    is_hot = hot[np.minimum(at, len(hot) - 1)] == tokens
    return np.concatenate([tokens[~is_hot], tokens[is_hot] | HOT_BIT])


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit id of a set."""
    if not len(tokens):
        return 0
    h = fold64(tokens.astype(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(fold64(np.array([h]))[0].astype(np.int64))


def least_overlap(a: int | np.ndarray, b: int | np.ndarray) -> int | np.ndarray:
    """Shared shingles that sets of these sizes need: 100 i >= 80 (a + b - i)."""
    return -(-4 * (a + b) // 9)


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def may_link(p: np.ndarray, n: int, q: np.ndarray, m: int) -> bool:
    """Whether sets of n and m shingles with these prefixes can link: up to the shorter prefix's end all is known, beyond it at most the rest is shared."""
    if 5 * min(n, m) < 4 * max(n, m):
        return False
    end = min(p[-1], q[-1])
    i, j = int(np.searchsorted(p, end, "right")), int(np.searchsorted(q, end, "right"))
    shared = len(np.intersect1d(p[:i], q[:j], assume_unique=True))
    return shared + min(n - i, m - j) >= least_overlap(n, m)


def possible_forest(prefixes: list[np.ndarray], n: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of labels, a spanning forest of those that hold sets which ``may_link``.

    A set's shared shingles with all others come from the lists of its shingles' sets; what is connected already is not looked at.
    """
    names, mine = np.unique(label, return_inverse=True)
    _, token, times = np.unique(np.concatenate(prefixes), return_inverse=True, return_counts=True)
    length = np.array([len(p) for p in prefixes])
    owner = np.repeat(np.arange(len(prefixes)), length)
    holders, first = owner[np.argsort(token, kind="stable")], np.r_[0, np.cumsum(times)[:-1]]
    ends = np.array([p[-1] for p in prefixes])
    by_end = np.argsort(ends)
    at = np.r_[0, np.cumsum(length)]
    out: list[tuple[int, int]] = []
    for i, p in enumerate(prefixes):
        if len(out) == len(names) - 1:
            break
        has = token[at[i] : at[i + 1]]
        has = has[times[has] > 1]
        shared = np.bincount(holders[spans(first[has], times[has])], minlength=len(prefixes))
        near = np.flatnonzero((shared > 0) & (mine != mine[i]) & (5 * np.minimum(n, n[i]) >= 4 * np.maximum(n, n[i])))
        if not len(near):
            continue
        known = np.empty(len(prefixes), np.int64)  # of i, up to the other's end
        known[by_end] = np.searchsorted(p, ends[by_end], "right")
        for j in near.tolist():
            if mine[j] == mine[i]:
                continue
            other = int(np.searchsorted(prefixes[j], ends[i], "right"))
            if shared[j] + min(n[i] - known[j], n[j] - other) >= least_overlap(n[i], n[j]):
                out.append((int(label[i]), int(label[j])))
                mine[mine == mine[j]] = mine[i]
    return out


def may_meet(t: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Rows (sorted by shingle) of sets that may link with another set of the shingle, if it is the first that both have: of either set no more than it and what follows is shared."""
    keep = np.zeros(len(t), bool)
    if not len(t):
        return keep
    start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    size = np.diff(np.r_[start, len(t)])

    def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = n[i], n[j]
        return (np.minimum(a - pos[i], b - pos[j]) >= least_overlap(a, b)) & (5 * np.minimum(a, b) >= 4 * np.maximum(a, b))

    two = start[size == 2]
    keep[two] = keep[two + 1] = fits(two, two + 1)
    for x, k in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        if k > PAIRED:
            keep[x : x + k] = True
        else:
            i = np.arange(x, x + k)
            ok = fits(i[:, None], i[None, :])
            np.fill_diagonal(ok, False)
            keep[i] = ok.any(1)
    return keep


class Trie:
    """A radix tree over sorted sequences, nodes in breadth-first order."""

    def __init__(self, seqs: list[np.ndarray]):
        self.universe = np.unique(np.concatenate(seqs))
        self.seqs = [np.searchsorted(self.universe, s) for s in seqs]
        keys = [s.astype(">u4").tobytes() for s in self.seqs]
        order = sorted(range(len(seqs)), key=keys.__getitem__)
        shared = [0] * len(order)  # with the sequence before
        for k in range(1, len(order)):
            a, b = self.seqs[order[k - 1]], self.seqs[order[k]]
            m = min(len(a), len(b))
            d = np.flatnonzero(a[:m] != b[:m])
            shared[k] = int(d[0]) if len(d) else m
        # breadth first: a node is a range of sorted sequences that agree up to its depth
        depth, owner, begin, kids, leaf_at, leaves = [0], [order[0]], [0], [], [], []
        ranges = [(0, len(order))]
        shared_arr = np.array(shared)
        at = 0
        first_child: list[int] = []
        while at < len(ranges):
            lo, hi = ranges[at]
            d = depth[at]
            leaf_at.append(len(leaves))
            while lo < hi and len(self.seqs[order[lo]]) == d:  # sequences that end here come first
                leaves.append(order[lo])
                lo += 1
            first_child.append(len(ranges))
            if lo < hi:
                cuts = [lo, *(np.flatnonzero(shared_arr[lo + 1 : hi] <= d) + lo + 1).tolist(), hi]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    end = len(self.seqs[order[a]]) if b - a == 1 else min(len(self.seqs[order[a]]), int(shared_arr[a + 1 : b].min()))
                    ranges.append((a, b)), depth.append(end), owner.append(order[a]), begin.append(d)
            kids.append(len(ranges) - first_child[-1])
            at += 1
        self.depth, self.first, self.kids = np.array(depth), np.array(first_child), np.array(kids)
        self.leaf_at, self.leaves = np.array([*leaf_at, len(leaves)]), np.array(leaves, np.int64)
        sizes = np.array([len(self.seqs[i]) for i in order])
        self.least = np.array([sizes[a:b].min() for a, b in ranges])
        self.most = np.array([sizes[a:b].max() for a, b in ranges])
        length = self.depth - np.array(begin)
        self.edge_at = np.r_[0, np.cumsum(length)]
        self.edge = np.concatenate([self.seqs[o][b:d] for o, b, d in zip(owner, begin, depth, strict=True)])
        self.size = np.array([len(s) for s in self.seqs])

    def linked(self, i: int) -> np.ndarray:
        """The sequences that link with sequence i."""
        q, n = self.seqs[i], len(self.seqs[i])
        mask = np.zeros(len(self.universe), np.int64)
        mask[q] = 1
        out: list[np.ndarray] = []
        node, over = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(node):
            # children of the nodes left, with the overlap that all below them share
            kids = self.kids[node]
            total = int(kids.sum())
            if not total:
                break
            child = spans(self.first[node], kids)
            base = np.repeat(over, kids)
            length = self.edge_at[child + 1] - self.edge_at[child]
            hits = mask[self.edge[spans(self.edge_at[child], length)]]
            over_child = base + np.add.reduceat(hits, np.r_[0, np.cumsum(length)[:-1]])
            last = self.edge[self.edge_at[child + 1] - 1]
            rest = np.minimum(n - np.searchsorted(q, last, "right"), self.most[child] - self.depth[child])
            ok = over_child + rest >= least_overlap(n, self.least[child])
            node, over = child[ok], over_child[ok]
            count = self.leaf_at[node + 1] - self.leaf_at[node]
            if count.any():
                leaf = self.leaves[spans(self.leaf_at[node], count)]
                found = np.repeat(over, count) >= least_overlap(n, self.size[leaf])
                out.append(leaf[found])
        got = np.concatenate(out) if out else np.zeros(0, np.int64)
        return got[got != i]


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenated ranges start .. start + length."""
    return np.repeat(start - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(int(length.sum()))


def forest(ids: list[int], seqs: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct sets, by their ids."""
    if len(ids) < 2:
        return []
    trie = Trie(seqs)
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    common = np.bincount(np.concatenate(trie.seqs), minlength=len(trie.universe))
    hub = int(np.argmax([common[s].mean() for s in trie.seqs]))
    out, left = [], len(ids)
    for i in (hub, *(k for k in range(len(ids)) if k != hub)):
        if left == 1:
            break
        if i != hub and find(i) == find(hub):
            continue  # a link across final components has an end that never was in the hub's, and that end was asked
        for j in trie.linked(i).tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[a] = b
                left -= 1
                out.append((ids[i], ids[j]))
    return out


def by_group(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The groups of consecutive rows with one key, across batches."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        cuts = np.flatnonzero(b[key].to_numpy()[1:] != b[key].to_numpy()[:-1]) + 1
        for part in (b.iloc[x:y] for x, y in zip([0, *cuts], [*cuts, len(b)], strict=True)):
            if held and held[-1][key].iloc[0] != part[key].iloc[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def frequent(docs: DataFrame, size: int, share: int, least: int, most: int) -> np.ndarray:
    """Sorted shingles that ``least`` of every ``share``-th text (by hash) have, the ``most`` commonest."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in chunks(batches):
            found = [shingles(t, words, size) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["t"])

    picked = docs.select("text").where("text is not null").where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    counted = picked.mapInArrow(tokens, "t long").groupBy("t").count().where(F.col("count") >= least)
    return np.sort(np.array([r["t"] for r in counted.orderBy(F.desc("count"), "t").limit(most).select("t").collect()], np.int64))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, block_tokens: int = 4_000_000, frequent_share: int = 16, frequent_least: int = 3, frequent_most: int = 200_000) -> DataFrame:
    """(id, n_shingles, component_id) for every row: documents link when 100 * intersection >= 80 * union of their shingle sets.

    component_id is the smallest id reachable by links, the row's own included. A null or empty text has no shingles and links
    with nothing; texts under ``size`` words are one shingle. Rows with a null id can link others but name no component
    unless all its ids are null (then it is null). Repeated rows are equal sets, an empty table gives no rows. Texts are whole however long,
    up to 2**31 shingles. Other columns are not read.
    """
    spark = df.sparkSession
    store = Staged(spark, "jaccard")
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    hot = spark.sparkContext.broadcast(frequent(docs, size, frequent_share, frequent_least, frequent_most))  # frequent_most numbers at most
    id_type = docs.schema["id"].dataType.simpleString()

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Set ids and sizes, and the prefix with the first of equal sets of a task."""
        words, seen = Words(), set()
        for b in chunks(batches):
            ids, ns, seqs = [], [], []
            for text in b.column(1):
                t = shingles(text.as_py() or "", words, size)
                s = set_id(t)
                ids.append(s), ns.append(len(t))
                seqs.append(ordered(t, hot.value)[: prefix_length(len(t))].copy() if len(t) and s not in seen else None)
                seen.add(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(seqs, pa.list_(pa.int64()))], ["id", "s", "n", "seq"])

    signed = store.put(docs.mapInArrow(signatures, f"id {id_type}, s long, n long, seq array<long>"))
    prefixes = signed.where("seq is not null").select("s", "n", "seq")

    # 1. rows of shared shingles; size and place of the shingle in one number
    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that may link at their shingle with another of its rows; all rows of the first and the last shingle of a task, which others may hold too."""
        held = [np.zeros(0, np.int64) for _ in range(3)]
        whole: int | None = None  # the shingle whose rows are all kept
        first = True
        for b in batches:
            t, s, at = (np.r_[h, c.to_numpy()] for h, c in zip(held, b.columns, strict=True))
            new = np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])] if len(t) else np.zeros(0, bool)
            t, s, at = t[new], s[new], at[new]
            if first and len(t):
                whole, first = int(t[0]), False
            cut = int(np.searchsorted(t, t[-1])) if len(t) else 0
            if len(t) - cut > MANY:  # a very frequent shingle: nothing waits
                whole, cut = int(t[-1]), len(t)
            keep = may_meet(t[:cut], at[:cut] >> 32, at[:cut] & 0xFFFFFFFF)
            if whole is not None:
                keep |= t[:cut] == whole
            yield pa.RecordBatch.from_arrays([pa.array(x[:cut][keep]) for x in (t, s, at)], ["t", "s", "at"])
            held = [t[cut:], s[cut:], at[cut:]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["t", "s", "at"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = prefixes.select(F.posexplode("seq").alias("pos", "t"), "s", "n").select("t", "s", (F.col("n") * F.lit(1 << 32) + F.col("pos")).alias("at"))
    near = rows.repartitionByRange(tasks, "t", "s").sortWithinPartitions("t", "s").mapInArrow(neighbours, "t long, s long, at long")
    near = store.put(near.select("t", "s", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos")))

    # 2. ties to the centre of each shingle: the class with the smallest id, so that alike classes get few centres
    heads = store.put(prefixes.join(near.select("s").distinct().hint("merge"), "s", "left_semi").groupBy("s").agg(F.first("n").alias("n"), F.first("seq").alias("seq")))
    centre = near.groupBy("t").agg(F.min(F.struct("s", "n", "pos")).alias("c")).select("t", F.col("c.s").alias("b"), F.col("c.n").alias("m"), F.col("c.pos").alias("mpos"))
    reach = "least(n - pos, m - mpos) >= ceil(4 * (n + m) / 9) and 5 * least(n, m) >= 4 * greatest(n, m)"
    tie = near.join(centre, "t").where(f"s <> b and {reach}").select(F.col("s").alias("a"), "b").distinct()

    @F.pandas_udf("boolean")
    def linkable(p: pd.Series, n: pd.Series, q: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([may_link(np.asarray(a), x, np.asarray(b), y) for a, x, b, y in zip(p, n, q, m, strict=True)], dtype=bool)

    left, right = heads.toDF("a", "an", "ap"), heads.toDF("b", "bn", "bp")
    ties = store.put(tie.join(left, "a").join(right, "b").where(linkable("ap", "an", "bp", "bn")).select("a", "b"))
    cluster = store.put(components(ties, store).select(F.col("node").alias("s"), F.col("label").alias("g")))

    # shingles across clusters: those whose smallest class is one are one group, as a passage's shingles have nearly the same classes
    of = near.join(cluster, "s", "left").withColumn("g", F.coalesce("g", "s"))
    crossing = of.groupBy("t").agg(F.min("g").alias("x"), F.max("g").alias("y"), F.min("s").alias("k")).where("x <> y").select("t", "k")
    meet = store.put(of.join(crossing, "t").select("k", "s", "g", "n").distinct())
    compared = dealt(meet, block_tokens // 8).join(heads.select("s", "seq"), "s")

    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in by_group(batches, "task"):
            g = g.drop_duplicates("s")
            found = possible_forest([np.asarray(x) for x in g["seq"]], g["n"].to_numpy(), g["g"].to_numpy())
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    bridges = store.put(compared.repartition("task").sortWithinPartitions("task").select("task", "s", "g", "n", "seq").mapInPandas(cross, "a long, b long"))
    joined = components(bridges, store).select(F.col("node").alias("g"), F.col("label").alias("k"))

    # 3. whole sets of clusters, with those that bridges join as one, in tries
    alone = joined.select(F.col("g").alias("s"), "g").join(cluster.select("s"), "s", "left_anti")  # a class that no tie has is its own cluster
    members = cluster.unionByName(alone).join(joined, "g", "left").select(F.coalesce("k", "g").alias("k"), "s")
    sized = members.join(heads.select("s", "n"), "s").withColumn("g", F.lit(0).cast("long")).select("k", "s", "g", "n")
    at = dealt(sized, block_tokens).groupBy("s").agg(F.collect_set("task").alias("tasks"))  # one task, but for sets of large clusters and of pairs
    whose = signed.where("seq is not null").select("s", "id").join(at, "s").groupBy("s").agg(F.min(F.struct("id")).alias("w"), F.first("tasks").alias("tasks"))
    whose = store.put(whose.select("w.id", "s", "tasks").groupBy("id").agg(F.collect_list(F.struct("s", "tasks")).alias("asked")))
    # by merge at every size: a plan that changes with the size would not show here what it costs there
    again = docs.join(whose.withColumnRenamed("id", "w").hint("merge"), F.col("id").eqNullSafe(F.col("w"))).select("text", "asked")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        for b in chunks(batches, 64):
            out: list[list] = [[], [], []]
            for text, asked in zip(b.column(0), b.column(1), strict=True):
                t = shingles(text.as_py() or "", words, size)
                s = set_id(t)
                for x in asked.as_py():
                    if x["s"] == s and s not in seen:
                        seen.add(s)
                        seq = ordered(t, hot.value)
                        for task in x["tasks"]:
                            out[0].append(task), out[1].append(s), out[2].append(seq)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], ["task", "s", "seq"])

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in by_group(batches, "task"):
            g = g.drop_duplicates("s")
            found = forest(g["s"].tolist(), [np.asarray(x) for x in g["seq"]])
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    full = again.mapInArrow(whole, "task long, s long, seq array<long>")
    links = store.put(full.repartition("task").sortWithinPartitions("task").mapInPandas(link, "a long, b long"))
    group = components(links, store)
    out = signed.select("id", "s", "n").join(group.select(F.col("node").alias("s"), F.col("label").alias("g")), "s", "left").withColumn("g", F.coalesce("g", "s"))
    out = store.final(out)
    names = out.where("n > 0").groupBy("g").agg(F.min("id").alias("component_id"))
    linked = out.where("n > 0").join(names, "g").select("id", F.col("n").alias("n_shingles"), "component_id")
    alone = out.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return linked.unionAll(alone).withColumnRenamed("id", id_col)


def dealt(members: DataFrame, block_tokens: int) -> DataFrame:
    """Members (k, s, g, n) of groups with the task that compares them.

    A group of at most ``block_tokens`` shingles is one task. A larger one is cut by size class (a class spans the ratio 5/4, so
    links lie in one class or two neighbouring ones) and within it by hash to blocks of about that many shingles; a task is a pair of
    blocks. Only sums by group and class are formed, so no task ever holds or sorts a large group.
    """
    large = members.groupBy("k").agg(F.sum("n").alias("total")).where(F.col("total") > block_tokens).select("k")
    small = members.join(large, "k", "left_anti").select(F.xxhash64("k").alias("task"), "s", "g", "n")
    rows = members.join(large, "k", "left_semi").withColumn("c", F.floor(F.log("n") / F.log(F.lit(1.25))))
    sizes = rows.groupBy("k", "c").agg(F.ceil(F.sum("n") / block_tokens).alias("parts"))
    blocks = sizes.select("k", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"))
    other = blocks.toDF("k", "d", "j")
    pairs = blocks.join(other, "k").where("(c = d and i < j) or d = c + 1").select("k", "c", "i", "d", "j")
    met = pairs.select("k", "c", "i").unionAll(pairs.select("k", F.col("d").alias("c"), F.col("j").alias("i"))).distinct()
    single = blocks.join(met, ["k", "c", "i"], "left_anti")  # a block that meets another needs no task of its own
    task = F.xxhash64("k", "c", "i", "d", "j")
    of_pair = pairs.select(task.alias("task"), "k", F.explode(F.array(F.struct("c", "i"), F.struct(F.col("d").alias("c"), F.col("j").alias("i")))).alias("b")).select("task", "k", "b.c", "b.i")
    of_pair = of_pair.unionAll(single.select(F.xxhash64("k", "c", "i").alias("task"), "k", "c", "i"))
    placed = rows.join(sizes, ["k", "c"]).withColumn("i", F.pmod(F.xxhash64("s"), F.col("parts")))
    return small.unionAll(placed.join(of_pair, ["k", "c", "i"]).select("task", "s", "g", "n"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
