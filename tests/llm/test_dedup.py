import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import decontam, fixity, jaccard, suffix_dedup

rng = random.Random(3)
WORDS = [f"w{i}" for i in range(400)]


def sentence(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


# --- sorted suffixes


def plain_passages(rows, words):
    """Maximal runs of words covered by passages of so many words that start at another place too."""
    split = {i: (t or "").encode().split() for i, t in rows}
    count = Counter(tuple(w[k : k + words]) for w in split.values() for k in range(len(w) - words + 1))
    out = {}
    for i, w in split.items():
        gone = np.zeros(len(w), int)
        for k in range(len(w) - words + 1):
            if count[tuple(w[k : k + words])] > 1:
                gone[k : k + words] = 1
        out[i] = int((np.diff(np.r_[0, gone]) == 1).sum())
    return out


def plain_removed(rows, width):
    datas = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(d[k : k + width] for _, d in datas for k in range(len(d) - width + 1))
    out = []
    for i, d in datas:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - width + 1):
            if count[d[k : k + width]] > 1:
                gone[k : k + width] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i if i is not None else -1, len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def copies(seed):
    r = random.Random(seed)
    passage, block = sentence(60, r), sentence(45, r)
    rows = [(i, sentence(r.randrange(3, 120), r)) for i in range(30)]
    rows += [(100 + i, sentence(r.randrange(0, 60), r) + " " + passage + " " + sentence(r.randrange(0, 60), r)) for i in range(25)]
    rows += [(200 + i, block[: r.randrange(100, len(block))] + sentence(20, r)) for i in range(15)]
    rows += [(300, passage + passage), (301, "a" * 3000), (302, "ab" * 900), (303, None), (304, ""), (305, "é" * 250), (None, passage), (306, rows[0][1]), (0, rows[0][1]), (307, rows[3][1])]
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_suffixes_equal_brute_force(spark, partitions):
    rows = copies(partitions)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = suffix_dedup.remove_repeats(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got)
    assert got == plain_removed(rows, 400)


def test_suffix_query_and_empty_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = suffix_dedup.op4_suffixes(spark, sf)
    assert sorted(map(tuple, got.drop("n_passages").collect())) == plain_removed(rows, 400)
    assert {r["doc_id"]: r["n_passages"] for r in got.collect()} == plain_passages(rows, 51)
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_multikey_order_and_large_groups():
    r = np.random.default_rng(0)
    words = r.integers(0, 3, (200, 4)).astype(np.uint64)
    order = suffix_dedup.multikey_order(words)
    assert [tuple(words[i]) for i in order] == sorted(map(tuple, words))
    anchor = b"#" * 8
    parts = []
    for _ in range(40):
        left, right = bytes(r.integers(97, 99, 6).astype(np.uint8)), bytes(r.integers(97, 99, 6).astype(np.uint8))
        parts.append((left[::-1], anchor + right, 0, 6))
    parts = list(dict.fromkeys(parts))
    got = suffix_dedup.repeated(parts, 14)
    whole = [p[0][::-1] + p[1] for p in parts]
    for i, flags in enumerate(got):
        for o in range(7):
            s = whole[i][6 - o : 20 - o]
            assert flags[o] == any(whole[j][6 - o : 20 - o] == s for j in range(len(parts)) if j != i)


# --- n-gram Jaccard join


def plain_groups(rows):
    words = jaccard.Words()
    sets = [set(jaccard.shingles(t or "", words).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return Counter((d, len(s), min(least[find(i)]) if least[find(i)] and s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def edited(text, n, r):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def near_copies(seed):
    r = random.Random(seed)
    rows = [(i, sentence(r.randrange(1, 90), r)) for i in range(40)]
    passage = sentence(30, r)
    rows += [(50 + i, passage + " " + sentence(r.randrange(2, 60), r)) for i in range(30)]  # shared, but not alike
    origin = sentence(120, r)
    chain = origin
    for i in range(40):
        chain = edited(chain, 1, r) if i % 2 else edited(origin, r.randrange(0, 5), r)
        rows.append((100 + i, chain))
    rows += [(200 + i, rows[2][1].upper()) for i in range(20)]  # equal sets
    rows += [(300, None), (301, ""), (302, "one two"), (303, "ONE\ttwo "), (304, "two one"), (None, "one two"), (None, None), (302, "one two"), (305, "a b c d e " * 400), (306, "é x y z w v")]
    return rows


@pytest.mark.parametrize("seed,block", [(1, 4_000_000), (2, 3000), (3, 600)])
def test_groups_equal_brute_force(spark, seed, block):
    rows = near_copies(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int").repartition(3)
    got = jaccard.similar_groups(df, block_tokens=block, frequent_share=1 if seed == 2 else 16)
    assert Counter(map(tuple, got.collect())) == plain_groups(rows)


def test_no_rows(spark):
    assert jaccard.similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_trie_finds_all_links():
    r = np.random.default_rng(1)
    base = r.choice(10**6, 60, replace=False)
    seqs = [np.unique(np.r_[r.permutation(base)[:54], r.integers(10**6, 2 * 10**6, r.integers(0, 8))]) for _ in range(60)]
    trie = jaccard.Trie(seqs)
    for i, a in enumerate(seqs):
        want = {j for j, b in enumerate(seqs) if j != i and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
        assert set(trie.linked(i).tolist()) == want
    n = np.array([len(s) for s in seqs])
    prefixes = [s[: jaccard.prefix_length(len(s))] for s in seqs]
    group = list(range(60))
    for i in range(60):
        for j in range(i):
            if len(np.intersect1d(prefixes[i], prefixes[j])) and jaccard.may_link(prefixes[i], n[i], prefixes[j], n[j]):
                group = [group[i] if g == group[j] else g for g in group]
    found = jaccard.possible_forest(prefixes, n, np.arange(60) + 100)
    assert len(found) == 60 - len(set(group)) and all(group[a - 100] == group[b - 100] for a, b in found)


# --- decontamination


def distance(pattern, text):
    best = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        row = [i + 1]
        for j, d in enumerate(text):
            row.append(min(best[j] + (c != d), best[j + 1] + 1, row[j] + 1))
        best = row
    return min(best)


def test_alignment_is_the_edit_distance():
    r = random.Random(2)
    for _ in range(60):
        p = [r.choice("abcd") for _ in range(60)]
        m = list(p)
        for _ in range(r.randrange(0, 5)):
            k, o = r.randrange(len(m)), r.random()
            if o < 0.3:
                m[k] = "#"
            elif o < 0.6:
                m.insert(k, "#")
            else:
                del m[k]
        before = "zz" * r.randrange(20)
        text = before + "".join(m) + "yyyy"
        got = decontam.align(decontam.normal("".join(p)), decontam.normal(text), len(before), 8, 6)
        assert got and got[0] == distance("".join(p), text)


def test_leaks(spark):
    r = random.Random(4)
    items = [(i, sentence(r.randrange(12, 90), r)) for i in range(12)] + [(99, None), (98, ""), (97, "tiny"), (5, sentence(20, r))]
    docs, want = [], set()
    for i in range(40):
        k, text = r.choice(items[:12])
        body = sentence(50, r)
        if i % 4 == 0:
            docs.append((i, body))
        else:
            leak = text if i % 4 == 1 else text.upper() if i % 4 == 2 else text[:30] + "#" + text[31:50] + text[51:]
            docs.append((i, body + " " + leak + " " + body))
            want.add((i, k))
    docs += [(100, None), (101, ""), (102, "x" * 100000), (None, items[0][1]), (1, docs[1][1])]
    df = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, leaks int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for slices in (4_000_000, 500):
        rows = decontam.with_leaks(df, bench, slice_chars=slices).collect()
        assert len(rows) == len(docs)
        found = {(x["doc_id"], leak["item_id"]) for x in rows for leak in x["leaks"] if x["doc_id"] is not None}
        assert found == want and [x for x in rows if x["doc_id"] is None][0]["leaks"]
    assert all(not x["leaks"] for x in decontam.with_leaks(df, bench.limit(0)).collect())
    assert decontam.with_leaks(df.limit(0), bench).collect() == []


def test_op8_finds_every_exact_passage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(x["doc_id"], i["item_id"]) for x in docs for i in items if x["text"] and i["text"] in x["text"]}
    got = decontam.op8_decontam(spark, sf).collect()
    assert want <= {(r["doc_id"], r["item_id"]) for r in got}
    text = {x["doc_id"]: x["text"] for x in docs}
    item = {i["item_id"]: i["text"] for i in items}
    for r in got:
        assert distance(item[r["item_id"]].lower(), text[r["doc_id"]][max(0, r["start"] - 200) : r["end"] + 200].lower()) <= 0.08 * len(item[r["item_id"]]) + 40


def sellers(pattern, text):
    """Fewest edits of the whole pattern against any part of the text, the first end of such a part and its last start."""
    cost, start = list(range(len(pattern) + 1)), [0] * (len(pattern) + 1)
    best = (cost[-1], 0, 0)
    for j, c in enumerate(text, 1):
        before, before_start = cost, start
        cost, start = [0], [j]
        for i, p in enumerate(pattern, 1):
            ways = [(before[i - 1] + (p != c), -before_start[i - 1]), (before[i] + 1, -before_start[i]), (cost[i - 1] + 1, -start[i - 1])]
            n, at = min(ways)
            cost.append(n), start.append(-at)
        if cost[-1] < best[0]:
            best = (cost[-1], j, start[-1])
    return best


def edited(text, n, r):
    out = list(text)
    for _ in range(n):
        at = r.randrange(len(out))
        out[at : at + 1] = r.choice(([], [r.choice("abcdefgh "), out[at]], [r.choice("ijklmnop")]))
    return "".join(out)


def test_leaks_equal_brute_force_about_the_limit():
    """Items of one segment with edits below, at and above the limit: found if and only if the best alignment is within it, with its edits and place."""
    r = random.Random(11)
    found = missed = 0
    for _ in range(120):
        item = "".join(r.choices("abcdefghijklmnop ", k=r.randrange(60, 160))).strip()
        limit = int(0.08 * len(item))
        text = "".join(r.choices("abcdefghijklmnop ", k=300)) + edited(item, r.randrange(0, limit + 5), r) + "".join(r.choices("abcdefghijklmnop ", k=200))
        edits, end, start = sellers(item, text)
        got = decontam.leaks_in(text, decontam.groups_of([item], 8, 0.08, 160), 8)
        if edits <= limit:
            found += 1
            assert [(i, n, e) for i, _, e, n in got] == [(0, edits, end)] and got[0][1] == start
        else:
            missed += 1
            assert got == []
    assert found > 40 and missed > 20


def test_slices_give_the_same_leaks(spark):
    """A benchmark in many slices, with an item that is cut into pieces, gives what one slice gives."""
    r = random.Random(12)
    items = [(i, " ".join(r.choices(WORDS, k=r.choice((12, 40, 90))))) for i in range(12)] + [(3, " ".join(r.choices(WORDS, k=30))), (99, " ".join(r.choices(WORDS, k=900)))]
    docs = [(k, sentence(40, r) + " " + " ".join(t for _, t in r.sample(items, 2)) + " " + sentence(30, r), "clash") for k in range(30)] + [(7, None, "x"), (None, items[0][1], "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string, leaks string")

    def spans(slice_chars):
        rows = decontam.with_leaks(df, bench, slice_chars=slice_chars).select("doc_id", "text", "leaks").collect()
        return sorted((str(x["doc_id"]), str(x["text"]), sorted(map(tuple, x["leaks"]))) for x in rows)

    assert spans(2000) == spans(10**6)


# --- fixity


def test_audit_locates_damage(spark):
    rows = [(i, f"http://h/{i}", "p" * (i % 7) + "é") for i in range(300)] + [(5, "http://h/5", "again"), (5, "http://h/5", None), (5, "http://h/5", ""), (None, None, None)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, seq int, sha256 string")
    store = fixity.Staged(spark, "t")
    records = store.put(fixity.archive(pages, per_file=64, store=store, damage=("key in (0, 73)", "key in (11, 12, 299)")))
    got = fixity.with_records(records, pages).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(len(rows)))
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2] is not None, (r[2] or "").encode()))
    assert [(r["key"], r["url"]) for r in got] == [w[:2] for w in want]
    payload = lambda r: fixity.parse_warc(bytes(r["record"]))[0][3].decode()
    assert [payload(r) for r in got] == [w[2] or "" for w in want]
    at = defaultdict(int)
    for r in got:
        assert r["offset"] == at[r["file"]] and r["length"] == len(r["record"]) and r["sha256"] == hashlib.sha256(r["record"]).hexdigest()
        at[r["file"]] += r["length"]
    h = fixity.height_for(len(rows))
    good = fixity.tree(records, h, store)
    assert good.levels[-1].count() == 1
    key = {r["seq"]: r["key"] for r in got}
    found = {(key[r["node"]], r["hash_b"] is None) for r in fixity.audit(good, fixity.tree(fixity.replica(records), h, store)).collect()}
    assert found == {(0, False), (73, False), (11, True), (12, True), (299, True)}
    assert fixity.audit(good, good).isEmpty()


def test_archive_bytes_parse_back(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x\r\n\r\ny"), (2, None, None)], "page_id long, url string, html string")
    data = b"".join(bytes(r["record"]) for r in fixity.with_records(fixity.archive(pages), pages).orderBy("seq").collect())
    got = fixity.parse_warc(data + b"WARC/1.1\r\nContent-Le")
    assert [(h["WARC-Target-URI"], p) for _, _, h, p in got] == [("http://a/", b"x\r\n\r\ny"), ("", b"")]


def test_equal_rows_are_dealt_over_tasks(spark):
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    store = fixity.Staged(spark, "t")
    got = fixity.with_rank(rows, ["k"], "seq", store, rows_per_task=50)
    most = spark.read.parquet(f"{store.root}/2").groupBy(F.shiftright("_tarn_m", 33)).count().agg(F.max("count")).first()[0]
    assert most < 150 and [r["k"] for r in got.orderBy("seq").collect()] == sorted(7 if i % 3 == 0 else i for i in range(900))


def test_empty_archive(spark):
    store = fixity.Staged(spark, "t")
    none = fixity.archive(spark.createDataFrame([], "page_id long, url string, html string"), store=store)
    t = fixity.tree(none, fixity.height_for(none.count()), store)
    assert fixity.audit(t, t).isEmpty()
