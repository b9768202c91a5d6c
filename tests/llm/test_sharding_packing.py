import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest

from tarn.llm import packing, sharding

ODD = [(1, "a"), (None, None), (2, ""), (2, ""), (3, "x y " * 3000), (4, "<|endoftext|> und Ümläut"), (5, "a")]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(*r, "s", 9) for r in rows], "doc_id long, text string, shard string, slot int")


def test_matrix_has_the_given_sums():
    counts, sizes = np.array([5, 0, 17, 3, 25]), np.array([10, 10, 10, 10, 10])
    m = np.stack([sharding.matrix_row(counts, sizes, i, 3) for i in range(5)])
    assert (m.sum(1) == counts).all() and (m.sum(0) == sizes).all() and (m >= 0).all()


def test_hypergeometric_beyond_numpys_limit():
    rng = np.random.default_rng(0)
    x = [sharding.hypergeometric(rng, 6 * 10**8, 6 * 10**8, 1000) for _ in range(300)]
    assert abs(np.mean(x) - 500) < 5 and 10 < np.std(x) < 22
    assert sharding.split(rng, np.array([10**9, 2 * 10**9]), 3 * 10**9).tolist() == [10**9, 2 * 10**9]


def test_rows_are_uniform_over_shards():
    counts, sizes = np.array([4, 4]), np.array([4, 4])
    first = [int(sharding.matrix_row(counts, sizes, 0, seed)[0]) for seed in range(2000)]
    expect = {0: 1 / 70, 1: 16 / 70, 2: 36 / 70, 3: 16 / 70, 4: 1 / 70}
    assert all(abs(first.count(k) / 2000 - p) < 0.04 for k, p in expect.items())


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards_are_exact(spark, shards):
    df = odd(spark, ODD * 5).repartition(3)
    got = sharding.shuffle_shards(df, shards, block_rows=4).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    n = len(ODD) * 5
    assert len(got) == n and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted((r[0] or 0, r[1] or "") for r in ODD * 5)


def test_empty_tables(spark):
    none = odd(spark, [])
    assert sharding.shuffle_shards(none).collect() == []
    assert packing.pack(none).collect() == []


def test_op10_digests(spark, sf):
    got = sharding.op10_sharding(spark, sf).collect()
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(text)
    for r in got:
        data = text[r["doc_id"]].encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "rows" and r["grown_shard"] is None


@cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def reference_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def check_packing(rows, texts, capacity):
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    for d, text in texts.items():
        ids = reference_ids(text)
        at = 0
        for k, r in enumerate(sorted(docs[d], key=lambda r: r["piece"])):
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["piece"] == k and r["start"] == at and r["ids_crc32"] == zlib.crc32(part) and len(part) == r["length"]
            assert k == 0 or r["length"] == capacity
            assert "ids" not in r or r["ids"] == part.astype(int).tolist()
            at += r["length"]
        assert at == len(ids)
    return len(bins)


def test_pieces_match_the_tokenizer(spark):
    texts = {1: "a", 2: "", 3: "x y " * 3000, 4: "<|endoftext|> und Ümläut  \n\n 12345", 5: None, 6: "ß" * 500}
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), with_ids=True).collect()
    check_packing([r.asDict() for r in rows], texts, 2048)


def test_op1_is_dense_and_whole(spark, sf):
    rows = [r.asDict() for r in packing.op1_packing(spark, sf).collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bins = check_packing(rows, texts, 2048)
    assert sum(r["length"] for r in rows) / 2048 / bins > 0.95


def test_rounds_merge_bins_of_many_partitions(spark):
    df = spark.createDataFrame([(i, "the of and " * (i % 40 + 1)) for i in range(400)], "doc_id long, text string").repartition(20)
    rows = packing.pack(df, capacity=256, fan_in=3, node_bins=30).collect()
    check_packing([r.asDict() for r in rows], {}, 256)
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)
    total, bins = sum(r["length"] for r in rows), len({r["sequence_id"] for r in rows})
    assert total / 256 / bins > 0.85


def test_repeated_rows_are_packed_each(spark):
    rows = packing.pack(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None"]


def test_ids_equal_the_tokenizer_on_many_texts(spark):
    """Whole documents of sf0.01 and odd strings: several scripts, marks, digits, spaces, controls, contractions, emoji."""
    rng = random.Random(8)
    pools = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJ", "0123456789", " \t\n\r\x0b\x0c  　", "'’\"-_.,;:!?()[]{}<>/\\|@#$%^&*~`+=", "äöüßéèñçøåæœ", "абвгдежз", "你好世界日本語한국어", "العربيةעברית", "🙂🚀👩‍💻🏳️‍🌈", "́̈​‍﻿", "\x00\x01\x7f\x85", "fiⅣ²①"]
    odd = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 120))) for _ in range(600)]
    odd += ["I'll we've don't CAN'T o'clock 's", "a" * 5000, " " * 3000, "\n" * 2000, "12345678901234567890" * 50, "x y " * 4000]
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + odd
    path = packing.vocabulary()
    wrong = [t[:80] for t in texts if list(packing.token_ids(t or "", path)) != reference_ids(t)]
    assert wrong == []


def test_a_tree_that_cannot_narrow_loses_little(spark, sf):
    """Nodes that hold five bins on average stop merging early; all pieces are there, in few more sequences."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(16)
    n = {}
    for node_bins in (5, 50000):
        rows = packing.pack(docs, node_bins=node_bins).collect()
        n[node_bins] = len({r["sequence_id"] for r in rows})
        assert sum(r["piece"] == 0 for r in rows) == docs.count()
    assert n[5] <= 1.1 * n[50000]
