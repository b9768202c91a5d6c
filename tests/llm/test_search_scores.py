import zlib

import numpy as np
from pyspark.sql import functions as F

from tarn.llm import ann, toxicity


def brute(rows, k=5, query=lambda i: i % 50 == 0):
    good = {}
    for i, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(tuple(v))
    good = {i: np.array(min(vs), float) for i, vs in good.items()}
    out = {}
    for i in filter(query, good):
        scored = sorted((-float(v @ good[i] / np.linalg.norm(v) / np.linalg.norm(good[i])), j) for j, v in good.items() if j != i)
        out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def run(df, **more):
    out = {}
    for r in ann.nearest(df, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_whole_windows_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 8)).astype("float32").tolist()
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(400 + i, base[0]) for i in range(120)]  # many copies
    rows += [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] * 8), (1150, [None] + [1.0] * 7), (None, base[1]), (1200, []), (50, base[50])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got, want = run(df, query="id % 50 = 0", window=2.0, block=64), brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-9)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [j for j, _ in run(df, query="id = 0")[0]] == [2, 1]
    assert run(df.limit(0)) == {} and run(df.where("vec_id = 0")) == {}


def test_recall_of_the_index(spark, sf):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got, want = run(df, query="id % 10 = 0"), brute(rows, query=lambda i: i % 10 == 0)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_hilbert_neighbours_touch():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = ann.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(side**3))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.op3_toxicity(spark, d)
    rows = got.join(labels.select("doc_id", "toxic"), "doc_id").where("held_out and toxic is not null").select("predicted", "toxic").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit / max(1, sum(r["toxic"] for r in rows)) > 0.75 and hit / max(1, sum(r["predicted"] for r in rows)) > 0.9
    assert got.count() == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.limit(200).collect())
    assert got.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").isEmpty()


def test_labels_of_held_out_rows_are_not_learned(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "bad word") for i in ids], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, 1, 1) for i in ids], "doc_id long, quality int, toxic int"))
    assert not len(model.at)


def test_odd_texts_are_scored(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "idiot " * 50000), (1, None)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    rows = toxicity.with_score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.with_score(docs.limit(0), toxicity.train(docs.limit(0), labels)).collect() == []


def test_rows_that_repeat_an_id_are_one_example(spark):
    texts = [(i, f"word{i % 7} {'vile' if i % 3 == 0 else 'kind'} text {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    once = toxicity.train(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    often = toxicity.train(spark.createDataFrame(texts + [texts[5]] * 400 + [(5, texts[5][1] + " and more words")], "doc_id long, text string").repartition(6), labels)
    assert np.array_equal(once.at, often.at) and np.allclose(once.weight, often.weight)
