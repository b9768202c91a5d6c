"""The stages of the corpus pipeline against plain versions of what each decides."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tarn.llm import decontam, pii, toxicity
from tarn.llm.common import Staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    store, docs, out = Staged(spark, "test"), spark.read.parquet(f"{sf}/documents.parquet"), {"input": spark.read.parquet(f"{sf}/documents.parquet")}
    for name, f in corpus_pipeline.STAGES:
        docs = out[name] = store.put(f(spark, docs, sf))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    assert all(stages[n].columns == COLUMNS for n in ("toxicity", "near_duplicates", "decontamination", "personal_data"))


def test_toxic_documents_go(spark, sf, stages):
    model = toxicity.train(stages["input"], spark.read.parquet(f"{sf}/labels.parquet"))
    scored = toxicity.with_score(stages["input"], model)
    assert ids(scored.where("score < 0.3")) == ids(stages["toxicity"])


def test_one_document_of_each_group_stays(stages):
    words = {r["doc_id"]: r["text"] or "" for r in stages["toxicity"].collect()}
    sets = {}
    for d, t in words.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {d: d for d in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    assert ids(stages["near_duplicates"]) == sorted(d for d in sets if find(d) == d)


def test_leaks_go_and_clean_documents_stay(spark, sf, stages):
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = stages["near_duplicates"].collect()
    leaks = {r["doc_id"] for r in before if any(i in (r["text"] or "") for i in items)}
    assert ids(stages["decontamination"]) == sorted(r["doc_id"] for r in before if r["doc_id"] not in leaks)


def test_personal_data_is_masked(stages):
    before = {r["doc_id"]: r for r in stages["decontamination"].collect()}
    after = {r["doc_id"]: r for r in stages["personal_data"].collect()}
    assert before.keys() == after.keys()
    for d, r in after.items():
        assert pii.base_spans(r["text"] or "") == [] and r["n_chars"] == len(r["text"] or "")
        if not pii.base_spans(before[d]["text"] or "") and "[" not in (r["text"] or ""):
            assert r["text"] == before[d]["text"]


def test_packing_is_whole(stages):
    pieces = stages["packing"]
    assert ids(pieces.where("piece = 0")) == ids(stages["personal_data"])
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n <> end or n > 2048").isEmpty()


def test_odd_rows_pass_through(spark, sf):
    rows = [(1, None, None, None, None), (None, "a b c d e f", "en", "s", 11), (2, "", "en", None, 0), (3, "w " * 30000, "en", "s", 60000), (3, "w " * 30000, "en", "s", 60000), (4, "call +1 (555) 555-1234 now", "en", "s", 26)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1))
    store = Staged(spark, "test")
    for name, f in corpus_pipeline.STAGES[:4]:
        df = store.put(f(spark, df, sf))
        assert df.columns == COLUMNS
    assert sorted((str(r["doc_id"]), r["text"] and r["text"][:20]) for r in df.collect()) == [("1", None), ("2", ""), ("3", "w " * 10), ("4", "call [PHONE] now"), ("None", "a b c d e f")]
    empty = df.limit(0)
    for _, f in corpus_pipeline.STAGES[:4]:
        assert f(spark, empty, sf).count() == 0
    assert decontam.with_leaks(empty, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
