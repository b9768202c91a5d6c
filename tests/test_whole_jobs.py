"""Queries that must do their work on whole tables."""

from tarn.plans import registry


def orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet")


def test_round_trip_writes_every_site(spark, sf, monkeypatch):
    from tarn.sources import tables

    written, roots = [], []
    plain = tables.write

    def seen(df, root, *a, **b):
        written.append(df.count())
        roots.append(root)
        plain(df, root, *a, **b)

    monkeypatch.setattr(tables, "write", seen)
    registry.queries()["s6_table_round_trip"](spark, sf).collect()
    assert written == [orders(spark, sf).count()]
    folders = {r["f"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots[0]).selectExpr("regexp_extract(path, 'site_id[^/]*', 0) as f").collect()}
    assert len(folders) <= tables.SITE_BUCKETS < orders(spark, sf).select("o_custkey").distinct().count()


def test_every_order_date_is_parsed(spark, sf):
    got = registry.queries()["dt1_parse"](spark, sf)
    assert got.where("a is not null and b is not null and c is not null").count() == orders(spark, sf).count()


def test_every_document_is_highlighted(spark, sf):
    import re

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["t"] for r in registry.queries()["z7_highlight"](spark, sf).collect()}
    assert got == {k: re.sub(r"\b(the|of)\b", r"<b>\1</b>", t, flags=re.I) for k, t in docs.items()}
    assert any("<b>The</b>" in t for t in got.values())


def test_tags_of_every_language_are_validated(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["tags"] for r in registry.queries()["p21_tag_validators"](spark, sf).collect()}
    assert got == {k: [w for w in t.split(" ") if w.startswith("t") and "tion" not in w] for k, t in docs.items()}


def test_a_tenth_is_replaced_and_a_tenth_deleted(spark, sf, monkeypatch):
    from tarn.operators import search

    left = []
    plain = search.without

    def seen(idx, keys, key):
        left.append({r[0] for r in idx.join(keys, key, "left_semi").select(key).distinct().collect()})
        return plain(idx, keys, key)

    monkeypatch.setattr(search, "without", seen)
    registry.queries()["z4_index_merge"](spark, sf).collect()
    ids = {r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert left == [{i for i in ids if i % 10 == 5}, {i for i in ids if i % 10 == 3}]
