"""What larger tables and odd inputs brought to light."""

import pytest
from pyspark.sql import functions as F

from tarn.functions import lang
from tarn.operators import runtime


@pytest.mark.parametrize("listed", [64, 0])
def test_links_are_resolved_in_every_row(spark, monkeypatch, listed):
    """Looked up in the row or joined: the same rows, those without links too; a separator is no pattern, of two targets the least counts."""
    monkeypatch.setattr(runtime, "LISTED", listed)
    known = spark.createDataFrame([("a", "A"), ("b", "z"), ("b", "B"), ("0", "no"), (None, "n"), ("c", None)], "source string, target string")
    texts = {0: "a|b||x|a|", 1: None, 2: "", 3: "x.y|a b", 4: "c|b", 5: "a"}
    got = runtime.resolved_links(spark.createDataFrame(list(texts.items()), "id int, links string").repartition(3), "links", "|", known)
    swap = {"a": "A", "b": "B", "0": "no"}
    assert got.columns == ["id", "links"]
    assert {r["id"]: r["links"] for r in got.collect()} == {k: None if t is None else "|".join(swap.get(x, x) for x in t.split("|")) for k, t in texts.items()}


def test_no_text_moves_for_a_few_redirects(spark, sf):
    from tarn.plans import registry

    plan = registry.queries()["e17_link_resolver"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_language_is_worked_out_once(spark):
    """Each class of characters is counted in one place of the plan, not once for each language that it may rule out."""
    odd = {"": "xx", None: "xx", "la la la": "fr", "en en": "fr", "123 456": "xx", "ÀÉ The İstanbul ve bir ΣΑΣ": "tr", "ъ болгарский ъъъ": "bg", "їжак і є": "uk", "ñ ¿¡ áéíóú": "es", "カカカ" + "漢" * 40: "ja", "漢" * 10 + "a" * 40: "zh", "я" * 2 + "a" * 8: "ru", "я" * 2 + "a" * 9: "xx"}
    df = spark.createDataFrame([(t, c) for t, c in odd.items()], "t string, want string").withColumn("got", lang.detected(F.col("t"), "xx"))
    assert [r for r in df.collect() if r["want"] != r["got"]] == []
    classes = len(lang.LETTERS) + len(lang.SCRIPTS) + sum(map(len, lang.WITHIN.values()))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= classes + 1


def test_language_under_a_python_function(spark):
    @F.udf("string")
    def doubled(x):
        return x * 2

    assert spark.createDataFrame([("der und die",)], "t string").select(doubled(lang.detected(F.col("t")))).first()[0] == "dede"


def test_stem_hash_detects_once(spark, sf):
    from tarn.plans import registry

    plan = registry.queries()["h3_content_hash"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= len(lang.LETTERS) + len(lang.SCRIPTS) + sum(map(len, lang.WITHIN.values())) + 1


@pytest.mark.parametrize("word,want", [("", ""), ("y", "y"), ("yy", "yy"), ("syzygy", "syzygi"), ("flying", "fly"), ("ed", "ed"), ("ing", "ing"), ("ééing", "ééing"), ("ąbying", "ąby"), ("yyying", "yy")])
def test_odd_stems(word, want):
    from tarn.functions.stem import porter

    assert porter(word) == want


ODD_PAGES = [
    "<head><meta charset=\"utf-8\"><title> two  blanks\n and &amp;amp; &quot;cut&quot; &amp</title></head><nav><ul><li><a href=\"/a\">a &amp; b</a></li><li><a href=\"/b\"> &lt;b&am</a></li><li><a href=\"/c\"></a></li><li><a href=\"/d\"><b>d</b></a></li></ul></nav>",
    "<TITLE>first</TITLE><svg><title>second</title></svg><meta charset=\"a\"><meta charset=\"b\"><nav><a href='x'>x</a></nav><nav><a href='y'>y</a></nav>",
    "<title></title><body><title>late</title><nav>\n<a href=\"&amp;\">1\n2</a>\n</nav>",
    "<title>never closed <nav><a href=z>z</nav>",
    "<div>\n\n<title>on line\nthree</title>\n<script>'<title>no</title>'</script></div>",
    "",
    None,
]


@pytest.mark.parametrize("name", ["x6_template_extraction", "x6b_title_native"])
def test_odd_pages_equal_sql(spark, tmp_path, name):
    import duckdb

    from tarn.plans import registry

    spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(ODD_PAGES)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = registry.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_references_are_decoded_once(spark):
    from tarn.functions import html

    page = "<title>&amp;quot; &lt;</title><p>one</p><p>two</p>"
    df = spark.createDataFrame([(page,)], "html string")
    assert df.select(html.fill_template({"t": [{"path": "//title"}]})("html")["t"]).first()[0] == "&quot; <"
    assert html.strings(html.xpath(html.parsed(page), "(//p)[2]")) == ["two"] and html.xpath(html.parsed(page), "(//p)[3]/text()") == []
