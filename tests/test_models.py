"""Queries without SQL, row by row against plain models, and functions against known values."""

import hashlib
import html as entities
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tarn.functions import lang, stem, urls
from tarn.operators import crawl, joins, merge, rules
from tarn.plans import registry
from tarn.sources import requests, tables


def rows(spark, sf, name, *columns):
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()


def run(spark, sf, name):
    return registry.queries()[name](spark, sf).collect()


# --- whole queries


def test_normal_urls_of_all_pages(spark, sf):
    want = {r["page_id"]: urls.normalized(r["url"]) for r in rows(spark, sf, "pages", "page_id", "url")}
    got = {r["page_id"]: r["url"] for r in run(spark, sf, "f1_url_normalize")}
    assert got == want and all(urls.normalized(u) == u for u in want.values())


def test_resolved_links_of_all_pages(spark, sf):
    pages = {r["page_id"]: r for r in rows(spark, sf, "pages", "page_id", "url", "html")}
    want = sorted((k, urljoin(r["url"], link)) for k, r in pages.items() for link in re.findall(r'href="([^"]*)"', r["html"]))
    got = sorted((r["page_id"], r["link"]) for r in run(spark, sf, "f2_url_resolve"))
    assert len(got) == len(want) and got == want


def soundex(word):
    """The American code: first letter, then digits of the letters after it; h and w between equal codes don't part them."""
    codes = {c: d for d, letters in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in letters}
    if not word or not (word[0].isascii() and word[0].isalpha()):
        return word
    out, last = word[0].upper(), codes.get(word[0])
    for c in word[1:]:
        if c in "hw":
            continue
        code = codes.get(c)  # a vowel or a mark parts equal codes
        if code and code != last:
            out += str(code)
        last = code
    return (out + "000")[:4]


def test_soundex_hashes(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in rows(spark, sf, "documents", "doc_id", "text")}
    got = {r["doc_id"]: r["h"] for r in run(spark, sf, "h4_content_hash")}
    want = {k: hashlib.md5("".join(soundex(w) for w in re.split(r"\s", t.lower())).encode()).hexdigest() for k, t in texts.items() if t.isascii()}
    assert got.keys() == texts.keys() and len(want) > 20
    assert {k: h for k, h in got.items() if k in want} == want


def test_stem_hashes(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in rows(spark, sf, "documents", "doc_id", "text")}
    found = {r["doc_id"]: r["detected"] for r in run(spark, sf, "l1_language")}
    got = {r["doc_id"]: r["h"] for r in run(spark, sf, "h3_content_hash")}
    assert got == {k: hashlib.md5("".join(stem.stem(w, found[k]) for w in t.lower().split()).encode()).hexdigest() for k, t in texts.items()}


def test_languages_of_documents(spark, sf):
    got = run(spark, sf, "l1_language")
    assert sum(r["detected"] == r["lang"] for r in got) >= 0.97 * len(got)


def visible(page):
    page = re.sub(r"(?is)<(script|style|noscript|template)\b.*?</\1>|<!--.*?-->|<!doctype[^>]*>", "", page)
    page = re.sub(r"(?is)</?(p|div|li|ul|ol|table|tr|td|th|h[1-6]|section|article|header|footer|nav|br|title|body)\b[^>]*>", " ", page)
    return re.sub(r"\s+", " ", entities.unescape(re.sub(r"(?s)<[^>]*>", "", page))).strip()


def test_inner_text_of_pages(spark, sf):
    pages = {r["page_id"]: r["html"] for r in rows(spark, sf, "pages", "page_id", "html")}
    got = {r["page_id"]: r["text"] for r in run(spark, sf, "f12_inner_text")}
    assert got == {k: visible(p) for k, p in pages.items()}


def test_main_text_of_pages(spark, sf):
    """The text of the article without what stands around it."""
    pages = {r["page_id"]: r["html"] for r in rows(spark, sf, "pages", "page_id", "html")}
    for r in run(spark, sf, "x8_main_text"):
        article = set(visible(re.search(r"(?s)<article>(.*?)(</article>|$)", pages[r["page_id"]])[1]).split())
        words = r["text"].split()
        assert sum(w in article for w in words) >= 0.95 * len(words) and len(set(words)) >= 0.6 * len(article)


def test_link_pipeline(spark, sf):
    want = set()
    for r in rows(spark, sf, "pages", "page_id", "url", "html"):
        first = {}
        for pos, link in enumerate(entities.unescape(x) for x in re.findall(r'<a [^>]*href="([^"]*)"', r["html"])):
            first.setdefault(urls.normalized(urljoin(r["url"], link)), pos)
        kept = [u for u in sorted(first, key=first.get) if re.search("^https?://", u) and not re.search(r"\.(css|js)$", u)]
        want |= {(r["page_id"], u, i == 3 and len(kept) > 4) for i, u in enumerate(kept[:4])}
    got = {(r["parent"], r["url"], r["error_mask"] != 0) for r in run(spark, sf, "x2_link_pipeline")}
    assert got == want


# --- functions


@pytest.mark.parametrize(
    "word,want",
    [("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("valenci", "valenc"), ("digitizer", "digit"), ("operator", "oper"), ("feudalism", "feudal"), ("decisiveness", "decis"), ("hopefulness", "hope"), ("formaliti", "formal"), ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("airliner", "airlin"), ("adjustable", "adjust"), ("replacement", "replac"), ("adoption", "adopt"), ("activate", "activ"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll")],
)
def test_porter(word, want):
    assert stem.stem(word, "en") == want


def test_light_stems():
    assert stem.stem("häusern", "de") == stem.stem("häuser", "de") == stem.stem("haus", "de") == "haus"
    assert stem.stem("palabras", "es") == stem.stem("palabra", "es") == "palabr" and stem.stem("ciudad", "es") == "ciudad"
    assert stem.stem("grandes", "fr") == stem.stem("grands", "fr") == "grand"
    assert stem.stem("слово", "ru") == "слово"


def test_scripts_and_languages(spark):
    said = {"en": "The house of the man and the dog", "de": "Der Hund und die Katze sind nicht das Haus", "it": "Il cane che non sono nel giardino della casa", "pt": "Os cães não são da casa para uma viagem", "nl": "Het huis van een man en niet de hond", "pl": "Nie jest tak, że się to zdarza na co dzień", "ru": "Это просто русский текст", "uk": "Це український текст із літерами їжак", "el": "Αυτό είναι ένα κείμενο", "he": "זה טקסט בעברית", "ar": "هذا نص باللغة العربية", "fa": "این یک متن فارسی است چه گپ", "hi": "यह एक हिंदी पाठ है", "ja": "これは日本語の文章です", "zh": "这是一个中文句子", "ko": "이것은 한국어 문장입니다", "th": "นี่คือข้อความภาษาไทย", "fi": "Hän on täällä ja se oli myös hyvä, mutta ei nyt", "tr": "Bu bir ev ve çok güzel bir bahçe için"}
    df = spark.createDataFrame([(k, t) for k, t in said.items()], "want string, t string")
    assert [(r["want"], r["got"]) for r in df.select("want", lang.detected(F.col("t")).alias("got")).collect() if r["want"] != r["got"]] == []


# --- operators


@pytest.mark.parametrize("right,want", [([1, 2], {0, 3}), ([1, None], set()), ([], {0, 1, 3, None})])
def test_not_in(spark, right, want):
    left = spark.createDataFrame([(0,), (1,), (3,), (None,)], "k int")
    got = joins.not_in(left, "k", spark.createDataFrame([(x,) for x in right], "o int"), "o")
    assert {r["k"] for r in got.collect()} == want
    assert "LeftAnti" in got._jdf.queryExecution().executedPlan().toString()


def test_rules_do_not_shuffle_rows(spark, sf):
    """Only the rules and one row of them move."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    rule = spark.createDataFrame([(1, "URGENT", 0, 1, 1)], "rule_id int, pattern string, op_code int, stage int, action int")
    plan = rules.decided(o, "o_orderkey", rule, F.col("o_orderpriority"), 1, default=False)._jdf.queryExecution().executedPlan().toString()
    orders = plan[plan.index("FileScan") - 400 :] if "FileScan" in plan else plan
    assert "hashpartitioning" not in orders and "rangepartitioning" not in plan


def test_rules_of_sites(spark):
    urls_ = spark.createDataFrame([(1, "a", "x1"), (2, "a", "y"), (3, "b", "x1"), (4, "c", "x1")], "id int, site string, url string")
    some = spark.createDataFrame([(1, "a", "^x", 0, 1, 1), (2, "a", "1$", 0, 1, -1), (3, "b", "x", 0, 1, 1)], "rule_id int, site string, pattern string, op_code int, stage int, action int")
    assert {r["id"]: r["passes"] for r in rules.decided(urls_, "id", some, F.col("url"), 1, False, on=["site"]).collect()} == {1: False, 2: False, 3: True, 4: False}
    assert {r["id"]: r["results"] for r in rules.evaluated(urls_, "id", some, F.col("url"), 1, on=["site"]).collect()} == {1: [1, 1], 2: [0, 0], 3: [1]}


def test_templates_of_hosts(spark):
    known = spark.createDataFrame([("a.example.com", "exact"), ("example.com", "parent"), ("*", "any"), (None, "lost")], "domain string, template string")
    hosts = spark.createDataFrame([("a.example.com",), ("b.example.com",), ("example.org",), (None,)], "h string")
    assert {r["h"]: r["template"] for r in crawl.templates_for(hosts, "h", known).collect()} == {"a.example.com": "exact", "b.example.com": "parent", "example.org": "any", None: None}
    assert crawl.templates_for(hosts, "h", known.limit(0)).where("template is not null").count() == 0


def test_entities_of_a_long_chain(spark):
    """Rows that share a content with the row before by one key and with the next by another are one entity, in few rounds."""
    n = 200
    rows_ = [("s", i, f"u{i}", f"r{i // 2}", f"c{(i + 1) // 2}") for i in range(n)] + [("t", n + i, f"u{i}", f"r{i // 2}", None) for i in range(4)] + [("s", n + 9, None, "", None)]
    got = merge.same_contents(spark.createDataFrame(rows_, "site_id string, pos int, url_md5 string, raw_content_md5 string, content_url_md5 string"))
    want = {i: 0 for i in range(n)} | {n: n, n + 1: n, n + 2: n + 2, n + 3: n + 2, n + 9: n + 9}
    assert {r["pos"]: r["entity"] for r in got.collect()} == want


def test_every_request_type_decodes(spark):
    """All fields of a type come through, others stay null; lists, unknown types and broken texts have defined answers."""
    import json

    value = {"bigint": 7, "double": 1.5, "array<string>": ["a"], "map<string,string>": {"LIMIT": "5"}}
    sample = {f: value.get(requests.FIELD_TYPES.get(f, "string"), [{"siteId": "s"}] if f in ("filters", "items") else "x") for f in requests.FIELDS}
    assert len(requests.REQUESTS) > 30
    data = [(k, json.dumps(sample)) for k in requests.REQUESTS] + [("url_new", json.dumps([sample, sample])), ("none", "{}"), ("site_new", "{broken"), ("site_new", None), ("url_new", '{"CDate":"2024-01-01","UDate":"NOW()"}')]
    got = requests.decoded(spark.createDataFrame(data, "kind string, text string"), "kind", "text").collect()
    for r in got[: len(requests.REQUESTS)]:
        filled = {f for f in requests.FIELDS if r["request"][f] is not None}
        assert filled == set(requests.REQUESTS[r["kind"]]) and r["error"] is None
    rest = got[len(requests.REQUESTS) :]
    assert [(r["kind"], r["pos"], r["error"], r["request"] is None) for r in rest] == [("url_new", 0, None, False), ("url_new", 1, None, False), ("none", 0, "unknown request", True), ("site_new", 0, "no JSON", True), ("site_new", 0, "no JSON", True), ("url_new", 0, None, False)]
    assert (rest[-1]["request"]["cDate"], rest[-1]["request"]["uDate"]) == ("2024-01-01", "NOW()")


def test_scan_of_a_database(spark, sf):
    """Rows written to a database over JDBC and scanned by a query, by index and by name."""
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url = "jdbc:derby:memory:tarn;create=true"
    spark.read.parquet(f"{sf}/nation.parquet").write.jdbc(url, "nations", mode="overwrite")
    got = tables.jdbc(spark, url, 'SELECT "n_name", "n_regionkey" FROM nations WHERE "n_regionkey" = 1').collect()
    want = sorted((r["n_name"], r["n_regionkey"]) for r in rows(spark, sf, "nation", "n_name", "n_regionkey") if r["n_regionkey"] == 1)
    assert sorted(tables.by_index(got)) == want and sorted(r.asDict()["n_name"] for r in got) == [n for n, _ in want]


def test_no_local_checkpoints_on_a_cluster():
    from types import SimpleNamespace

    from tarn.lineage import checkpoint_dir

    conf = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn")))
