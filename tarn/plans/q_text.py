"""Scalar and text functions over documents, pages and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import dates as D
from tarn.functions import lang as L
from tarn.functions import text as X
from tarn.functions import urls as U
from tarn.plans.registry import query, table
from tarn.sources.tables import spread


def docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang"))


def pages(spark, d):
    return table(spark, d, "pages")


@query("f1_url_normalize")
def f1(spark, d):
    return pages(spark, d).select("page_id", U.url_normalize("url").alias("url"))


@query("f2_url_resolve")
def f2(spark, d):
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
    return pages(spark, d).select("page_id", "url", links.alias("link")).select("page_id", U.url_resolve("url", "link").alias("link"))


@query("f3_normalize_masked", "SELECT page_id, CASE WHEN regexp_matches(regexp_replace(url, '^(\\w+://)www\\.', '\\1'), '^(?i:https?|ftp)://') THEN regexp_replace(url, '^(\\w+://)www\\.', '\\1') ELSE 'normalization-error://?' || url END AS url FROM pages")
def f3(spark, d):
    return pages(spark, d).select("page_id", U.normalize_masked(F.col("url"), U.SKIP_WWW | U.USE_VALIDATOR).alias("url"))


@query("f4_replace_rules", "SELECT page_id, regexp_replace(regexp_replace(url, '(?i)HTTPS?://', 'http://', 'g'), '[?&]ref=\\w+', '', 'g') AS url FROM pages")
def f4(spark, d):
    return pages(spark, d).select("page_id", U.replace_rules(F.col("url"), [("HTTPS?://", "http://"), (r"[?&]ref=\w+", "")]).alias("url"))


@query("f5_hosts", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) AS domain_url, array_to_string(list_slice(string_split(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '.'), -2, -1), '.') AS base FROM pages")
def f5(spark, d):
    u = F.col("url")
    return pages(spark, d).select("page_id", U.host(u).alias("host"), U.domain_url(u).alias("domain_url"), U.base_host(u).alias("base"))


@query("f6_valid", "SELECT page_id, regexp_matches(url, '^https?://[^\\s/?#]+\\.[^\\s/?#]+\\S*$') AND NOT regexp_matches(regexp_replace(url, '%[0-9A-Fa-f]{2}', '', 'g'), '%') AS ok FROM pages")
def f6(spark, d):
    return pages(spark, d).select("page_id", U.valid(F.col("url")).alias("ok"))


@query("f7_internal_links", "WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"(https?://[^\"]*)\"', 1)) AS link FROM pages) SELECT page_id, count(*) FILTER (array_to_string(list_slice(string_split(lower(regexp_extract(link, '^[a-z]+://([^/?#:]+)', 1)), '.'), -2, -1), '.') = array_to_string(list_slice(string_split(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '.'), -2, -1), '.')) AS internal, count(*) AS n FROM l GROUP BY 1")
def f7(spark, d):
    l = pages(spark, d).select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="(https?://[^"]*)"'), 1)).alias("link"))  # noqa: E741
    return l.groupBy("page_id").agg(F.count_if(U.is_internal(F.col("link"), F.col("url"))).alias("internal"), F.count("*").alias("n"))


@query("f8_site_id", "SELECT page_id, md5(regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || '/') AS site_id FROM pages")
def f8(spark, d):
    return pages(spark, d).select("page_id", U.site_id(F.col("url")).alias("site_id"))


@query("f9_entities", "WITH t AS (SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || ' &lt; &amp;amp &#8364;' AS t FROM documents) SELECT doc_id, regexp_replace(t, '&amp;([a-zA-Z]+|#[0-9]+);', '&\\1;', 'g') AS t FROM t")
def f9(spark, d):
    """All texts, each with entities that stand already; texts with entities of their own stay as they are there."""
    return docs(spark, d).select("doc_id", X.encode_entities(F.concat("text", F.lit(" < &amp &#8364;"))).alias("t"))


@query("f10_strip_comments", "SELECT page_id, md5(regexp_replace(html, '<!--.*?(-->|$)', '', 'gs')) AS h FROM pages")
def f10(spark, d):
    return pages(spark, d).select("page_id", F.md5(X.strip_comments(F.col("html"))).alias("h"))


@query("f11_strip_tags", "SELECT page_id, md5(regexp_replace(html, '(<!--.*?-->|<[^>]*>)', ' ', 'gs')) AS h FROM pages")
def f11(spark, d):
    return pages(spark, d).select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("h"))


@query("f13_pairs", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS c, o_orderstatus AS s FROM orders")
def f13(spark, d):
    text = F.concat(F.lit("c="), F.col("o_custkey"), F.lit(",junk,s="), F.col("o_orderstatus"), F.lit("=x"))
    m = X.pairs(text)
    return table(spark, d, "orders").select("o_orderkey", m["c"].alias("c"), m["s"].alias("s"))


@query("f14_tails", "SELECT doc_id, (strpos(text, '.') > 1 AND strpos(text, '.') = length(text)) AS tail, regexp_replace(text, '(?:ha)+', 'ha', 'g') AS t FROM documents")
def f14(spark, d):
    return docs(spark, d).select("doc_id", X.is_tail(F.col("text"), ".").alias("tail"), X.collapse(F.col("text"), "ha").alias("t"))


@query("f17_css_blocks", "SELECT page_id, len(regexp_extract_all(html, '(?s)\\{.+?\\}')) AS n FROM pages")
def f17(spark, d):
    return pages(spark, d).select("page_id", X.css_blocks(F.col("html")).cast("long").alias("n"))


@query("f18_hash_int", "SELECT doc_id, CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) AS h FROM documents")
def f18(spark, d):
    return docs(spark, d).select("doc_id", X.hash_int(F.col("text")).alias("h"))


@query("f19_si_numbers", "SELECT o_orderkey, (o_orderkey % 90 + 10) * 1000.0 AS a, 0.0 AS b FROM orders")
def f19(spark, d):
    k = F.col("o_orderkey") % 90 + 10
    return table(spark, d, "orders").select("o_orderkey", X.si_number(F.concat(k, F.lit("k"))).alias("a"), X.si_number(F.lit("none")).alias("b"))


@query("f20_match", "SELECT o_orderkey, regexp_matches(o_orderpriority, '^[12]') AS a, upper(o_orderstatus) = 'O' AS b FROM orders")
def f20(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.matches(F.col("o_orderpriority"), "/^[12]").alias("a"), X.matches(F.col("o_orderstatus"), "o").alias("b"))


@query("f21_json", "SELECT event_id, props->>'$.k' AS k, (props->>'$.k') IN ('1','2','3') AS ok FROM events")
def f21(spark, d):
    return table(spark, d, "events").select("event_id", X.json_path(F.col("props"), "k").alias("k"), X.json_checks(F.col("props"), "$.k", ["1", "2", "3"]).alias("ok"))


@query("f22_proxy_parts", "SELECT s_suppkey, 'u' || s_suppkey AS usr, 'h' || s_nationkey || '.net' AS host, 8000 + s_nationkey AS port FROM supplier")
def f22(spark, d):
    text = F.concat(F.lit("http://u"), F.col("s_suppkey"), F.lit(":pw@h"), F.col("s_nationkey"), F.lit(".net:"), F.col("s_nationkey") + 8000)
    return table(spark, d, "supplier").select("s_suppkey", U.proxy_parts(text).alias("p")).select("s_suppkey", F.col("p.user").alias("usr"), "p.host", "p.port")


@query("h1_content_hash", "SELECT doc_id, md5(lower(text)) AS h FROM documents")
def h1(spark, d):
    return docs(spark, d).select("doc_id", X.content_hash_1(F.col("text")).alias("h"))


@query("h2_content_hash", "SELECT doc_id, md5(array_to_string(list_filter(list_sort(list_distinct(regexp_split_to_array(lower(text), '\\s'))), lambda x: length(x) >= 3), '')) AS h FROM documents")
def h2(spark, d):
    return docs(spark, d).select("doc_id", X.content_hash_2(F.col("text")).alias("h"))


@query("h3_content_hash")
def h3(spark, d):
    return docs(spark, d).select("doc_id", X.content_hash_3(F.col("text"), L.detected(F.col("text"))).alias("h"))


@query("h4_content_hash")
def h4(spark, d):
    return docs(spark, d).select("doc_id", X.content_hash_4(F.col("text")).alias("h"))


@query("t2_word_metrics", "SELECT doc_id, len(regexp_split_to_array(text, '\\s')) AS words, CAST(floor(len(list_filter(regexp_split_to_array(text, '\\s'), lambda x: regexp_full_match(x, '[\\p{L}\\p{N}]+') AND NOT (regexp_full_match(x, '[\\p{Lu}\\p{Ll}\\p{N}]+') AND length(x) < 3))) * 100 / len(regexp_split_to_array(text, '\\s'))) AS BIGINT) AS good FROM documents")
def t2(spark, d):
    return docs(spark, d).select("doc_id", X.metric("WORDS_NUMBER", F.col("text")).cast("long").alias("words"), X.metric("WORDS_NUMBER_PERCENT", F.col("text")).alias("good"))


@query("t3_size_metrics", "SELECT doc_id, length(text) AS n, CASE WHEN length(text) > 0 THEN CAST(floor(length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) * 100 / length(text)) AS BIGINT) END AS good FROM documents")
def t3(spark, d):
    return docs(spark, d).select("doc_id", X.metric("CONTENT_SIZE", F.col("text")).cast("long").alias("n"), X.metric("CONTENT_SIZE_PERCENT", F.col("text")).alias("good"))


@query("t1_tag_metrics", "SELECT doc_id, CAST(2 + CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS BIGINT) AS n, CASE WHEN n_chars > 500 THEN 100 ELSE 66 END AS pct FROM documents")
def t1(spark, d):
    tags = F.create_map(F.lit("a"), F.col("lang"), F.lit("b"), F.col("source"), F.lit("c"), F.when(F.col("n_chars") > 500, "x").otherwise(" "))
    return table(spark, d, "documents").select("doc_id", X.metric("TAGS_NUMBER", tags).cast("long").alias("n"), X.metric("TAGS_NUMBER_PERCENT", tags).alias("pct"))


@query("l1_language")
def l1(spark, d):
    return docs(spark, d).select("doc_id", "lang", L.detected(F.col("text")).alias("detected"))


@query("k1_error_mask", "SELECT o_orderkey, list_filter(['bad_url', 'timeout', 'http', 'empty'], lambda x: (o_orderkey % 16) & CASE x WHEN 'bad_url' THEN 1 WHEN 'timeout' THEN 2 WHEN 'http' THEN 4 ELSE 8 END <> 0) AS names FROM orders")
def k1(spark, d):
    names = {0: "bad_url", 1: "timeout", 2: "http", 3: "empty"}
    return table(spark, d, "orders").select("o_orderkey", X.mask_names(F.col("o_orderkey") % 16, names).alias("names"))


@query("k2_charset", "SELECT page_id, lower(regexp_extract(html, '(?i)<meta[^>]+charset\\s*=\\s*[\"'']?([\\w-]+)', 1)) AS charset FROM pages")
def k2(spark, d):
    return pages(spark, d).select("page_id", X.declared_charset(F.col("html")).alias("charset"))


@query("k3_mime", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json' WHEN 2 THEN 'text/xml' WHEN 3 THEN 'application/pdf' ELSE 'text/plain' END AS mime FROM pages")
def k3(spark, d):
    forms = [F.concat(F.lit(" "), F.col("html")), F.concat(F.lit('{"url":"'), F.col("url"), F.lit('"}')), F.concat(F.lit('<?xml version="1.0"?><u>'), F.col("url"), F.lit("</u>")), F.concat(F.lit("%PDF-1.7 "), F.col("url")), F.col("url")]
    return pages(spark, d).select("page_id", X.mime(F.element_at(F.array(*forms), (F.col("page_id") % 5 + 1).cast("int"))).alias("mime"))


@query("k4_header", "SELECT o_orderkey, o_orderstatus AS status, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') AS at FROM orders")
def k4(spark, d):
    text = F.concat(F.lit("Server: x\nX-Status: "), F.col("o_orderstatus"), F.lit("\nVary: y"))
    return table(spark, d, "orders").select("o_orderkey", X.header(text, "x-status").alias("status"), D.http_date(F.col("o_orderdate")).alias("at"))


@query("dt1_parse", "SELECT o_orderkey, o_orderdate AS a, CAST(o_orderdate AS DATE)::TIMESTAMP AS b, TIMESTAMP '2024-01-01 12:00:00' - INTERVAL 1 HOUR * (o_orderkey % 40 + 1) AS c FROM orders")
def dt1(spark, d):
    return parsed_orders(spread(table(spark, d, "orders")))


def parsed_orders(o):
    now, c = "2024-01-01 12:00:00", F.col("o_orderdate")
    forms = {"a": F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "b": F.date_format(c, "'on' dd.MM.yyyy"), "c": F.concat(F.col("o_orderkey") % 40 + 1, F.lit(" hours ago"))}
    return o.select("o_orderkey", *[D.parse_date(x, now).alias(n) for n, x in forms.items()])


@query("dt4_offsets", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 330 WHEN 1 THEN -480 WHEN 2 THEN -210 END AS m, o_orderdate - INTERVAL 1 MINUTE * CASE o_orderkey % 4 WHEN 0 THEN 330 WHEN 1 THEN -480 WHEN 2 THEN -210 ELSE 0 END AS utc FROM orders")
def dt4(spark, d):
    zone = F.element_at(F.array(*[F.lit(z) for z in ("12:00 IST", "12:00 PST", "12:00:00 -0330", "12:00")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", D.offset_minutes(zone).alias("m"), D.to_utc(F.col("o_orderdate"), D.offset_minutes(zone)).alias("utc"))


@query("dt5_zone_by_url", "SELECT page_id, TIMESTAMP '2024-01-01 12:00:00' - INTERVAL 1 MINUTE * CASE WHEN url LIKE '%/de/%' THEN 60 WHEN url LIKE '%/en/%' THEN -300 ELSE 0 END AS at FROM pages")
def dt5(spark, d):
    return pages(spark, d).select("page_id", D.zone_by_url(F.expr("timestamp_ntz'2024-01-01 12:00:00'"), F.col("url"), [("/de/", 60), ("/en/", -300)]).alias("at"))


@query("dt6_day_month", "SELECT o_orderkey, o_orderdate AS at FROM orders")
def dt6(spark, d):
    return table(spark, d, "orders").select("o_orderkey", D.day_month_swapped(F.date_format("o_orderdate", "yyyy-dd-MM HH:mm:ss")).alias("at"))


@query("dt7_precedence", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 2 DAY END AS p FROM orders")
def dt7(spark, d):
    c, day = F.col("o_orderdate"), lambda n: F.make_interval(days=F.lit(n))
    values = {"rss": F.when(F.col("o_orderkey") % 2 == 0, c), "http_date": F.when(F.col("o_orderkey") % 3 == 0, c + day(1)), "pubdate": c + day(2)}
    return table(spark, d, "orders").select("o_orderkey", D.publication_date(values, F.lit(2 | 4 | 32), F.lit(4)).alias("p"))


@query("dt8_last_modified", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2020-01-01' WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE TIMESTAMP '2024-01-01' - INTERVAL 7 DAY END AS at FROM orders")
def dt8(spark, d):
    ts = lambda s: F.expr(f"timestamp_ntz'{s} 00:00:00'")
    k = F.col("o_orderkey")
    at = D.last_modified(F.when(k % 5 == 0, 304).otherwise(200), ts("2020-01-01"), F.when(k % 2 == 0, F.col("o_orderdate")), F.lit(None).cast("timestamp_ntz"), ts("2024-01-01"), 7)
    return table(spark, d, "orders").select("o_orderkey", at.alias("at"))
