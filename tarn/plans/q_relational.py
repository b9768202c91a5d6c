"""Joins, aggregates and set operations. Roles: customer, nation = sites; orders = urls; lineitem = node results; events = operation log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import counters as C
from tarn.operators import joins as J
from tarn.plans.registry import query, table


def url_rows(spark, d):
    """Orders as URL rows."""
    status = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 7).otherwise(4)
    return table(spark, d, "orders").select(F.col("o_custkey").alias("site_id"), F.col("o_orderkey").alias("url_id"), status.alias("status"), (F.col("o_orderkey") % 3).alias("state"), (F.col("o_orderkey") % 5).alias("crawled"), (F.col("o_orderkey") % 2).alias("processed"), (F.col("o_orderkey") % 7 * 512).cast("long").alias("error_mask"), F.round("o_totalprice").cast("long").alias("size"), (F.col("o_orderkey") % 40).alias("crawling_time"), F.col("o_orderdate").alias("c_date"), F.col("o_orderpriority").alias("priority"))


URLS = "(SELECT o_custkey AS site_id, o_orderkey AS url_id, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 7 ELSE 4 END AS status, o_orderkey % 3 AS state, o_orderkey % 5 AS crawled, o_orderkey % 2 AS processed, o_orderkey % 7 * 512 AS error_mask, CAST(round(o_totalprice) AS BIGINT) AS size, o_orderkey % 40 AS crawling_time, o_orderdate AS c_date, o_orderpriority AS priority FROM orders)"


@query("j1_site_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE') AND o_custkey IN (1, 4, 7, 10, 13, 16, 22, 31, 40, 52)")
def j1(spark, d):
    chosen = table(spark, d, "customer").where("c_mktsegment = 'AUTOMOBILE'").where(F.col("c_custkey").isin(1, 4, 7, 10, 13, 16, 22, 31, 40, 52))
    return table(spark, d, "orders").join(chosen, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("j2_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 150000)")
def j2(spark, d):
    hot = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 150000")
    return table(spark, d, "customer").join(hot, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j3_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j3(spark, d):
    return J.not_in(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders").where("o_orderstatus = 'P'"), "o_custkey").select("c_custkey")


@query("j4_property_default", "SELECT c_custkey, coalesce(v, '1') AS modes FROM customer LEFT JOIN (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 = 0) ON k = c_custkey")
def j4(spark, d):
    sites = table(spark, d, "customer").select("c_custkey")
    properties = table(spark, d, "customer").where("c_custkey % 3 = 0").select("c_custkey", F.lit("modes").alias("name"), F.col("c_mktsegment").alias("value"))
    return J.property_value(sites, "c_custkey", properties, "modes", F.lit("1"))


@query("j5_recrawl_period", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate < TIMESTAMP '2001-01-01' - INTERVAL 1 DAY * (c_nationkey * 30)")
def j5(spark, d):
    sites = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") * 30).alias("recrawl_days"))
    rows = table(spark, d, "orders").join(sites, F.col("o_custkey") == F.col("c_custkey"))
    return rows.where("o_orderdate < timestamp_ntz'2001-01-01 00:00:00' - make_interval(0, 0, 0, recrawl_days)").select("o_orderkey")


@query("j6_site_window", "SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders JOIN (SELECT o_custkey AS k, min(o_orderdate) AS a FROM orders GROUP BY 1) ON k = o_custkey WHERE o_orderdate BETWEEN a AND a + INTERVAL 365 DAY GROUP BY 1")
def j6(spark, d):
    o = table(spark, d, "orders")
    start = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"))
    return o.join(start, "o_custkey").where("o_orderdate between a and a + make_interval(0, 0, 0, 365)").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))


@query("j7_inner_templates", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'")
def j7(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region").where("r_name like 'A%'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("j8_longest_prefix", "WITH s AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+/', 0) AS prefix FROM pages WHERE page_id % 2 = 0 AND regexp_matches(url, '^https?://[^/]+/')) SELECT page_id, arg_max(prefix, strlen(prefix)) AS site FROM pages LEFT JOIN s ON starts_with(url, prefix) GROUP BY page_id")
def j8(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    sites = pages.where("page_id % 2 = 0").select(F.regexp_extract("url", "^https?://[^/]+/", 0).alias("prefix")).where("prefix <> ''").distinct().withColumn("site", F.col("prefix"))
    return J.longest_prefix(pages, "url", sites, "prefix", "site").select("page_id", "site")


@query("j9_attributes", "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(n, 0) AS n FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, count(*) AS n FROM labels GROUP BY 1) USING (doc_id)")
def j9(spark, d):
    out = J.with_lists(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels"), "attributes", ["quality", "toxic"], ["quality"])
    return out.select("doc_id", F.coalesce(F.array_max("attributes")["quality"], F.lit(-1)).alias("quality"), F.size("attributes").cast("long").alias("n"))


@query("j10_nested_site", "SELECT n_nationkey, coalesce(list_sort(list_distinct(list(s_suppkey) FILTER (s_suppkey IS NOT NULL))), []) AS proxies, count(DISTINCT c_custkey) AS sites FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def j10(spark, d):
    n = table(spark, d, "nation").select("n_nationkey")
    n = J.with_lists(n, "n_nationkey", table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "p", ["s_suppkey"], ["s_suppkey"])
    sites = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("sites"))
    return n.join(sites, "n_nationkey", "left").select("n_nationkey", F.expr("transform(p, x -> x.s_suppkey)").alias("proxies"), F.coalesce("sites", F.lit(0)).alias("sites"))


@query("j11_parent_lookup", "SELECT c.conv_id, c.turn, md5(p.text) AS parent FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def j11(spark, d):
    c = table(spark, d, "conversations")
    parent = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.md5("text").alias("parent"))
    return c.join(parent, ["conv_id", "turn"]).select("conv_id", "turn", "parent")


@query("j13_proxy_domains", "SELECT page_id, count(*) AS proxies FROM pages, (VALUES (1, 'com'), (2, 'net'), (3, '*'), (4, 'org')) p(id, dom) WHERE dom = '*' OR url LIKE '%example.' || dom || '/%' GROUP BY 1")
def j13(spark, d):
    proxies = spark.createDataFrame([(1, ["example\\.com/"]), (2, ["example\\.net/"]), (3, ["*"]), (4, ["example\\.org/"])], "id int, domains array<string>")
    rows = table(spark, d, "pages").select("page_id", "url").join(F.broadcast(proxies), F.expr("exists(domains, x -> x = '*' or url rlike x)"))  # a small rule table
    return rows.groupBy("page_id").agg(F.count("*").alias("proxies"))


@query("j14_set_difference", "SELECT md5(text) AS m, count(*) AS n FROM documents WHERE doc_id % 2 = 0 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 1 AND text IS NOT NULL) GROUP BY 1")
def j14(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.md5("text").alias("m"))
    return t.where("doc_id % 2 = 0").join(t.where("doc_id % 2 = 1"), "m", "left_anti").groupBy("m").agg(F.count("*").alias("n"))


@query("j15_chain_merge", "SELECT conv_id, role, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1, 2")
def j15(spark, d):
    return J.chained(table(spark, d, "conversations"), ["conv_id", "role"], "turn", "text")


@query("a1_recalculate", f"SELECT site_id, count(*) FILTER (crawled > 0 AND error_mask & 4198399 = 0) AS resources, count(*) FILTER (processed > 0) AS contents, count(*) AS collected_urls, count(*) FILTER (status = 1) AS new_urls, count(*) FILTER (error_mask > 0) AS errors, count(*) FILTER (state = 1) AS deleted_urls FROM {URLS} GROUP BY 1")
def a1(spark, d):
    return C.recalculated(url_rows(spark, d), "site_id")


@query("a1b_override", f"SELECT site_id, count(*) FILTER (CASE WHEN site_id % 10 = 0 THEN processed > 0 AND crawled > 0 ELSE processed > 0 END) AS contents FROM {URLS} GROUP BY 1")
def a1b(spark, d):
    override = F.when(F.col("site_id") % 10 == 0, F.expr("processed > 0 and crawled > 0")).otherwise(F.expr("processed > 0"))
    return C.recalculated(url_rows(spark, d), "site_id", {"contents": "true"}, {"contents": override})


@query("a2_cleanup_fields", f"SELECT site_id, CAST(sum(size) AS BIGINT) AS size, count(*) FILTER (error_mask > 0) AS errors, bit_or(error_mask) AS error_mask, avg(CASE WHEN crawling_time > 0 THEN size / crawling_time * 1000 END) AS avg_speed FROM {URLS} WHERE NOT (status = 4 AND crawled = 0) GROUP BY 1")
def a2(spark, d):
    return C.cleanup_fields(url_rows(spark, d).where(C.THIS_NODE), "site_id", "size", "error_mask", "crawling_time")


@query("a3_partition_recalc", f"SELECT site_id, count(*) FILTER (status = 1) AS new_urls, count(*) FILTER (error_mask > 0) AS errors FROM {URLS} GROUP BY 1")
def a3(spark, d):
    return C.recalculated(url_rows(spark, d), "site_id", {k: C.SITE_COUNTERS[k] for k in ("collected_urls", "new_urls", "errors")}, partition_only=True)


@query("a4_custom_sql", "SELECT CAST(sum(c_custkey) AS BIGINT) AS a, avg(c_acctbal) AS b, count(DISTINCT c_nationkey) AS n FROM customer")
def a4(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("sites")
    return spark.sql("SELECT sum(c_custkey) AS a, avg(c_acctbal) AS b, count(DISTINCT c_nationkey) AS n FROM sites")


@query("a5_window_stats", "SELECT o_custkey, count(*) AS n, max(o_orderdate) AS newest, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-01-01' GROUP BY 1")
def a5(spark, d):
    rows = table(spark, d, "orders").where("o_orderdate between timestamp_ntz'1997-01-01' and timestamp_ntz'1998-01-01'")
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("newest"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("a6_site_merge", "SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS l_quantity, max(l_linenumber) AS l_linenumber, bit_or(l_partkey) AS l_partkey, min(l_discount) AS l_discount FROM lineitem GROUP BY 1")
def a6(spark, d):
    return C.merged_sites(table(spark, d, "lineitem"), "l_orderkey", ["l_quantity"], ["l_linenumber"], ["l_partkey"], ["l_discount"])


@query("a8_running_mean", "SELECT o_custkey, avg(o_totalprice) AS avg_speed, count(*) AS avg_speed_counter FROM orders GROUP BY 1")
def a8(spark, d):
    state = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("avg_speed_counter"))
    return state.select("o_custkey", (F.col("s") / F.col("avg_speed_counter")).alias("avg_speed"), "avg_speed_counter")


@query("a9_modification_rate", "SELECT user_id, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS m_rate FROM events GROUP BY 1")
def a9(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)).alias("m_rate"))


@query("a10_operation_counts", "SELECT user_id, count(*) FILTER (event_type = 'view') AS f_view, count(*) FILTER (event_type = 'click') AS f_click, count(*) FILTER (event_type = 'error') AS f_error FROM events GROUP BY 1")
def a10(spark, d):
    return C.operation_counts(table(spark, d, "events"), ["user_id"], "event_type", {"f_view": "view", "f_click": "click", "f_error": "error"})


@query("a11_node_averages", "SELECT CAST(sum(l_partkey) // count(*) AS BIGINT) AS cpu, CAST(sum(l_suppkey) // count(*) AS BIGINT) AS io, min(l_shipdate) AS u_date FROM lineitem WHERE l_linestatus = 'O'")
def a11(spark, d):
    most = F.lit(2**63 - 1)
    mean = lambda c: F.coalesce(F.expr(f"sum({c}) div count(*)"), most)
    return table(spark, d, "lineitem").where("l_linestatus = 'O'").agg(mean("l_partkey").alias("cpu"), mean("l_suppkey").alias("io"), F.min("l_shipdate").alias("u_date"))


@query("a12_task_times", "SELECT event_type, min(value) AS low, max(value) AS high, sum(value) AS total, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1")
def a12(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"), F.count("*").alias("n"), F.avg("value").alias("mean"))


@query("a14_integrity", "SELECT hosts, count(*) AS items FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS hosts FROM lineitem GROUP BY 1) GROUP BY 1")
def a14(spark, d):
    return C.integrity(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("a15_duplicates", "SELECT md5(text) AS m, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def a15(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("m")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("a16_link_frequency", "SELECT link, count(DISTINCT url) AS freq FROM (SELECT url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) WHERE link <> url GROUP BY 1")
def a16(spark, d):
    pages = table(spark, d, "pages").select("url", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1).alias("links"))
    return C.link_frequency(pages, "url", "links")


@query("a17_tag_mask", "SELECT conv_id, bit_or(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 WHEN 'system' THEN 4 ELSE 8 END) AS tags_mask, count(*) FILTER (trim(text) <> '') AS tags_count FROM conversations GROUP BY 1")
def a17(spark, d):
    bit = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).when(F.col("role") == "system", 4).otherwise(8)
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.bit_or(bit).alias("tags_mask"), F.count_if(F.trim("text") != "").alias("tags_count"))


@query("a18_template_metrics", "SELECT conv_id, count(*) FILTER (text <> '') AS contents_count, CAST(sum(length(text)) AS BIGINT) AS contents_len FROM conversations GROUP BY 1")
def a18(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("text") != "").alias("contents_count"), F.sum(F.length("text")).alias("contents_len"))


@query("a19_fetched_counts", "SELECT count(*) AS total, count(DISTINCT l_orderkey) AS uniq FROM lineitem")
def a19(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("total"), F.count_distinct("l_orderkey").alias("uniq"))


@query("u1_union_all", "SELECT o_orderkey AS id FROM orders UNION ALL SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1")
def u1(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).unionByName(table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id")))


@query("u3_except_intersect", "SELECT 'except' AS kind, count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'both', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)")
def u3(spark, d):
    a, b = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(a.subtract(b), "except").unionAll(count(a.intersect(b), "both"))


@query("u5_array_distinct", "SELECT doc_id, len(list_distinct(string_split(lower(text), ' '))) AS n FROM documents")
def u5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.array_distinct(F.split(F.lower("text"), " "))).cast("long").alias("n"))
