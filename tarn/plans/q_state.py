"""State transitions. Roles: orders = urls, customer = sites, labels = attributes, events = operation log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import merge as M
from tarn.operators import state as S
from tarn.plans.registry import query, table

NOW = "timestamp_ntz'2002-01-01 00:00:00'"


def now():
    return F.expr(NOW)


def urls(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 7).otherwise(2)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("url_md5"), F.col("o_custkey").alias("site_id"), status.alias("status"), F.lit(0).alias("state"), F.col("o_orderdate").alias("u_date"), F.col("o_orderdate").alias("tc_date"), F.col("o_orderpriority").alias("priority"))


URLS = "(SELECT o_orderkey AS url_md5, o_custkey AS site_id, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 7 ELSE 2 END AS status, 0 AS state, o_orderdate AS u_date, o_orderdate AS tc_date, o_orderpriority AS priority FROM orders)"


@query("m1_insert", "SELECT md5(text) AS k, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def m1(spark, d):
    t = table(spark, d, "documents").select(F.md5("text").alias("k"), "doc_id")
    out, _ = S.inserted(t.limit(0), t, ["k"], [F.col("doc_id")])
    return out


@query("m1b_insert_status", "SELECT doc_id, CASE WHEN md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id < 100 AND text IS NOT NULL) THEN 1 ELSE 0 END AS status FROM documents WHERE doc_id >= 100")
def m1b(spark, d):
    t = table(spark, d, "documents").select(F.md5("text").alias("k"), "doc_id")
    _, status = S.inserted(M.first_wins(t.where("doc_id < 100"), ["k"], [F.col("doc_id")]), t.where("doc_id >= 100"), ["k"], [F.col("doc_id")])
    return status.select("doc_id", "status")


@query("m2_site_update", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def m2(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    change = t.where("c_custkey % 3 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    return S.updated(t, change, ["c_custkey"])


@query("m2b_overwrite", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (1, 2) UNION ALL SELECT -s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (1, 2) AND s_suppkey % 2 = 0 UNION ALL SELECT -1000000 - n, n FROM (VALUES (1), (2)) v(n)")
def m2b(spark, d):
    t = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    new = t.where("s_nationkey in (1, 2) and s_suppkey % 2 = 0").select((-F.col("s_suppkey")).alias("s_suppkey"), "s_nationkey").unionAll(spark.createDataFrame([(-1000001, 1), (-1000002, 2)], "s_suppkey long, s_nationkey int"))
    return S.overwritten(t, new, "s_nationkey")


@query("m2c_restart", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 6 ELSE 5 END AS iterations, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_nationkey END AS errors FROM customer")
def m2c(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.lit(5).alias("iterations"), F.col("c_nationkey").cast("long").alias("errors"), F.lit(3).cast("long").alias("error_mask"), F.lit(2).alias("state"))
    return S.restarted(t, F.col("c_mktsegment") == "BUILDING").select("c_custkey", "iterations", "errors")


@query("m3_site_status", "SELECT c_custkey, count(o_orderkey) AS urls, count(o_orderkey) FILTER (o_orderstatus = 'O') AS new_urls FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'HOUSEHOLD' GROUP BY 1")
def m3(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("urls"), F.count_if(F.col("o_orderstatus") == "O").alias("new_urls"))
    sites = table(spark, d, "customer").where("c_mktsegment = 'HOUSEHOLD'").select("c_custkey")
    return sites.join(counts, "c_custkey", "left").na.fill(0)


@query("m5_url_new_defaults", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, c_mktsegment) AS p FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def m5(spark, d):
    u = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("p"))
    return S.with_site_defaults(u, table(spark, d, "customer"), "c_custkey", {"p": "c_mktsegment"}).select("o_orderkey", "p")


@query("m6_url_update", f"SELECT url_md5, CASE WHEN priority = '5-LOW' THEN 4 ELSE status END AS status, CASE WHEN priority = '5-LOW' THEN TIMESTAMP '2002-01-01' ELSE u_date END AS u_date FROM {URLS}")
def m6(spark, d):
    return S.updated_where(urls(spark, d), F.col("priority") == "5-LOW", {"status": F.lit(4), "u_date": now()}).select("url_md5", "status", "u_date")


@query("m7_url_delete", f"SELECT url_md5, status = 7 AS moved, CASE WHEN status = 7 THEN TIMESTAMP '2002-01-01' ELSE tc_date END AS tc_date FROM {URLS}")
def m7(spark, d):
    u = urls(spark, d)
    c = S.deleted(u, u.limit(0), F.col("status") == 7, now())
    return c.table.select("url_md5", F.lit(False).alias("moved"), "tc_date").unionAll(c.moved.select("url_md5", F.lit(True), "tc_date"))


@query("m8_url_cleanup", f"SELECT url_md5, CASE WHEN status = 7 THEN 1 ELSE status END AS status, CASE WHEN status = 7 THEN u_date - INTERVAL 3600 SECOND ELSE u_date END AS u_date FROM {URLS}")
def m8(spark, d):
    return S.cleaned(urls(spark, d), F.col("status") == 7, 0, 1, now(), F.lit(3600)).select("url_md5", "status", "u_date")


@query("m9_purge", f"WITH t AS (SELECT * FROM {URLS} WHERE status = 7), o AS (SELECT url_md5 FROM t ORDER BY u_date, url_md5 LIMIT 100) SELECT 'left' AS side, url_md5 FROM t WHERE url_md5 NOT IN (SELECT url_md5 FROM o) UNION ALL SELECT 'contents', url_md5 FROM o")
def m9(spark, d):
    u = urls(spark, d)
    left, contents = S.purged(u.where("status = 7"), u.where("status <> 7"), "url_md5", "tc_date", [F.col("u_date"), F.col("url_md5")], 100)
    return left.select(F.lit("left").alias("side"), "url_md5").unionAll(contents.select(F.lit("contents"), "url_md5"))


@query("m11_url_status", f"SELECT url_md5, status FROM {URLS} WHERE url_md5 IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def m11(spark, d):
    wanted = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("url_md5"))
    return urls(spark, d).join(wanted, "url_md5", "left_semi").select("url_md5", "status")


@query("m12_latest_content", "SELECT o_custkey, o_orderpriority AS body FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def m12(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_orderpriority").alias("body"))
    return S.latest(rows, ["o_custkey"], "at").select("o_custkey", "body")


@query("s7_raw_contents", "SELECT l_orderkey, min(l_shipdate) AS first, max(l_shipdate) AS last, count(*) AS n FROM lineitem GROUP BY 1")
def s7(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("ctime"), F.col("l_shipdate").alias("body"))
    keys = ["l_orderkey"]
    out = S.raw_content(rows, keys, "first").withColumnRenamed("body", "first").join(S.raw_content(rows, keys, "last").withColumnRenamed("body", "last"), keys)
    return out.join(S.raw_content(rows, keys, "all").select("l_orderkey", F.size("body").cast("long").alias("n")), keys)


@query("m14_history", "SELECT event_id, user_id FROM events WHERE event_type IN ('error', 'view') AND user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)")
def m14(spark, d):
    log = table(spark, d, "events").where("event_type in ('error', 'view')")
    return log.join(table(spark, d, "customer").where("c_nationkey = 5"), F.col("user_id") == F.col("c_custkey"), "left_semi").select("event_id", "user_id")


@query("m15_attributes", "SELECT doc_id, max(CASE WHEN doc_id % 4 = 0 THEN 9 ELSE quality END) AS quality FROM labels GROUP BY 1")
def m15(spark, d):
    t = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return M.upsert(t, t.where("doc_id % 4 = 0").withColumn("quality", F.lit(9)), ["doc_id"])


@query("m16_proxy_find", "SELECT s_suppkey, s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1 AND s_acctbal > 0")
def m16(spark, d):
    nation = table(spark, d, "nation").where("n_regionkey = 1")
    return table(spark, d, "supplier").where("s_acctbal > 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey", "s_nationkey")


@query("m18_sql_custom", "SELECT o_custkey, count(*) AS n, 2 AS rejected FROM orders GROUP BY 1")
def m18(spark, d):
    """Custom statements on a table: the rows of the first; of the others one is rejected and one fails."""
    from tarn.operators.criteria import sql_custom

    table(spark, d, "orders").createOrReplaceTempView("tarn_urls")
    got = sql_custom(spark, ["SELECT o_custkey, count(*) AS n FROM tarn_urls GROUP BY o_custkey", "DROP TABLE tarn_urls", "SELECT nothing FROM tarn_urls"])
    return got[0].withColumn("rejected", F.lit(sum(isinstance(x, str) for x in got)))


@query("m21_fetch_and_mark", f"SELECT url_md5, CASE WHEN url_md5 IN (SELECT url_md5 FROM {URLS} WHERE status = 1 ORDER BY u_date, url_md5 LIMIT 200) THEN 2 ELSE status END AS status FROM {URLS}")
def m21(spark, d):
    u = urls(spark, d)
    _, out = S.marked(u, u.where("status = 1").orderBy("u_date", "url_md5").limit(200), "url_md5", 2, now())
    return out.select("url_md5", "status")


@query("m22_log", "SELECT site_id, op_code, count(*) AS n FROM (SELECT o_custkey AS site_id, 22 AS op_code FROM orders WHERE o_custkey % 5 = 0) GROUP BY 1, 2")
def m22(spark, d):
    log = S.logged(urls(spark, d), "site_id", "url_md5", "update", now())
    on = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("site_id"), F.lit("STATS_LOG").alias("name"), F.lit("1").alias("value"))
    return S.log_enabled(log, on).groupBy("site_id", "op_code").agg(F.count("*").alias("n"))


@query("m23_recrawl", "SELECT id, recrawl_date + INTERVAL 1 MINUTE * (greatest(ceil((epoch(TIMESTAMP '2002-01-01') - epoch(recrawl_date)) / (period * 60)), 1) * period)::INT AS next, CASE WHEN id % 2 = 0 THEN least(period + 30, 5000) ELSE greatest(period - 30, 60) END AS tuned FROM (SELECT o_custkey AS id, max(o_orderdate) AS recrawl_date, (o_custkey % 7 + 1) * 1440 AS period FROM orders GROUP BY 1)")
def m23(spark, d):
    sites = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("recrawl_date")).withColumn("period", (F.col("id") % 7 + 1) * 1440)
    return sites.select("id", S.next_recrawl(F.col("recrawl_date"), F.col("period"), now()).alias("next"), S.tuned_period(F.col("period"), (F.col("id") + 1) % 2, 30, 60, 5000).alias("tuned"))


@query("m24_stuck", f"SELECT url_md5, CASE WHEN url_md5 IN (SELECT url_md5 FROM {URLS} WHERE status IN (2, 3, 5, 6) AND u_date < TIMESTAMP '2002-01-01' - INTERVAL 60 MINUTE ORDER BY u_date, url_md5 LIMIT 500) THEN 1 ELSE status END AS status FROM {URLS}")
def m24(spark, d):
    return S.returned(urls(spark, d), now(), 60, 500, [F.col("u_date"), F.col("url_md5")], "url_md5").select("url_md5", "status")


@query("m25_quota", "SELECT c_custkey, greatest(CAST(ceil(c_nationkey / 4.0) AS BIGINT), 1) AS q FROM customer")
def m25(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.node_quota(F.col("c_nationkey"), 4).alias("q"))


@query("m27_cache", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2002-01-01' - INTERVAL 31536000 SECOND")
def m27(spark, d):
    t = table(spark, d, "orders")
    return S.cached(t.where("o_orderkey % 2 = 0"), t.where("o_orderkey % 3 = 0 or o_orderkey % 2 = 1"), ["o_orderkey"], "o_orderdate", now(), 31536000).select("o_orderkey")
