"""Selection queries. Roles: customer = sites, orders = urls, supplier = nodes or proxies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import select as S
from tarn.operators.criteria import Criterion, per_site_criterion, project
from tarn.plans.registry import query, table

SITES = "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0"
SITE_ORDER = "c_acctbal DESC, c_custkey ASC"


def sites(spark: SparkSession, d: str) -> DataFrame:
    return Criterion(where="c_mktsegment = 'BUILDING' AND c_acctbal > 0").apply(table(spark, d, "customer"))


def urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")



def site_order():
    return [F.col("c_acctbal").desc(), F.col("c_custkey").asc()]


@query(
    "w1_proportional_fetch",
    f"""WITH s AS ({SITES}), r AS (SELECT o_orderkey, o_custkey, o_orderdate, c_acctbal, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders JOIN s ON o_custkey = c_custkey WHERE o_orderstatus = 'O')
SELECT o_orderkey, o_custkey AS site_id, rn, CAST((rn - 1) // greatest(500 // (SELECT count(*) FROM s), 1) AS BIGINT) AS page FROM r ORDER BY page, c_acctbal DESC, o_custkey, rn LIMIT 500""",
)
def w1(spark, d):
    open_urls = Criterion(where="o_orderstatus = 'O'").apply(urls(spark, d))
    out = S.proportional_fetch(open_urls, sites(spark, d), "c_custkey", site_order(), [F.col("o_orderdate"), F.col("o_orderkey")], 500)
    return out.select("o_orderkey", F.col("c_custkey").alias("site_id"), F.col("rn").cast("long"), F.col("page").cast("long"))


@query(
    "w2_simple_fetch",
    f"""WITH s AS ({SITES}), r AS (SELECT o_orderkey, o_custkey, c_acctbal, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders JOIN s ON o_custkey = c_custkey)
SELECT o_orderkey, o_custkey AS site_id, rn FROM r WHERE rn <= 3 ORDER BY c_acctbal DESC, o_custkey, rn LIMIT 300""",
)
def w2(spark, d):
    out = S.simple_fetch(urls(spark, d), sites(spark, d), "c_custkey", site_order(), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, 300)
    return out.select("o_orderkey", F.col("c_custkey").alias("site_id"), F.col("rn").cast("long"))


@query("w3_default_order", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate ASC, o_orderkey LIMIT 250 OFFSET 50")
def w3(spark, d):
    c = Criterion.of({"WHERE": "o_orderpriority == '1-URGENT'", "ORDER BY": "o_orderdate ASC, o_orderkey", "LIMIT": "50, 250"})
    return c.apply(table(spark, d, "orders")).select("o_orderkey", "o_orderdate")


@query("w4_gather_sort", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus IN ('P','F') ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def w4(spark, d):
    parts = [table(spark, d, "orders").where(F.col("o_orderstatus") == s) for s in ("P", "F")]
    return Criterion(order_by="o_totalprice DESC, o_orderkey", limit=100).apply(parts[0].unionByName(parts[1])).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("w5_metric_sort", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 300")
def w5(spark, d):
    return S.metric_sorted(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality"), "quality", "doc_id").limit(300)


@query("w6_metric_range", "SELECT doc_id, n_chars FROM documents WHERE n_chars >= 500 AND n_chars <= 2000")
def w6(spark, d):
    return S.metric_range(table(spark, d, "documents"), "n_chars", 500, 2000).select("doc_id", "n_chars")


@query("w7_content_check", "SELECT doc_id, (n_chars >= 200 AND array_length(string_split(text, ' ')) >= 50) AS both_ok, (n_chars >= 5000 OR array_length(string_split(text, ' ')) >= 900) AS any_ok FROM documents")
def w7(spark, d):
    t = table(spark, d, "documents").withColumn("words", F.size(F.split("text", " ")))
    rules = [(F.col("n_chars"), 200, 5000), (F.col("words"), 50, 900)]
    return t.select("doc_id", (rules[0][0] >= rules[0][1]).__and__(rules[1][0] >= rules[1][1]).alias("both_ok"), ((rules[0][0] >= rules[0][2]) | (rules[1][0] >= rules[1][2])).alias("any_ok"))


@query("w8_url_limits", "SELECT o_orderkey, o_custkey, rn FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn > 2 AND rn <= 5")
def w8(spark, d):
    return S.page_of(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 2, 3).select("o_orderkey", "o_custkey", F.col("rn").cast("long"))


@query("w9_pattern_limits", "SELECT o_orderpriority, count(*) AS n FROM (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= CASE WHEN o_orderpriority LIKE '%URGENT' THEN 5 WHEN o_orderpriority LIKE '%HIGH' THEN 2 ELSE 1 END GROUP BY 1")
def w9(spark, d):
    limits = [("HIGH$", 2), ("URGENT$", 5)]  # the last matching rule wins
    cap = F.lit(1)
    for pattern, n in limits:
        cap = F.when(F.col("o_orderpriority").rlike(pattern), n).otherwise(cap)
    rows = S.page_of(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], [F.col("o_orderkey")], 0, 5)
    return rows.where(F.col("rn") <= cap).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "w10_caps",
    """SELECT l_orderkey, l_linenumber, CASE WHEN rn = 3 AND n > 3 THEN 256 ELSE 0 END AS error_mask FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE rn <= 3""",
)
def w10(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0).alias("error_mask"))
    return S.capped(rows, ["l_orderkey"], [F.col("l_linenumber")], 3, 256)


@query("w10b_size_cap", "SELECT o_orderkey, running FROM (SELECT o_orderkey, sum(CAST(round(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM orders) WHERE running <= 300000")
def w10b(spark, d):
    rows = table(spark, d, "orders").withColumn("size", F.round("o_totalprice").cast("long"))
    return S.within_size(rows, ["o_custkey"], [F.col("o_orderkey")], "size", 300000).select("o_orderkey", "running")


@query("w11_auto_remove", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1000)")
def w11(spark, d):
    _, rest = S.split_top(table(spark, d, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")], 1000, "o_orderkey")
    return rest.select("o_orderkey")


@query("w12_aging", "SELECT o_orderkey, o_custkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-01') WHERE rn <= 2 ORDER BY rn, o_custkey LIMIT 400")
def w12(spark, d):
    old = Criterion(where="o_orderdate < DATE_SUB(NOW(), INTERVAL 5 YEAR)", now="2002-06-01 00:00:00").apply(table(spark, d, "orders"))
    return S.two_level(old, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], 2, 400).select("o_orderkey", "o_custkey", F.col("rn").cast("long"))


@query("w13_purge_slice", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey LIMIT 40 OFFSET 10)")
def w13(spark, d):
    return S.site_slice(table(spark, d, "orders"), "o_custkey", 10, 40).select("o_orderkey", "o_custkey")


@query("w14_lowest_frequency", "SELECT s_nationkey, s_suppkey, freq FROM (SELECT s_nationkey, s_suppkey, f * (s_suppkey % 3 + 1) AS freq, row_number() OVER (PARTITION BY s_nationkey ORDER BY f * (s_suppkey % 3 + 1), s_suppkey) AS rn FROM supplier JOIN (SELECT l_suppkey, count(*) AS f FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey) WHERE rn = 1")
def w14(spark, d):
    used = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("f"))
    return S.lowest_used(table(spark, d, "supplier").join(used, "s_suppkey"), ["s_nationkey"], "s_suppkey", F.col("f") * (F.col("s_suppkey") % 3 + 1))


@query("w15_due_tasks", "SELECT o_orderkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus = 'O' ORDER BY o_orderdate, CAST(o_orderpriority[1:1] AS INT) DESC, o_custkey DESC, o_orderkey LIMIT 50")
def w15(spark, d):
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("r_time"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("state"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_custkey").alias("tries"))
    return S.due_tasks(tasks, F.expr("timestamp_ntz'1996-01-01 00:00:00'"), 1, 50).select("id")


@query("w16_time_slots", "SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 AS slot, count(*) AS n FROM events GROUP BY 1")
def w16(spark, d):
    return S.slot_counts(table(spark, d, "events"), "ts", 3600)


@query("w17_best_template", "SELECT doc_id % 50 AS domain, arg_max(lang, (n_chars, -doc_id)) AS template, max(n_chars) AS score FROM documents WHERE n_chars > 100 GROUP BY 1")
def w17(spark, d):
    t = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("domain"), F.col("lang").alias("template"), F.col("n_chars").alias("contents_count"), F.col("n_chars").alias("contents_len"), F.col("doc_id").alias("pos"), (F.col("n_chars") <= 100).alias("mandatory_empty"))
    return S.best_template(t, ["domain"])


@query("w19_best_value", "SELECT source, max(text) AS best FROM documents GROUP BY source")
def w19(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.max_by("text", "text").alias("best"))


@query("w20_rank_order", "SELECT o_custkey, coalesce(max(CASE WHEN o_orderstatus='O' THEN o_orderkey END), max(CASE WHEN o_orderstatus='P' THEN o_orderkey END), max(o_orderkey)) AS filled FROM orders GROUP BY 1")
def w20(spark, d):
    pick = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.coalesce(pick("O"), pick("P"), F.max("o_orderkey")).alias("filled"))


@query("p1_criterion", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice > 200000) AND (o_orderdate >= TIMESTAMP '1996-01-01')")
def p1(spark, d):
    c = Criterion(where="`o_orderstatus`=='O' OR o_totalprice > 200000", now="1996-06-01 00:00:00")
    return c.apply(table(spark, d, "orders"), extra="o_orderdate >= DATE_SUB(NOW(), INTERVAL 152 DAY)").select("o_orderkey")


@query("p2_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders WHERE o_orderstatus = 'F')")
def p2(spark, d):
    o = table(spark, d, "orders")
    mean = o.where("o_orderstatus = 'F'").agg(F.avg("o_totalprice").alias("m"))
    return Criterion(where="o_totalprice > %mean%", sql={"mean": mean}).apply(o).select("o_orderkey")


@query("p2b_site_override", "SELECT o_orderkey FROM orders WHERE CASE WHEN o_custkey = 1 THEN o_totalprice > 0 WHEN o_custkey = 4 THEN o_totalprice < 50000 ELSE o_orderstatus = 'P' END")
def p2b(spark, d):
    o = table(spark, d, "orders").withColumn("site_id", F.col("o_custkey").cast("string"))
    return o.where(per_site_criterion("o_orderstatus = 'P'", {"1": "o_totalprice > 0", "4": "o_totalprice < 50000"})).select("o_orderkey")


@query("p3_extra_tables", "SELECT o_orderkey, o_custkey FROM orders, customer WHERE o_custkey = c_custkey AND c_mktsegment = 'MACHINERY' AND o_totalprice > c_acctbal * 30")
def p3(spark, d):
    c = Criterion(where="o_custkey = sites.c_custkey AND sites.c_mktsegment = 'MACHINERY' AND o_totalprice > sites.c_acctbal * 30", tables={"sites": table(spark, d, "customer")})
    return c.apply(table(spark, d, "orders")).select("o_orderkey", "o_custkey")


@query("p4_projection", "SELECT doc_id, coalesce(lang, 'xx') AS lang, CAST(NULL AS VARCHAR) AS charset FROM documents")
def p4(spark, d):
    return project(table(spark, d, "documents"), {"doc_id": None, "lang": "xx", "charset": None}, keep_defaults=True).withColumn("charset", F.col("charset").cast("string"))


@query("p5_content_mask", "SELECT doc_id, CASE WHEN doc_id % 4 & 1 <> 0 THEN md5(text) END AS raw, CASE WHEN doc_id % 4 & 2 <> 0 THEN lang END AS processed FROM documents")
def p5(spark, d):
    mask = F.col("doc_id") % 4
    return table(spark, d, "documents").select("doc_id", F.when(mask.bitwiseAND(1) != 0, F.md5("text")).alias("raw"), F.when(mask.bitwiseAND(2) != 0, F.col("lang")).alias("processed"))


@query("p14_computed_fields", "SELECT o_orderkey, CAST(round(o_totalprice * 1.1, 0) AS BIGINT) AS o_totalprice, concat(o_orderstatus, '-', o_orderpriority) AS o_orderstatus FROM orders")
def p14(spark, d):
    fields = {"o_totalprice": ("round(o_totalprice * 1.1, 0)", "long"), "o_orderstatus": ("concat(o_orderstatus, '-', o_orderpriority)", "string")}
    return table(spark, d, "orders").withColumns({k: F.expr(e).cast(t) for k, (e, t) in fields.items()}).select("o_orderkey", *fields)


@query("q_sql_functions", "SELECT o_orderkey, year(o_orderdate) * 100 + month(o_orderdate) AS ym, o_orderkey // 7 AS q, strlen(o_orderpriority) AS n, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS s, CAST(epoch(o_orderdate + INTERVAL 90 MINUTE) AS BIGINT) AS later FROM orders")
def q_sql(spark, d):
    from tarn.operators.criteria import to_spark

    fields = {"ym": "cast(DATE_FORMAT(o_orderdate, '%Y%m') as bigint)", "q": "o_orderkey DIV 7", "n": "LENGTH(o_orderpriority)", "s": "IF(o_totalprice > 100000, 'big', 'small')", "later": "unix_timestamp(cast(DATE_ADD(o_orderdate, INTERVAL 90 MINUTE) as timestamp))"}
    return table(spark, d, "orders").select("o_orderkey", *[F.expr(to_spark(e)).alias(k) for k, e in fields.items()])
