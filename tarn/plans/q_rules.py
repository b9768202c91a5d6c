"""Rule filters over orders, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import rules as R
from tarn.plans.registry import query, table
from tarn.sources.tables import spread

RULES = "(VALUES (1, '1-URGENT', 0, 1, 1), (2, '5-LOW', 0, 1, -1), (3, '150000', 6, 2, 1), (4, '20000', 5, 2, -1)) r(rule_id, pattern, op_code, stage, action)"


def rules(spark):
    rows = [(1, "1-URGENT", 0, 1, 1, 0), (2, "5-LOW", 0, 1, -1, 0), (3, "150000", 6, 2, 1, 0), (4, "20000", 5, 2, -1, 0), (5, "never", 0, 1, 1, 1)]
    return R.loaded(spark.createDataFrame(rows, "rule_id int, pattern string, op_code int, stage int, action int, state int"))


@query("p7_rule_operations", "SELECT o_orderkey, regexp_matches(o_orderpriority, 'URG') AS re, o_custkey = 100 AS eq, o_custkey <> 100 AS ne, o_custkey <= 100 AS le, o_custkey >= 100 AS ge, o_custkey < 100 AS lt, o_custkey > 100 AS gt, false AS bad FROM orders")
def p7(spark, d):
    o, n = table(spark, d, "orders"), F.lit("100")
    ops = {"eq": 1, "ne": 2, "le": 3, "ge": 4, "lt": 5, "gt": 6}
    return o.select("o_orderkey", R.matched(F.col("o_orderpriority"), F.lit(0), F.lit("URG")).alias("re"), *[R.matched(F.col("o_custkey"), F.lit(c), n).alias(k) for k, c in ops.items()], R.matched(F.col("o_orderpriority"), F.lit(6), n).alias("bad"))


@query("p8_stage_evaluation", f"SELECT o_orderkey, list(CASE WHEN regexp_matches(o_orderpriority, pattern) THEN 1 ELSE 0 END ORDER BY rule_id) AS results FROM orders, {RULES} WHERE stage = 1 GROUP BY 1")
def p8(spark, d):
    return R.evaluated(table(spark, d, "orders"), "o_orderkey", rules(spark), F.col("o_orderpriority"), 1)


@query("p8b_all_rules", "SELECT o_orderkey, [CASE WHEN CAST(round(o_totalprice) AS BIGINT) > 150000 AND CAST(round(o_totalprice) AS BIGINT) < 20000 THEN 1 ELSE 0 END] AS results FROM orders")
def p8b(spark, d):
    rows = table(spark, d, "orders").withColumn("size", F.round("o_totalprice").cast("long"))
    return R.evaluated(rows, "o_orderkey", rules(spark), F.col("size"), 2, any_of=False)


@query("p9_decision", "SELECT o_orderkey, o_orderpriority = '1-URGENT' AS link_stage, o_orderpriority <> '5-LOW' AS dom_stage FROM orders")
def p9(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    link = R.decided(rows, "o_orderkey", rules(spark), F.col("o_orderpriority"), 1, default=False).withColumnRenamed("passes", "link_stage")
    return R.decided(link, "o_orderkey", rules(spark), F.col("o_orderpriority"), 1, default=True).select("o_orderkey", "link_stage", F.col("passes").alias("dom_stage"))


@query("p10_rule_loading", "SELECT o_orderkey AS rule_id, unnest([o_orderpriority, o_orderstatus]) AS pattern FROM orders WHERE o_orderkey % 3 <> 0")
def p10(spark, d):
    lines = F.concat("o_orderpriority", F.lit("\r\n\r\n"), "o_orderstatus", F.lit("\r\n"))
    state = F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, 0)
    return R.loaded(table(spark, d, "orders").select(F.col("o_orderkey").alias("rule_id"), lines.alias("pattern"), state.alias("state"))).select("rule_id", "pattern")


@query("p12_date_macros", "SELECT o_orderkey, 'http://x/' || strftime(o_orderdate, '%Y') || '/' || strftime(o_orderdate - INTERVAL 3 HOUR, '%m-%d') || '?h=' || strftime(o_orderdate + INTERVAL 5 HOUR, '%H') AS url FROM orders")
def p12(spark, d):
    text = F.lit("http://x/%@YEAR%/%@MONTH(-3)%-%@DAY(-3)%?h=%@HOUR(+5)%")
    return table(spark, d, "orders").select("o_orderkey", R.date_macros(text, F.col("o_orderdate")).alias("url"))


@query("p13_sql_predicate", "SELECT o_orderkey FROM orders WHERE CAST(o_totalprice > 100000 AND o_orderstatus = 'O' AS INT) > 0")
def p13(spark, d):
    return table(spark, d, "orders").where(F.expr("cast(o_totalprice > 100000 AND o_orderstatus = 'O' as int)") > 0).select("o_orderkey")


@query("p15_pattern_dates", "SELECT page_id, CASE WHEN regexp_matches(url, '/de/') THEN TIMESTAMP '2024-02-01' WHEN regexp_matches(url, '/en/') THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2000-01-01' END AS p_date FROM pages")
def p15(spark, d):
    ts = lambda s: F.expr(f"timestamp_ntz'{s} 00:00:00'")
    return table(spark, d, "pages").select("page_id", R.last_match(F.col("url"), [("/en/", ts("2024-01-01")), ("/de/", ts("2024-02-01"))], ts("2000-01-01")).alias("p_date"))


@query("p16_content_replace", "SELECT doc_id, CASE WHEN lang = 'en' THEN regexp_replace(text, '(the) (of)', '\\2 \\1', 'g') ELSE text END AS text FROM documents")
def p16(spark, d):
    return table(spark, d, "documents").select("doc_id", R.replaced(F.col("text"), [(F.col("lang") == "en", "(the) (of)", r"\2 \1")]).alias("text"))


@query("p17_anchored_match", "SELECT page_id FROM pages WHERE regexp_matches(url, '^(?:https://m\\.)')")
def p17(spark, d):
    return table(spark, d, "pages").where(R.condition("url match https://m\\.", {"url": F.col("url")})).select("page_id")


@query("p18_condition_language", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN regexp_matches(o_orderpriority, 'HIGH|URGENT') THEN 'hot' ELSE 'rest' END AS kind FROM orders")
def p18(spark, d):
    fields = {"url.status": F.col("o_orderstatus"), "url.priority": F.col("o_orderpriority")}
    kinds = [("url.status == O", F.lit("open")), ("url.priority search HIGH|URGENT", F.lit("hot")), ("url.status is empty", F.lit("none"))]
    return table(spark, d, "orders").select("o_orderkey", R.first_true(kinds, fields, F.lit("rest")).alias("kind"))


@query("p21_tag_validators", "SELECT doc_id, list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '^t') AND NOT regexp_matches(x, 'tion')) AS tags FROM documents")
def p21(spark, d):
    return validated_tags(spread(table(spark, d, "documents").select("doc_id", "text")))


def validated_tags(docs):
    return docs.select("doc_id", R.kept_by_regex(F.split("text", " "), "^t", "tion").alias("tags"))


@query("p22_existence", "SELECT c_custkey, CASE WHEN last IS NULL THEN 0 WHEN last < TIMESTAMP '2001-08-01' - INTERVAL 1 DAY * (c_nationkey * 20) THEN 2 ELSE 1 END AS seen FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def p22(spark, d):
    known = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("at"))
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return R.existing(rows, known, ["c_custkey"], F.col("c_nationkey") * 20, F.expr("timestamp_ntz'2001-08-01 00:00:00'"), "at").select("c_custkey", "seen")
