"""Runtime tables, search, sources and streams. Roles: orders = tasks, supplier = nodes, events = log stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import runtime as E
from tarn.operators import search as Z
from tarn.plans.registry import query, table
from tarn.sources import tables as T
from tarn.streaming import loops as G


def tasks(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("started"))


@query("e1_task_status", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'backlog' ELSE 'log' END AS side FROM orders")
def e1(spark, d):
    t = tasks(spark, d)
    return E.task_status(t.where("id % 2 = 0").withColumn("side", F.lit("backlog")), t.withColumn("side", F.lit("log")), t.select("id")).select("id", "side")


@query("e2_status_filters", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 50000 AND o_orderdate >= TIMESTAMP '1998-01-01'")
def e2(spark, d):
    return E.between_filters(table(spark, d, "orders"), {"o_totalprice": (1000, 50000), "o_orderdate": (F.expr("timestamp_ntz'1998-01-01'"), None)}).select("o_orderkey")


@query("e4_state_guard", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'finished' WHEN o_orderkey % 3 = 1 THEN 'in_progress' ELSE 'planned' END AS state FROM orders")
def e4(spark, d):
    k = F.col("o_orderkey") % 3
    old = F.when(k == 0, "finished").when(k == 1, "planned").otherwise("new")
    new = F.when(k == 0, "planned").when(k == 1, "in_progress").otherwise("planned")
    return table(spark, d, "orders").select("o_orderkey", E.guarded(old, new).alias("state"))


@query("e5_archive", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'log' ELSE 'backlog' END AS side, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '2002-01-01' END AS finished FROM orders")
def e5(spark, d):
    t, none = tasks(spark, d), F.lit(None).cast("timestamp_ntz")
    backlog, log = E.archived(t, t.limit(0).withColumn("finished", none), t.where("state = 'F'").select("id"), F.expr("timestamp_ntz'2002-01-01'"))
    return backlog.select("id", F.lit("backlog").alias("side"), none.alias("finished")).unionAll(log.select("id", F.lit("log"), "finished"))


@query("e6_cleanup", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' OR o_orderdate + INTERVAL 86400 SECOND < TIMESTAMP '1997-01-01'")
def e6(spark, d):
    t = tasks(spark, d).withColumn("cleanup_state", F.lit("P")).withColumn("ttl", F.lit(86400))
    return E.to_clean(t, F.expr("timestamp_ntz'1997-01-01'")).select("id")


@query("e8_node_metrics", "SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS cpu, 'b' || s_suppkey AS ram FROM supplier")
def e8(spark, d):
    text = F.concat(F.lit("[cpu] "), F.col("s_nationkey"), F.lit(" 5\n[ram] a b"), F.col("s_suppkey"))
    m = E.metric_sections(text, ["cpu", "ram"])
    return table(spark, d, "supplier").select("s_suppkey", m["cpu"][0].alias("cpu"), m["ram"][1].alias("ram"))


@query("e9_cluster_nodes", "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'router' ELSE 'replica' END AS role, s_name AS host, CAST(unnest([s_suppkey, s_suppkey + 1000]) AS INT) AS port FROM supplier")
def e9(spark, d):
    """A description of a cluster for each nation, its suppliers the nodes."""
    node = F.struct(F.when(F.col("s_suppkey") % 3 == 0, "router").otherwise("replica").alias("role"), F.col("s_name").alias("host"), F.array("s_suppkey", F.col("s_suppkey") + 1000).alias("ports"))
    text = F.to_json(F.struct(F.struct(F.collect_list(node).alias("nodes")).alias("cluster")))
    return E.cluster_nodes(table(spark, d, "supplier").groupBy("s_nationkey").agg(text.alias("s")), "s")


@query("e10_url_sync", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus <> 'F') AS a FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) ON k = o_custkey WHERE o_orderkey % 2 = 1 AND c_nationkey <= 12 AND coalesce(a, 0) < 3")
def e10(spark, d):
    u = table(spark, d, "orders").select(F.col("o_custkey").alias("site_id"), F.col("o_orderkey").alias("url_md5"), "o_orderstatus")
    sites = table(spark, d, "customer").select(F.col("c_custkey").alias("site_id"), F.lit(1).alias("state"), F.lit(12).alias("max_errors"), F.col("c_nationkey").alias("errors"), F.lit(3).alias("max_urls"))
    out = E.synced(u.where("url_md5 % 2 = 0"), u.where("url_md5 % 2 = 1"), sites, "site_id", F.col("o_orderstatus") != "F")
    return out.select(F.col("url_md5").alias("o_orderkey"))


@query("e12_url_wrap", "SELECT page_id, 'http://p/?u=' || url AS a FROM pages")
def e12(spark, d):
    from tarn.functions.urls import wrapped

    return table(spark, d, "pages").select("page_id", wrapped(F.col("url"), "http://p/?u=%URL%").alias("a"))


@query("e13_batch_split", "SELECT o_orderkey % 3 AS node, count(*) AS n FROM orders GROUP BY 1")
def e13(spark, d):
    return table(spark, d, "orders").groupBy(E.node_of(F.col("o_orderkey"), 3).alias("node")).agg(F.count("*").alias("n"))


@query("e14_chains", "SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f FROM orders GROUP BY 1")
def e14(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.md5(F.col("o_orderkey").cast("string")).alias("url_md5"), "o_orderstatus")
    chains = o.groupBy("o_custkey").agg(F.concat_ws("\n", F.collect_list("url_md5")).alias("items"))
    out = E.chain_items(chains, "items", "o_custkey", o.select("url_md5", "o_orderstatus"))
    return out.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("f"))


@query("e15_site_gates", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 3 <> 2 AND (c_nationkey <= 10 OR o_orderkey % 2 > 0)")
def e15(spark, d):
    items = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("site_id"), (F.col("o_orderkey") % 2).alias("processed"))
    sites = table(spark, d, "customer").select(F.col("c_custkey").alias("site_id"), (F.col("c_nationkey") % 3).alias("state"), F.col("c_nationkey").alias("contents"), F.lit(10).alias("max_resources"))
    return E.processable(items, sites, "site_id").select("o_orderkey")


@query("e17_link_resolver", "SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE w WHEN 'the' THEN 'THE' WHEN 'of' THEN 'OF' ELSE w END), ' ') AS text FROM documents")
def e17(spark, d):
    redirects = spark.createDataFrame([("the", "THE"), ("of", "OF")], "source string, target string")
    return E.resolved_links(table(spark, d, "documents").select("doc_id", "text"), "text", " ", redirects)


@query("e18_differences", "SELECT c_custkey, 'left' AS side FROM customer WHERE c_custkey % 10 = 0 AND c_custkey <> 0 UNION ALL SELECT -c_custkey, 'right' FROM customer WHERE c_custkey % 10 = 0 AND c_custkey <> 0")
def e18(spark, d):
    a = table(spark, d, "customer").select("c_custkey", "c_name")
    b = a.withColumn("c_custkey", F.when(F.col("c_custkey") % 10 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey")))
    return E.differences(a, b, ignore=["c_name"])


@query("z1_search", "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents), m AS (SELECT doc_id, sum(6) AS w, count(DISTINCT term) AS hits FROM t WHERE term IN ('the', 'onesh', 'with') GROUP BY 1) SELECT doc_id, CAST(w AS BIGINT) AS weight, hits FROM m JOIN documents USING (doc_id) WHERE lang = 'en' AND n_chars BETWEEN 100 AND 5000 ORDER BY weight DESC, doc_id LIMIT 40 OFFSET 5")
def z1(spark, d):
    docs = table(spark, d, "documents")
    idx = Z.index(T.spread(docs.select("doc_id", "text")), "doc_id", {"bodys": "text"})
    filters = [Z.Filter(3, "lang", ["en"]), Z.Filter(1, "n_chars", [100, 5000])]
    return Z.search(idx, docs.select("doc_id", "lang", "n_chars"), "doc_id", "the with onesh", filters, offset=5, limit=40, any_term=True).select("doc_id", "weight", "hits")


@query("z3_word_info", "SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) WHERE term IN ('the', 'und') GROUP BY 1")
def z3(spark, d):
    return Z.word_info(Z.index(table(spark, d, "documents"), "doc_id", {"bodys": "text"}), "doc_id", "the und")


@query("z4_index_merge", "SELECT doc_id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS words FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents WHERE doc_id % 10 <> 3) GROUP BY 1, 2) GROUP BY 1")
def z4(spark, d):
    """Indexes that share the odd multiples of 5, a tenth of the table; another tenth is deleted from both."""
    docs = table(spark, d, "documents")
    a, b = Z.index(docs.where("doc_id % 2 = 0 or doc_id % 5 = 0"), "doc_id", {"bodys": "text"}), Z.index(docs.where("doc_id % 2 = 1"), "doc_id", {"bodys": "text"})
    return Z.without(Z.merged(a, b, "doc_id"), docs.where("doc_id % 10 = 3").select("doc_id"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("words"))


@query("z7_highlight", "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\\p{L}\\p{Nd}_][\\p{L}\\p{Nd}\\p{Mn}_]*|[^\\p{L}\\p{Nd}_]+'), lambda w: CASE WHEN lower(w) IN ('the', 'of') THEN '<b>' || w || '</b>' ELSE w END), '') AS t FROM documents")
def z7(spark, d):
    rows = T.spread(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", X.highlighted(F.col("text"), ["the", "of"], "<b>", "</b>").alias("t"))


@query("s10_result_extraction", "SELECT event_id, '{\"k\":\"' || (props->>'$.k') || '\"}' AS line FROM events")
def s10(spark, d):
    rows = table(spark, d, "events").select("event_id", F.base64(F.col("props").cast("binary")).alias("data"))
    return T.extracted(rows, "data", "k int", ["k"])


@query("s12_batch", "SELECT md5(text) AS url_md5, min(doc_id) AS pos, 7 AS batch_id FROM documents GROUP BY 1")
def s12(spark, d):
    return T.batch(table(spark, d, "documents").select(F.md5("text").alias("url_md5"), F.col("doc_id").alias("pos")), 7)


@query("s4_key_value", "SELECT o_custkey AS id, max(o_orderdate) AS c_date FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1")
def s4(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("c_date"))
    store = T.kv_put(rows.where("id % 3 = 0"), rows.where("id % 3 <> 0"))
    return T.kv_delete(store, rows.where("id % 2 = 1").select("id").distinct()).select("id", "c_date")


def stream(spark, d):
    path = f"{d}/events.parquet"
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(path.rsplit("/", 1)[0] + "/events.parque[t]")


@query("g9_stream_counters", "SELECT date_trunc('hour', ts) AS start, user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def g9(spark, d):
    """Windows that the watermark has closed."""
    got = G.drained(G.operation_counters(stream(spark, d), "user_id", "event_type", "ts"))
    return got.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("g10_stream_rates", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def g10(spark, d):
    out = G.host_rates(stream(spark, d), "event_type", "ts", "1 hour")
    got = G.drained(out, mode="complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
