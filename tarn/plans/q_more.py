"""Further operators of the inventory: contents, requests composed of others, authors, relative dates, loops."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarn.functions import author as A
from tarn.functions import dates as D
from tarn.functions import text as X
from tarn.operators import content as C
from tarn.operators import counters as K
from tarn.operators import search as Z
from tarn.operators import select as S
from tarn.operators import state as ST
from tarn.plans.registry import query, table
from tarn.sources import tables as T
from tarn.streaming import loops as G


@query("p6_content_view", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS best, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS internal FROM documents")
def p6(spark, d):
    none = F.array().cast("array<string>")
    view = F.struct(F.col("source").alias("default"), F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(none).alias("internal"), F.when(F.col("doc_id") % 3 == 0, F.array("lang", "lang")).otherwise(none).alias("custom"))
    return table(spark, d, "documents").withColumn("c", view).select("doc_id", C.content_view(F.col("c")).alias("v")).select("doc_id", "v.best", F.size("v.internal").alias("internal"))


@query("p11_macros", "SELECT o_orderkey, 'key ' || o_orderkey || ' of ' || o_custkey AS t FROM orders")
def p11(spark, d):
    from tarn.operators.crawl import templated

    return table(spark, d, "orders").select("o_orderkey", templated("key %KEY% of %SITE%", {"KEY": F.col("o_orderkey"), "SITE": F.col("o_custkey")}).alias("t"))


@query("p19_replace_mime", "SELECT page_id, page_id % 5 <> 0 AND page_id % 2 = 0 AND (url LIKE '%/de/%' OR url LIKE '%/en/%') AS yes FROM pages")
def p19(spark, d):
    k = F.col("page_id")
    return table(spark, d, "pages").select("page_id", C.replace_mime(3, k % 2 == 0, k % 5 == 0, F.lit(True), [F.col("url").contains("/de/"), F.col("url").contains("/en/")]).alias("yes"))


@query("a7_unique_site_fold", "SELECT l_suppkey, CAST(sum(l_quantity) AS DOUBLE) AS l_quantity, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber FROM lineitem GROUP BY 1")
def a7(spark, d):
    return K.merged_sites(table(spark, d, "lineitem"), "l_suppkey", ["l_quantity", "l_linenumber"], [], [], [])


@query("u4_explicit_list", "SELECT c_custkey FROM customer WHERE c_custkey IN (3, 5, 8, 13, 21) AND c_acctbal > -500")
def u4(spark, d):
    wanted = spark.createDataFrame([(i,) for i in (3, 5, 8, 13, 21)], "c_custkey long")
    return table(spark, d, "customer").where("c_acctbal > -500").join(wanted, "c_custkey", "left_semi").select("c_custkey")


@query("m4_site_delete", "SELECT o_orderkey, o_custkey % 10 = 0 AND o_orderpriority <> '1-URGENT' AS moved FROM orders")
def m4(spark, d):
    o = table(spark, d, "orders")
    c = ST.deleted(o, o.limit(0), (F.col("o_custkey") % 10 == 0) & (F.col("o_orderpriority") != "1-URGENT"), F.lit(None))  # root URLs are saved
    return c.table.select("o_orderkey", F.lit(False).alias("moved")).unionAll(c.moved.select("o_orderkey", F.lit(True)))


@query("m10_url_age", "WITH a AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING' AND CASE WHEN c_custkey % 7 = 0 THEN o_orderstatus = 'P' ELSE o_orderdate < TIMESTAMP '1998-01-01' END), t AS (SELECT o_orderkey FROM a WHERE rn <= 3 ORDER BY rn, o_custkey LIMIT 1000) SELECT o_orderkey, o_orderkey IN (SELECT o_orderkey FROM t) AS aged FROM orders")
def m10(spark, d):
    from tarn.operators.criteria import per_site_criterion

    o = table(spark, d, "orders")
    sites = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    own = F.when(F.col("o_custkey") % 7 == 0, F.col("o_orderstatus") == "P").otherwise(per_site_criterion("o_orderdate < timestamp_ntz'1998-01-01'", {}, "o_custkey"))
    aged = S.two_level(o.join(sites, "o_custkey", "left_semi").where(own), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], 3, 1000).select("o_orderkey")
    return o.select("o_orderkey").join(aged.withColumn("aged", F.lit(True)), "o_orderkey", "left").na.fill(False)


@query("m13_url_content", "SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN md5(text) END AS processed, CASE WHEN doc_id % 1024 >= 512 THEN quality END AS attributes FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)")
def m13(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    parts = {"processed": table(spark, d, "documents").select("doc_id", F.md5("text").alias("v")), "attributes": table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("v"))}
    return C.responded(docs, "doc_id", F.col("doc_id") % 1024, parts)


@query("m17_field_recalculate", "SELECT c_custkey, coalesce(n, c_nationkey) AS new_urls FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def m17(spark, d):
    fresh = K.recalculated(table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", {"new_urls": "o_orderstatus = 'O'"})
    sites = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("new_urls"))
    return K.refreshed(sites, fresh, "c_custkey", ["new_urls"])


@query("m26_write_back", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE lang END AS data FROM documents")
def m26(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("data"))
    results = docs.where("doc_id % 4 = 0").select("doc_id", F.lit("x").alias("data"), F.lit("social").alias("name"), F.lit("1").alias("value"), F.lit(7).alias("status"))
    attributes = results.select("doc_id", "name", "value").limit(0)
    return C.written_back(docs, attributes, docs.select("doc_id", F.lit(1).alias("status")), results, "doc_id")[0]


@query("f15_meta_refresh", "SELECT page_id, CASE WHEN page_id % 4 = 3 THEN '' ELSE url END AS target FROM pages")
def f15(spark, d):
    forms = ("<meta http-equiv='Refresh' content='5; URL=%s'>", '<META content-x="1" HTTP-EQUIV=refresh content="0;url=%s">', '<meta http-equiv="refresh" CONTENT="3; url=\'%s\'"/>', '<meta name="refresh" content="url=%s">')
    k, page = F.col("page_id") % 4, F.lit("")
    for i, form in enumerate(forms):
        page = F.when(k == i, F.replace(F.lit(form), F.lit("%s"), F.col("url"))).otherwise(page)
    return table(spark, d, "pages").select("page_id", X.meta_refresh(F.concat(F.lit("<html><head>"), page, F.substring("html", 1, 60))).alias("target"))


@query("f16_mail", "WITH m AS (SELECT doc_id, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', 0) AS a FROM documents) SELECT doc_id, a || ',v' || doc_id || '@c.d' AS mails, split_part(a, '@', 1) || ',v' || doc_id AS names FROM m")
def f16(spark, d):
    first = F.regexp_extract("text", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", 0)
    link = F.concat(F.lit("mailto:"), first, F.lit(",v"), F.col("doc_id"), F.lit("@c.d?subject=a@b"))
    return table(spark, d, "documents").select("doc_id", X.mail_address(link).alias("mails"), X.mail_address(link, True).alias("names"))


@query("c1_authors", "WITH n AS (SELECT c_custkey, translate(CAST(c_custkey AS VARCHAR), '0123456789', 'aeiouaeiou') || 'n' AS x, lower(c_mktsegment) AS y FROM customer), t AS (SELECT c_custkey, upper(x[1]) || x[2:] AS a, upper(y[1]) || y[2:] AS b FROM n) SELECT c_custkey, a || ' ' || b AS name FROM t")
def c1(spark, d):
    x = F.concat(F.translate(F.col("c_custkey").cast("string"), "0123456789", "aeiouaeiou"), F.lit("n"))
    y = F.lower("c_mktsegment")
    a, b = F.initcap(x), F.initcap(y)
    forms = [F.concat(F.lit("by "), a, F.lit(" "), b, F.lit(", staff")), F.concat(x, F.lit("."), y, F.lit("@mail.com")), F.concat(x, b), F.concat(F.lit("Written by "), a, F.lit(" "), b), F.concat(x, F.lit("_"), y)]
    raw = F.element_at(F.array(*forms), (F.col("c_custkey") % len(forms) + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", A.normalize_author(raw).alias("name"))


NOON = "TIMESTAMP '2024-05-05 12:00:00'"


@query("dt2_relative_dates", f"SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN {NOON} - INTERVAL 1 MINUTE * (c_nationkey + 1) WHEN 1 THEN {NOON} - INTERVAL 1 HOUR * (c_nationkey + 1) WHEN 2 THEN {NOON} - INTERVAL 1 DAY * (c_nationkey + 1) WHEN 3 THEN TIMESTAMP '2024-05-04' ELSE TIMESTAMP '2024-05-05' END AS at FROM customer")
def dt2(spark, d):
    n = F.col("c_nationkey") + 1
    forms = [F.concat(n, F.lit(" min ago")), F.concat(n, F.lit(" hours ago")), F.concat(F.lit("posted "), n, F.lit(" days ago")), F.when(F.col("c_nationkey") % 2 == 0, "gestern").otherwise("yesterday"), F.lit("today")]
    text = F.element_at(F.array(*forms), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", D.parse_date(text, "2024-05-05 12:00:00").alias("at"))


@query("dt3_eras", "SELECT c_custkey, make_timestamp(CASE c_custkey % 3 WHEN 0 THEN 1989 WHEN 1 THEN 1926 ELSE 2019 END + c_nationkey, c_custkey % 12 + 1, c_custkey % 28 + 1, 0, 0, 0.0) AS at FROM customer")
def dt3(spark, d):
    k = F.col("c_custkey")
    era = F.element_at(F.array(*[F.lit(x) for x in ("平成", "昭和", "令和")]), (k % 3 + 1).cast("int"))
    text = F.concat(era, F.col("c_nationkey") + 1, F.lit("年"), k % 12 + 1, F.lit("月"), k % 28 + 1, F.lit("日"))
    wide = F.translate(text, "0123456789", "０１２３４５６７８９")
    return table(spark, d, "customer").select("c_custkey", D.parse_date(F.when(k % 2 == 0, text).otherwise(wide), "2024-05-05 12:00:00").alias("at"))


@query("x10_json_elements", "SELECT event_id, i AS item, CASE WHEN i = 0 THEN event_type ELSE props->>'$.k' END AS title FROM events, (VALUES (0), (1)) t(i)")
def x10(spark, d):
    text = F.concat(F.lit('[{"t":"'), F.col("event_type"), F.lit('","u":"x"},{"t":" ","u":"'), F.get_json_object("props", "$.k"), F.lit('"}]'))
    return C.json_elements(table(spark, d, "events").select("event_id", text.alias("j")), "j", "struct<t:string,u:string>", {"title": ["t", "u"]})


@query("x13_media", "WITH l AS (SELECT page_id, list_transform(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1), lambda x: regexp_extract(url, '^[a-z]+://[^/]+', 0) || x) || ['http://x/b.png', regexp_extract(url, '^([a-z]+:)//', 1) || '//c/d.png'] AS l FROM pages) SELECT page_id, list_filter(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: NOT regexp_matches(x, '/para$')) AS media FROM l")
def x13(spark, d):
    links = F.concat(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1), F.array(*[F.lit(u) for u in ("http://x/b.png", "//c/d.png", "http://x/b.png")]))
    return table(spark, d, "pages").select("page_id", C.media_list(links, F.col("url"), exclude="/para$").alias("media"))


@query("x14_refined_titles", "WITH t AS (SELECT c_custkey, c_name || ' of ' || lower(c_mktsegment) AS h, ' | ' || repeat('x', c_nationkey * 2 + 1) AS r FROM customer) SELECT c_custkey, CASE WHEN length(h) * 2 > length(h || r) THEN h ELSE h || r END AS t FROM t")
def x14(spark, d):
    title = F.concat("c_name", F.lit(" of "), F.lower("c_mktsegment"), F.lit(" | "), F.repeat(F.lit("x"), (F.col("c_nationkey") * 2 + 1).cast("int")))
    return table(spark, d, "customer").select("c_custkey", C.refined_title(title).alias("t"))


@query("x16_module_chain", "SELECT doc_id, upper(lang) || '!' AS lang FROM documents WHERE n_chars > 1000")
def x16(spark, d):
    modules = [lambda x: x.where("n_chars > 1000"), lambda x: x.withColumn("lang", F.upper("lang")), lambda x: x.withColumn("lang", F.concat("lang", F.lit("!")))]
    return C.chained(table(spark, d, "documents"), modules).select("doc_id", "lang")


@query("x8b_ranked_extractors", "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<h2>(.*?)</h2>', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '')) AS title FROM pages")
def x8b(spark, d):
    for rank, tag in ((10, "h2"), (7, "h1"), (5, "title")):
        C.extractor(tag, rank)(lambda c, tag=tag: F.trim(F.regexp_extract(c, f"(?is)<{tag}>(.*?)</{tag}>", 1)))
    return table(spark, d, "pages").select("page_id", C.by_rank(F.col("html"), ["title", "h1", "h2"]).alias("title"))


@query("z2_field_weights", "WITH t AS (SELECT doc_id, 6 AS w, unnest(string_split(lower(source), ' ')) AS term FROM documents UNION ALL SELECT doc_id, 8, lang FROM documents) SELECT doc_id, CAST(sum(w) AS BIGINT) AS weight FROM t WHERE term IN ('de', 'src3') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def z2(spark, d):
    docs = table(spark, d, "documents")
    idx = Z.index(docs, "doc_id", {"title": "lang", "bodys": "source"})
    return Z.search(idx, docs.select("doc_id"), "doc_id", "de src3", limit=50, any_term=True).select("doc_id", "weight")


@query("z6_kv_store", "SELECT o_custkey AS id, max(o_totalprice) AS c_date FROM orders GROUP BY 1")
def z6(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("c_date"))
    return T.kv_put(rows.limit(0), rows).select("id", "c_date")


@query("z10_routing", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey, CAST(i % 3 AS INT) AS in_turn, CAST(o_custkey % 5 AS INT) AS by_key, 1 AS places FROM r")
def z10(spark, d):
    """The node that each request goes to: in turn, by key, and that all requests of a key meet at one place."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    turns = Z.in_turn(o, ["o_orderkey"], 3).select("o_orderkey", "o_custkey", F.col("node").alias("in_turn"))
    met = Z.routed(turns, "resource", 5, "o_custkey").withColumn("place", F.spark_partition_id())
    places = met.groupBy("o_custkey").agg(F.count_distinct("place").cast("int").alias("places"))
    return met.join(places, "o_custkey").select("o_orderkey", "in_turn", F.pmod("o_custkey", F.lit(5)).cast("int").alias("by_key"), "places")


@query("e3_available_ids", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 25")
def e3(spark, d):
    from tarn.operators.criteria import Criterion

    return Criterion(where="o_orderstatus = 'P'", order_by="o_orderdate, o_orderkey", limit=25).apply(table(spark, d, "orders")).select(F.col("o_orderkey").alias("id"))


@query("e7_node_upsert", "SELECT l_suppkey AS node, arg_max(l_partkey, (l_shipdate, l_orderkey, l_linenumber)) AS cpu FROM lineitem GROUP BY 1")
def e7(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("cpu"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"))
    return ST.latest(rows, ["node"], "at").select("node", "cpu")


@query("e11_feed_rows", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-05-05' END AS p_date FROM pages")
def e11(spark, d):
    from tarn.operators.runtime import feed_rows

    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("u"), F.col("page_id")).alias("url"))
    entries = pages.where("page_id % 2 = 0").select(F.col("url").alias("link"), F.lit("2024-01-01").alias("date"), F.lit("s").alias("summary"), F.lit(0).alias("pos"))
    return feed_rows(pages, entries, F.expr("timestamp_ntz'2024-05-05'")).select("page_id", "p_date")


@query("e16_filter_stages", "SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW' AND o_totalprice > 100000")
def e16(spark, d):
    from tarn.operators.rules import decided

    rules = spark.createDataFrame([("LOW$", 0, 1, -1), ("100000", 6, 2, 1), (".", 0, 3, -1)], "pattern string, op_code int, stage int, action int")
    rows = table(spark, d, "orders").withColumn("size", F.round(F.col("o_totalprice") + 0.499999).cast("long"))
    before = decided(rows, "o_orderkey", rules, F.col("o_orderpriority"), 1, default=True).where("passes").drop("passes")
    return decided(before, "o_orderkey", rules, F.col("size"), 2, default=False).where("passes").select("o_orderkey")


@query("s8_feed_source", "SELECT page_id % 5 AS feed, url AS link, regexp_extract(url, '[a-z]+$') AS title FROM pages")
def s8(spark, d):
    from tarn.functions.html import parse_feed

    item = F.concat(F.lit("<item><title> "), F.regexp_extract("url", "[a-z]+$", 0), F.lit("</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link></item>"))
    feeds = table(spark, d, "pages").groupBy((F.col("page_id") % 5).alias("feed")).agg(F.concat(F.lit("<rss><channel>"), F.concat_ws("", F.collect_list(item)), F.lit("</channel></rss>")).alias("xml"))
    return feeds.select("feed", F.explode(parse_feed("xml")).alias("e")).select("feed", F.col("e")["link"].alias("link"), F.col("e")["title"].alias("title"))


@query("s13_joined_results", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS o_orderpriority FROM orders")
def s13(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    parts = [o.where(f"o_orderstatus = '{x}'") for x in "FOP"]
    return T.joined_results([parts[0].drop("o_orderpriority"), parts[1].drop("o_orderpriority"), parts[2]])


@query("s14_json_path", "SELECT event_id, CAST(event_id % 3 + 1 AS VARCHAR) AS n, 'v' AS first FROM events")
def s14(spark, d):
    text = F.concat(F.lit('{"a":{"b":['), F.array_join(F.array_repeat(F.lit('"v"'), (F.col("event_id") % 3 + 1).cast("int")), ","), F.lit("]}}"))
    return table(spark, d, "events").select("event_id", X.json_path(text, "a:b:__LEN__").alias("n"), X.json_path(text, "a:b:0").alias("first"))


@query("s6_table_round_trip", "SELECT o_custkey, count(*) AS n, min(md5(CAST(o_orderkey AS VARCHAR))) AS url_md5, max(o_orderdate) AS o_date FROM orders GROUP BY 1")
def s6(spark, d):
    """All orders as an entity table, written and read again."""
    from tarn.lineage import checkpoint_dir

    root = f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
    log = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("site_id"), F.md5(F.col("o_orderkey").cast("string")).alias("url_md5"), F.lit(1).alias("op_code"), F.lit("{}").alias("object"), F.col("o_orderdate").alias("o_date"))
    T.write(log, root, "url_log")
    return T.read(spark, root, "url_log").groupBy(F.col("site_id").cast("long").alias("o_custkey")).agg(F.count("*").alias("n"), F.min("url_md5").alias("url_md5"), F.max("o_date").alias("o_date"))


@query("g1_batch_loop", "SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'O') ORDER BY (rn - 1) // 1, o_custkey, rn LIMIT 5")
def g1(spark, d):
    """One trigger of the regular loop: select fairly and mark, inside foreachBatch."""
    from tarn.lineage import checkpoint_dir

    root = f"{checkpoint_dir(spark)}/loop-{uuid.uuid4().hex}"
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def step(_, batch_id: int) -> None:
        urls = table(spark, d, "orders").where("o_orderstatus = 'O'")
        sites = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
        S.proportional_fetch(urls, sites, "o_custkey", [F.col("o_custkey").asc()], [F.col("o_orderdate"), F.col("o_orderkey")], 5).select("o_orderkey").write.mode("overwrite").parquet(f"{root}/selected")

    q = G.every(ticks, "10 minutes", f"{root}/checkpoint", step).start()
    try:
        while not q.recentProgress and q.isActive:
            q.awaitTermination(1)
    finally:
        q.stop()
    return spark.read.parquet(f"{root}/selected")


@query("g7_task_queue", "SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN bool_or(event_type = 'purchase') THEN 'finished' ELSE 'expired' END AS outcome FROM events GROUP BY user_id HAVING bool_or(event_type = 'purchase') OR max(ts) + INTERVAL 60 SECOND <= (SELECT max(ts) FROM events)")
def g7(spark, d):
    """Task updates through the queue processor; needs the RocksDB state store, which is set for this session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    return G.drained(G.task_outcomes(stream.select("user_id", "event_type", "ts"), "user_id", "event_type", "ts", "purchase", 60000))


LIMITED = "WITH f AS (SELECT user_id, list_reduce(list(struct_pack(t := ts, ids := [struct_pack(e := event_id, ts := ts)]) ORDER BY ts, event_id), lambda o, n: CASE WHEN n.t >= o.t + INTERVAL 3600 SECOND THEN struct_pack(t := n.t, ids := o.ids || n.ids) ELSE o END).ids AS l FROM events GROUP BY 1) SELECT user_id, x.e AS event_id, x.ts AS ts FROM (SELECT user_id, unnest(l) AS x FROM f)"


@query("r3c_stream_limiter", LIMITED)
def r3c(spark, d):
    """The rate limiter over the event stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    got = G.drained(G.limited(stream.select("event_id", "user_id", "ts"), "user_id", "ts", 3600.0))
    return got.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("a13_stat_fields", "WITH o AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'INIT' WHEN 'purchase' THEN 'SET' WHEN 'click' THEN 'SUB' ELSE 'ADD' END AS op, CAST(round(value) AS BIGINT) AS v FROM events), l AS (SELECT user_id, max(event_id) AS last FROM o WHERE op IN ('INIT', 'SET') GROUP BY 1) SELECT o.user_id, CAST(sum(CASE op WHEN 'ADD' THEN v WHEN 'SUB' THEN -v WHEN 'SET' THEN v ELSE 0 END) AS BIGINT) AS value FROM o LEFT JOIN l ON l.user_id = o.user_id WHERE last IS NULL OR event_id >= last GROUP BY 1")
def a13(spark, d):
    op = F.when(F.col("event_type") == "signup", "INIT").when(F.col("event_type") == "purchase", "SET").when(F.col("event_type") == "click", "SUB").otherwise("ADD")
    ops = table(spark, d, "events").select("user_id", "event_id", op.alias("op"), F.round("value").cast("long").alias("v"))
    return K.stat_fields(ops, ["user_id"], "event_id", "op", "v")


@query("g3_stuck_loop", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '2002-01-01' - INTERVAL 60 MINUTE AND rn <= 500 THEN 1 WHEN o_orderstatus = 'P' THEN 2 WHEN o_orderstatus = 'O' THEN 1 ELSE 7 END AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)")
def g3(spark, d):
    """One run of the loop that sets stuck URLs back."""
    status = F.when(F.col("o_orderstatus") == "P", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(7)
    urls = table(spark, d, "orders").select("o_orderkey", status.alias("status"), F.col("o_orderdate").alias("u_date"))
    return ST.returned(urls, F.expr("timestamp_ntz'2002-01-01 00:00:00'"), 60, 500, [F.col("u_date"), F.col("o_orderkey")], "o_orderkey").select("o_orderkey", "status")
