"""Loops, requests, stores and services. Roles as elsewhere: orders = urls or tasks, customer = sites, supplier = nodes, events = requests."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.lineage import checkpoint_dir
from tarn.operators import content as C
from tarn.operators import policy as P
from tarn.operators import rules as R
from tarn.operators import runtime as E
from tarn.operators import search as Z
from tarn.operators import select as S
from tarn.operators import state as ST
from tarn.plans.q_state import URLS, now, urls
from tarn.plans.registry import query, table
from tarn.sources import requests as Q
from tarn.sources import tables as T
from tarn.streaming import loops as G


def one_run(spark: SparkSession, step: Callable[[], DataFrame]) -> DataFrame:
    """What the plan of a loop gives at its first trigger, as a streaming query runs it."""
    root = f"{checkpoint_dir(spark)}/loop-{uuid.uuid4().hex}"
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    q = G.every(ticks, "10 minutes", f"{root}/checkpoint", lambda _, batch: step().write.mode("overwrite").parquet(f"{root}/out")).start()
    try:
        while not q.recentProgress and q.isActive:
            q.awaitTermination(1)
        if q.exception():
            raise q.exception()
    finally:
        q.stop()
    return spark.read.parquet(f"{root}/out")


# --- loops


@query("g2_incremental_loop", "SELECT o_orderkey, o_orderkey % 4 AS depth FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 <= 2 AND o_orderdate < TIMESTAMP '2002-01-01' - INTERVAL 86400 SECOND ORDER BY o_orderkey % 4, o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 300")
def g2(spark, d):
    """Crawled URLs for a recrawl in steps: shallow ones first, then those that change most, then the latest."""
    status = F.when(F.col("o_orderstatus") == "F", 7).otherwise(1)
    u = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("depth"), F.col("o_totalprice").alias("m_rate"), F.col("o_orderdate").alias("u_date"), F.col("o_orderdate").alias("tc_date"), status.alias("status"))
    return one_run(spark, lambda: S.incremental(u, now(), 86400, 2, 300, "o_orderkey").select("o_orderkey", "depth"))


@query("g4_purge_loop", f"WITH t AS (SELECT * FROM {URLS} WHERE status = 7) SELECT url_md5 FROM t WHERE url_md5 NOT IN (SELECT url_md5 FROM t ORDER BY u_date, url_md5 LIMIT 100)")
def g4(spark, d):
    u = urls(spark, d)
    return one_run(spark, lambda: ST.purged(u.where("status = 7"), u.where("status <> 7"), "url_md5", "tc_date", [F.col("u_date"), F.col("url_md5")], 100)[0].select("url_md5"))


@query("g5_aging_loop", f"SELECT url_md5, site_id, rn FROM (SELECT url_md5, site_id, row_number() OVER (PARTITION BY site_id ORDER BY u_date, url_md5) AS rn FROM {URLS} WHERE u_date < TIMESTAMP '2000-01-01') WHERE rn <= 5 ORDER BY rn, site_id LIMIT 10000")
def g5(spark, d):
    old = urls(spark, d).where("u_date < timestamp_ntz'2000-01-01'")
    return one_run(spark, lambda: S.two_level(old, "site_id", [F.col("u_date"), F.col("url_md5")], 5, 10000).select("url_md5", "site_id", F.col("rn").cast("long").alias("rn")))


@query("g6_recrawl_loop", "WITH s AS (SELECT o_custkey AS id, max(o_orderdate) AS recrawl_date, (o_custkey % 7) * 1440 AS period FROM orders GROUP BY 1) SELECT id, recrawl_date + INTERVAL 1 MINUTE * (greatest(ceil((epoch(TIMESTAMP '2002-01-01') - epoch(recrawl_date)) / (period * 60)), 1) * period)::INT AS next FROM s WHERE id % 3 <> 2 AND period > 0 AND recrawl_date <= TIMESTAMP '2002-01-01' ORDER BY recrawl_date, id LIMIT 40")
def g6(spark, d):
    """Sites whose recrawl is due, with the date of the next one."""
    sites = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("recrawl_date")).withColumns({"recrawl_period": F.col("id") % 7 * 1440, "state": F.when(F.col("id") % 3 == 2, 2).otherwise(1)})
    return one_run(spark, lambda: ST.recrawl_due(sites, now(), 40).select("id", ST.next_recrawl(F.col("recrawl_date"), F.col("recrawl_period"), now()).alias("next")))


@query("g8_process_loop", f"SELECT url_md5, CASE WHEN url_md5 IN (SELECT url_md5 FROM {URLS} JOIN customer ON c_custkey = site_id WHERE status = 2 AND c_nationkey % 3 <> 2 ORDER BY u_date, url_md5 LIMIT 50) THEN 5 ELSE status END AS status FROM {URLS}")
def g8(spark, d):
    """One batch for processing: crawled URLs of sites that are not disabled, selected and marked."""
    u, sites = urls(spark, d), table(spark, d, "customer").where("c_nationkey % 3 <> 2").select(F.col("c_custkey").alias("site_id"))
    return one_run(spark, lambda: ST.marked(u, u.where("status = 2").join(sites, "site_id", "left_semi").orderBy("u_date", "url_md5").limit(50), "url_md5", 5, now())[1].select("url_md5", "status"))


@query("g11_cleanup_loop", "SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderstatus = 'P' OR o_orderdate + INTERVAL 1 SECOND * (86400 * (o_orderkey % 900)) < TIMESTAMP '1999-01-01')")
def g11(spark, d):
    """Tasks that stay when those in their last state or past their time are removed."""
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.lit("P").alias("cleanup_state"), F.col("o_orderdate").alias("started"), (F.col("o_orderkey") % 900 * 86400).alias("ttl"))
    return one_run(spark, lambda: tasks.join(E.to_clean(tasks, F.expr("timestamp_ntz'1999-01-01'")).select("id"), "id", "left_anti").select("id"))


@query("g12_deadline", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN sum(l_quantity) OVER w <= 60 THEN 'done' WHEN l_orderkey % 2 = 0 THEN 'kept' ELSE 'dropped' END AS outcome FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING)")
def g12(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return S.before_deadline(items, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")], F.col("l_quantity"), F.lit(60.0), F.col("l_orderkey") % 2 == 0)


# --- requests


#: The types of requests in the order in which the query below deals them out.
KINDS = sorted(Q.REQUESTS)
_HAS = {f: ", ".join(f"'{k}'" for k in KINDS if f in Q.REQUESTS[k]) for f in ("siteId", "state", "criterions", "urls")}


@query(
    "s9_requests",
    f"WITH r AS (SELECT o_orderkey, {KINDS!r}[CAST(o_orderkey % {len(KINDS)} AS INT) + 1] AS kind, o_custkey, o_orderpriority, o_orderkey % 7 = 0 AS two, o_orderkey % 11 = 0 AS bad FROM orders), "
    "e AS (SELECT *, unnest(CASE WHEN two AND NOT bad THEN [0, 1] ELSE [0] END) AS pos FROM r) "
    f"SELECT o_orderkey, kind, CAST(pos AS INT) AS pos, CASE WHEN bad THEN 'no JSON' END AS error, CASE WHEN NOT bad AND kind IN ({_HAS['siteId']}) THEN CAST(o_custkey AS VARCHAR) END AS site_id, CASE WHEN NOT bad AND kind IN ({_HAS['state']}) THEN pos + 1 END AS state, CASE WHEN NOT bad AND kind IN ({_HAS['criterions']}) THEN o_orderpriority END AS order_by, CASE WHEN NOT bad AND kind IN ({_HAS['urls']}) THEN 2 END AS n_urls FROM e",
)
def s9(spark, d):
    """A request of every type, some as lists, some no JSON; a type decodes the fields it has and no others."""
    k = F.col("o_orderkey")
    one = lambda state: F.to_json(F.struct(F.col("o_custkey").cast("string").alias("siteId"), F.lit(state).alias("state"), F.create_map(F.lit("ORDER BY"), "o_orderpriority").alias("criterions"), F.array(F.lit("a"), F.lit("b")).alias("urls"), F.lit("x").alias("unheard")))
    text = F.when(k % 7 == 0, F.concat(F.lit("["), one(1), F.lit(","), one(2), F.lit("]"))).otherwise(one(1))
    rows = table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, KINDS)), (k % len(KINDS) + 1).cast("int")).alias("kind"), F.when(k % 11 == 0, F.substring(text, 1, 20)).otherwise(text).alias("text"))
    r = Q.decoded(rows, "kind", "text")
    return r.select("o_orderkey", "kind", "pos", "error", F.col("request.siteId").alias("site_id"), F.col("request.state").alias("state"), F.col("request.criterions")["ORDER BY"].alias("order_by"), F.when(F.col("request.urls").isNotNull(), F.size("request.urls")).alias("n_urls"))


@query("m19_read_only", "SELECT o_orderkey, o_orderkey % 4 IN (0, 3) AS ok FROM orders")
def m19(spark, d):
    """Which statements a read-only connection takes."""
    from tarn.operators.criteria import reads_only

    forms = (" select * from t where id = ", "DROP TABLE t", "update t set a = ", "/* why */ -- so\n WITH x AS (SELECT 1) SELECT * FROM x where 1 = ")
    text = F.concat(F.element_at(F.array(*map(F.lit, forms)), (F.col("o_orderkey") % 4 + 1).cast("int")), F.col("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", reads_only(text).alias("ok"))


@query("s3_mapped_rows", "WITH f AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment = 'BUILDING' ORDER BY c_custkey) AS rn FROM customer), u AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND rn = 1 THEN 'first' ELSE c_mktsegment END AS seg, c_acctbal FROM f), x AS (SELECT *, row_number() OVER (PARTITION BY c_acctbal < 0 ORDER BY c_custkey) AS rn FROM u) SELECT c_custkey, CASE WHEN c_custkey % 100 = 0 THEN 'put' ELSE seg END AS seg FROM x WHERE NOT (c_acctbal < 0 AND rn = 1) OR c_custkey % 100 = 0 UNION ALL SELECT -c_custkey, 'put' FROM customer WHERE c_custkey % 100 = 0")
def s3(spark, d):
    """Rows of a mapped class: the first match of a condition updated, the first of another deleted, rows inserted or updated by key."""
    t = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"), "c_acctbal")
    key = [F.col("c_custkey")]
    t = ST.updated_first(t, F.col("seg") == "BUILDING", {"seg": F.lit("first")}, key, "c_custkey")
    t = ST.deleted_first(t, F.col("c_acctbal") < 0, key, "c_custkey")
    put = table(spark, d, "customer").where("c_custkey % 100 = 0").select(F.explode(F.array("c_custkey", -F.col("c_custkey"))).alias("c_custkey"), F.lit("put").alias("seg"), "c_acctbal")
    from tarn.operators.merge import upsert

    return upsert(t, put, ["c_custkey"]).select("c_custkey", "seg")


@query("s5_content_store", "SELECT md5(text) AS id, CASE WHEN max(doc_id) % 3 = 0 THEN 'second' ELSE max(source) END AS data FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING max(doc_id) % 5 <> 1")
def s5(spark, d):
    """Contents of a store in their own database: inserted, updated where the key is there, deleted, fetched."""
    docs = table(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("id")).agg(F.max("doc_id").alias("doc_id"), F.max("source").alias("data"))
    root = f"{checkpoint_dir(spark)}/contents-{uuid.uuid4().hex}"
    rows = lambda df, data, day: df.select(F.lit("s").alias("site_id"), "id", data.alias("data"), F.expr(f"timestamp_ntz'2024-01-0{day}'").alias("c_date"))
    T.write(rows(docs, F.col("data"), 1), root, "contents", database="contents")
    store = T.kv_put(T.read(spark, root, "contents", database="contents"), rows(docs.where("doc_id % 3 = 0"), F.lit("second"), 2))
    return T.kv_get(T.kv_delete(store, docs.where("doc_id % 5 = 1").select("id")), docs.select("id")).select("id", "data")


@query("s6b_raw_names", "SELECT doc_id, md5(text) || '.' || ['bin', 'tidy', 'headers', 'requests', 'meta', 'cookies', 'dynamic', 'chain'][CAST(doc_id % 8 AS INT) + 1] AS name FROM documents WHERE text IS NOT NULL")
def s6b(spark, d):
    """Raw contents written by kind and read again, with the names of their files."""
    root = f"{checkpoint_dir(spark)}/raw-{uuid.uuid4().hex}"
    kind = F.element_at(F.array(*map(F.lit, T.SUFFIXES)), (F.col("doc_id") % 8 + 1).cast("int"))
    T.write_raw(table(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("url_md5"), kind.alias("kind"), "text"), root)
    return spark.read.parquet(root).select("doc_id", T.raw_name(F.col("url_md5"), F.col("kind")).alias("name"))


@query("s11_imported_documents", "SELECT o_orderkey AS id, o_orderpriority AS data, form FROM orders, (VALUES ('json'), ('xml')) f(form)")
def s11(spark, d):
    """Documents in JSON and in XML files, imported as rows."""
    root = f"{checkpoint_dir(spark)}/import-{uuid.uuid4().hex}"
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("data"))
    rows.write.json(f"{root}/json")
    rows.write.format("xml").option("rootTag", "documents").option("rowTag", "document").save(f"{root}/xml")
    read = lambda form: T.import_documents(spark, f"{root}/{form}", form, "id long, data string").select("id", "data", F.lit(form).alias("form"))
    return read("json").unionByName(read("xml"))


@query("s15_file_sum", "SELECT CAST(sum(o_orderkey) AS BIGINT) AS hits FROM orders")
def s15(spark, d):
    """A number summed over the files of nested folders."""
    root = f"{checkpoint_dir(spark)}/stats-{uuid.uuid4().hex}"
    table(spark, d, "orders").select(F.col("o_orderkey").alias("hits"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 3).alias("part")).write.partitionBy("status", "part").json(root)
    return T.file_sum(spark, root, "hits")


@query("s16_fetched_contents", "SELECT page_id + off AS id, CASE WHEN off = 0 THEN 200 ELSE 404 END AS http_code, CASE WHEN off = 0 THEN length(html) ELSE 0 END AS size, CASE WHEN off = 0 THEN md5(html) END AS raw_md5 FROM pages, (VALUES (0), (1000000)) t(off)")
def s16(spark, d):
    """URLs fetched from a table of contents that are there already; those it lacks are not found."""
    pages = table(spark, d, "pages").withColumn("url", F.concat("url", F.lit("#"), F.col("page_id")))
    wanted = pages.select(F.col("page_id").alias("id"), "url").unionAll(pages.select(F.col("page_id") + 1000000, F.concat("url", F.lit("x"))))
    return T.fetched(wanted, pages.select("url", F.col("html").alias("body"))).select("id", "http_code", "size", F.md5("body").alias("raw_md5"))


# --- admission, rules, write-back


@query("j12_filter_urls", "SELECT o_orderkey, pattern FROM orders JOIN (SELECT c_custkey, unnest(['URGENT|HIGH', '^[45]'][1:1 + c_nationkey % 2]) AS pattern FROM customer) ON c_custkey = o_custkey WHERE regexp_matches(o_orderpriority, pattern)")
def j12(spark, d):
    rules = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.explode(F.slice(F.array(F.lit("URGENT|HIGH"), F.lit("^[45]")), F.lit(1), 1 + F.col("c_nationkey") % 2)).alias("pattern"))
    return R.rule_matches(table(spark, d, "orders"), rules, ["o_custkey"], "o_orderpriority").select("o_orderkey", "pattern")


@query("p20_admission", "WITH e AS (SELECT event_id, user_id, ts, value, event_type, count(*) OVER w AS n, epoch_us(ts) - epoch_us(min(ts) OVER w) AS age FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), u AS (SELECT user_id, count(*) AS uses FROM events GROUP BY 1) SELECT event_id, (age = 0 OR n * 1e6 / age <= 0.00005) AND value >= 10 AND value <= 90 AND event_type IN ('view', 'click', 'purchase') AND uses < 40 AS admitted FROM e JOIN u USING (user_id)")
def p20(spark, d):
    """Requests that rate, media limits and a free proxy of their host all admit."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value", "event_type")
    uses = e.groupBy("user_id").agg(F.count("*").alias("uses"))
    media = P.media_within(F.col("value"), F.lit(1.0), F.col("event_type"), 10, 90, kinds=["view", "click", "purchase"])
    return P.admitted_requests(e, "user_id", "ts", 0.00005, media, uses, F.lit(40)).select("event_id", "admitted")


@query("r10_task_admission", "WITH n AS (SELECT avg(s_acctbal) AS load, avg(s_nationkey) AS io, sum(s_nationkey) / greatest(count(*), 1) AS per_core, min(s_acctbal) AS ram FROM supplier), l AS (SELECT 'loose' AS rules, load <= 1e9 AND io <= 25 AND per_core <= 25 AND ram >= -1e9 AS ok FROM n UNION ALL SELECT 'by load', load <= 4500 AND io <= 25 AND per_core <= 25 AND ram >= -1e9 FROM n UNION ALL SELECT 'by io', load <= 1e9 AND io <= 3 AND per_core <= 25 AND ram >= -1e9 FROM n) SELECT rules, o_orderkey FROM l, orders WHERE ok")
def r10(spark, d):
    """Tasks that the averages of the nodes leave room for, under three sets of limits."""
    node = table(spark, d, "supplier").agg(F.avg("s_acctbal").alias("load"), F.avg("s_nationkey").alias("io"), F.sum("s_nationkey").alias("threads"), F.count("*").alias("cores"), F.min("s_acctbal").alias("ram"))
    tasks = table(spark, d, "orders").select("o_orderkey")
    sets = {"loose": (25, 1e9, 25, -1e9), "by load": (25, 4500, 25, -1e9), "by io": (25, 1e9, 3, -1e9)}
    out = [P.admits(node, tasks, *limits).select(F.lit(name).alias("rules"), "o_orderkey") for name, limits in sets.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("e19_attributes_only", "SELECT doc_id, 'error' AS name, CAST(doc_id % 9 AS VARCHAR) AS value FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 'quality', CAST(max(quality) AS VARCHAR) FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def e19(spark, d):
    """Results without data write an attribute of their item and nothing else."""
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("data"))
    results = docs.where("doc_id % 4 <> 0").select("doc_id", F.lit(None).cast("string").alias("data"), F.lit("error").alias("name"), (F.col("doc_id") % 9).cast("string").alias("value"), F.lit(7).alias("status"))
    have = table(spark, d, "labels").where("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("string").alias("value")).select("doc_id", F.lit("quality").alias("name"), "value")
    return C.written_back(docs, have, docs.select("doc_id", F.lit(1).alias("status")), results, "doc_id")[1]


# --- services


@query("z5_tokeniser", "SELECT doc_id, list_transform(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_-]+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'und', 'les')), lambda w: CASE w WHEN 'pour' THEN 'for' ELSE regexp_replace(CASE WHEN regexp_matches(w, '^.{3,}(tion|ing|er)$') THEN w ELSE w || '#' END, '(tion|ing|er|#)$', '') END) AS words FROM documents")
def z5(spark, d):
    t = Z.Tokeniser("_-", 3, ("the", "und", "les"), {"pour": "for"}, ("tion", "ing", "er"))
    return T.spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", t.tokens(F.col("text")).alias("words"))


@query("z8_commands", "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'in_progress' WHEN 1 THEN CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'planned' ELSE 'in_progress' END WHEN 2 THEN CASE o_orderstatus WHEN 'F' THEN 'finished' ELSE 'terminated' END WHEN 3 THEN CASE WHEN o_orderstatus = 'F' THEN 'finished' END END AS answer, o_orderkey % 5 <> 4 AND NOT (o_orderkey % 5 = 3 AND o_orderstatus = 'F') AS stays FROM orders")
def z8(spark, d):
    """Commands to tasks: set, check, terminate, get (a finished one's result, which then leaves) and delete."""
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "O", "planned").otherwise("in_progress")
    command = F.element_at(F.array(*map(F.lit, ("set", "check", "terminate", "get", "delete"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    answers, tasks = E.commanded(o.select(F.col("o_orderkey").alias("id"), state.alias("state")), o.select(F.col("o_orderkey").alias("id"), command.alias("command")))
    return answers.join(tasks.select("id", F.lit(True).alias("stays")), "id", "left").select("id", "answer", F.coalesce("stays", F.lit(False)).alias("stays"))


@query("z9_structure", "WITH n AS (SELECT s_nationkey AS cluster, count(*) FILTER (s_suppkey % 4 = 0) AS routers, count(*) FILTER (s_suppkey % 4 = 1) AS managers, count(*) FILTER (s_suppkey % 4 > 1) AS replicas, count(*) FILTER (s_suppkey % 4 > 1 AND s_acctbal < 0) AS down FROM supplier GROUP BY 1) SELECT *, list_filter([CASE WHEN routers = 0 THEN 'no router' END, CASE WHEN managers = 0 THEN 'no manager' END, CASE WHEN replicas - down < managers THEN 'too few replicas' END], lambda x: x IS NOT NULL) AS problems FROM n")
def z9(spark, d):
    """The roles of every cluster's nodes and what its structure lacks."""
    role = F.when(F.col("s_suppkey") % 4 == 0, "router").when(F.col("s_suppkey") % 4 == 1, "manager").otherwise("replica")
    nodes = table(spark, d, "supplier").select(F.col("s_nationkey").alias("cluster"), role.alias("role"), (F.col("s_acctbal") >= 0).alias("up"))
    return E.structure(nodes, "cluster")


@query("x8c_ranked_tags", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'Headline ' || page_id WHEN page_id % 2 = 0 THEN 'Graph ' || page_id ELSE trim(regexp_replace(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) END AS title, CASE WHEN page_id % 5 = 0 THEN 'linked data' WHEN page_id % 2 = 0 THEN 'open graph' ELSE 'heading' END AS from_, CASE WHEN page_id % 5 = 0 THEN 'A' || page_id WHEN page_id % 3 = 0 THEN 'B' || page_id END AS author, CASE WHEN page_id % 5 = 0 THEN '2024-01-0' || page_id % 9 WHEN page_id % 7 = 0 THEN '2023-05-05' END AS pubdate FROM pages")
def x8c(spark, d):
    """Tags of articles by extractors in order of rank; pages are given some of the marks that extractors look for."""
    k = F.col("page_id")
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    none = F.lit("")
    data = F.when(k % 5 == 0, s('<script type="application/ld+json">{"headline":"Headline ', k, '","author":{"name":"A', k, '"},"datePublished":"2024-01-0', k % 9, '"}</script>')).otherwise(none)
    graph = F.when(k % 2 == 0, s('<meta property="og:title" content="Graph ', k, '">')).otherwise(none)
    author = F.when(k % 3 == 0, s("<META content='B", k, "' name='author'/>")).otherwise(none)
    time = F.when(k % 7 == 0, "<time class=x datetime='2023-05-05'>then</time>").otherwise(none)
    tags = table(spark, d, "pages").select("page_id", C.ranked_tags(F.concat(data, graph, author, "html", time)).alias("t"))
    value = lambda tag: F.col("t")[tag]["value"].alias(tag)
    return tags.select("page_id", value("title"), F.col("t")["title"]["extractor"].alias("from_"), value("author"), value("pubdate"))
