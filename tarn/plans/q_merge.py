"""Dedup and merges. Roles: lineitem = URL rows from several nodes (l_suppkey), documents = contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import merge as M
from tarn.plans.registry import query, table
from tarn.sources.tables import spread


def node_rows(spark, d):
    """Line items as URL rows of nodes."""
    status = F.when(F.col("l_returnflag") == "A", 4).when(F.col("l_returnflag") == "N", 1).otherwise(7)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("url_md5"), F.col("l_suppkey").alias("node"), (F.col("l_suppkey") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("pos"), status.alias("status"), (F.col("l_quantity") % 3).cast("int").alias("crawled"), (F.col("l_linenumber") % 2).alias("processed"), (F.col("l_linenumber") % 4).alias("batch_id"), F.col("l_shipdate").alias("u_date"))


NODES = "(SELECT l_orderkey AS url_md5, l_suppkey AS node, l_suppkey * 1000000000 + l_partkey * 1000 + l_linenumber AS pos, CASE l_returnflag WHEN 'A' THEN 4 WHEN 'N' THEN 1 ELSE 7 END AS status, CAST(l_quantity AS BIGINT) % 3 AS crawled, l_linenumber % 2 AS processed, l_linenumber % 4 AS batch_id, l_shipdate AS u_date FROM lineitem)"


@query("d1_first_wins", "SELECT m, doc_id FROM (SELECT md5(text) AS m, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def d1(spark, d):
    return M.first_wins(table(spark, d, "documents").select(F.md5("text").alias("m"), "doc_id"), ["m"], [F.col("doc_id")])


FOLD = "CASE WHEN (o.status <= n.status AND least(n.crawled, n.processed, n.batch_id) > 0) OR (o.status = n.status AND n.crawled > 0 AND (o.crawled = 0 OR n.u_date > o.u_date)) THEN n ELSE o END"
NAMES = ("url_md5", "node", "pos", "status", "crawled", "processed", "batch_id", "u_date")


@query("d2_url_merge_fold", f"SELECT u.* FROM (SELECT list_reduce(list(struct_pack({', '.join(f'{n} := {n}' for n in NAMES)}) ORDER BY pos, {', '.join(NAMES)}), lambda o, n: {FOLD}) AS u FROM {NODES} GROUP BY url_md5)")
def d2(spark, d):
    rows = node_rows(spark, d)
    return M.folded(rows, ["url_md5"], ["pos", *rows.columns], M.url_replaces)


@query("d2b_url_merge_total", f"SELECT url_md5, status, crawled, u_date FROM (SELECT *, row_number() OVER (PARTITION BY url_md5 ORDER BY status DESC, (crawled > 0) DESC, u_date DESC, pos) AS rn FROM {NODES}) WHERE rn = 1")
def d2b(spark, d):
    return M.latest_by_total_order(node_rows(spark, d), ["url_md5"]).select("url_md5", "status", F.col("crawled").cast("long").alias("crawled"), "u_date")


@query("d3_content_entities", "WITH RECURSIVE r AS MATERIALIZED (SELECT source AS site_id, doc_id AS pos, md5(CAST(doc_id AS VARCHAR)) AS url_md5, md5(text) AS raw_content_md5, CASE WHEN n_chars < 200 THEN md5(substr(text, 1, 20)) END AS content_url_md5 FROM documents), e AS MATERIALIZED (SELECT a.pos AS a, b.pos AS b FROM r a JOIN r b ON a.site_id = b.site_id AND a.raw_content_md5 = b.raw_content_md5 UNION SELECT a.pos, b.pos FROM r a JOIN r b ON a.site_id = b.site_id AND a.content_url_md5 = b.content_url_md5), w(pos, other) AS (SELECT pos, pos FROM r UNION SELECT w.pos, e.b FROM w JOIN e ON w.other = e.a) SELECT r.*, entity FROM r JOIN (SELECT pos, min(other) AS entity FROM w GROUP BY 1) USING (pos)")
def d3(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("site_id"), F.col("doc_id").alias("pos"), F.md5(F.col("doc_id").cast("string")).alias("url_md5"), F.md5("text").alias("raw_content_md5"), F.when(F.col("n_chars") < 200, F.md5(F.substring("text", 1, 20))).alias("content_url_md5"))
    return M.same_contents(rows)


@query("d4_content_hash_dedup", "SELECT h, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, md5(array_to_string(list_filter(list_sort(list_distinct(regexp_split_to_array(lower(text), '\\s'))), lambda x: length(x) >= 3), '')) AS h FROM documents) GROUP BY 1")
def d4(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.content_hash_2(F.col("text")).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("d5_line_repeats", "SELECT doc_id, CAST(count(*) FILTER (prev IS NULL OR prev <> line) AS BIGINT) AS n FROM (SELECT doc_id, trim(line) AS line, lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) GROUP BY 1")
def d5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(M.without_repeats(F.split("text", "\n"))).cast("long").alias("n"))


@query("d6_fill_if_empty", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS title, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS author FROM documents")
def d6(spark, d):
    left = F.create_map(F.lit("title"), F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("lang")), F.lit("author"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    right = F.create_map(F.lit("title"), F.col("source"), F.lit("author"), F.col("source"))
    m = M.merged_maps(left, right)
    return table(spark, d, "documents").select("doc_id", m["title"].alias("title"), m["author"].alias("author"))


@query("d7_prefer_filled", "SELECT o_custkey, coalesce(max(o_orderpriority) FILTER (o_orderstatus = 'P'), min(o_orderpriority)) AS p FROM orders GROUP BY 1")
def d7(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))).alias("a"), F.min("o_orderpriority").alias("b"))
    return o.select("o_custkey", M.filled(F.col("a"), F.col("b")).alias("p"))


@query("d8_batch_extend", "WITH b AS (SELECT doc_id FROM documents WHERE doc_id < 50) SELECT doc_id FROM b UNION ALL SELECT doc_id FROM (SELECT doc_id FROM documents WHERE doc_id >= 30 AND doc_id NOT IN (SELECT doc_id FROM b) ORDER BY doc_id LIMIT 30)")
def d8(spark, d):
    t = table(spark, d, "documents").select("doc_id")
    return M.extended(t.where("doc_id < 50"), t.where("doc_id >= 30"), "doc_id", [F.col("doc_id")], 80)


@query("d9_response_merge", "SELECT o_custkey, string_agg(o_orderstatus, ';' ORDER BY o_orderkey) AS codes FROM orders GROUP BY 1")
def d9(spark, d):
    codes = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(codes, lambda x: x["o_orderstatus"]), ";").alias("codes"))


@query("d10_insert_ignore", "SELECT m, min(doc_id) AS doc_id FROM (SELECT md5(text) AS m, doc_id FROM documents) WHERE doc_id % 2 = 1 AND m NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) GROUP BY 1 UNION ALL SELECT md5(text), doc_id FROM documents WHERE doc_id % 2 = 0")
def d10(spark, d):
    t = table(spark, d, "documents").select(F.md5("text").alias("m"), "doc_id")
    old, new = t.where("doc_id % 2 = 0"), t.where("doc_id % 2 = 1")
    return old.unionByName(M.first_wins(new.join(old, "m", "left_anti"), ["m"], [F.col("doc_id")]))


@query("d11_url_statistics", "SELECT page_id, count(*) OVER (PARTITION BY url) = 1 AS source_unique, count(*) OVER (PARTITION BY lower(regexp_replace(regexp_replace(url, '#.*$', ''), '/$', ''))) = 1 AS canonical_unique FROM pages")
def d11(spark, d):
    from pyspark.sql import Window

    canonical = F.lower(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/$", ""))
    once = lambda c: F.count("*").over(Window.partitionBy(c)) == 1
    return table(spark, d, "pages").select("page_id", once(F.col("url")).alias("source_unique"), once(canonical).alias("canonical_unique"))
