"""Document table functions that are plans: the link pipeline, URL generation, iteration, templating, page properties."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import urls as U
from tarn.functions.html import extract_links
from tarn.lineage import checkpointed
from tarn.operators.select import capped


def collected_links(pages: DataFrame, page: str, url: str, html: str, rules: Callable[[DataFrame], DataFrame] | None = None, max_per_page: int = 100, depth: int = 0, error_bit: int = 1 << 20) -> DataFrame:
    """URL rows from pages: extracted, normalised, first of equal ones, filtered by ``rules``, capped for each page, one deeper.

    Columns: parent (page), url, url_md5, pos, depth, internal, error_mask (the last row kept of a cut page carries ``error_bit``).
    """
    links = pages.select(F.col(page).alias("parent"), F.col(url).alias("page_url"), F.posexplode(extract_links()(F.col(html), F.col(url))).alias("pos", "raw"))
    rows = links.withColumn("url", U.url_normalize("raw")).where(U.valid(F.col("url")))
    rows = rows.groupBy("parent", "page_url", "url").agg(F.min("pos").alias("pos"))
    rows = rows.select("parent", "page_url", "url", F.md5("url").alias("url_md5"), "pos", F.lit(depth + 1).alias("depth"), U.is_internal(F.col("url"), F.col("page_url")).alias("internal"), F.lit(0).alias("error_mask"))
    rows = rules(rows) if rules else rows
    return capped(rows, ["parent"], [F.col("pos")], max_per_page, error_bit)


def iterated(seeds: DataFrame, links: DataFrame, source: str, target: str, rounds: int, cap: int) -> DataFrame:
    """(node, round) reached from the seeds within some rounds, up to ``cap`` new nodes a round: a frontier joined to the links, less what was seen."""
    seen = seeds.select(F.col(seeds.columns[0]).alias("node"), F.lit(0).alias("round"))
    frontier = seen
    for r in range(1, rounds + 1):
        step = frontier.select("node").join(links, F.col("node") == F.col(source)).select(F.col(target).alias("node")).distinct()
        frontier = checkpointed(step.join(seen, "node", "left_anti").orderBy("node").limit(cap).withColumn("round", F.lit(r)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def generated_urls(spark, template: str, parameters: Mapping[str, Sequence[str] | tuple[int, int, int]], max_items: int | None = None) -> DataFrame:
    """URLs of a template with %name% parameters: lists, or (first, last, step) numbers; all combinations, in order."""
    df = spark.range(1).select(F.lit(template).alias("url"), F.array().cast("array<long>").alias("at"))
    for name, values in parameters.items():
        pool = F.sequence(*[F.lit(v) for v in values]) if isinstance(values, tuple) else F.array(*[F.lit(v) for v in values])
        df = df.select("url", "at", F.posexplode(pool).alias("i", "v"))
        df = df.select(F.replace("url", F.lit(f"%{name}%"), F.col("v").cast("string")).alias("url"), F.concat("at", F.array(F.col("i").cast("long"))).alias("at"))
    out = df.orderBy("at")
    return (out.limit(max_items) if max_items is not None else out).select("url")


def templated(template: str, values: Mapping[str, Column]) -> Column:
    """A response template with %name% macros; null values are empty."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit(f"%{name}%"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def escaped(c: Column, form: str) -> Column:
    """A value escaped for json, csv, xml, html, sql or text."""
    if form == "json":
        return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":"(.*)"\}$', 1)
    if form == "csv":
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    if form in ("xml", "html"):
        out = F.replace(c, F.lit("&"), F.lit("&amp;"))
        for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")) if form == "sql" else c


def templates_for(pages: DataFrame, host: str, templates: DataFrame) -> DataFrame:
    """Pages with the best template of their host: exact name, then parent domains from the longest, then *; (domain, template) is a rule table."""
    labels = F.split(F.col(host), r"\.")
    names = F.concat(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")), F.array(F.lit("*")))
    one = templates.where("domain is not null").groupBy("domain").agg(F.min("template").alias("template"))
    known = F.broadcast(one.agg(F.map_from_entries(F.collect_list(F.struct("domain", "template"))).alias("_known")))  # one row, written by hand
    found = F.filter(F.transform(names, lambda n: F.try_element_at(F.col("_known"), n)), lambda t: t.isNotNull())
    return pages.join(known, F.lit(True), "left").withColumn("template", F.get(found, F.lit(0))).drop("_known")


def best_rule(rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One value a tag from weighted rules: mandatory, then priority, then extracted; rules that join by concat are appended in order."""
    weight = F.col("mandatory") * 4 + F.col("priority") * 2 + (F.trim(F.coalesce("value", F.lit(""))) != "").cast("int")
    best = F.max_by(F.when(F.col("join") != "concat", F.col("value")), F.struct(weight, -F.col("pos")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("join") == "concat", F.struct("pos", "value")))), lambda x: x["value"]), " ")
    return rules.groupBy(*keys).agg(F.trim(F.concat_ws(" ", best, joined)).alias("value"))
