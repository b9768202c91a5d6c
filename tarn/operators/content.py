"""Content responses, write-back of results, refinement of extracted fields, post-processing chains."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a content request (fixed values).
CONTENT = {"processed": 1 << 0, "raw_last": 1 << 1, "raw_first": 1 << 2, "raw_all": 1 << 3, "headers": 1 << 4, "requests": 1 << 5, "meta": 1 << 6, "cookies": 1 << 7, "tidy": 1 << 8, "attributes": 1 << 9, "db_fields": 1 << 10}


def content_view(content: Column, internal_all: bool = False, custom_all: bool = False) -> Column:
    """Processed contents {default, internal, custom}: the best custom one, else the default; of internal and custom ones the first, or all."""
    first = lambda a: F.slice(a, 1, 1)
    best = F.coalesce(F.get(content["custom"], F.lit(0)), content["default"])
    internal = content["internal"] if internal_all else first(content["internal"])
    custom = content["custom"] if custom_all else first(content["custom"])
    return F.struct(best.alias("best"), F.coalesce(internal, F.array().cast("array<string>")).alias("internal"), F.coalesce(custom, F.array().cast("array<string>")).alias("custom"))


def responded(urls: DataFrame, key: str, mask: Column, parts: Mapping[str, DataFrame]) -> DataFrame:
    """One response row a URL: each part (a table of key and value) as a column where its bit is set."""
    out = urls.withColumn("_mask", mask)
    for name, rows in parts.items():
        out = out.join(rows.select(F.col(key), F.col(rows.columns[-1]).alias(f"_{name}")), key, "left").withColumn(name, F.when(F.col("_mask").bitwiseAND(CONTENT[name]) != 0, F.col(f"_{name}"))).drop(f"_{name}")
    return out.drop("_mask")


def written_back(contents: DataFrame, attributes: DataFrame, urls: DataFrame, results: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contents, attributes, urls) with external results (key, data, name, value, status) put in; rows without data write their attribute only."""
    from tarn.operators.merge import patched, upsert

    data = results.where("data is not null").groupBy(key).agg(F.max("data").alias("data"))
    marks = results.where("name is not null").groupBy(key, "name").agg(F.max("value").alias("value"))
    status = results.where("data is not null").groupBy(key).agg(F.max("status").alias("status"))
    return upsert(contents, data, [key]), upsert(attributes, marks, [key, "name"]), patched(urls, status, [key])


def replace_mime(mode: int, type_ok: Column, root: Column, parent: Column, found: Sequence[Column]) -> Column:
    """Whether the content type is replaced: 0 never, 1 always, 2 for the root URL, 3 for its children; of allowed types, and if any pattern is found."""
    scope = {0: F.lit(False), 1: F.lit(True), 2: root, 3: ~root & parent}[mode]
    some = F.lit(False)
    for f in found:
        some = some | F.coalesce(f, F.lit(False))
    return scope & type_ok & (some if found else F.lit(True))


def json_elements(rows: DataFrame, column: str, schema: str, merge: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row an element of a JSON array; each tag is the first filled field of its list."""
    each = rows.select(*[c for c in rows.columns if c != column], F.posexplode(F.from_json(column, f"array<{schema}>")).alias("item", "e"))
    filled = lambda f: F.when(F.trim(F.coalesce(F.col(f"e.{f}").cast("string"), F.lit(""))) != "", F.col(f"e.{f}").cast("string"))
    return each.select(*[c for c in each.columns if c != "e"], *[F.coalesce(*[filled(f) for f in fields]).alias(tag) for tag, fields in merge.items()])


def media_list(links: Column, base: Column, include: str | None = None, exclude: str | None = None) -> Column:
    """Distinct absolute media references in order; //host and /path are completed from the page's URL."""
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", 0)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    full = F.transform(links, lambda u: F.when(u.startswith("//"), F.concat(scheme, u)).when(u.startswith("/"), F.concat(origin, u)).when(u.rlike(r"^\w+:"), u).otherwise(F.concat(F.regexp_extract(base, r"^[^?#]*/", 0), u)))
    out = F.array_distinct(full)
    out = out if include is None else F.filter(out, lambda u: u.rlike(include))
    return out if exclude is None else F.filter(out, lambda u: ~u.rlike(exclude))


def refined_title(c: Column) -> Column:
    """A title without the site's name after the last | or dash, if what is left is the longer part."""
    head = F.regexp_extract(c, r"^(.*)\s+[|–—-]\s+[^|–—-]*$", 1)
    return F.trim(F.when(F.length(head) * 2 > F.length(c), head).otherwise(c))


def without_bad_dates(ts: Column, now: Column, oldest: str = "1970-01-02") -> Column:
    """Dates in the future or before any web page are no dates."""
    return F.when((ts <= now + F.make_interval(days=F.lit(1))) & (ts >= F.expr(f"timestamp_ntz'{oldest}'")), ts)


def chained(df: DataFrame, modules: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Post-processing modules one after another."""
    for m in modules:
        df = df.transform(m)
    return df


#: Extractors by name and rank; users add their own column functions.
EXTRACTORS: dict[str, tuple[int, Callable[[Column], Column]]] = {}


def extractor(name: str, rank: int):
    def add(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
        EXTRACTORS[name] = (rank, f)
        return f

    return add


def by_rank(c: Column, names: Sequence[str] | None = None) -> Column:
    """The first filled result of the extractors, highest rank first."""
    ranked = sorted(((r, n, f) for n, (r, f) in EXTRACTORS.items() if names is None or n in names), key=lambda x: (-x[0], x[1]))
    results = [f(c) for _, _, f in ranked]
    return F.coalesce(*[F.when(F.trim(F.coalesce(r, F.lit(""))) != "", r) for r in results])


def meta(c: Column, name: str) -> Column:
    """The content of a page's meta element of a name or property, in either order of its attributes; empty if none."""
    key = rf"(?:name|property)\s*=\s*[\"']?{name}[\"']?"
    value = r"content\s*=\s*[\"']([^\"']*)[\"']"
    return F.trim(F.coalesce(F.nullif(F.regexp_extract(c, rf"(?is)<meta\b[^>]*{key}[^>]*{value}", 1), F.lit("")), F.regexp_extract(c, rf"(?is)<meta\b[^>]*{value}[^>]*{key}", 1)))


def element(c: Column, tag: str) -> Column:
    """The text of a page's first element of a tag, without the tags in it."""
    return F.trim(F.regexp_replace(F.regexp_extract(c, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", ""))


def attribute(c: Column, tag: str, name: str) -> Column:
    return F.trim(F.regexp_extract(c, rf"(?is)<{tag}\b[^>]*\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1))


def linked_data(c: Column, path: str) -> Column:
    """A value of a page's first block of linked data (JSON-LD)."""
    block = F.regexp_extract(c, r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1)
    return F.coalesce(F.get_json_object(block, path), F.lit(""))


#: The extractors of each tag of an article, the best first; a later one fills what those before it leave empty.
TAGS: dict[str, tuple[tuple[str, Callable[[Column], Column]], ...]] = {
    "title": (("linked data", lambda c: linked_data(c, "$.headline")), ("open graph", lambda c: meta(c, "og:title")), ("heading", lambda c: element(c, "h1")), ("head", lambda c: element(c, "title"))),
    "author": (("linked data", lambda c: linked_data(c, "$.author.name")), ("meta", lambda c: meta(c, "author")), ("link", lambda c: F.trim(F.regexp_extract(c, r"(?is)<a\b[^>]*rel\s*=\s*[\"']author[\"'][^>]*>([^<]*)</a>", 1)))),
    "pubdate": (("linked data", lambda c: linked_data(c, "$.datePublished")), ("open graph", lambda c: meta(c, "article:published_time")), ("time", lambda c: attribute(c, "time", "datetime")), ("meta", lambda c: meta(c, "date"))),
    "description": (("open graph", lambda c: meta(c, "og:description")), ("meta", lambda c: meta(c, "description")), ("first paragraph", lambda c: element(c, "p"))),
    "image": (("open graph", lambda c: meta(c, "og:image")), ("first", lambda c: attribute(c, "img", "src"))),
}


def ranked_tags(c: Column) -> Column:
    """A map of each tag to {value, extractor}: the first filled result of its extractors; tags that none fills are null."""
    entries = []
    for tag, extractors in TAGS.items():
        found = [F.when(F.length(f(c)) > 0, F.struct(f(c).alias("value"), F.lit(name).alias("extractor"))) for name, f in extractors]
        entries += [F.lit(tag), F.coalesce(*found)]
    return F.create_map(*entries)
