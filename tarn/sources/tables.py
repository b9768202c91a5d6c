"""Sources and sinks: entity tables, key-value stores, raw contents, requests in JSON, extraction of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn import schemas

#: Logical database names and the namespace each stands for.
DATABASES = {n: n for n in ("primary", "secondary", "statistics", "attributes", "contents", "urls_deleted", "keyvalue", "logs", "domains")}


def location(root: str, name: str, database: str = "primary") -> str:
    return f"{root.rstrip('/')}/{DATABASES[database]}/{name}"


#: Folders of an entity table; sites are dealt to them by hash, so that their number does not grow with the sites.
SITE_BUCKETS = 64


def bucket(site_id: Column) -> Column:
    return F.pmod(F.xxhash64(site_id), F.lit(SITE_BUCKETS)).cast("int")


def read(spark: SparkSession, root: str, name: str, database: str = "primary", site_id: str | None = None) -> DataFrame:
    """An entity table; a site id prunes partitions."""
    df = spark.read.schema(schemas.ALL[name]).parquet(location(root, name, database))
    if site_id is not None:
        df = df.where((F.col("site_id_bucket") == bucket(F.lit(site_id))) & (F.col("site_id") == site_id))
    return df.select(*schemas.ALL[name].names)


def spread(df: DataFrame) -> DataFrame:
    """A scan whose files give fewer tasks than there are cores (one large row group) dealt over all cores, for work that is heavy on each row; other scans as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def write(df: DataFrame, root: str, name: str, database: str = "primary", mode: str = "overwrite") -> None:
    """An entity table, partitioned by hash buckets of the site; each task writes its own files, so a large site is no single task."""
    if "site_id" in df.columns:
        df.withColumn("site_id_bucket", bucket(F.col("site_id"))).write.mode(mode).partitionBy("site_id_bucket").parquet(location(root, name, database))
    else:
        df.write.mode(mode).parquet(location(root, name, database))


def by_index(rows: list) -> list[tuple]:
    """Collected rows as tuples; ``Row.asDict`` gives them by name."""
    return [tuple(r) for r in rows]


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of a relational database; give partitionColumn, bounds and numPartitions for large ones."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def kv_put(store: DataFrame, rows: DataFrame, key: str = "id", date: str = "c_date") -> DataFrame:
    """A key-value table with rows put in; of several with one key the newest counts."""
    from tarn.operators.state import latest

    return latest(store.unionByName(rows), [key], date).select(*store.columns)


def kv_get(store: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return store.join(keys, key, "left_semi")


def kv_delete(store: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return store.join(keys, key, "left_anti")


#: File suffix by kind of raw content.
SUFFIXES = {"raw": "bin", "tidy": "tidy", "headers": "headers", "request": "requests", "meta": "meta", "cookies": "cookies", "dynamic": "dynamic", "chain": "chain"}


def raw_name(url_md5: Column, kind: Column) -> Column:
    """The file name of a raw content: the URL's hash and the suffix of its kind."""
    suffix = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.concat(url_md5, F.lit("."), F.coalesce(suffix[kind], F.lit("bin")))


def fetched(urls: DataFrame, contents: DataFrame) -> DataFrame:
    """URLs with ``http_code``, ``size`` and ``body`` from a table (url, body) of contents that are there already; others are not found."""
    found = urls.join(contents, "url", "left")
    return found.withColumns({"http_code": F.when(F.col("body").isNull(), 404).otherwise(200), "size": F.coalesce(F.length("body"), F.lit(0))})


def write_raw(df: DataFrame, path: str) -> None:
    """Raw contents by kind."""
    df.write.mode("append").partitionBy("kind").parquet(path)


def import_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as rows (path, ctime, body)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return df.select("path", F.col("modificationTime").cast("timestamp_ntz").alias("ctime"), F.col("content").alias("body"))


def import_documents(spark: SparkSession, path: str, form: str, schema: str | None = None, row_tag: str = "document", lines: bool = True) -> DataFrame:
    """XML or JSON documents as rows; a schema saves a pass that infers one. Without ``lines`` a JSON file is one document or a list."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.format("xml").option("rowTag", row_tag).load(path) if form == "xml" else reader.option("multiLine", str(not lines).lower()).json(path)


def file_sum(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Sum of a whole-number field over all JSON files below a path."""
    df = spark.read.schema(T.StructType([T.StructField(field, T.LongType())])).option("recursiveFileLookup", "true").json(path)
    return df.agg(F.coalesce(F.sum(field), F.lit(0)).alias(field))


def extracted(df: DataFrame, column: str, schema: str, fields: Sequence[str], form: str = "json", base64: bool = True, offset: int = 0, count: int | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """Fields of coded results as json, csv lines or field lines, from an offset."""
    text = F.decode(F.unbase64(column), "UTF-8") if base64 else F.col(column)
    data = F.from_json(text, schema)
    parts = [data[f].cast("string") for f in fields]
    line = {"json": F.to_json(F.struct(*[p.alias(f) for p, f in zip(parts, fields, strict=True)])), "csv": F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(p, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for p in parts]), "line": F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts])}[form]
    out = df.orderBy(*order) if order else df
    out = out.offset(offset) if offset else out
    out = out.limit(count) if count is not None else out
    return out.select(*[c for c in df.columns if c != column], line.alias("line"))


def batch(urls: DataFrame, batch_id: int, key: str = "url_md5", position: str = "pos") -> DataFrame:
    """A batch of the URLs of a list, the first of equal ones."""
    from tarn.operators.merge import first_wins

    return first_wins(urls, [key], [F.col(position)]).withColumn("batch_id", F.lit(batch_id))


def joined_results(parts: Sequence[DataFrame]) -> DataFrame:
    """Result files as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
