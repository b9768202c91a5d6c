"""Merkle fixity audit of WARC replicas.

Records lie in archive files of a fixed number of records, in key order, at known offsets. Each record is hashed with its
offset and length; ``fan_out`` neighbouring ranges make a node of the next level, up to one root. An audit compares
the roots of two replicas and joins only the children of nodes that differ, level by level, down to the damaged
records. Ranks come from a range partition and the row counts of its partitions, so no task holds more than a
share of the records, whatever keys repeat. All of it is DataFrame code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.common import Staged


def record_bytes(url: F.Column, payload: F.Column) -> F.Column:
    """A WARC resource record; null url and payload are empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.encode(F.concat(head, body, F.lit("\r\n\r\n")), "UTF-8")


def with_rank(df: DataFrame, order: list[str], name: str, store: Staged, rows_per_task: int = 20000) -> DataFrame:
    """``df`` with the rank (from 0) of each row in ``order``; rows that are equal in it are ranked in any order, and dealt over tasks like others."""
    rows = store.put(df.withColumn("_tarn_row", F.monotonically_increasing_id()))  # a number of each row, so that equal rows can be split
    n = rows.count()
    by = [*order, "_tarn_row"]
    ranged = store.put(rows.repartitionByRange(max(1, -(-n // rows_per_task)), *by).sortWithinPartitions(*by).withColumn("_tarn_m", F.monotonically_increasing_id()))
    part = F.shiftright("_tarn_m", 33)
    held = sorted((r["p"], r["low"], r["count"]) for r in ranged.groupBy(part.alias("p")).agg(F.min("_tarn_m").alias("low"), F.count("*").alias("count")).collect())
    at, shifts = 0, []
    for p, low, count in held:  # one entry a partition
        shifts.append((p, at - low))
        at += count
    offsets = df.sparkSession.createDataFrame(shifts, "_tarn_p long, _tarn_shift long")
    return ranged.withColumn("_tarn_p", part).join(F.broadcast(offsets), "_tarn_p").withColumn(name, F.col("_tarn_m") + F.col("_tarn_shift")).drop("_tarn_p", "_tarn_m", "_tarn_shift", "_tarn_row")


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", per_file: int = 1024, store: Staged | None = None, damage: tuple[str, str] | None = None) -> DataFrame:
    """The index of an archive: key, url, seq (rank by key, url and payload), file, offset, length, sha256 of the record.

    Null urls and payloads are empty ones in a record, null keys come first, repeated rows are records of their own, an empty table is
    an empty archive; other columns are not read. A record is digested where its page is read: payloads are never shuffled, but for
    those of different pages that share key and url, which alone need them for their order. Offsets and lengths are 64 bits, a payload is
    at most 2 GB. ``damage``, of two conditions on ``key``, adds ``other``: the digest with the last byte changed for rows under the
    first, and null for rows under the second, as a replica with those faults would have it.
    """
    store = store or Staged(pages.sparkSession, "fixity")
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{payload}`").alias("payload"))
    record = record_bytes(F.col("url"), F.col("payload"))
    sha = F.sha2(record, 256)
    digests = {"sha256": sha, "null_payload": F.col("payload").isNull(), "length": F.length(record).cast("long")}
    if damage:
        flipped = F.concat(F.substring(record, 1, F.length(record) - 1), F.encode(F.lit("#"), "UTF-8"))
        digests["other"] = F.when(F.coalesce(F.expr(damage[1]), F.lit(False)), F.lit(None).cast("string")).when(F.coalesce(F.expr(damage[0]), F.lit(False)), F.sha2(flipped, 256)).otherwise(sha)
    light = store.put(rows.withColumns(digests).drop("payload"))
    several = light.groupBy("key", "url").agg(F.min(F.struct("null_payload", "sha256")).alias("x"), F.max(F.struct("null_payload", "sha256")).alias("y")).where("x <> y").select(F.col("key").alias("k"), F.col("url").alias("u"))
    alike = rows.join(several, F.col("key").eqNullSafe(F.col("k")) & F.col("url").eqNullSafe(F.col("u")), "left_semi").distinct()
    ordered = with_rank(alike, ["key", "url", "payload"], "tie", store).select(F.col("key").alias("k"), F.col("url").alias("u"), F.col("payload").isNull().alias("p"), F.sha2(record, 256).alias("s"), "tie")
    same = F.col("key").eqNullSafe(F.col("k")) & F.col("url").eqNullSafe(F.col("u")) & (F.col("null_payload") == F.col("p")) & (F.col("sha256") == F.col("s"))
    placed = light.join(ordered, same, "left").drop("k", "u", "p", "s", "null_payload")
    sized = with_rank(placed, ["key", "url", "tie"], "seq", store).withColumn("file", F.expr(f"seq div {per_file}"))
    before = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select("key", "url", "seq", "file", "offset", "length", "sha256", *(["other"] if damage else []))


def with_records(index: DataFrame, pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """An archive's index with ``record``, the bytes themselves: what is to be written to files, in order of file and offset."""
    body = pages.select(F.col(f"`{key}`").alias("_k"), record_bytes(F.col(f"`{url}`"), F.col(f"`{payload}`")).alias("record")).withColumn("_s", F.sha2("record", 256)).dropDuplicates(["_k", "_s"])
    return index.join(body, F.col("key").eqNullSafe(F.col("_k")) & (F.col("sha256") == F.col("_s"))).drop("_k", "_s")


@dataclass
class Tree:
    """Levels of a replica from its records to the root, each (node, first, last, hash); node n of a level holds n * fan_out .. of the one below."""

    levels: list[DataFrame]
    fan_out: int


def tree(records: DataFrame, height: int, store: Staged, fan_out: int = 16) -> Tree:
    """The hash tree over records (seq, file, offset, length, sha256); ``height`` levels above the leaves end in one root."""
    leaf = records.select(F.col("seq").alias("node"), F.col("seq").alias("first"), F.col("seq").alias("last"), F.sha2(F.concat_ws(":", "file", "offset", "length", "sha256").cast("binary"), 256).alias("hash"))
    levels = [store.put(leaf)]
    for _ in range(height):
        child = F.sort_array(F.collect_list(F.struct("node", "hash")))  # fan_out children at most
        up = levels[-1].groupBy(F.expr(f"node div {fan_out}").alias("node")).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sha2(F.array_join(F.transform(child, lambda c: F.concat_ws(":", c["node"], c["hash"])), ",").cast("binary"), 256).alias("hash"))
        levels.append(store.put(up))
    return Tree(levels, fan_out)


def height_for(records: int, fan_out: int = 16) -> int:
    h = 0
    while records > 1:
        records, h = -(-records // fan_out), h + 1
    return h


def audit(a: Tree, b: Tree) -> DataFrame:
    """Leaves that differ between two trees of one height: node (seq), hash_a, hash_b; null where a replica lacks the record."""

    def differing(level: int, within: DataFrame | None) -> DataFrame:
        sides = []
        for t, name in ((a, "hash_a"), (b, "hash_b")):
            rows = t.levels[level].select("node", F.col("hash").alias(name))
            if within is not None:
                rows = rows.join(within.select(F.col("node").alias("up")), F.expr(f"node div {t.fan_out}") == F.col("up"), "left_semi")
            sides.append(rows)
        return sides[0].join(sides[1], "node", "full_outer").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))

    found = None
    for level in range(len(a.levels) - 1, -1, -1):
        found = differing(level, found)
    return found


def parse_warc(data: bytes) -> list[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of the records of an uncompressed WARC file; a damaged tail is left out."""
    out, at = [], 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            break
        head = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        size = int(head.get("Content-Length", 0))
        stop = end + 4 + size + 4
        if stop > len(data):
            break
        out.append((at, stop - at, head, data[end + 4 : end + 4 + size]))
        at = stop
    return out


def replica(index: DataFrame) -> DataFrame:
    """The replica whose digests are in ``other``; records without one are lost."""
    return index.where("other is not null").withColumn("sha256", F.col("other"))


def op9_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an archive record with the verdict of an audit against a replica with known faults.

    The replica is the archive with a byte changed in pages whose id leaves 7 modulo 1000 and without those that leave 8.
    """
    store = Staged(spark, "fixity")
    records = store.put(archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), store=store, damage=("key % 1000 = 7", "key % 1000 = 8")))
    height = height_for(records.count())
    found = audit(tree(records, height, store), tree(replica(records), height, store)).select(F.col("node").alias("seq"), F.when(F.col("hash_b").isNull(), "missing").otherwise("corrupt").alias("found"))
    out = records.join(found, "seq", "left").select(F.col("key").alias("page_id"), "file", "offset", "length", "sha256", F.coalesce("found", F.lit("ok")).alias("status"))
    return store.final(out)


OP9_SQL = """
WITH r AS (
  SELECT page_id, row_number() OVER (ORDER BY page_id NULLS FIRST, url NULLS FIRST, html NULLS FIRST) - 1 AS seq,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages)
SELECT page_id, seq // 1024 AS file,
  CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY seq // 1024 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS sha256,
  CASE WHEN page_id % 1000 = 7 THEN 'corrupt' WHEN page_id % 1000 = 8 THEN 'missing' ELSE 'ok' END AS status
FROM r
"""
