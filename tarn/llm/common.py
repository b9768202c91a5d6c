"""What the training-data operators share: staged tables, lineage cuts and Arrow batch helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Spark removes a statement's shuffle files when the statement ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local run takes a folder of its own; elsewhere that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset; on {master} it must name a folder that driver and executors share")
        d = f"file://{tempfile.gettempdir()}/tarn-shared"
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


class Staged:
    """Tables written under the shared folder. ``drop`` and ``last_only`` remove those that nothing reads any more; the rest go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/tarn-{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._gone)

    def write(self, df: DataFrame, partition_by: str | None = None) -> str:
        """Write ``df`` as Parquet under a fresh path; executors lost later don't lose it."""
        self.n += 1
        path, before = f"{self.root}/{self.n}", self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            w = df.write.option("compression", "zstd")
            (w.partitionBy(partition_by) if partition_by else w).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return path

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back: a lineage cut whose plan is a scan."""
        schema = df.schema
        return self.spark.read.schema(schema).parquet(self.write(df))

    def drop(self, *paths: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for p in paths:
            hp = jvm.org.apache.hadoop.fs.Path(p)
            hp.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hp, True)

    def last_only(self) -> None:
        """Remove all tables but the one written last, when only that is read from now on."""
        self.drop(*[f"{self.root}/{i}" for i in range(1, self.n)])

    def final(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as an operator's result and remove all tables it was made from."""
        out = self.put(df)
        self.last_only()
        return out

    def _gone(self) -> None:
        with contextlib.suppress(Exception):  # the session may have stopped
            self.drop(self.root)


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that what a step makes of long texts stays small."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def fold64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
