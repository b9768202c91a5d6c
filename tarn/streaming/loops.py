"""The periodic loops as Structured Streaming: counters with watermarks, rate windows, batch triggers, queues with time limits."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from tarn.lineage import checkpoint_dir


def operation_counters(log: DataFrame, site: str, op: str, ts: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Operations by site and time window; rows later than the watermark are dropped."""
    at = log.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    out = at.groupBy(F.window("_at", window).alias("w"), F.col(site), F.col(op)).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), site, op, "n")


def host_rates(requests: DataFrame, host: str, ts: str, period: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Requests of a host in each period."""
    at = requests.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return at.groupBy(F.window("_at", period).alias("w"), F.col(host)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), host, "n")


class Limiter(StatefulProcessor):
    """Admits a request of a key when ``gap`` seconds have passed since the last one it admitted."""

    def __init__(self, key: str, ts: str, gap: float):
        self.key, self.ts, self.gap = key, ts, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        every = pd.concat(list(rows))
        every = every.sort_values([self.ts, *(c for c in every.columns if c != self.ts)])
        keep = []
        for t in every[self.ts]:
            t = t.to_pydatetime()
            keep.append(last is None or (t - last).total_seconds() >= self.gap)
            if keep[-1]:
                last = t
        if last is not None:
            self.last.update((last,))
        yield every[keep]

    def close(self) -> None:
        pass


def limited(requests: DataFrame, key: str, ts: str, gap: float) -> DataFrame:
    """A stream of requests through a ``Limiter`` for each key; needs the RocksDB state store."""
    df = requests.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=Limiter(key, ts, gap), outputStructType=df.schema, outputMode="Append", timeMode="None")


class Queue(StatefulProcessor):
    """Tasks by id: a finished one is reported at once, one without an update for ``ttl_ms`` of event time as expired."""

    def __init__(self, state: str, ts: str, done: str, ttl_ms: int):
        self.state, self.ts, self.done, self.ttl_ms = state, ts, done, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "due long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        if (every[self.state] == self.done).any():
            self.due.clear()
            yield pd.DataFrame({"id": [str(key[0])], "outcome": ["finished"]})
        else:
            due = int(every[self.ts].max().timestamp() * 1000) + self.ttl_ms
            self.handle.registerTimer(due)
            self.due.update((due,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.due.clear()
        yield pd.DataFrame({"id": [str(key[0])], "outcome": ["expired"]})

    def close(self) -> None:
        pass


def task_outcomes(updates: DataFrame, key: str, state: str, ts: str, done: str, ttl_ms: int, late: str = "0 seconds") -> DataFrame:
    """(id, outcome) of tasks; needs the RocksDB state store."""
    df = updates.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=Queue(state, ts, done, ttl_ms), outputStructType="id string, outcome string", outputMode="Append", timeMode="EventTime")


def every(trigger_rows: DataFrame, period: str | None, checkpoint: str, step: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A periodic loop: ``step`` runs a batch plan (selection, purge, aging, recrawl, return of stuck URLs) at every trigger; without a period once over what is there."""
    w = trigger_rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return w.trigger(processingTime=period) if period else w.trigger(availableNow=True)


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there, as a table under the shared folder."""
    root = f"{checkpoint_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"

    def put(rows: DataFrame, batch: int) -> None:
        # a batch that is repeated after a failure replaces what it wrote
        rows.write.mode("overwrite").parquet(f"{root}/rows" if mode == "complete" else f"{root}/rows/batch={batch}")

    df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/rows").select(*df.columns)
