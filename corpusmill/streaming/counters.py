"""A counter of flagged rows in a row for each key of a stream, with a limit, as state of its own kind.

Rows may come late and more than once. They wait, by key, time and id, in the state of an aggregation until the watermark has passed them; Spark's engine keeps that
state, so a waiting row costs no call of Python. A key's rows that a batch lets go are then counted at once, in the order of time and id, from the key's counter, and are given out once
with their run; what later batches let go lies behind them. So the result is that of the sorted table, in whatever order and batches rows arrive within the watermark's delay;
rows behind the watermark are left out. Once a run reaches the limit the key is stopped: that row says so, and later rows of the key are not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shipping import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunCounter(StatefulProcessor):
    """State: run, longest, stopped, the last time counted. It is read and written once for all rows of a key in a batch."""

    def __init__(self, limit: int, forget: int):
        self.limit, self.forget = limit, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counter = handle.getValueState("counter", "run long, longest long, stopped boolean, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, longest, stopped, last = self.counter.get() or (0, 0, False, 0)
        due = [] if stopped else sorted(r for pdf in rows for r in zip(pdf["at"].tolist(), pdf["id"].tolist(), pdf["flag"].tolist()))
        out = []
        for at, i, flag in due:
            if last and self.forget and at - last > self.forget * 1000:
                run = longest = 0
            run, last = run + 1 if flag else 0, at
            longest = max(longest, run)
            stopped = 0 < self.limit <= run
            out.append((key[0], at, i, run, longest, stopped))
            if stopped:
                break
        if due:
            self.counter.update((run, longest, stopped, last))
        yield pd.DataFrame(out, columns=["key", "at", "id", "run", "longest", "stopped"])

    def close(self) -> None:
        pass


def counted(stream: DataFrame, key: str, ts: str, row_id: str, flag, *, limit: int = 0, late: str = "10 minutes", forget_ms: int = 0) -> DataFrame:
    """key, ts, row_id, run, longest, stopped of each row that the watermark has passed, up to the row that stops its key. Append mode.

    limit: 0 stops nothing. forget_ms: a key without rows for longer (in event time) starts anew. A null flag is not set; rows with a null key, time or id are left out.
    A row that comes again while it waits is one row, flagged if one of its copies is. The session needs the RocksDB state store (with_rocksdb).
    """
    ship(stream.sparkSession)
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(row_id).cast("long").alias("id"), F.coalesce(flag, F.lit(False)).alias("flag")).dropna()
    # The watermark counts in milliseconds: a row is let go with the others of its millisecond, so none comes behind one that is counted.
    rows = rows.withColumn("at", F.unix_micros("ts")).withColumn("ts", F.date_trunc("millisecond", "ts")).withWatermark("ts", late)
    due = rows.groupBy("key", "ts", "at", "id").agg(F.bool_or("flag").alias("flag"))
    out = due.groupBy("key").transformWithStateInPandas(RunCounter(limit, forget_ms), "key long, at long, id long, run long, longest long, stopped boolean", "Append", "None")
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts), F.col("id").alias(row_id), "run", "longest", "stopped")


class with_rocksdb:
    """Within it, streams of the session keep their state in RocksDB, which state with timers and maps needs; the setting before comes back after."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.KEY)
        self.spark.conf.set(self.KEY, PROVIDER)

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self.KEY, self.before)
