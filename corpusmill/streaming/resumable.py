"""Streams that can be killed and started again: batches committed once, and their progress as a table.

A batch is written to a folder named by its number (`batch=7`), replacing what an earlier, broken try left there, and counts as committed once
Spark's own commit marks the folder. A restarted stream takes the offsets that its checkpoint logged for the batch, so the rows of a batch are the same on each try,
and readers see each batch whole and once, or not at all.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.tables import filesystem

BATCH = "batch"


def file_stream(spark: SparkSession, folder: str, schema, *, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream over the files of a folder as they arrive; a file is taken once."""
    reader = spark.readStream.format(kind).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def _own_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)


def committed_batches(target: str) -> list[int]:
    """The numbers of the batches that are written whole: a control list, one number a batch."""
    from pyarrow import fs

    store, path = filesystem(_own_uri(target))
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
    return sorted(int(os.path.basename(os.path.dirname(f.path)).split("=")[1]) for f in found if f.base_name == "_SUCCESS" and os.path.basename(os.path.dirname(f.path)).startswith(BATCH + "="))


def committed(spark: SparkSession, target: str, schema, *, kind: str = "parquet", since: int = 0) -> DataFrame:
    """The rows of all whole batches from `since` on, with their batch. No batch: no rows. A batch that is being written is not seen."""
    batches = [b for b in committed_batches(target) if b >= since]
    # The reader lists folders itself; a batch is one of the path's partitions.
    if not batches:
        return spark.createDataFrame([], schema).withColumn(BATCH, F.lit(None).cast("long"))
    rows = spark.read.format(kind).schema(schema).option("basePath", target).load([f"{target}/{BATCH}={b}" for b in batches])
    return rows.withColumn(BATCH, F.col(BATCH).cast("long"))


def start(stream: DataFrame, target: str, checkpoint: str, *, kind: str = "parquet", name: str | None = None, each: Callable[[DataFrame, int], DataFrame] | None = None, mode: str = "append", available: bool = True, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Start, or go on with, the stream of that checkpoint, writing each batch below target.

    each(rows, batch) may change a batch before it is written; like any batch code it may run more than once and must give equal rows for equal input.
    after(batch) runs when a batch is written and before the checkpoint says so; what it raises stops the stream there, and the next start writes that batch again.
    available: stop when all that is there now is taken, else go on.
    """

    def commit(rows: DataFrame, batch: int) -> None:
        (each(rows, batch) if each else rows).write.mode("overwrite").format(kind).save(f"{target}/{BATCH}={batch}")
        if after:
            after(batch)

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).outputMode(mode)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(availableNow=True) if available else writer).start()


def unfinished(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no committed result, for a start without a checkpoint: the output itself says what is done. Null keys are never done."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


class ProgressTable(StreamingQueryListener):
    """A listener that appends what streams do to a table of JSON lines: a row for each start, batch and end.

    kind (started, batch, idle, ended), at, query, run, name, batch, rows, rows_per_second, phases (milliseconds of each), watermark, state_rows, late_rows, error.
    A row is one small file, written whole under a name of its own by the driver (control data: one a batch); what a listener raises never stops a stream.
    """

    SCHEMA = "kind string, at string, query string, run string, name string, batch long, rows long, rows_per_second double, phases map<string,long>, watermark string, state_rows long, late_rows long, error string"

    def __init__(self, folder: str):
        self.folder, self.count = folder, 0
        self.store, self.path = filesystem(_own_uri(folder))
        self.store.create_dir(self.path, recursive=True)

    def _append(self, row: dict) -> None:
        self.count += 1
        name = f"{self.path}/{time.time_ns():020d}-{self.count:06d}-{row['kind']}.json"
        with self.store.open_output_stream(name) as f:
            f.write(json.dumps(row).encode())

    def onQueryStarted(self, event) -> None:
        self._append({"kind": "started", "at": event.timestamp, "query": str(event.id), "run": str(event.runId), "name": event.name})

    def _progress(self, p, kind: str) -> None:
        state = p.stateOperators
        self._append({
            "kind": kind, "at": p.timestamp, "query": str(p.id), "run": str(p.runId), "name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond,
            "phases": dict(p.durationMs), "watermark": dict(p.eventTime or {}).get("watermark"), "state_rows": sum(s.numRowsTotal for s in state), "late_rows": sum(s.numRowsDroppedByWatermark for s in state),
        })

    def onQueryProgress(self, event) -> None:
        self._progress(event.progress, "batch")

    def onQueryIdle(self, event) -> None:
        self._append({"kind": "idle", "at": event.timestamp, "query": str(event.id), "run": str(event.runId)})

    def onQueryTerminated(self, event) -> None:
        self._append({"kind": "ended", "query": str(event.id), "run": str(event.runId), "error": event.exception})

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.SCHEMA).json(self.folder)

    def wait_ended(self, query: StreamingQuery, seconds: float = 30) -> bool:
        """Events arrive behind the stream: wait until the end of this run is in the table."""
        from pyarrow import fs

        until = time.time() + seconds
        while time.time() < until:
            for f in self.store.get_file_info(fs.FileSelector(self.path)):
                if f.base_name.endswith("-ended.json"):
                    with self.store.open_input_stream(f.path) as s:
                        if json.loads(s.read())["run"] == str(query.runId):
                            return True
            time.sleep(0.1)
        return False


def batches_of(progress: DataFrame, name: str | None = None) -> DataFrame:
    """batch, rows, tries, milliseconds of each committed batch of a stream: the last report of a batch stands, as a broken try reports none."""
    p = progress.where("kind = 'batch'")
    if name:
        p = p.where(F.col("name") == name)
    return p.groupBy("query", "batch").agg(F.max_by("rows", "at").alias("rows"), F.count(F.lit(1)).alias("reports"), F.max_by(F.col("phases")["triggerExecution"], F.col("at")).alias("milliseconds"))
