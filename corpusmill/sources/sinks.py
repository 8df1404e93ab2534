"""Sinks. Spark's commit protocol makes each write all or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def report(row: DataFrame, path: str) -> None:
    """A report is one row."""
    row.limit(1).coalesce(1).write.mode("overwrite").json(path)


def sample_rows(df: DataFrame, path: str, key: str = "id") -> None:
    """A sample's results as one row (text, status, image paths), laid out by id, instead of a folder for each. Two rows of one id fail the job."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1)
    if n:
        raise ValueError(f"more than one row for {key} {n[0][0]}")
    by_id(df, path, key)


def progress(spark, path: str, done: int, total: int) -> None:
    """A marker of how far a run is: its index, or `finished`. It replaces the last one."""
    spark.createDataFrame([("finished" if done >= total else str(done),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_judgements(df: DataFrame, path: str) -> None:
    """Only judgements without an error are kept for reuse."""
    append(df.where("coalesce(error, '') = ''"), path)


def new_only(df: DataFrame, path: str) -> None:
    """Fails if path is there."""
    df.write.mode("errorifexists").parquet(path)


def all_and_short(df: DataFrame, path: str, length: Column, most: int) -> None:
    """All rows, and those up to a length, in one write: a partition for each kind, and the whole is both."""
    df.withColumn("short", length <= most).write.mode("overwrite").partitionBy("short").parquet(path)


def by_id(df: DataFrame, path: str, key: str = "id", parts: int = 64) -> None:
    """Records laid out by a hash of their id, for lookups."""
    df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts))).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def bundle_plan(items: DataFrame, key: str, columns: list[str], root: str = "files") -> tuple[DataFrame, DataFrame]:
    """Items with paths relative to a bundle, and what to copy where (path, target), each file once. Names keep a hash of the folder, so equal names do not meet."""
    target = lambda c: F.when(T.given(c).isNotNull(), F.concat(F.lit(root + "/"), F.substring(F.md5(c), 1, 8), F.lit("_"), T.safe_name(F.element_at(F.split(c, "/"), -1))))
    long = items.unpivot([key], columns, "key", "path").where(T.given(F.col("path")).isNotNull()).select("path").distinct()
    return items.withColumns({c: target(F.col(c)) for c in columns}), long.withColumn("target", target(F.col("path")))


def copy_bundle(plan: DataFrame, folder: str) -> DataFrame:
    """Copies by plan into folder (a place that all executors see) and returns path, target, bytes, sha256."""

    def run(batches):
        import hashlib
        import os
        import uuid

        import pandas as pd
        from pyarrow import fs

        for pdf in batches:
            rows = []
            for path, target in zip(pdf["path"], pdf["target"]):
                store, at = fs.FileSystem.from_uri(path)
                to_store, to = fs.FileSystem.from_uri(f"{folder}/{target}")
                to_store.create_dir(os.path.dirname(to), recursive=True)
                digest, n, part = hashlib.sha256(), 0, f"{to}.{uuid.uuid4().hex}"
                with store.open_input_stream(at) as src, to_store.open_output_stream(part) as dst:
                    while block := src.read(1 << 20):
                        digest.update(block)
                        n += len(block)
                        dst.write(block)
                to_store.move(part, to)
                rows.append((path, target, n, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "target", "bytes", "sha256"])

    return plan.select("path", "target").mapInPandas(run, "path string, target string, bytes long, sha256 string")


def totals(digests: DataFrame) -> DataFrame:
    return digests.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
