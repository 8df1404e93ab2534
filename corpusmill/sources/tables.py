"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset: an own one in local mode, else an error, as executors would not see it."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master") or ""):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="corpusmill-shared"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return "file://" + _own_dir[0]


def filesystem(uri: str):
    """The store of a file of the shared folder, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _drop(uri: str) -> None:
    with contextlib.suppress(Exception):  # a store may be gone before the application ends
        store, path = filesystem(uri)
        store.delete_dir(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, path)
    return path


def parted(df: DataFrame, column: str, name: str = "parted") -> DataFrame:
    """written(), with a folder for each value of a column of few values, so that a filter on it reads that folder alone."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
