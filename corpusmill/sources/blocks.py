"""Files of any size, read in pieces: digests of whole files, and of byte ranges that Spark spreads over tasks.

Spark lists the files (their content is pruned, so no row holds a file and its limit of 2 GB does not apply); tasks open them by name and hold
one read at a time.
"""

from __future__ import annotations

import fnmatch
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shipping import ship

READ, RANGE = 1 << 20, 64 << 20


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes of the files below path. Spark lists no files without a byte, so these have no row."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))


def _pieces(path: str, start: int, end: int):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        f.seek(start)
        while start < end and (piece := f.read(min(READ, end - start))):
            start += len(piece)
            yield piece


def _digest(frames):
    for pdf in frames:
        out = []
        for path, start, end in zip(pdf["path"], pdf["start"], pdf["end"]):
            digest, n, error = hashlib.sha256(), 0, None
            try:
                for piece in _pieces(path, start, end):
                    digest.update(piece)
                    n += len(piece)
            except Exception as e:  # an error is a value of the row
                error = f"{type(e).__name__}: {e}"
            out.append((path, start, n, None if error else digest.hexdigest(), error))
        yield pd.DataFrame(out, columns=["path", "start", "bytes", "sha256", "error"])


def _digests(rows: DataFrame) -> DataFrame:
    ship(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "path", "start").mapInPandas(_digest, "path string, start long, bytes long, sha256 string, error string")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256, error of the files below path; a file is read once, in pieces of 1 MB. A file that cannot be read, or goes while it is, has an error and no digest."""
    return _digests(listed(spark, path).select("path", F.lit(0).cast("long").alias("start"), F.col("bytes").alias("end"))).drop("start")


def range_digests(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """path, start, bytes, sha256, error of each range of `size` bytes, so that one large file is many tasks."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size).cast("long")))
    ranges = listed(spark, path).select("path", "bytes", at.alias("start"))
    return _digests(ranges.select("path", "start", F.least(F.col("bytes"), F.col("start") + size).alias("end")))


#: What an export of a model for a new run leaves out.
RUN_FILES = ("optimizer*", "trainer_state.json", "status.json", "logs/*")
SUMS = "SHA256SUMS"


def checksum_list(spark: SparkSession, folder: str, exclude: tuple[str, ...] = (), need: str | None = None) -> DataFrame:
    """path (./ and the place below folder), bytes, sha256, line of the files below folder, but for the list itself and those whose place, or a folder of it, matches a pattern of `exclude`.

    need: a pattern that some file directly in folder must match, else an error. Write `line` in the order of path for a list that checking tools read.
    """
    root = re.sub("^/+", "/", re.sub("^[a-z0-9]+:(?=/)", "", folder)).rstrip("/")
    place = F.substring_index("path", root + "/", -1)
    files = listed(spark, folder).withColumn("_place", place)
    match = lambda p: F.col("_place").rlike(f"(^|/){fnmatch.translate(p)[4:-3]}$")  # noqa: E731  # what stands in (?s:...)
    gone = F.col("_place") == SUMS
    for p in exclude:
        gone = gone | match(p)
    files = files.where(~gone)
    if need and files.where(~F.contains("_place", F.lit("/")) & match(need)).isEmpty():
        raise ValueError(f"no {need} in {folder}")
    names = files.select(F.col("path").alias("_path"), F.concat(F.lit("./"), "_place").alias("_place"))
    out = _digests(files.select("path", F.lit(0).cast("long").alias("start"), F.col("bytes").alias("end"))).join(names, F.col("path") == F.col("_path"))
    return out.select(F.col("_place").alias("path"), "bytes", "sha256", F.concat("sha256", F.lit("  "), "_place").alias("line"))


def changed_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, start, state (new, gone, changed) of ranges that differ between two tables of range_digests()."""
    b = before.select("path", "start", F.col("sha256").alias("_b"), F.lit(True).alias("_in_b"))
    a = after.select("path", "start", F.col("sha256").alias("_a"), F.lit(True).alias("_in_a"))
    state = F.when(F.col("_in_b").isNull(), "new").when(F.col("_in_a").isNull(), "gone").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return b.join(a, ["path", "start"], "full").select("path", "start", state.alias("state")).where("state is not null")
