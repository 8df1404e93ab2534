"""What the operators share: shipping the package, Arrow maps, word splitting; tables in the shared folder."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.shipping import ship
from ..sources.tables import filesystem, new_path, shared_dir, written  # noqa: F401 (the operators take them from here)

#: Bytes of A-Z to a-z.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Java regular expression of a word of the contracts: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bounds of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow with the package shipped. Batches have BATCH_ROWS rows and BATCH_BYTES bytes at most: the session's
    settings are lowered to that where they are higher, and left so, as a plan reads them when it runs."""
    spark = df.sparkSession
    ship(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key)
        number = int(re.match(r"-?\d+", now)[0])
        if number <= 0 or number > most or not now.isdigit():
            spark.conf.set(key, str(most))
    return df.mapInArrow(fn, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


#: Odd multipliers; each gives an independent family of hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _joined(a: np.ndarray, b: np.ndarray, base: np.uint64) -> np.ndarray:
    """A hash of two neighbours' hashes. The shift between the products keeps the whole from being a polynomial, whose values collide for some texts at any base."""
    x = a * base
    x += b
    x ^= x >> np.uint64(29)
    return x


def grams(symbols: np.ndarray, width: int, base: int) -> np.ndarray:
    """The hash of each run of `width` symbols (uint64), from hashes of runs of 1, 2, 4 and so on."""
    if len(symbols) < width:
        return np.zeros(0, np.uint64)
    m, n = np.uint64(base), 1
    level = symbols * m
    level ^= level >> np.uint64(31)
    while 2 * n <= width:
        level = _joined(level[:-n], level[n:], m)
        n *= 2
    if width > n:
        level = _joined(level[: len(level) - (width - n)], level[width - n :], m)
    return mix64(level + np.uint64(width))


def slices(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """The hash of each [start, end): of its length and the runs of a power of two that it starts and ends with, which cover it."""
    length = end - start
    out = length.astype(np.uint64)
    if not len(out):
        return out
    m, n = np.uint64(base), 1
    level = symbols * m
    level ^= level >> np.uint64(31)
    most = int(length.max())
    kind = np.frexp(length)[1] - 1  # floor of the logarithm
    while n <= most:
        at = np.flatnonzero(kind == n.bit_length() - 1)
        if len(at):
            out[at] = mix64(_joined(level[start[at]], level[end[at] - n], m) * m + out[at])
        if 2 * n <= most:
            level = _joined(level[:-n], level[n:], m)
        n *= 2
    return out


def sliding(a: np.ndarray, width: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over each window of a."""
    n, out = 1, a
    while 2 * n <= width:
        out = f(out[:-n], out[n:])
        n *= 2
    if width > n:
        out = f(out[: -(width - n)], out[width - n :])
    return out


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least value of some window of that width (minimizers). Two equal windows have them at the same places."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    least = sliding(h, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum) == h)
