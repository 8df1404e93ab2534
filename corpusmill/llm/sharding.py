"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered in the order of their keys, and a keyed permutation of 0 .. n - 1 (a balanced Feistel network over the next power
of four, walked again while it leads out of the range) sends row r to place p: shard p mod shards, slot p div shards. Shards so differ by one row at
most (the law `rows`), each shard is a random draw of the corpus in random order, and shard and slot of a row, or the row of
a shard's slot, are computed from n and the seed alone. No rows are exchanged to shuffle them, only to number them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.normalize import with_ordinal
from .common import BASES, mix64, ship

SHARDS, SEED, ROUNDS = 16, 20260620, 6


def _keys(seed: int) -> np.ndarray:
    return mix64(np.uint64(seed & 0xFFFFFFFFFFFFFFFF) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(BASES[0]))


def _network(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    """A bijection of [0, 4^half)."""
    low = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & low
    for k in keys:
        left, right = right, left ^ (mix64(right + k) & low)
    return right << np.uint64(half) | left  # turned, so that the reversed keys undo it


def _walked(x: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    half = max(1, (max(n - 1, 0).bit_length() + 1) // 2)
    out = _network(x.astype(np.uint64), half, keys)
    while len(at := np.flatnonzero(out >= n)):
        out[at] = _network(out[at], half, keys)
    return out.astype(np.int64)


def permuted(rows: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The places of row numbers below n."""
    return _walked(rows, n, _keys(seed))


def unpermuted(places: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The row numbers of places below n."""
    return _walked(places, n, _keys(seed)[::-1])


def sharded(docs: DataFrame, *order: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs with row, shard (int) and slot (long); rows are numbered in the order of the columns `order`.

    Name columns that tell different rows apart: rows that agree in all of them are interchangeable, so equal rows may
    stand under any of each other's places and the result as a whole is the same each run. Nulls come first. Equal texts are placed one by one like any other rows. The
    numbered rows are written once; a value that most rows share is split by the rows' places in the input. Columns named row, shard or slot are replaced. Empty table: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.drop("row", "shard", "slot").withColumn("_salt", F.monotonically_increasing_id())
    d = with_ordinal(d, *order, "_salt").drop("_salt").withColumnRenamed("ordinal", "row")
    n = d.count()

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permuted(row.to_numpy(), n, seed))

    d = d.withColumn("_p", place("row"))
    return d.withColumn("shard", F.pmod("_p", F.lit(shards)).cast("int")).withColumn("slot", F.floor(F.col("_p") / shards).cast("long")).drop("_p")


def write_shards(docs: DataFrame, folder: str, *order: str, shards: int = SHARDS, seed: int = SEED, parts: int = 4) -> None:
    """The shards as Parquet below folder, partitioned by shard, each in `parts` ranges of slots, each range sorted by slot."""
    d = sharded(docs, *order, shards=shards, seed=seed)
    d = d.withColumn("_range", F.floor(F.col("slot") * parts / d.agg(F.max("slot") + 1).scalar()))
    d.repartition(shards * parts, "shard", "_range").sortWithinPartitions("shard", "slot").drop("_range").write.partitionBy("shard").parquet(folder)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 1), text_crc32. Null text: size 1, crc32 of nothing."""
    t = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))


def op13_feistel(spark, sf_dir: str) -> DataFrame:
    """Texts are reduced to size and checksum in the scan, so the numbering moves 24 bytes a row; rows of one doc_id are ordered by these."""
    d = sharded(digests(spark.read.parquet(f"{sf_dir}/documents.parquet")), "doc_id", "text_crc32", "size")
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _rounds_sql(source: str) -> str:
    """The network on column p of a table with row, turns, half and low, in DuckDB: products modulo 2^64 go through 128 bits."""
    times = lambda x, c: f"({x}::uhugeint * {c}::uhugeint % 18446744073709551616::uhugeint)::ubigint"
    out = f"select row, turns, half, low, p >> half as l, p & low as r from ({source})"
    for k in _keys(SEED).tolist():
        mixed = f"((r::uhugeint + {k}::uhugeint) % 18446744073709551616::uhugeint)::ubigint as a, xor(a, a >> 31) as b, {times('b', 0xBF58476D1CE4E5B9)} as c, xor(c, c >> 29) as d, {times('d', 0x94D049BB133111EB)} as e"
        out = f"select row, turns, half, low, r as l, xor(l, xor(e, e >> 32) & low) as r from (select *, {mixed} from ({out}))"
    return f"select row, (r << half) | l as p, turns + 1 as turns from ({out})"


#: DuckDB. The checksum goes byte by byte through the table of the usual polynomial; places are walked by recursion.
SQL = f"""
with recursive bits as (
  select 0 as k, i::ubigint as b, i::ubigint as v from range(256) t(i)
  union all select k + 1, b, case when v & 1 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end from bits where k < 8
), crc as (select list(v order by b) as tab from bits where k = 8),
x as (
  select doc_id, strlen(coalesce(text, '')) + 1 as size,
    list_reduce(list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::ubigint)), lambda a, b: xor(tab[(xor(a, b) & 255)::bigint + 1], a >> 8)) as c
  from documents, crc
), y as (select doc_id, size::bigint as size, xor(c, 4294967295::ubigint)::bigint as text_crc32 from x),
h as (select count(*)::ubigint as n, greatest(1, (ceil(log2(greatest(count(*), 1)))::int + 1) // 2) as half, ((1::ubigint << greatest(1, (ceil(log2(greatest(count(*), 1)))::int + 1) // 2)) - 1)::ubigint as low from y),
r as (select *, row_number() over (order by doc_id nulls first, text_crc32, size) - 1 as row from y),
w as (select row, row::ubigint as p, 0 as turns from r union all {_rounds_sql("select w.*, half, low from w, h where turns = 0 or p >= n")})
select doc_id, size, text_crc32, 'rows' as law, (p % {SHARDS})::int as shard, (p // {SHARDS})::bigint as slot, null::int as grown_shard from w join r using (row), h where turns > 0 and p < n
"""
