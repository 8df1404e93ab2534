"""Sampling without state: order by a seeded hash of the key, so results do not depend on the order of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def seeded(seed: str, *parts) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]))


def ranked(df: DataFrame, stratum: str, key: str, seed: str) -> DataFrame:
    """pick: a row's place in its stratum's seeded order."""
    return df.withColumn("pick", F.row_number().over(W.partitionBy(stratum).orderBy(seeded(seed, stratum, key), key)))


def quota_sample(df: DataFrame, quotas: DataFrame, stratum: str, key: str, seed: str) -> DataFrame:
    """The first rows of each stratum by quota (stratum, quota). A smaller quota gives a part of a larger one's sample.
    The largest quota, as a literal, lets Spark keep no more rows than that of a stratum in each task before the shuffle."""
    most = quotas.agg(F.max("quota")).first()[0] or 0
    return ranked(df, stratum, key, seed).where(F.col("pick") <= int(most)).join(quotas, stratum).where("pick <= quota").drop("quota")


def shortfalls(df: DataFrame, quotas: DataFrame, stratum: str) -> DataFrame:
    """Strata with fewer rows than their quota: stratum, quota, available."""
    have = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("available"))
    return quotas.join(have, stratum, "left").withColumn("available", F.coalesce("available", F.lit(0))).where("available < quota")


def scene_disjoint_sample(df: DataFrame, quotas: dict, stratum: str, scene: str, key: str, seed: str, used: DataFrame | None = None, save=None, split=None) -> DataFrame:
    """Quota per stratum with one row for each scene, and no scene that an earlier stratum (in sorted order) or `used` has.
    A step for each stratum: quotas are a short control table. save(df) writes each step, so that later ones do not run it again;
    split(df, stratum) parts the input first, so that each step reads its own stratum alone."""
    out, df = None, split(df, stratum) if split else df
    for name in sorted(quotas):
        rows = df.where(F.col(stratum) == name)
        for seen in (used, out):
            if seen is not None:
                rows = rows.join(seen.select(scene).distinct(), scene, "left_anti")
        rows = rows.withColumn("_order", seeded(seed, stratum, key))
        first = rows.withColumn("_n", F.row_number().over(W.partitionBy(scene).orderBy("_order", key))).where("_n = 1")
        step = first.orderBy("_order", key).limit(quotas[name]).drop("_order", "_n")
        step = save(step) if save else step
        out = step if out is None else out.unionByName(step)
    return out


def balanced_sample(df: DataFrame, n: int, stratum: str, scene: str, level: str, key: str, seed: str, save=None, split=None) -> DataFrame:
    """n rows of each stratum with n or more, smallest stratum first; within one, scenes least used on its level, then
    least used at all, then by seeded order. Counts do not change within a stratum, so a scene can come twice in one.
    save(df) writes each step, so that later ones do not run it again; without it the plan is one query. split(df, stratum) parts
    the input first, so that each step reads its own stratum alone."""
    df = split(df, stratum) if split else df
    sizes = sorted((r["count"], r[0]) for r in df.groupBy(stratum).count().collect())
    out = None
    for size, name in sizes:
        if size < n:
            continue
        rows = df.where(F.col(stratum) == name).withColumn("_order", seeded(seed, stratum, key))
        if out is None:
            rows = rows.withColumn("_level", F.lit(0)).withColumn("_all", F.lit(0))
        else:
            on_level = out.groupBy(level, scene).agg(F.count(F.lit(1)).alias("_level"))
            at_all = out.groupBy(scene).agg(F.count(F.lit(1)).alias("_all"))
            rows = rows.join(on_level, [level, scene], "left").join(at_all, scene, "left").fillna(0, ["_level", "_all"])
        step = rows.orderBy("_level", "_all", "_order", key).limit(n).select(*df.columns)
        step = save(step) if save else step
        out = step if out is None else out.unionByName(step)
    return out if out is not None else df.limit(0)


def skipped_strata(df: DataFrame, n: int, stratum: str) -> DataFrame:
    return df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < n)


def epoch_order(key: str, seed: int, epoch: int) -> Column:
    return seeded(str(seed + epoch * 100003), key)


def _long(n: int | Column) -> Column:
    return (n if isinstance(n, Column) else F.lit(n)).cast("long")


def batch_slots(df: DataFrame, ordinal: str, total: int | Column, world: int, size: int) -> DataFrame:
    """batch, rank, slot of each row by its 0-based place; the rows past the last whole round are left out. total may be a scalar subquery."""
    per = world * size
    at = F.col(ordinal)
    kept = df.where(at < _long(total) - F.pmod(_long(total), F.lit(per)))
    return kept.select("*", F.floor(at / per).alias("batch"), F.floor(F.pmod(at, F.lit(per)) / size).alias("rank"), F.pmod(at, F.lit(size)).alias("slot"))


def modulo_shard(df: DataFrame, ordinal: str, shards: int, shard: int) -> DataFrame:
    return df.where(F.pmod(F.col(ordinal), F.lit(shards)) == shard)


def range_shard(df: DataFrame, ordinal: str, total: int | Column, shards: int, shard: int) -> DataFrame:
    """One of `shards` blocks of equal length. total may be a scalar subquery."""
    block = F.floor((_long(total) + shards - 1) / shards)
    return df.where((F.col(ordinal) >= block * shard) & (F.col(ordinal) < block * (shard + 1)))


def priority_dedup(df: DataFrame, keys: list[str], quality: str, order: str) -> DataFrame:
    """The row of highest quality of each key, the first of equals."""
    w = W.partitionBy(*keys).orderBy(F.desc(quality), order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
