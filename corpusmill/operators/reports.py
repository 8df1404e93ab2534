"""Counts, histograms and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def histogram_of_counts(df: DataFrame, key: str) -> DataFrame:
    """times, keys: how many keys occur so often."""
    return counts(df, key).groupBy(F.col("n").alias("times")).agg(F.count(F.lit(1)).alias("keys"))


def count_bounds(df: DataFrame, key: str, *by: str) -> DataFrame:
    """Least and greatest count of a key, overall or by more columns; 0 without rows."""
    per = counts(df, *by, key)
    return per.groupBy(*by).agg(F.coalesce(F.min("n"), F.lit(0)).alias("least"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count(F.lit(1)).alias("keys"))


def mean_skip_nan(c: Column) -> Column:
    """Mean of what is neither null nor NaN; null if nothing is."""
    return F.avg(F.when(~F.isnan(c), c))


#: What an evaluation's report holds, and where a row has it.
EVALUATION = {
    "mean_total_reward": "reward.score", "mean_gated_reward": "reward.gated_score", "mean_text_reward": "text_reward.score", "mean_label_score": "text_reward.label_score.score",
    "mean_planning_score": "text_reward.planning_score.score", "mean_image_reward": "image_reward.score", "mean_reference_reward": "reference_reward.score",
    "mean_combined_image_reward": "reward.combined_image_score", "mean_infrared_psnr": "reference_reward.infrared.psnr", "mean_infrared_ssim": "reference_reward.infrared.ssim",
    "mean_visible_psnr": "reference_reward.visible.psnr", "mean_visible_ssim": "reference_reward.visible.ssim", "mean_fused_psnr": "reference_reward.fused.psnr", "mean_fused_ssim": "reference_reward.fused.ssim",
}


def evaluation(rows: DataFrame, root: str, metrics: dict[str, str] = EVALUATION) -> DataFrame:
    """One row: eval_root, num_samples, num_gate_ok, and each metric's mean over the rows that have it (null without one). rows: records as VARIANT in column `record`, whatever
    parts each of them has; what is no number, or NaN, counts as not there. No rows: counts 0. One scan, partial aggregates."""
    # A string or a boolean is no number, though a cast would make it one.
    number = lambda path: F.when(F.schema_of_variant(F.try_variant_get("record", f"$.{path}", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("record", f"$.{path}", "double"))
    ok = F.coalesce(F.try_variant_get("record", "$.format_gate.ok", "boolean"), F.lit(False))
    return rows.agg(F.lit(root).alias("eval_root"), F.count(F.lit(1)).alias("num_samples"), F.count_if(ok).alias("num_gate_ok"), *[mean_skip_nan(number(path)).alias(name) for name, path in metrics.items()])


def share(condition: Column, of: Column | None = None) -> Column:
    """Rows with the condition over rows (of a kind), 0 without any."""
    total = F.count(F.lit(1)) if of is None else F.count_if(of)
    return F.count_if(condition if of is None else condition & of) / F.greatest(total, F.lit(1))


def latest(df: DataFrame, keys: list[str], by: list, first_of: list) -> DataFrame:
    """The row with the greatest `by`, the first of equals by `first_of`. With no keys the whole table is one group (a top row, not a window)."""
    order = [F.desc(c) for c in by] + list(first_of)
    if not keys:
        return df.orderBy(*order).limit(1)
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def throughput(elapsed: Column, steps: Column, plans=(33, 66)) -> list[Column]:
    """Seconds a step and hours of each plan's steps; null without steps."""
    per = F.try_divide(elapsed, steps)
    return [per.alias("sec_per_step"), *[(per * n / 3600).alias(f"hours_{n}") for n in plans]]


def macro_average(df: DataFrame, stratum: str, value: str) -> DataFrame:
    """The mean of the strata's means."""
    return df.groupBy(stratum).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("value"))


def level_averages(df: DataFrame, stratum: str, level: str, value: str) -> DataFrame:
    """The mean of the strata's means of each level, and of all (level null)."""
    return df.groupBy(level, stratum).agg(F.avg(value).alias("m")).groupingSets([[F.col(level)], []], level).agg(F.avg("m").alias("value"), F.count(F.lit(1)).alias("strata"))


def rolled_up(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """n and total of each level's groups, of the levels above, and of all (null where a level is summed over)."""
    return df.rollup(*levels).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def not_yet(strata: DataFrame, scenes: DataFrame, done: DataFrame, stratum: str, scene: str, most: int = 100_000) -> DataFrame:
    """Rows of strata with each scene (column `scene` of scenes) that `done` (stratum, scene) does not hold.

    Strata times scenes is what a catalogue is, so scenes are put in one list, of `most` different ones at most (more fail the job), and each stratum's row is
    exploded by it; rows are spread by what they hold, and no join without a key takes place. Null scenes are none.
    """
    names = scenes.agg(F.array_sort(F.collect_set(scene)).alias("s")).select(F.when(F.size("s") <= most, F.col("s")).otherwise(F.raise_error(F.lit(f"more than {most} scenes")).cast("array<string>")).alias("s")).scalar()
    every = strata.withColumn(scene, F.explode(names))
    return every.join(done.select(stratum, scene).distinct(), [stratum, scene], "left_anti")


def missing_from(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def conflicts(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys with different payloads: never settled silently."""
    return df.groupBy(key).agg(F.count_distinct(payload).alias("payloads")).where("payloads > 1")


def pending(df: DataFrame, done: DataFrame, key: str, *more: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose key is in none of the tables."""
    out = df.join(done.select(key).distinct(), key, "left_anti")
    for table, k in more:
        out = out.join(table.select(k).distinct(), k, "left_anti")
    return out


def with_cache(df: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with what the cache holds for them, and the rows that it lacks."""
    return df.join(cache, key, "left"), df.join(cache.select(key).distinct(), key, "left_anti")


def merged_metrics(df: DataFrame, weighted: dict[str, str], largest: list[str], *keys: str) -> DataFrame:
    """Means weighted by a column each, and maxima, over parts; one row, or one for each of the keys."""
    return df.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(v) * F.col(w)), F.sum(w)).alias(v) for v, w in weighted.items()], *[F.max(c).alias(c) for c in largest])
