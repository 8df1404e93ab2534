"""Completions put together from their side tables, on tables bucketed by what they are joined on."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import new_path

MODALITIES = ("infrared", "visible", "fused")


def bucketed(df: DataFrame, *keys: str, buckets: int = 16, name: str = "bucketed") -> DataFrame:
    """df written in buckets of its keys and read back: tables with the same buckets join on these keys without an exchange, as often as one likes. Lies in the shared folder."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", new_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def assembled(status: DataFrame, samples: DataFrame, texts: DataFrame, images: DataFrame, folder: str = "folder") -> DataFrame:
    """status with sample (struct of the sample's columns, null without one), text ('' without one) and images (modality -> path), missing (what is not there, in order).

    samples and texts have a row a folder at most; images has folder, modality, path, of several for one modality the least path counts, and paths that are null are not there.
    A folder that only side tables know is no completion. Null folders have no side rows.
    """
    of = lambda m: F.min(F.when(F.col("modality") == m, F.col("path")))
    pictures = images.groupBy(folder).agg(*[of(m).alias(f"_{m}") for m in MODALITIES])
    sample = samples.select(folder, F.struct(*[c for c in samples.columns if c != folder]).alias("sample"))
    out = status.join(sample, folder, "left").join(texts.select(folder, F.col("text").alias("_text")), folder, "left").join(pictures, folder, "left")
    found = F.map_filter(F.create_map(*[x for m in MODALITIES for x in (F.lit(m), F.col(f"_{m}"))]), lambda k, v: v.isNotNull())
    gone = [F.when(F.col("sample").isNull(), "sample"), F.when(F.col("_text").isNull(), "text"), *[F.when(F.col(f"_{m}").isNull(), m) for m in MODALITIES]]
    return out.select(*status.columns, "sample", F.coalesce("_text", F.lit("")).alias("text"), found.alias("images"), F.array_compact(F.array(*gone)).alias("missing"))


def paired(predictions: DataFrame, truths: DataFrame, key: str = "id") -> DataFrame:
    """Each prediction beside the truth of its own (key, modality), and what only one side has: key, modality, prediction, truth (structs), prediction_exists, truth_exists.

    Rows of one (key, modality) all pair with each other's; null keys or modalities pair with nothing.
    """
    side = lambda d, n: d.select(key, "modality", F.struct(*[c for c in d.columns if c not in (key, "modality")]).alias(n))
    out = side(predictions, "prediction").join(side(truths, "truth"), [key, "modality"], "full")
    return out.select(key, "modality", "prediction", "truth", F.col("prediction").isNotNull().alias("prediction_exists"), F.col("truth").isNotNull().alias("truth_exists"))


def metric_record(pairs: DataFrame, key: str, metrics: dict[str, Column]) -> DataFrame:
    """A row a key: for each modality a struct of prediction_exists, truth_exists and the metrics (null where a side is missing), and complete: all pairs are there."""
    both = F.col("prediction_exists") & F.col("truth_exists")
    rows = pairs.select(key, "modality", "prediction_exists", "truth_exists", *[F.when(both, c).alias(n) for n, c in metrics.items()])
    value = F.struct("prediction_exists", "truth_exists", *metrics)
    absent = F.struct(F.lit(False).alias("prediction_exists"), F.lit(False).alias("truth_exists"), *[F.lit(None).cast("double").alias(n) for n in metrics])
    out = rows.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col("modality") == m, value)), absent).alias(m) for m in MODALITIES])
    there = [F.col(m)[x] for m in MODALITIES for x in ("prediction_exists", "truth_exists")]
    complete = there[0]
    for t in there[1:]:
        complete = complete & t
    return out.withColumn("complete", complete)
