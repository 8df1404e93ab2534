"""JSON arrays as elements with their numbers, of any schema: VARIANT values that are typed later, and errors that name file and element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def exploded(df: DataFrame, text: str) -> DataFrame:
    """df with element (from 0), value (VARIANT) and error, a row for each element of the JSON array in column `text`.

    What is no array, or no JSON, is one row with an error and no element. A null text or an empty array has no row. `text` itself is not kept.
    """
    spark = df.sparkSession
    d = df.where(F.col(text).isNotNull()).withColumn("_v", F.try_parse_json(text))
    kind = F.schema_of_variant("_v")
    d = d.withColumn("_ok", F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False)))
    names = [c for c in df.columns if c != text]
    good = d.where("_ok").lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(*names, F.col("pos").alias("element"), "value", F.lit(None).cast("string").alias("error"))
    why = F.when(F.col("_v").isNull(), F.lit("no JSON")).otherwise(F.concat(F.lit("no array: "), kind))
    return good.unionByName(d.where("not _ok").select(*names, F.lit(None).cast("int").alias("element"), F.lit(None).cast("variant").alias("value"), why.alias("error")))


def array_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source_file, element, value, error of files that hold one array each."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
    return exploded(whole.withColumnRenamed("value", "_text"), "_text")


def typed(elements: DataFrame, schema: str, into: str = "item") -> DataFrame:
    """elements with the value as `schema` (DDL of a struct), or an error that names the element: one that is no object, or does not fit."""
    item = F.try_variant_get("value", "$", f"struct<{schema}>")
    # A VARIANT null is a value, but no object.
    shape = F.schema_of_variant("value")
    bad = F.when(~F.startswith(shape, F.lit("OBJECT")), F.concat(F.lit("no object: "), shape)).when(item.isNull(), F.lit("does not fit"))
    return elements.withColumn("error", F.coalesce("error", F.when(F.col("value").isNotNull(), bad))).withColumn(into, F.when(F.col("error").isNull(), item)).drop("value")


def required(elements: DataFrame, name: Column, into: str = "item") -> DataFrame:
    """Fails on the first element with an error met, naming where it stands (`name`, such as the file) and its number from 0."""
    said = F.concat(F.coalesce(name.cast("string"), F.lit("?")), F.lit(": element "), F.coalesce(F.col("element").cast("string"), F.lit("-")), F.lit(": "), F.col("error"))
    return elements.withColumn(into, F.when(F.col("error").isNotNull(), F.raise_error(said).cast(elements.schema[into].dataType)).otherwise(F.col(into)))


def drifts(elements: DataFrame) -> DataFrame:
    """shape: the one schema that all values fit, over all rows; and n values. VARIANT where fields differ in kind."""
    return elements.where("value is not null").agg(F.schema_of_variant_agg("value").alias("shape"), F.count(F.lit(1)).alias("n"))
