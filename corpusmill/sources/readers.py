"""Typed readers. Schemas are given, never inferred; order is a column where it matters."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..operators.normalize import PATHS, STAGES

_s = S.StringType()


def _strings(*names: str) -> list[S.StructField]:
    return [S.StructField(n, _s) for n in names]


#: An annotated item; older kinds of it lack some columns.
ITEM = S.StructType([
    *_strings("id", "sample_id", *PATHS, "infrared_label", "visible_label", "infrared_level", "visible_level", "base_image"),
    *_strings(*[f"{s}_cot" for s in STAGES], *[f"{s}_understand" for s in STAGES], "final_cot", "final_answer", "error"),
    S.StructField("cot_valid", S.StructType([S.StructField(s, S.BooleanType()) for s in STAGES])),
    S.StructField("raw_qwen_outputs", S.StructType(_strings(*STAGES))),
])
TOKENS = S.StructType([S.StructField("id", _s), S.StructField("token", S.ArrayType(S.IntegerType())), S.StructField("label", S.ArrayType(S.IntegerType()))])
METRICS = S.StructType([S.StructField(n, S.LongType()) for n in ("micro_step", "update_step")] + [S.StructField(n, S.DoubleType()) for n in ("elapsed_sec", "grad_norm", "replay_logp_max_abs", "max_cuda_memory_gib", "reward_mean")])
STATE = S.StructType([S.StructField(n, S.LongType()) for n in ("micro_step", "update_step", "grad_accum_count", "epoch", "batch_in_epoch")] + [S.StructField("epoch_complete", S.BooleanType())])
CACHE = S.StructType([S.StructField("cache_key", _s), S.StructField("raw", S.MapType(_s, _s)), S.StructField("error", _s)])
_side = S.StructType([S.StructField("score", S.DoubleType()), S.StructField("error", _s)])
REWARDS = S.StructType(
    [S.StructField(n, S.LongType()) for n in ("micro_step", "update_step", "rank", "generation_index", "completion_tokens", "num_generated_images")]
    + _strings("id", "output_dir", "fused_image_path")
    + [S.StructField("reward", S.StructType([S.StructField("score", S.DoubleType()), S.StructField("format_gate", S.StructType([S.StructField("ok", S.BooleanType())])), S.StructField("reference_reward", _side), S.StructField("image_reward", _side)]))]
)


def json_items(spark: SparkSession, paths: str | list[str], schema: S.StructType = ITEM) -> DataFrame:
    """Items of .json (one array a file) and .jsonl files, with the file they came from. A bad element fails the job; another suffix is an error."""
    names = sorted({paths} if isinstance(paths, str) else set(paths))
    kinds: dict[str, list[str]] = {}
    for p in names:
        kinds.setdefault(PurePosixPath(p).suffix.lower(), []).append(p)
    if odd := set(kinds) - {".json", ".jsonl"}:
        raise ValueError(f"unknown suffix: {sorted(odd)}")
    out = None
    for suffix, files in kinds.items():
        df = spark.read.schema(schema).option("multiLine", suffix == ".json").option("mode", "FAILFAST").json(files).withColumn("source_file", F.col("_metadata.file_path"))
        out = df if out is None else out.unionByName(df)
    return out


def head(df: DataFrame, ordinal: str, most: int) -> DataFrame:
    """The first rows by their ordinal; all of them if most is 0 or less."""
    return df.orderBy(ordinal).limit(most) if most > 0 else df


def trainer_state(spark: SparkSession, path: str) -> DataFrame:
    """A run's state files (trainer_state*.json below path), with the file they came from."""
    df = spark.read.schema(STATE).option("recursiveFileLookup", True).option("pathGlobFilter", "trainer_state*.json").option("multiLine", True).json(path)
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def json_fields(df: DataFrame, column: str, schema: str | S.StructType, need: str) -> DataFrame:
    """df with the fields of a column of JSON objects in its place; rows whose object, or whose field `need`, is not there are left out."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.from_json(column, schema).alias("_m")).where(F.col(f"_m.{need}").isNotNull()).select(*kept, "_m.*")


def metric_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON object lines with a micro_step of a mixed text log; all other lines are passed over."""
    lines = spark.read.text(path).where(F.ltrim("value").startswith("{"))
    return json_fields(lines, "value", METRICS, "micro_step")


def reward_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All ranks' reward logs (reward_details_rank*.jsonl below folder); lines that are no objects are left out."""
    return spark.read.schema(REWARDS).option("pathGlobFilter", "reward_details_rank*.jsonl").option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(folder)


def status_rows(spark: SparkSession, root: str, schema: S.StructType) -> DataFrame:
    """status.json of every sample folder below root, with the folder."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "status.json").option("multiLine", True).json(root)
    return df.withColumn("folder", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))


def side_texts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """folder, text of the files of that name below root."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    return df.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder"), F.col("value").alias("text"))


def with_side_text(status: DataFrame, texts: DataFrame) -> DataFrame:
    """Status rows with their folder's text, '' if there is none."""
    return status.join(texts, "folder", "left").withColumn("text", F.coalesce("text", F.lit("")))


def last_write_wins(df: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """The last row of each key by `order`."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def judge_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's last row for each key. Rows of failed judgements are not used."""
    rows = spark.read.schema(CACHE).json(path).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    return last_write_wins(rows.where("cache_key is not null and coalesce(error, '') = '' and not coalesce(map_contains_key(raw, 'raw_output'), false)"), "cache_key", "_at").drop("_at")


def skip_ids(spark: SparkSession, path: str) -> DataFrame:
    """id: a JSON list, or lines with # comments."""
    if path.endswith(".json"):
        lines = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("id"))
    else:
        lines = spark.read.text(path).select(T.clean(F.substring_index("value", "#", 1)).alias("id"))
    return lines.where("id <> ''").distinct()


def token_records(spark: SparkSession, path: str) -> DataFrame:
    """Token records, kept as Parquet. Tokens and labels of unequal length fail the job."""
    df = spark.read.schema(TOKENS).parquet(path)
    return df.where(F.assert_true(F.coalesce(F.size("token") == F.size("label"), F.lit(True)), "tokens and labels differ in length").isNull())


def data_config(text: str) -> list[str]:
    """Paths of a `META:` list of `- path: ...` lines (or the same as JSON)."""
    if text.lstrip().startswith("{"):
        return [m["path"] for m in json.loads(text)["META"]]
    return [line.split("path:", 1)[1].strip().strip("'\"") for line in text.splitlines() if line.strip().startswith(("- path:", "path:"))]


def decoded_images(files: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """path, h, w, pixels (0 to 1, RGB) of binaryFile rows; null pixels and an error where a file cannot be decoded. Needs an image library on the executors."""

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        try:
            from PIL import Image
        except ImportError as e:
            Image, why = None, str(e)
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    if Image is None:
                        raise RuntimeError(why)
                    im = Image.open(io.BytesIO(content)).convert("RGB")
                    if size and im.size != size:
                        im = im.resize(size, Image.BICUBIC)
                    a = np.asarray(im, np.float32) / 255
                    rows.append((path, a.shape[0], a.shape[1], a.ravel().tolist(), None))
                except Exception as e:  # an error is a value of the row
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "h", "w", "pixels", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, h int, w int, pixels array<float>, error string")
