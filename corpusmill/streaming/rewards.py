"""Streams of reward rows: windows with a watermark, runs without signal, and calls of a judge in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import written


def windowed_rates(stream: DataFrame, *, late: str = "10 minutes", width: str = "1 hour", flag: str = "event_type = 'error'") -> DataFrame:
    """Rows, mean value and share flagged for each window and type; works on a stream or a table."""
    return (
        stream.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.avg(F.expr(flag).cast("double")).alias("share"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value", "share")
    )


def sessions(stream: DataFrame, *, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _runs(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    run, most = state.get if state.exists else (0, 0)
    for pdf in frames:
        for bad in pdf.sort_values(["ts", "event_id"])["event_type"] == "error":
            run = run + 1 if bad else 0
            most = max(most, run)
    state.update((run, most))
    yield pd.DataFrame({"user_id": [key[0]], "run": [run], "longest": [most]})


def failure_runs(stream: DataFrame) -> DataFrame:
    """user_id, run, longest: errors in a row so far, kept as state between batches."""
    return stream.groupBy("user_id").applyInPandasWithState(_runs, "user_id long, run long, longest long", "run long, longest long", "update", "NoTimeout")


def judged(rows: DataFrame, judge: Callable[[list[dict]], list[dict]], size: int = 8) -> DataFrame:
    """rows with judge_raw (JSON) and judge_error. The judge gets `size` rows at a time; its failure is the rows' error and stops nothing."""
    import json

    columns = rows.columns

    def run(frames):
        for pdf in frames:
            raws, errors = [], []
            for i in range(0, len(pdf), size):
                part = pdf.iloc[i : i + size]
                try:
                    got = judge(part.to_dict("records"))
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} answers for {len(part)} rows")
                    raws += [json.dumps(x, sort_keys=True) for x in got]
                    errors += [""] * len(part)
                except Exception as e:
                    raws += [None] * len(part)
                    errors += [f"{type(e).__name__}: {e}"] * len(part)
            yield pdf.assign(judge_raw=raws, judge_error=errors)

    schema = rows.select(*columns, F.lit(None).cast("string").alias("judge_raw"), F.lit("").alias("judge_error")).schema
    return rows.mapInPandas(run, schema)


def scored_lists(rows: DataFrame, setup: Callable[[], Callable[[list[dict]], list[float]]], size: int = 8) -> DataFrame:
    """rows with score and score_error, by a callback from a list of rows to a list of scores.

    setup() makes the callback once a task (a model, a client). Lists have `size` rows whatever Arrow's batches are, but for a task's last; a list that fails, or has
    another number of scores, is an error of its rows and stops nothing; a score that is no finite number is an error of its own row. Only a list of rows is held at a time.
    """
    import math

    names = rows.columns

    def run(frames):
        score = setup()
        held: list[dict] = []

        def scored(part: list[dict]) -> pd.DataFrame:
            try:
                got = list(score([dict(r) for r in part]))
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} scores for {len(part)} rows")
                values = [(float(x), None) if isinstance(x, (int, float)) and math.isfinite(x) else (None, f"no score: {x!r}") for x in got]
            except Exception as e:
                values = [(None, f"{type(e).__name__}: {e}")] * len(part)
            return pd.DataFrame([(*[r[n] for n in names], *v) for r, v in zip(part, values)], columns=[*names, "score", "score_error"])

        for pdf in frames:
            # Nulls of numbers come as NaN; the callback gets None.
            held += pdf.astype(object).where(pdf.notna(), None).to_dict("records")
            while len(held) >= size:
                part, held = held[:size], held[size:]
                yield scored(part)
        if held:
            yield scored(held)

    schema = rows.select(*names, F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("score_error")).schema
    return rows.mapInPandas(run, schema)


def retried(rows: DataFrame, make: Callable[[DataFrame], DataFrame], valid: str, times: int = 3) -> DataFrame:
    """make(rows), and again only for rows that are not valid, up to `times`. Each try is written, so that none is made twice, and none is made for no rows."""
    done, left = None, rows
    for k in range(times):
        tried = written(make(left), "tried")
        left = tried.where(f"not coalesce({valid}, false)")
        last = k + 1 == times or left.isEmpty()
        good = tried if last else tried.where(valid)
        done = good if done is None else done.unionByName(good)
        if last:
            return done
        left = left.select(*rows.columns)
    return done
