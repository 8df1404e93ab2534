import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import blocks, readers, sinks
from corpusmill.streaming import rewards


def test_json_items(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "infrared_label": None}, {"id": "2", "cot_valid": {"visible": True}}]))
    (tmp_path / "b.jsonl").write_text('{"id": "3"}\n\n{"id": "4"}\n')
    df = readers.json_items(spark, [f"file://{tmp_path}/a.json", f"file://{tmp_path}/b.jsonl"])
    assert sorted(r["id"] for r in df.collect()) == ["1", "2", "3", "4"]
    with pytest.raises(ValueError):
        readers.json_items(spark, "x.csv")


def test_metric_log(spark, tmp_path):
    (tmp_path / "log").write_text('start\n{"micro_step": 1, "grad_norm": 0.5}\n{broken\n{"other": 2}\n')
    assert [r["grad_norm"] for r in readers.metric_log(spark, str(tmp_path / "log")).collect()] == [0.5]


def test_cache_keeps_last_good_row(spark, tmp_path):
    rows = [{"cache_key": "a", "raw": {"x": "1"}}, {"cache_key": "a", "raw": {"x": "2"}}, {"cache_key": "b", "raw": {"raw_output": "?"}}, {"cache_key": "c", "raw": {}, "error": "e"}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = readers.judge_cache(spark, str(tmp_path / "c.jsonl")).collect()
    assert [(r["cache_key"], r["raw"]) for r in got] == [("a", {"x": "2"})]


def test_skip_ids_and_config(spark, tmp_path):
    (tmp_path / "s.txt").write_text("a # note\n# all\n\nb\n")
    assert sorted(r["id"] for r in readers.skip_ids(spark, str(tmp_path / "s.txt")).collect()) == ["a", "b"]
    assert readers.data_config("META:\n  - path: 'x/y.json'\n  - path: z\n") == ["x/y.json", "z"]


def test_status_and_texts(spark, tmp_path):
    for k in "ab":
        (tmp_path / k).mkdir()
        (tmp_path / k / "status.json").write_text(json.dumps({"id": k, "ok": True}))
    (tmp_path / "a" / "generated_text.txt").write_text("hello\nthere")
    s = readers.with_side_text(readers.status_rows(spark, str(tmp_path), "id string, ok boolean"), readers.side_texts(spark, str(tmp_path), "generated_text.txt"))
    assert {r["id"]: r["text"] for r in s.collect()} == {"a": "hello\nthere", "b": ""}


def test_bundle(spark, tmp_path):
    (tmp_path / "f 1.png").write_bytes(b"abc")
    df = spark.createDataFrame([("1", f"file://{tmp_path}/f 1.png", None)], "id string, p string, q string")
    moved, plan = sinks.bundle_plan(df, "id", ["p", "q"])
    got = sinks.copy_bundle(plan.withColumn("path", F.replace("path", F.lit("file://"), F.lit(""))), str(tmp_path / "out")).collect()
    assert got[0]["sha256"] == hashlib.sha256(b"abc").hexdigest() and (tmp_path / "out" / got[0]["target"]).read_bytes() == b"abc"
    assert moved.first()["p"] == got[0]["target"] and moved.first()["q"] is None
    assert blocks.file_digests(spark, str(tmp_path / "out")).count() == 1
    assert sinks.totals(spark.createDataFrame([(3,)], "bytes int")).first()["bytes"] == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2]), ("b", [1])], "id string, token array<int>")
    sinks.all_and_short(df, str(tmp_path / "d"), F.size("token"), 1)
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2 and spark.read.parquet(str(tmp_path / "d") + "/short=true").count() == 1
    sinks.new_only(df, str(tmp_path / "n"))
    with pytest.raises(Exception):
        sinks.new_only(df, str(tmp_path / "n"))
    sinks.by_id(df, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 2


def test_judge_failure_is_a_value(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int").coalesce(1)

    def judge(rows):
        if any(r["id"] == 3 for r in rows):
            raise RuntimeError("no")
        return [{"score": r["id"]} for r in rows]

    got = {r["id"]: (r["judge_raw"], r["judge_error"]) for r in rewards.judged(df, judge, 2).collect()}
    assert got[1] == ('{"score": 1}', "") and got[3][1] == "RuntimeError: no"


def test_retries(spark):
    df = spark.range(4)
    calls = []

    def make(d):
        calls.append(1)
        return d.withColumn("ok", F.col("id") < len(calls) * 2)

    assert {r["id"]: r["ok"] for r in rewards.retried(df, make, "ok", 3).collect()} == dict.fromkeys(range(4), True)


def test_stream_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = rewards.windowed_rates(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    key = ["window_start", "event_type", "n"]
    assert sorted(map(tuple, spark.table("w").select(key).collect())) == sorted(map(tuple, rewards.windowed_rates(batch).select(key).collect()))
    r = rewards.failure_runs(stream).writeStream.outputMode("update").format("memory").queryName("r").start()
    r.processAllAvailable()
    r.stop()
    got = {x["user_id"]: x["longest"] for x in spark.table("r").collect()}
    from corpusmill.operators import runs

    want = {x["user_id"]: x["longest"] for x in runs.longest_runs(batch, "user_id", ["ts", "event_id"], F.col("event_type") == "error").collect()}
    assert got == want
