"""Numbering and steps at sizes where samples differ, and functions that no query calls."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import vocab
from corpusmill.operators import normalize, reports, rules, sampling
from corpusmill.plans import jobs
from corpusmill.sources import readers, sinks, tables
from corpusmill.streaming import rewards
from tests_support import item, items


def test_numbering_is_dense_where_bounds_are_sampled(spark):
    """Range bounds of two reads differ once partitions exceed the sample; the numbers stay dense and in order."""
    df = spark.range(0, 300_000, 1, 3).select(F.md5(F.col("id").cast("string")).alias("k"), F.rand(1).alias("x"), F.lit(None).cast("long").alias("empty"))
    out = tables.written(normalize.with_ordinal(df, "k"))
    r = out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ordinal").alias("d"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi")).first()
    assert (r["n"], r["d"], r["lo"], r["hi"]) == (300_000, 300_000, 0, 299_999)
    first = [x["k"] for x in out.where("ordinal < 50").orderBy("ordinal").collect()]
    assert first == [x["k"] for x in df.orderBy("k").limit(50).collect()]
    assert out.columns == ["k", "x", "empty", "ordinal"]


def test_numbering_of_nulls_ties_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (5, 3), (5, 4)], "k int, v int")
    got = [(r["ordinal"], r["k"]) for r in normalize.with_ordinal(df, "k").orderBy("ordinal").collect()]
    assert got == [(0, None), (1, None), (2, 5), (3, 5)]
    assert normalize.with_ordinal(df.limit(0), "k").collect() == []


def test_slots_and_shards_take_a_subquery(spark):
    df = spark.range(25).select(F.col("id").alias("o"))
    n = df.agg(F.count(F.lit(1))).scalar()
    for total in (25, n):
        slots = sampling.batch_slots(df, "o", total, 3, 4)
        assert slots.count() == 24 and [tuple(r) for r in slots.where("o in (0, 5, 23)").orderBy("o").collect()] == [(0, 0, 0, 0), (5, 0, 1, 1), (23, 1, 2, 3)]
        assert [sampling.range_shard(df, "o", total, 4, s).count() for s in range(4)] == [7, 7, 7, 4]


def test_written_steps_change_no_sample(spark):
    df = spark.range(400).select("id", (F.col("id") % 3).cast("string").alias("s"), (F.col("id") % 17).alias("scene"), F.lit("l").alias("level"))
    for save, split in ((None, None), (tables.written, None), (tables.written, tables.parted)):
        picked = sampling.scene_disjoint_sample(df, {"0": 5, "1": 5, "2": 5}, "s", "scene", "id", "1", save=save, split=split)
        assert picked.count() == picked.select("scene").distinct().count() == 15
        even = sampling.balanced_sample(df, 6, "s", "scene", "level", "id", "1", save, split)
        rows = (sorted(r["id"] for r in picked.collect()), sorted(r["id"] for r in even.collect()))
        assert save is None or rows == before  # noqa: F821
        before = rows
    assert sampling.balanced_sample(df, 1000, "s", "scene", "level", "id", "1", tables.written).count() == 0


def test_split_manifests(spark):
    rows = [item(f"{label}-{i}", label=label, name=f"{label}{i}_ir-{label}_vis-x.png") for label in ("rain", "haze") for i in range(8)]
    rows = [r | {"visible_level": "level_2", "infrared_level": "level_2", "infrared_label": "noise", "infrared_degraded_path": r["infrared_degraded_path"].replace(r["id"].split("-")[0] + "/", "noise/")} for r in rows]
    df = normalize.with_ordinal(items(spark, rows), "id")
    quota = lambda n: spark.createDataFrame([("rain", n), ("haze", n)], "stratum string, quota int")
    out = jobs.split_manifests(df, {"small": quota(2), "large": quota(5)}, "7", "noise", {"rain": 1, "haze": 1})
    ids = {k: {r["id"] for r in v.collect()} for k, v in out.items()}
    assert len(ids["small"]) == 4 and len(ids["large"]) == 10 and ids["small"] < ids["large"] and ids["extra"] == ids["large"] - ids["small"]
    assert len(ids["dev"]) == 2 and not ids["dev"] & ids["large"]
    gate = rules.splits_gate(out["small"], out["large"], out["extra"]).first()
    assert gate["nested"] and gate["disjoint"] and gate["union_equals"]
    with pytest.raises(ValueError, match="too few rows"):
        jobs.split_manifests(df, {"small": quota(9)}, "7", "noise")


def test_result_row(spark):
    raw = {s: "<think>" + "a thought that is long enough. " * 5 + "</think>" + "".join(f"<{t}>{s} {t}</{t}>" for t in vocab.ANSWER_TAGS[s]) for s in normalize.STAGES}
    df = spark.createDataFrame([("1", *raw.values()), ("2", *list(raw.values())[:2], None)], "id string, a string, b string, c string")
    by = {r["id"]: r for r in normalize.result_row(df, dict(zip(raw, "abc"))).collect()}
    assert tuple(by["1"]["cot_valid"]) == (True, True, True) and tuple(by["2"]["cot_valid"]) == (True, True, False)
    tag = vocab.ANSWER_TAGS["fused"][0]
    assert f"fused {tag}" in by["1"]["final_answer"] and by["1"]["raw_qwen_outputs"]["fused"] == raw["fused"] and by["2"]["raw_qwen_outputs"]["fused"] is None


def test_texts_and_fields_of_rows(spark):
    df = spark.createDataFrame([("", "two", None), (None, None, None), (" ", "two", "file:///secret/x")], "a string, b string, c string").coalesce(1)
    got = df.select(normalize.completion_text("a", "b").alias("t"), rules.missing_fields(["a", "b"]).alias("m"), rules.leaked_text(["a", "c"], ["secret", "%"]).alias("l")).collect()
    assert [r["t"] for r in got] == ["two", "", " "]  # a space is a text
    assert [r["m"] for r in got] == [["a"], ["a", "b"], []] and [r["l"] for r in got] == [False, False, True]
    long = normalize.unpivoted_paths(df.withColumn("id", F.lit("i")), "id", ["a", "b"]).where("path = 'two'")
    assert {(r["id"], r["key"]) for r in long.collect()} == {("i", "b")}
    field = items(spark, [item("1", infrared_cot="<infrared_understand>seen</infrared_understand>"), item("2", infrared_understand=" kept ")])
    assert [r[0] for r in field.select(normalize.understand_value("infrared")).collect()] == ["seen", "kept"]


def test_throughput(spark):
    df = spark.createDataFrame([(100.0, 10), (5.0, 0)], "e double, n int")
    got = [tuple(r) for r in df.select(*reports.throughput(F.col("e"), F.col("n"), (36,))).collect()]
    assert got == [(10.0, 0.1), (None, None)]


def test_sessions(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:29:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:10:00"), (2, None)]
    got = rewards.sessions(spark.createDataFrame(rows, "user_id long, ts string")).collect()
    assert sorted((r["user_id"], str(r["start"])[11:16], str(r["end"])[11:16], r["n"]) for r in got) == [(1, "00:00", "00:59", 2), (1, "02:00", "02:30", 1), (2, "00:10", "00:40", 1)]


def test_token_records_and_json_sinks(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.new_only(spark.createDataFrame([("1", [1, 2], [0, 2]), ("2", None, None)], readers.TOKENS), at)
    assert readers.token_records(spark, at).count() == 2
    bad = str(tmp_path / "bad")
    sinks.new_only(spark.createDataFrame([("1", [1, 2], [0])], readers.TOKENS), bad)
    with pytest.raises(Exception, match="differ in length"):
        readers.token_records(spark, bad).collect()
    lines = str(tmp_path / "lines")
    df = spark.createDataFrame([("k", {"a": "1"}, ""), ("e", {"a": "2"}, "late"), ("n", {"a": "3"}, None)], readers.CACHE)
    sinks.append_judgements(df, lines)
    sinks.json_lines(df.limit(0), lines, "append")
    got = [json.loads(r["value"]) for r in spark.read.text(lines).collect()]
    assert sorted(r["cache_key"] for r in got) == ["k", "n"]
    assert {r["cache_key"] for r in readers.judge_cache(spark, lines).collect()} == {"k", "n"}


def test_images_without_a_decoder_or_with_bad_bytes_are_error_rows(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(b"no image")
    rows = readers.decoded_images(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert len(rows) == 1 and rows[0]["pixels"] is None and rows[0]["error"]


def test_last_write_wins_by_two_keys(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 0), (None, "a", 7)], "k int, j string, at int")
    assert sorted((r["k"] or 0, r["j"], r["at"]) for r in readers.last_write_wins(df, ["k", "j"], "at").collect()) == [(0, "a", 7), (1, "a", 2), (1, "b", 0)]


def test_shared_folder(spark):
    a, b = tables.new_path(spark, "x"), tables.new_path(spark, "x")
    assert a != b and a.startswith(tables.shared_dir(spark))
