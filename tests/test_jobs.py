import pytest
from pyspark.sql import functions as F

from corpusmill.functions import vocab
from corpusmill.operators import groups, normalize
from corpusmill.plans import jobs
from tests_support import items, item

STAGE_TEXT = {f"{s}_cot": "<think>" + "a long enough thought about it. " * 5 + "</think><answer>" + "".join(f"<{t}>some value here</{t}>" for t in vocab.ANSWER_TAGS[s]) + "</answer>" for s in normalize.STAGES}


def test_build_corpus(spark):
    rows = [item(f"{label}-{i}", label=label, name=f"{i}.png", cot_valid=(True,) * 3, **STAGE_TEXT) for label in ("haze", "rain") for i in range(4)]
    rows += [item("again", label="haze", name="0.png", **STAGE_TEXT), item("bad", label="haze", name="9.png")]
    out = jobs.build_corpus(normalize.with_ordinal(items(spark, rows), "id"), 3, "1", allow_missing_cot_valid=True)
    assert out["selected"].count() == 6 and out["training"].count() == 6
    assert [r["id"] for r in out["rejected"].collect()] == ["bad"] and out["summary"].first()["code"] == "invalid_format"
    with pytest.raises(ValueError):
        jobs.build_corpus(normalize.with_ordinal(items(spark, rows), "id"), 3, "1", strict=True)


def test_score_completions(spark):
    df = spark.createDataFrame([("1", "no tags", 3, "haze", "rain", 0.5)], "id string, text string, n_images int, infrared_label string, visible_label string, reference_score double")
    cache = spark.createDataFrame([], "cache_key string, raw map<string,string>")
    scored, missing = jobs.score_completions(df, cache)
    assert scored.first()["score"] == 0 and missing.count() == 0


def test_small_functions(spark):
    df = spark.createDataFrame([("1", "stripe_noise_haze", '{"a": {"b": 2}}')], "id string, l string, j string")
    r = df.select(normalize.component_hint(F.col("l")).alias("h"), normalize.prompt("see {x}: {y}", x=F.col("id"), y=F.lit(None)).alias("p"), normalize.nested(F.parse_json("j"), "a.b").alias("n"), normalize.required_for(F.lit("fused_only")).alias("q")).first()
    assert tuple(r) == ("stripe noise + haze", "see 1: ", 2.0, ["fused_cot"])
    a, b = spark.createDataFrame([(0, 1)], "p int, x int"), spark.createDataFrame([(0, 2), (1, 3)], "p int, y int")
    assert normalize.zipped(a, b.where("p = 0"), ["p"]).first()["y"] == 2
    with pytest.raises(Exception):
        normalize.zipped(a, b, ["p"]).collect()


def test_streams_decode(spark):
    s, e, c = vocab.IMAGE_START, vocab.IMAGE_END, vocab.CODE_FIRST
    df = spark.createDataFrame([("1", [7, s, 1, 2, c, c + 1, e, 8, s, 1, 2, c])], "id string, token array<int>")
    r = groups.decoded_streams(groups.exploded_tokens(df, "id", "token")).first()
    assert r["text_tokens"] == [7, 8] and r["blocks"][0]["codes"] == [c, c + 1] and len(r["blocks"]) == 1
    assert normalize.legacy_schema(items(spark, [item("1", **{f"{x}_understand": "t" for x in normalize.STAGES})])).count() == 1
