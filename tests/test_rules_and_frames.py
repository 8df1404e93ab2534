"""Rules, names, frames, gates and markers."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import scoring, text as T, vocab
from corpusmill.operators import groups, normalize, rules
from corpusmill.sources import readers, sinks
from tests_support import item, items

MARK = vocab.PLACEHOLDER


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, count, names", [
    (f"<clean_infrared_image>{MARK}</clean_infrared_image><clean_fused_image>{MARK}</clean_fused_image>", 3, ["infrared_restored.png", "fused_image.png", "visible_restored.png"]),
    (f"{MARK}{MARK}", 2, ["infrared_restored.png", "visible_restored.png"]), ("", 5, ["infrared_restored.png", "visible_restored.png", "fused_image.png", "extra_image_1.png", "extra_image_2.png"]),
    (f"<clean_fused_image>{MARK}{MARK}</clean_fused_image>", 2, ["fused_image.png", "infrared_restored.png"]), (None, 0, []),
])
def test_output_names(spark, text, count, names):
    assert one(spark, normalize.output_names(F.lit(text).cast("string"), F.lit(count))) == names


def test_sanitizer_tells_broken_thoughts_anew(spark):
    body = "<infrared_degradation>heavy noise</infrared_degradation><infrared_understand>a warm body</infrared_understand><infrared_image>a clean one</infrared_image>"
    told = vocab.SYNTHESIS["infrared"].format(infrared_degradation="heavy noise", infrared_understand="a warm body", infrared_image="a clean one")
    out = one(spark, T.sanitized_stage(F.lit("<think>short</think><answer>" + body), "infrared"))
    assert out.startswith(f"<think>\n{told}\n</think>")
    long = "The frame is hazy and the target is warm. " * 5
    assert one(spark, T.sanitized_stage(F.lit(f"</think> <think>{long}"), "fused")).count(vocab.NO_FIELD) == 2
    assert long.strip() in one(spark, T.sanitized_stage(F.lit(f"{long}</think><answer>{body}"), "infrared"))


def test_labels_in_two_orders(spark):
    assert one(spark, T.canonical_label(F.lit("foo_noise"))) == "noise+foo" and one(spark, T.canonical_degradation(F.lit("foo_noise"))) == "foo+noise"
    assert one(spark, T.canonical_degradation(F.lit("a+b"))) == "a+b" and one(spark, T.canonical_degradation(F.lit("__"))) == "__"
    assert one(spark, scoring.coverage(F.lit("low-light"), F.lit("a Low-Light scene"))) == 1.0 and one(spark, scoring.coverage(F.lit("low-light"), F.lit("a flow-light scene"))) == 0.0


def test_legacy_texts(spark):
    assert one(spark, T.legacy_understand(F.lit("rendered as plain text near the sign."))) == "rendered as plain text near the sign."
    assert one(spark, T.legacy_understand(F.lit(' : "kept"\n \nNow, for the rest <b>'))) == "kept" and one(spark, T.legacy_understand(F.lit("x" * 2000))) == "x" * 2000


def test_grammar_takes_any_case_and_spaces(spark):
    assert one(spark, rules.ordered_grammar(F.lit("<A>one</A>< b >two</ b >"), ["a", "b"])) == []
    assert one(spark, rules.ordered_grammar(F.lit("<a>x</a><answer>"), ["a"])) == ["think_or_answer_tag", "trailing_text"]
    assert one(spark, rules.stage_errors(F.lit(None).cast("string"), "fused")) == ["missing:fused_cot"]


def test_scene_comes_from_the_fused_path(spark):
    df = items(spark, [item("1") | {"fused_gt_path": "gt/REAL.png"}])
    assert normalize.filled_metadata(df).first()["base_image"] == "REAL.png"
    assert one(spark, T.base_scene_from_id(F.lit(None), F.lit("whole-id"), F.lit("p/q.png"))) == "whole-id" and one(spark, T.base_scene_from_id(F.lit(""), F.lit(""), F.lit(""), F.lit("p/q.r.png"))) == "q.r"


def test_settings_and_gates(spark):
    good = dict(num_generations=2, image_top_k=2, text_top_k=1, kl_beta=0, max_new_tokens=1, temperature=1.0, per_device_batch_size=1, gradient_accumulation_steps=1, epochs=1, lr=1e-6,
                reward_timeout_sec=1, distributed_timeout_sec=1, stop_after_images=3, do_sample=True, lambda_text=0.1, lambda_image=0.9, reference_reward_weight=0.9, qwen_reward_weight=0.1, skip_image_reward=False)
    assert rules.argument_errors(good) == []
    bad = good | dict(num_generations=1, lr=0, do_sample=False, lambda_text=0, lambda_image=0, skip_image_reward=True, reference_reward_weight=0, stop_after_images=2)
    assert len(rules.argument_errors(bad)) == 6
    passed = spark.createDataFrame([(True,)], "passed boolean")
    rules.require_passed(passed, "preflight")
    for report in (passed.limit(0), passed.select(F.lit(False).alias("passed")), passed.unionAll(passed)):
        with pytest.raises(ValueError):
            rules.require_passed(report, "preflight")
    assert [one(spark, rules.divisible(F.lit(n))) for n in (64, 33, 0)] == [True, False, False]


def test_messages_and_judge_records(spark):
    m = one(spark, normalize.message(F.lit("look"), [F.lit("a.png"), F.lit(None).cast("string")], 100))
    assert m[0]["role"] == "user" and [(x["type"], x["image"], x["text"], x["max_pixels"]) for x in m[0]["content"]] == [("image", "a.png", None, 100), ("text", None, "look", None)]
    marks = {k: F.lit(0.5) for k in scoring.JUDGE_WEIGHTS}
    r = one(spark, scoring.judge_raw(marks, F.lit(None).cast("double"), F.lit("boom")))
    assert r["artifact_suppression"] == 5.0 and r["overall"] is None and r["error"] == "boom"
    again = {k: F.lit(r[k]).cast("string") for k in scoring.JUDGE_WEIGHTS}
    assert one(spark, scoring.judge_score(again)) == pytest.approx(0.5)


def test_image_starts_behind_an_open_tag(spark):
    before = lambda *x: F.array(*[F.lit(i) for i in x])
    assert [one(spark, groups.may_start(b, [[1, 2], [9]])) for b in (before(5, 1, 2), before(2), before(9), before(1, 2, 3))] == [True, False, True, False]


def test_rows_markers_and_heads(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long")
    sinks.sample_rows(df, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 2
    with pytest.raises(ValueError):
        sinks.sample_rows(df.unionAll(df), str(tmp_path / "twice"))
    for done, text in ((1, "1"), (2, "finished")):
        sinks.progress(spark, str(tmp_path / "mark"), done, 2)
        assert spark.read.text(str(tmp_path / "mark")).first()[0] == text
    assert [r["id"] for r in readers.head(df, "n", 1).collect()] == ["a"] and readers.head(df, "n", 0).count() == 2
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "trainer_state.json").write_text('{\n "micro_step": 3, "update_step": 1}')
    (tmp_path / "run" / "reward_details_rank0.jsonl").write_text('{"id": "x", "rank": 0}\n')
    (tmp_path / "run" / "other.jsonl").write_text('{"id": "y"}\n')
    assert readers.trainer_state(spark, str(tmp_path / "run")).first()["micro_step"] == 3
    assert [r["id"] for r in readers.reward_rows(spark, str(tmp_path / "run")).collect()] == ["x"]
