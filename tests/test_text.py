import pytest
from pyspark.sql import functions as F

from corpusmill.functions import scoring, text as T, vocab


def ask(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]


def many(spark, expr, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", expr(F.col("t")).alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


def test_components(spark):
    cases = {
        "noise": ["noise"], "noise_stripe_noise": ["noise", "stripe_noise"], "stripe_noise_noise": ["stripe_noise", "noise"], "foo_stripe_noise": ["foo", "stripe", "noise"],
        "_noise": ["noise"], "noise__rain": ["noise", "rain"], "noise_": ["noise"], "": [], "haze_rain_x_noise": ["haze", "rain", "x", "noise"], "rainx": ["rainx"],
        "blur2_blur4": ["blur2", "blur4"], "noisehaze": ["noisehaze"], "haze+noise": ["haze", "noise"],
    }
    assert many(spark, T.components, list(cases)) == list(cases.values())
    assert many(spark, T.canonical_label, ["noise_stripe_noise", "stripe_noise_noise", None]) == ["noise+stripe_noise"] * 2 + [""]


def test_tag_dialects(spark):
    text = "<A>one</A> < a >two< / a ><a> </a>"
    assert ask(spark, lambda c: T.last_tag(c, "a"), text) == "two"
    assert ask(spark, lambda c: T.last_tag(c, "a", keep_empty=True), text) == ""
    assert ask(spark, lambda c: T.last_tag(c, "A", strict=True), text) == "one"
    assert ask(spark, lambda c: T.last_tag(c, "a"), None) == ""
    assert ask(spark, lambda c: T.opened_tags(c, "a"), "<a>x <a>y</a>") == ["x <a>y", "y"]
    assert ask(spark, lambda c: T.opened_tags(c, "a"), "<a>tail <b>z") == ["tail"]


def test_truncate_and_collapse(spark):
    assert many(spark, lambda c: T.truncated(c, 20), ["short", None]) == ["short", ""]
    assert ask(spark, lambda c: T.truncated(c, 20), "abcdefghijkl. mnopqrstuvwxyz") == "abcdefghijkl"
    assert ask(spark, T.collapsed, " a \t b \n\n c ") == "a b\nc"
    assert ask(spark, T.without_pollution, "keep\nThe user said so\nalso") == "keep\nalso"


@pytest.mark.parametrize("stage", ["infrared", "fused"])
def test_sanitizer_is_idempotent(spark, stage):
    tags = vocab.ANSWER_TAGS[stage]
    body = "".join(f"<{t}>: 'value of {t}, " + "long text; " * 120 + f"'</{t}>" for t in tags)
    texts = [
        "<think>" + "This is a long thought. " * 20 + f"</think><answer>{body}</answer>", "<think>short</think>" + body, None, "", "no tags at all", f"<{tags[0]}>never closed <x>y",
        "<think>the user said\n" + "fine line about haze. " * 10 + "</think>" + body,
    ]
    once = many(spark, lambda c: T.sanitized_stage(c, stage), texts)
    assert many(spark, lambda c: T.sanitized_stage(c, stage), once) == once
    assert all(x.startswith("<think>\n") and x.endswith("</answer>") for x in once)


def document(swap=False, end=True, placeholders=3):
    out = []
    for i, outer in enumerate(vocab.OUTER_TAGS):
        if outer.endswith("_cot"):
            inner = "".join(f"<{t}>haze and noise, infrared fusion of visible detail, remove artifacts</{t}>" for t in vocab.INNER_TAGS[outer] if t != "answer")
            out.append(f"<{outer}><answer>a</answer>{inner}</{outer}>")
        else:
            mark = vocab.PLACEHOLDER if i // 2 < placeholders else "none"
            out.append(f"<{outer}>{mark}</{outer}>")
    if swap:
        out[0], out[2] = out[2], out[0]
    text = "\n".join(out)
    return text if end else text.removesuffix("</clean_fused_image>")


def test_format_gate(spark):
    rows = [(document(), 3), (document(end=False), 3), (document(swap=True), 3), (document(placeholders=2), 3), (document(), 2), (None, None), (document() + "<fused_cot>x</fused_cot>", 3)]
    df = spark.createDataFrame(rows, "t string, n int").select(scoring.format_gate(F.col("t"), F.col("n")).alias("g"), scoring.format_score(F.col("t"), F.col("n")).alias("s"))
    got = df.collect()
    assert [r["g"]["score"] for r in got] == [1, 1, 0, 0, 0, 0, 0]
    assert got[0]["s"]["score"] == 1.0 and "tag_order" in got[2]["g"]["problems"] and "duplicate:fused_cot" in got[6]["g"]["problems"]
    assert all(0 <= r["s"]["score"] <= 1 for r in got)


def test_labels_and_planning(spark):
    df = spark.createDataFrame([(document(),)], "t string")
    r = df.select(scoring.label_score(F.col("t"), F.lit("noise+stripe_noise"), F.lit("haze")).alias("l"), scoring.planning_score(F.col("t")).alias("p"), scoring.degradation_score(F.col("t"), "visible", F.lit("haze")).alias("d")).first()
    assert r["l"] == pytest.approx(0.5 * 0.5 + 0.5) and r["p"] == 1.0 and r["d"] == pytest.approx(1 - 0.08)


def test_names_and_paths(spark):
    assert many(spark, T.safe_name, ["a b/c", "__x__", "", None]) == ["a_b_c", "x", "sample", "sample"]
    assert many(spark, T.path_label, ["x/level_2/haze/a.png", "level_1/rain", "mylevel_1/x/y", None]) == ["haze", "rain", "", ""]
    assert many(spark, T.parent_label, ["a/b/c.png", "c.png", None]) == ["b", "unknown", "unknown"]
    assert ask(spark, lambda c: T.base_scene_from_id(F.lit(""), c, F.lit("p/q.r.png")), "s1_ir-x") == "s1"
    assert ask(spark, lambda c: T.json_in_text(c).cast("string"), 'so {"a": 1} it is') is not None
    assert ask(spark, lambda c: T.protocol(c), "< COT >") == "fused_only"


def made(spark, use):
    """How often use(value) makes its value for a row: each place where its plan names it, as lambdas share nothing."""
    plan = spark.range(1).select(use(F.upper(F.concat(F.lit("a"), F.col("id").cast("string")))).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("upper(")


def test_a_cut_text_is_made_once(spark):
    assert made(spark, lambda t: T.truncated(t, 9)) == 1
    assert made(spark, lambda t: T.sanitized_stage(t, "fused")) == 1
    rows = spark.createDataFrame([("ab. cd. efgh",), ("ab. cdefghijk",), ("short",), ("12345. é 78",), ("x\ny; zzzzzzz",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.truncated(F.col("t"), 9)).collect()] == ["ab. cd", "ab. cdefg", "short", "12345", "x\ny; zzzz", ""]


def test_rewards_make_their_text_once(spark):
    assert made(spark, scoring.planning_score) == 1 and made(spark, lambda t: scoring.coverage(F.lit("rain_haze"), t)) == 1


def test_format_score_makes_its_text_once(spark):
    assert made(spark, lambda t: scoring.format_score(t, F.lit(3))) == 1
