import pytest
from pyspark.sql import functions as F

from corpusmill.functions import vocab
from corpusmill.operators import groups, normalize, reports, rules, sampling
from corpusmill.sources import readers

PATHS = normalize.PATHS


def items(spark, rows):
    base = {f.name: None for f in readers.ITEM.fields}
    return spark.createDataFrame([tuple((base | r)[f.name] for f in readers.ITEM.fields) for r in rows], readers.ITEM)


def item(i="x", label="haze", level="level_2", name="a.png", **more):
    return {"id": i, **{p: f"root/{level}/{label}/{name}" for p in PATHS}} | more


STAGES = {f"{s}_cot": "text" for s in normalize.STAGES}
GOOD = dict(STAGES, cot_valid=(True, True, True))
LEGACY = {f"{s}_understand": "text" for s in normalize.STAGES}


def test_quality_and_validity(spark):
    rows = [item("1", **GOOD), item("2", **STAGES), item("3", final_cot="t"), item("4", **LEGACY), item("5", **GOOD) | {PATHS[0]: None}, item("6", **GOOD) | {PATHS[1]: ""}]
    df = items(spark, rows)
    got = df.select(normalize.quality_rank().alias("q"), rules.item_valid().alias("v"), rules.item_valid(allow_missing_cot_valid=True, allow_legacy=True).alias("w")).collect()
    assert [r["q"] for r in got] == [4, 3, 2, 1, 4, 4]
    assert [r["v"] for r in got] == [True, False, True, False, False, False]  # flags are asked of stage texts alone
    assert [r["w"] for r in got][:4] == [True, True, True, True]


def test_fills_and_pairing(spark):
    df = normalize.filled_metadata(items(spark, [item("1"), item("2") | {PATHS[1]: "root/level_1/rain/b.png"}, item("3", infrared_label="fog")]))
    got = df.select("infrared_label", "infrared_level", "base_image", rules.pairing_errors().alias("e")).collect()
    assert got[0][:3] == ("haze", "level_2", "a.png") and got[0]["e"] == []
    assert got[1]["e"] == ["image_name_mismatch", "cross_level_pair"]
    assert got[2]["e"] == ["infrared:path_label_mismatch"]


def test_rl_projection_fills_ids_and_labels(spark):
    df = normalize.with_ordinal(items(spark, [item(None, label="noise_haze"), item("b")]), "id")
    got = {r["id"]: r for r in normalize.rl_projection(df).collect()}
    assert got["sample_000000"]["infrared_label"] == "haze+noise" and "b" in got


def test_priority_dedup_keeps_first_of_best(spark):
    df = spark.createDataFrame([("k", 1, 0), ("k", 4, 1), ("k", 4, 2)], "k string, q int, o int")
    assert [r["o"] for r in sampling.priority_dedup(df, ["k"], "q", "o").collect()] == [1]


def test_ordered_grammar(spark):
    texts = ["<a>x</a>\n<b>y</b>", "<b>y</b><a>x</a>", "<a>x</a><b>y</b> more", "<a><i>x</i></a><b>y</b>", None, "<b>y</b>"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", rules.ordered_grammar(F.col("t"), ["a", "b"]).alias("e")).orderBy("i")
    got = [r["e"] for r in df.collect()]
    assert got[0] == [] and got[1] == ["missing_or_out_of_order:a", "trailing_text"] and got[2] == ["trailing_text"] and got[3] == ["markup:a"]
    assert got[4] == ["missing_or_out_of_order:a", "missing_or_out_of_order:b"] and got[5] == ["missing_or_out_of_order:a"]


def test_record_errors_and_clean_schema(spark):
    stage = lambda s: "<think>" + "a thought about it. " * 8 + "</think><answer>" + "".join(f"<{t}>a value of some length</{t}>" for t in vocab.ANSWER_TAGS[s]) + "</answer>"
    texts = {f"{s}_cot": stage(s) for s in normalize.STAGES}
    final = "\n".join(f"<{t}>value</{t}>" for s in ("visible", "infrared", "fused") for t in vocab.ANSWER_TAGS[s])
    df = items(spark, [item("1", cot_valid=(True,) * 3, final_answer=final, **texts), item("2", error="boom", **texts)])
    got = df.select(rules.record_errors().alias("e")).collect()
    assert got[0]["e"] == [] and got[1]["e"][0] == "error"
    assert rules.error_summary(df.select(rules.record_errors().alias("errors"))).first()["n"] >= 1
    assert normalize.clean_stage_schema(df).count() == 2


def table(spark, n=400):
    return spark.range(n).select(F.col("id"), (F.col("id") % 3).cast("string").alias("s"), (F.col("id") % 17).alias("scene"), F.lit("l").alias("level"))


def test_samples_nest_and_ignore_input_order(spark):
    df = table(spark)
    q = lambda k: spark.createDataFrame([("0", k), ("1", k), ("2", k)], "s string, quota int")
    pick = lambda d, k: {r["id"] for r in sampling.quota_sample(d, q(k), "s", "id", "1").collect()}
    small, large = pick(df, 4), pick(df, 9)
    assert len(small) == 12 and len(large) == 27 and small < large and pick(df.orderBy(F.rand()), 9) == large
    assert sampling.shortfalls(df, q(200), "s").count() == 3
    extra = df.where(F.col("id").isin(*(large - small)))
    gate = rules.splits_gate(df.where(F.col("id").isin(*small)), df.where(F.col("id").isin(*large)), extra, "id").first()
    assert gate["nested"] and gate["disjoint"] and gate["union_equals"]


def test_disjoint_sample_is_the_greedy_one(spark):
    import hashlib

    df = table(spark)
    got = [(r["s"], r["id"], r["scene"]) for r in sampling.scene_disjoint_sample(df, {"0": 4, "1": 5, "2": 3}, "s", "scene", "id", "9").collect()]
    used, want = set(), []
    for s, n in (("0", 4), ("1", 5), ("2", 3)):
        order = sorted((r for r in df.collect() if r["s"] == s), key=lambda r: hashlib.md5(f"9:{s}:{r['id']}".encode()).hexdigest())
        mine = []
        for r in order:
            if r["scene"] not in used and len(mine) < n:
                used.add(r["scene"])
                mine.append((s, r["id"], r["scene"]))
        want += mine
    assert sorted(got) == sorted(want)


def test_balanced_sample_levels_exposure(spark):
    got = sampling.balanced_sample(table(spark), 17, "s", "scene", "level", "id", "3").collect()
    seen = {}
    for r in got:
        seen[r["scene"]] = seen.get(r["scene"], 0) + 1
    assert len(got) == 51 and max(seen.values()) - min(seen.values()) <= 4
    assert sampling.skipped_strata(table(spark), 134, "s").count() == 2


def test_slots_and_shards(spark):
    df = normalize.with_ordinal(spark.range(50).select((F.col("id") * 7 % 50).alias("id")), "id")
    assert [r["ordinal"] for r in df.orderBy("id").collect()] == list(range(50))
    slots = sampling.batch_slots(df, "ordinal", 50, 3, 4).collect()
    assert len(slots) == 48 and len({(r["batch"], r["rank"], r["slot"]) for r in slots}) == 48
    assert sum(sampling.modulo_shard(df, "ordinal", 3, k).count() for k in range(3)) == 50
    assert sum(sampling.range_shard(df, "ordinal", 50, 4, k).count() for k in range(4)) == 50


def test_advantages(spark):
    df = spark.createDataFrame([("a", 0.2), ("a", 0.8), ("b", 0.5), ("b", 0.5)], "g string, r double")
    got = sorted(r["advantage"] for r in groups.advantages(df, "g", "r").collect())
    assert got == pytest.approx([-0.99966668, 0.99966668])
    assert groups.wrong_size(df, "g", 3).count() == 2


def test_image_blocks(spark):
    s, e, c = vocab.IMAGE_START, vocab.IMAGE_END, vocab.CODE_FIRST
    streams = [("three", [s, 1, 2, c, e, 5, s, 1, 2, c, e, s, 1, 2, c, c, e]), ("open", [1, s, 1, 2, c]), ("early", [e, s, 1, 2, c, e]), ("none", [s, 1, 2, 7, e])]
    df = spark.createDataFrame(streams, "id string, token array<int>")
    t = groups.exploded_tokens(df, "id", "token")
    got = sorted(tuple(r) for r in groups.image_blocks(t).select("id", "block", "start_at", "end_at").collect())
    assert got == [("early", 0, 1, 5), ("three", 0, 0, 4), ("three", 1, 6, 10), ("three", 2, 11, 16)]
    weights = spark.createDataFrame([(0, 2.0), (1, 3.0)], "block int, weight double")
    w = groups.token_weights(t, groups.image_blocks(t), weights).where("id = 'three'").orderBy("pos").collect()
    assert [r["weight"] for r in w][:7] == [2.0] * 5 + [1.0, 3.0]
    inside = groups.open_blocks(t).where("id = 'open'").orderBy("pos").collect()
    assert [r["inside"] for r in inside] == [False, True, True, True, True]


def test_token_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3], 1)], "t array<int>, n int")
    r = df.select(groups.padded(F.col("t"), 5).alias("a"), groups.padded(F.col("t"), 2).alias("b"), groups.masked_labels(F.col("t"), F.col("n")).alias("c"), groups.ends_with(F.col("t"), [2, 3]).alias("d"), groups.framed(F.array(*[F.lit(x) for x in range(4)]), 2, 2, 100, 9).alias("e")).first()
    assert r["a"] == [1, 2, 3, 0, 0] and r["b"] == [1, 2] and r["c"] == [-100, 2, 3] and r["d"] is True
    assert r["e"] == [vocab.IMAGE_START, 102, 102, 0, 1, 9, 2, 3, 9, vocab.IMAGE_END]
    cls = [spark.range(1).select(groups.expected_class(F.lit(k), 2, 2).alias("x")).first()["x"] for k in (0, 3, 4, 5, 6, 8, 9)]
    assert cls == ["grid", "code", "code", "newline", "code", "newline", "end"]


def test_ties_means_and_reports(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (4.0,), (4.0,), (float("nan"),), (None,)], "v double")
    assert groups.top_with_ties(df.where("v is not null and not isnan(v)"), 3, "v").count() == 4
    assert df.agg(reports.mean_skip_nan(F.col("v")).alias("m")).first()["m"] == 4.5
    assert df.limit(0).agg(reports.mean_skip_nan(F.col("v")).alias("m")).first()["m"] is None
    assert df.limit(0).agg(reports.share(F.col("v") > 1).alias("m")).first()["m"] == 0
    state = spark.createDataFrame([(3, 0), (3, 1), (1, 2)], "u int, o int")
    assert reports.latest(state, [], ["u"], ["o"]).first()["o"] == 0
    gate = rules.threshold_gate(spark.createDataFrame([(0.9, None)], "a double, b double"), {"a": (">=", 0.5), "b": ("<=", 1.0)}).first()
    assert gate["a_ok"] and not gate["b_ok"] and not gate["passed"]
    with pytest.raises(ValueError):
        rules.require_empty(df, "rows")


def test_missing_paths(spark):
    df = items(spark, [item("1")])
    listing = spark.createDataFrame([("other",)], "path string")
    assert rules.missing_paths(df, listing).first()["missing"] == sorted(PATHS)
    assert rules.leaked_keys(df, ["error", "zzz"]) == ["error"]


def test_conversation_and_names(spark):
    df = items(spark, [item("1")])
    r = normalize.conversation(df, F.lit("q"), normalize.flat_answer({"a": F.lit("x"), "b": F.lit(None)}), list(PATHS[:3])).first()
    assert r["conversations"][1]["value"] == "<a>x</a>\n<b></b>" and len(r["image"]) == 3
    t = spark.createDataFrame([("<clean_infrared_image><|image|></clean_infrared_image> <|image|>",), ("",)], "t string")
    assert [x["n"] for x in t.select(normalize.image_names(F.col("t")).alias("n")).collect()] == [["clean_infrared_image", "extra_image_2"], []]
