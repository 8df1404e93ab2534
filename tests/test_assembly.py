"""Completions from bucketed side tables, array elements, byte ranges, lists of rewards and contexts of image blocks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import assembly, runs
from corpusmill.sources import blocks, elements
from corpusmill.streaming import rewards


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_completions_have_all_sides_or_say_which_lack(spark):
    status = spark.createDataFrame([("a", "done"), ("b", "done"), ("c", "failed"), (None, "lost")], "folder string, state string")
    samples = spark.createDataFrame([("a", "id1", "haze"), ("c", "id3", None), ("z", "id9", None)], "folder string, id string, label string")
    texts = spark.createDataFrame([("a", "said"), ("b", None), (None, "nobody's")], "folder string, text string")
    images = spark.createDataFrame([("a", "infrared", "a/i.png"), ("a", "visible", "a/v.png"), ("a", "fused", "a/f2.png"), ("a", "fused", "a/f1.png"), ("b", "visible", None), ("c", "mask", "c/m.png")], "folder string, modality string, path string")
    tables = [assembly.bucketed(t, "folder", buckets=4) for t in (status, samples, texts, images)]
    with_limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = assembly.assembled(*tables)
        got = {r["folder"]: r.asDict(True) for r in out.collect()}
        assert exchanges(out) == 0  # neither the joins nor the images' groups move a row
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_limit)
    assert got["a"] == {"folder": "a", "state": "done", "sample": {"id": "id1", "label": "haze"}, "text": "said", "images": {"infrared": "a/i.png", "visible": "a/v.png", "fused": "a/f1.png"}, "missing": []}
    assert got["b"]["missing"] == ["sample", "text", "infrared", "visible", "fused"] and got["b"]["text"] == "" and got["b"]["images"] == {}
    assert got["c"]["missing"] == ["text", "infrared", "visible", "fused"] and got["c"]["sample"] == {"id": "id3", "label": None}
    assert got[None]["missing"] == ["sample", "text", "infrared", "visible", "fused"] and len(got) == 4


def test_pairs_by_id_and_modality(spark):
    p = spark.createDataFrame([("1", "infrared", 5.0), ("1", "fused", 7.0), ("2", "visible", 1.0), (None, "fused", 3.0)], "id string, modality string, x double")
    g = spark.createDataFrame([("1", "infrared", 4.0), ("1", "visible", 2.0), ("2", "visible", 1.5), ("3", "fused", 9.0)], "id string, modality string, x double")
    a, b = (assembly.bucketed(t, "id", "modality", buckets=4) for t in (p, g))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = assembly.paired(a, b)
        assert pairs.count() == 6 and exchanges(pairs) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    out = {r["id"]: r.asDict(True) for r in assembly.metric_record(pairs, "id", {"error": F.abs(F.col("prediction.x") - F.col("truth.x"))}).collect()}
    assert out["1"]["infrared"] == {"prediction_exists": True, "truth_exists": True, "error": 1.0} and not out["1"]["complete"]
    assert out["1"]["visible"] == {"prediction_exists": False, "truth_exists": True, "error": None}
    assert out["2"]["visible"]["error"] == 0.5 and out["2"]["fused"] == {"prediction_exists": False, "truth_exists": False, "error": None}
    assert out["3"]["fused"]["truth_exists"] and set(out) == {"1", "2", "3", None}


def test_array_elements_have_numbers(spark, tmp_path):
    files = {"a.json": '[{"id": "x", "n": 1}, {"id": "y", "n": 2.5, "more": [1]}]', "b.json": '[{"id": "z"}, 7, null, {"id": {"deep": 1}}]', "c.json": '{"id": "not an array"}', "d.json": "[broken", "e.json": "[]"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    found = elements.array_files(spark, str(tmp_path))
    typed = elements.typed(found, "id string, n double").withColumn("file", F.element_at(F.split("source_file", "/"), -1))
    got = {(r["file"], r["element"]): (r["item"] and tuple(r["item"]), r["error"]) for r in typed.collect()}
    assert got["a.json", 0] == (("x", 1.0), None) and got["a.json", 1] == (("y", 2.5), None) and got["b.json", 0] == (("z", None), None)
    assert got["b.json", 1][1].startswith("no object: ") and got["b.json", 2][1] == "no object: VOID" and got["c.json", None][1].startswith("no array: OBJECT") and got["d.json", None][1] == "no JSON"
    assert not any(f == "e.json" for f, _ in got)
    with pytest.raises(Exception, match="b.json: element 1: no object"):
        elements.required(typed.where("file = 'b.json' and element < 2"), F.col("file")).collect()
    assert elements.required(typed.where("file = 'a.json'"), F.col("file")).count() == 2
    shape = elements.drifts(found.where("source_file like '%a.json'")).first()
    assert shape["n"] == 2 and "more: ARRAY" in shape["shape"] and "n: DECIMAL" in shape["shape"]


def test_digests_in_ranges(spark, tmp_path):
    r = random.Random(1)
    data = {"big.bin": r.randbytes(5_300_000), "sub/small.bin": b"abc", "gone.bin": b"x"}
    (tmp_path / "sub").mkdir()
    for name, raw in data.items():
        (tmp_path / name).write_bytes(raw)
    whole = {x["path"].split("/")[-1]: x for x in blocks.file_digests(spark, str(tmp_path)).collect()}
    for name, raw in data.items():
        x = whole[name.split("/")[-1]]
        assert (x["bytes"], x["sha256"], x["error"]) == (len(raw), hashlib.sha256(raw).hexdigest(), None)
    ranges = blocks.range_digests(spark, str(tmp_path), 1_000_000)
    got = {(x["path"].split("/")[-1], x["start"]): (x["bytes"], x["sha256"]) for x in ranges.collect()}
    assert len(got) == 8 and all(got["big.bin", a] == (len(p := data["big.bin"][a : a + 1_000_000]), hashlib.sha256(p).hexdigest()) for a in range(0, 5_300_000, 1_000_000))
    before = spark.createDataFrame(ranges.collect(), ranges.schema)
    raw = bytearray(data["big.bin"])
    raw[2_500_000] ^= 1
    (tmp_path / "big.bin").write_bytes(bytes(raw) + b"x" * 900_000)
    (tmp_path / "gone.bin").unlink()
    diff = {(x["path"].split("/")[-1], x["start"]): x["state"] for x in blocks.changed_ranges(before, blocks.range_digests(spark, str(tmp_path), 1_000_000)).collect()}
    assert diff == {("big.bin", 2_000_000): "changed", ("big.bin", 5_000_000): "changed", ("big.bin", 6_000_000): "new", ("gone.bin", 0): "gone"}


def test_lists_have_one_size_whatever_the_batches(spark):
    df = spark.range(0, 50, 1, 2).select("id", F.when(F.col("id") % 9 != 0, F.col("id").cast("string")).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")

    def setup():
        made = [0]

        def score(rows):
            made[0] += 1
            if any(r["id"] == 30 for r in rows):
                raise ValueError("no score today")
            return [float(len(rows)) if r["id"] != 40 else float("nan") for r in rows] if made[0] > 0 and all(r["text"] is None or isinstance(r["text"], str) for r in rows) else []

        return score

    try:
        got = {r["id"]: (r["score"], r["score_error"], r["text"]) for r in rewards.scored_lists(df, setup, 8).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 50 and got[0] == (8.0, None, None) and got[1] == (8.0, None, "1")
    assert got[24][0] == 1.0 and got[49][0] == 1.0  # the last list of each of the two tasks
    assert all("no score today" in got[i][1] for i in range(25, 33)) and got[33][0] == 8.0 and got[40] == (None, "no score: nan", "40")


def test_retries_make_each_try_once(spark):
    calls = []

    def make(rows):
        calls.append(rows.count())
        return rows.withColumn("ok", F.col("n") < 10 * len(calls))

    df = spark.range(25).select(F.col("id").alias("n"))
    out = rewards.retried(df, make, "ok", 5)
    assert calls == [25, 15, 5] and sorted(r["n"] for r in out.collect()) == list(range(25)) and out.where("not ok").count() == 0


S, E = 100, 101


def plain_contexts(seq, first):
    out, cursor = [], 0
    ends = [i for i, t in enumerate(seq) if t == E]
    for start in (i for i, t in enumerate(seq) if t == S and i >= first):
        while cursor < len(ends) and ends[cursor] <= start:
            cursor += 1
        end = ends[cursor] if cursor < len(ends) else len(seq)
        cursor += 1
        if end - start >= 3:
            out.append((start, end))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_context_map_and_back(spark, seed):
    r = random.Random(seed)
    streams = {k: [r.choice([S, E, 1, 2, 3, 4, 5]) for _ in range(n)] for k, n in (("a", 120), ("b", 7), ("c", 1), ("d", 300), (None, 60))}
    first = 4
    df = spark.createDataFrame([(k, i, t) for k, s in streams.items() for i, t in enumerate(s)], "id string, pos long, token int").repartition(4)
    found = runs.context_blocks(df, "id", S, E, first)
    got = {}
    for x in found.collect():
        got.setdefault(x["id"], []).append((x["start_at"], x["end_at"], x["block"]))
    assert {k: sorted(v[:2] for v in vs) for k, vs in got.items()} == {k: c for k, s in streams.items() if (c := plain_contexts(s, first))}
    assert sorted(v[2] for vs in got.values() for v in vs) == list(range(found.count()))
    want = {}
    for k, vs in got.items():
        for a, b, block in sorted(vs):
            for p in range(a + 2, b):
                want[k, p] = (block, p - a)
    where = runs.context_map(df, found, "id")
    assert {(x["id"], x["pos"]): (x["block"], x["offset"]) for x in where.collect()} == want
    back = runs.context_places(where.select("block", "offset", F.struct("id", "pos").alias("was")), found, "id").collect()
    assert len(back) == len(want) and all((x["id"], x["pos"]) == tuple(x["was"]) for x in back)


def test_checksum_list(spark, tmp_path):
    for name in ("a.safetensors", "config.json", "optimizer_1.pt", "trainer_state.json", "logs/x.txt", "sub/status.json", "sub/keep.bin", "SHA256SUMS"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    got = {r["path"]: r["line"] for r in blocks.checksum_list(spark, str(tmp_path), blocks.RUN_FILES, "*.safetensors").collect()}
    assert got == {f"./{n}": f"{hashlib.sha256(n.encode()).hexdigest()}  ./{n}" for n in ("a.safetensors", "config.json", "sub/keep.bin")}
    assert blocks.checksum_list(spark, str(tmp_path)).count() == 7
    with pytest.raises(ValueError, match="no \\*.gguf"):
        blocks.checksum_list(spark, str(tmp_path), need="*.gguf")


def test_evaluation_of_odd_records(spark):
    from corpusmill.operators import reports

    rows = ['{"reward": {"score": 1}, "format_gate": {"ok": true}}', '{"reward": {"score": "7"}, "format_gate": 3}', '{"reward": 5}', '{"reward": {"score": 2.5}, "reference_reward": {"fused": {"psnr": 4}}}', "[]", '{"reward": {"score": true}}']
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(F.parse_json("t").alias("record"))
    r = reports.evaluation(df, "/x").first()
    assert (r["num_samples"], r["num_gate_ok"], r["mean_total_reward"], r["mean_fused_psnr"], r["mean_text_reward"]) == (6, 1, 1.75, 4.0, None)
    r = reports.evaluation(df.limit(0), "/x").first()
    assert (r["num_samples"], r["num_gate_ok"], r["mean_total_reward"]) == (0, 0, None) and len(r) == 17


def test_samples_of_a_manifest(spark):
    from corpusmill.operators import normalize
    from tests_support import item, items

    rows = [item("a"), item("a", label="rain"), item("b") | {"fused_gt_path": " ", "visible_clean_path": ""}, item("c") | {"infrared_degraded_path": "x/y.png"}, item(None) | {"sample_id": "s"}, item("d")]
    d = normalize.with_ordinal(items(spark, rows).withColumn("o", F.monotonically_increasing_id()), "o")
    got = {r["ordinal"]: (r["id"], r["errors"]) for r in normalize.rl_samples(d, 5).collect()}
    assert got[0] == ("a", ["duplicate id: a"]) and got[1] == got[0] and got[4] == ("s", []) and 5 not in got
    assert got[2][1] == ["sample index=2 missing paths: visible_clean_path"] and got[3][1] == ["sample index=3 no infrared_label: "]


def test_catalogue_not_yet_done(spark):
    from corpusmill.operators import reports

    strata = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "s string, w int")
    scenes = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "c string")
    done = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "z")], "s string, c string")
    out = reports.not_yet(strata, scenes, done, "s", "c")
    assert sorted(map(tuple, out.select("s", "w", "c").collect()), key=str) == sorted([("a", 1, "y"), ("b", 2, "x"), ("b", 2, "y"), (None, 3, "x"), (None, 3, "y")], key=str)
    with pytest.raises(Exception, match="more than 1 scenes"):
        reports.not_yet(strata, scenes, done, "s", "c", 1).collect()
    assert reports.not_yet(strata, scenes.limit(0), done, "s", "c").count() == 0


def test_turns_and_flat_conversations(spark):
    from corpusmill.operators import normalize, rules

    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "u"), (2, 1, "user", "v"), (3, 1, "system", "late"), (3, 0, "user", "u"), (4, 0, "user", "u"), (4, 1, "tool", "t"), (4, 2, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert {r["conv_id"]: r["ordered"] for r in rules.turns_in_order(df).collect()} == {1: True, 2: False, 3: False, 4: False}
    flat = {r["conv_id"]: tuple(r)[1:] for r in normalize.flat_conversations(df).collect()}
    assert flat[1] == ("system>user>assistant", 3, "<system>s</system>\n<user>u</user>\n<assistant>a</assistant>") and flat[3][0] == "user>system"


def test_json_fields(spark):
    from corpusmill.sources import readers

    df = spark.createDataFrame([(1, '{"k": 3}'), (2, "{broken"), (3, '{"j": 1}'), (4, None)], "i int, t string")
    assert [tuple(r) for r in readers.json_fields(df, "t", "k int", "k").collect()] == [(1, 3)]
