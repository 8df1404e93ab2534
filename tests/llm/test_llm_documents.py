"""Near duplicates, decontamination, quality, mixing and token files."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import components, decontaminate as dc, minhash, mixing, quality, token_files as tf


def words(r, n, pool=500):
    return [f"w{r.randint(0, pool)}" for _ in range(n)]


def test_near_duplicates(spark):
    r = random.Random(4)
    docs = [(1, None), (2, ""), (3, "one two"), (4, "One TWO"), (5, "   ")]
    base = words(r, 120)
    for i in range(6, 46):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"n{r.randint(0, 99)}"
        docs.append((i, " ".join(w)))
    docs += [(i, " ".join(words(r, 60))) for i in range(50, 70)] + [(90, " ".join(base).upper()), (91, " ".join(base))]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, root int, bucket string")
    got = {x["doc_id"]: tuple(x)[1:] for x in minhash.near_duplicates(df, words=4).collect()}
    assert got == minhash.brute_force(docs)
    assert minhash.one_of_each(df, words=4).columns == df.columns
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    t = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (5, t), (5, "other words stand in this text")], "doc_id long, text string")
    got = sorted(((x["doc_id"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True), (5, None, False), (5, None, False)], key=str)


def test_signature_is_circulant():
    scatter, slices = minhash.permutations(8)
    s = np.array([3 << 44, 99 << 44, 12345 << 44], np.uint64)
    circle = slices[:, 0]
    want = [min(int(circle[(scatter[x] + k) % minhash.UNIVERSE]) for x in (3, 99, 12345)) for k in range(8)]
    assert minhash.signature(s, 8).tolist() == want


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (3, None), (4, "..."), (5, "short item"), (10, "never seen words at all")]


@pytest.mark.parametrize("block", [8 << 20, 20])
def test_contamination(spark, block):
    a = ITEMS[0][1]
    docs = [
        (1, f"intro, {a.upper()}! end"), (2, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (3, "beta gamma delta epsilon zeta eta theta iota kappa"), (4, None), (5, ""),
        (6, "a short-item; short"), (7, "short item short item"), (8, f"{a} x {a}"), (9, "shört item"),
    ]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, hits int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in dc.contamination(df, bench, block_bytes=block).collect()}
    assert got == dc.brute_force(docs, ITEMS)
    assert {r["doc_id"] for r in dc.decontaminated(df, bench, block_bytes=block).collect()} == {d for d, v in got.items() if not v[1]}
    assert dc.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    best = {(r["item_id"], r["item_pos"]): (r["length"], r["doc_id"], r["doc_pos"]) for r in dc.longest_matches(df, bench, block_bytes=block).collect()}
    assert best["1", 0] == (12, 1, 1) and best["1", 2] == (10, 1, 3) and best["2", 0] == (2, 6, 1)


def test_base_counts():
    assert quality.base_counts(b"") == (0, 0, 0, 0, 0, True)
    text = "a b c d e f g h a b c d e f g h\nsame line\nsame line\n \n \n#x <y> é\x0bz"
    n = quality.base_counts(text.encode())
    assert n == (24, sum(len(w) for w in text.replace("\x0b", " ").split()), 3, 1, 16, True)


def test_quality_learns_and_holds_out(spark):
    r = random.Random(1)
    good, bad = [f"good{i}" for i in range(200)], [f"junk{i}%" for i in range(200)]
    docs = [(i, " ".join(r.choices(good if i % 3 else bad, k=60))) for i in range(300)] + [(900, None), (901, "few words")]
    df = spark.createDataFrame([(d, t, True) for d, t in docs], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.judged(df, labels).collect()}
    assert sum(got[i]["kept"] == (i % 3 > 0) for i in range(200, 300)) >= 98
    assert got[900]["base_failed"] and not got[901]["kept"] and 0 <= got[0]["probability"] <= 1
    assert quality.kept_only(df, labels).columns == df.columns
    assert all(x["probability"] is None for x in quality.judged(df, labels.limit(0)).collect())


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, " ".join(words(r, r.randint(0, 80))), s) for i, s in enumerate(["a"] * 100 + ["b"] * 3 + ["c"] * 60 + [None] * 20 + ["empty"] * 2)]
    rows = [(d, "" if s == "empty" else t, s) for d, t, s in rows] + [(None, None, "a"), (7, rows[7][1], "a")]
    df = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, source string, size int")
    got = mixing.plan(df).collect()
    total = sum(x["size"] for x in got)
    by = {}
    for x in got:
        by.setdefault(x["source"], []).append(x)
        assert 0 <= x["taken"] <= 3 * x["size"]
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert sum(x["taken"] for x in v) == round(v[0]["target"]) and v[0]["target"] <= 3 * v[0]["source_size"]
    assert len(got) == len(rows) and sorted(map(str, mixing.plan(df.repartition(7)).collect())) == sorted(map(str, got))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    counted = {x["source"]: x["n"] for x in mixed.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()}
    assert {k: counted.get(k) or 0 for k in by} == {k: sum(x["taken"] for x in v) for k, v in by.items()}
    assert mixing.plan(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano(steps):
    values = np.concatenate([[0], np.cumsum(np.array(steps, np.int64))]).astype(np.int64)
    ef = tf.EliasFano.of(values)
    assert ef.all().tolist() == values.tolist()
    assert [ef.select(i) for i in range(0, len(values), 37)] == values[::37].tolist()
    ids = b"\1\0" * int(min(values[-1], 9))
    docs, again, back = tf.unpack(tf.pack([None] * len(steps), steps, ids, 2))
    assert docs == [None] * len(steps) and again.all().tolist() == values.tolist() and len(back) * 2 == len(ids)


def test_token_round_trip(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    texts = [None, "", "Hello, WORLD. don't", "ΑΣ Σας İstanbul ǰ J̌ ﬁ", "<|endoftext|> x<|startoftext|>", "naïve, über. ᄒ", "a\x01b \x1f c", "word " * 3000]
    df = spark.createDataFrame([(i * 3 if i != 4 else None, x, "p") for i, x in enumerate(texts)], "doc_id long, text string, path string")
    got = {r["doc_id"]: tuple(r)[1:] for r in tf.tokens(df).collect()}
    start = 0
    for d, x in sorted(((i * 3 if i != 4 else -1), x) for i, x in enumerate(texts)):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        assert got[None if d < 0 else d] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tf.tokens(df.limit(0)).count() == 0


def test_each_text_of_a_repeated_id_is_searched(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = [(5, a), (5, b), (9, a + " x"), (10, b + " y"), (11, None), (11, a), (12, ""), (None, b), (None, "alone"), (3, "alone")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x["doc_id"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(df, words=4).collect()}
    assert got == {(5, None, False), (9, None, False), (10, None, False), (11, None, False), (12, 12, True), (None, None, True), (3, None, False)}


def thue_morse(bits):
    a, b = b"a", b"b"
    for _ in range(bits):
        a, b = a + b, b + a
    return a.decode(), b.decode()


def test_hashes_tell_structured_texts_apart(spark):
    from corpusmill.llm import common, repeats

    for bits in (5, 7, 10, 12):
        a, b = thue_morse(bits)
        assert repeats.word_symbols(a.encode())[0] != repeats.word_symbols(b.encode())[0]
        x, y = (repeats.byte_symbols(t.encode()) for t in (a, b))
        n = len(a)
        assert common.grams(x, n, common.BASES[0])[0] != common.grams(y, n, common.BASES[0])[0]
        whole = np.array([0]), np.array([n])
        assert common.slices(x, *whole, common.BASES[1])[0] != common.slices(y, *whole, common.BASES[1])[0]
    docs = [(1, a), (2, b + " one two three"), (3, a + " " + " ".join(f"w{i}" for i in range(34))), (4, b + " " + " ".join(f"w{i}" for i in range(34)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x["doc_id"]: tuple(x)[1:] for x in minhash.near_duplicates(df, words=4).collect()} == minhash.brute_force(docs)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=80), st.integers(1, 40))
def test_equal_runs_have_equal_hashes(symbols, width):
    from corpusmill.llm import common

    x = np.array(symbols, np.uint64) + np.uint64(5)
    runs = common.grams(x, width, common.BASES[0])
    plain = [tuple(symbols[i : i + width]) for i in range(len(symbols) - width + 1)]
    assert len(runs) == max(0, len(plain)) and len(set(runs.tolist())) == len(set(plain))
    at = [(i, j) for i in range(len(symbols)) for j in range(i + 1, len(symbols) + 1)]
    got = common.slices(x, np.array([i for i, _ in at]), np.array([j for _, j in at]), common.BASES[1])
    seen = {}
    for h, (i, j) in zip(got.tolist(), at):
        assert seen.setdefault(h, tuple(symbols[i:j])) == tuple(symbols[i:j])
    assert len(seen) == len({tuple(symbols[i:j]) for i, j in at})


def test_large_buckets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 3)
    r = random.Random(9)
    core = words(r, 100)
    docs = []
    for i in range(60):  # four families that share a core, so that buckets mix them
        w = core + [f"f{i % 4}x{k}" for k in range(34)]
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"n{r.randint(0, 9)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x["doc_id"]: tuple(x)[1:] for x in minhash.near_duplicates(df, words=1).collect()} == minhash.brute_force(docs, words=1)


def test_recall_of_near_duplicates_at_full_size(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x["doc_id"]: tuple(x)[1:] for x in minhash.near_duplicates(df, words=4).collect()} == minhash.brute_force(docs)


def plain_counts(text):
    """The base counts by the letter of the contract."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    starts = {}
    for i in range(len(words) - 7):
        starts.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {i + k for places in starts.values() if len(places) > 1 for i in places for k in range(8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), failed


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "日本", "#", "x|y", "\n", "\n\n", " ", "\t", "\x0b", "\x85", " ", "long-word"]), max_size=90), st.sampled_from(["", " ", "\n"]))
def test_base_counts_against_a_plain_version(pieces, joint):
    text = joint.join(pieces)
    assert quality.base_counts(text.encode()) == plain_counts(text)


def test_base_counts_of_whole_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    for r in quality.judged(docs, labels).collect():
        want = plain_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["kept"] and want[-1]) and (want[-1] or r["kept"] == (r["probability"] >= quality.THRESHOLD))
