"""Filter audit, alignment of tokenizers and sharding, against plain versions."""

import itertools
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import alignment as al, filter_audit as fa, sharding as sh

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, part string, shard int, kept long"


def documents(spark, rows):
    """With columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, "p", 3, 4) for r in rows], DOCS)


# Filter audit.


def plain_audit(docs, labels):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    parts = {}
    for d, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and first.get(t, d) < d,
        }
        parts.setdefault(s or "", []).append((fails, d in good, d in toxic))
    out = set()
    for part, rows in parts.items():
        removed_by = Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                removed_by[f] += len(gone)
                steps.append((f, ("".join(order), k, len(left), len(gone), sum(x[0][f] for x in rows) - len(gone), sum(x[0][f] and sum(x[0].values()) == 1 for x in rows), sum(x[1] for x in gone), sum(x[2] for x in gone))))
        out |= {(part, *s, removed_by[f]) for f, s in steps}
    return out


def audit_rows(seed=3):
    r = random.Random(seed)
    pool = ["", None, "A B C", "low " * 250, "cost $5 " + " ".join(f"w{i}" for i in range(240)), "X" * 9 + " word", "a\x0bb\x0cc\x1cd e", " ".join(f"v{i}" for i in range(200)), "w" * 200_000 + "&"]
    docs = [(r.choice([None, *range(20)]), r.choice(pool), r.choice(["s", "t", "", None, "hot", "hot", "hot"])) for _ in range(60)]
    labels = [(r.choice([None, *range(20)]), r.choice([0, 1, None]), r.choice([0, 0, 1, None])) for _ in range(25)]
    return docs + docs[:5], labels


def test_audit(spark):
    docs, labels = audit_rows()
    df = documents(spark, docs).repartition(3)
    lab = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = [tuple(r) for r in fa.audit(fa.flagged(df, lab), list("ABCDE")).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(docs, labels)


def test_audit_of_no_rows_and_fewer_filters(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = documents(spark, [(1, "a", "s")])
    assert fa.audit(fa.flagged(df.limit(0), lab), list("ABCDE")).count() == 0
    two = fa.audit(fa.flagged(df, lab), ["A", "D"]).collect()
    assert sorted((r["filter_order"], r["step"], r["kept"], r["removed"], r["shapley"]) for r in two) == [("AD", 1, 0, 1, 2), ("AD", 2, 0, 0, 0), ("DA", 1, 1, 0, 0), ("DA", 2, 0, 1, 2)]
    assert len(fa.steps(list("ABCDE"))) == 600


# Alignment.


@lru_cache
def models():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B), {c: n for n, c in byte_characters()}


def plain_alignment(text):
    """Groups by the ends that both have, one at a time."""
    if not text:
        return None
    a, b, byte = models()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    of_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
        return None
    ends_a, ends_b = list(itertools.accumulate(map(len, of_a))), list(itertools.accumulate(map(len, of_b)))
    cuts = sorted(set(ends_a) & set(ends_b))
    groups = [([], []) for _ in cuts]
    for side, ids, ends in ((0, ids_a, ends_a), (1, ids_b, ends_b)):
        for i, e in zip(ids, ends):
            groups[bisect_left(cuts, e)][side].append(i)
    by_end = dict(zip(ends_b, ids_b))
    links = [(i, by_end[e]) for i, e in zip(ids_a, ends_a) if e in by_end]
    return len(ids_a), len(ids_b), groups, links


def byte_characters():
    n = 0
    for b in range(256):
        if 33 <= b < 127 or 161 <= b < 173 or 174 <= b:
            yield b, chr(b)
        else:
            yield b, chr(256 + n)
            n += 1


def shown(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


ODD = ["a\r\nb", "x  y", "▁ sign", "one two", "<|endoftext|>", "<s> <0x41> </s>", "\x00 nul", " ", "  ", "\n", "\n\n x", "tab\t\tend ", " lead", "é́ 漢字 \U0001f642", "it's we'll I'M", "12٩² ½", "café\n \nnaïve"]


@pytest.fixture(scope="module")
def aligner():
    return al.aligner(A, B)


def test_texts_one_by_one(aligner):
    r = random.Random(2)
    texts = ODD + ["".join(r.choice(" \n\t.,'aBséß漢\U0001f642́019") for _ in range(r.randint(1, 60))) for _ in range(800)]
    for text, got in zip(texts, aligner.texts(texts)):
        want = plain_alignment(text)
        if want is None:
            assert got is None, text
        else:
            assert got[0] == shown(want[2]) and got[2:] == want[:2], text
            assert [divmod(int(k), len(aligner.b.bytes)) for k in np.frombuffer(got[1], f"<u{aligner.width}")] == want[3], text
    assert aligner.by_words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(min_size=0, max_size=40), min_size=1, max_size=8))
def test_any_texts_by_words_and_whole(texts):
    a = al.aligner(A, B)
    assert a.texts(texts) == [a.whole(t) if t else None for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30))
def test_groups_of_intervals(a, b):
    short, long = sorted((a, b), key=sum)
    short.append(sum(long) - sum(short) or 1)
    if sum(short) != sum(long):
        long.append(sum(short) - sum(long))
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    of = lambda ends: [sum(c < e for c in cuts) for e in ends]
    got = al.groups(ends_a, ends_b)
    assert got[0].tolist() == of(ends_a) and got[1].tolist() == of(ends_b)
    first, last = al.overlaps(ends_a, ends_b)
    for i, e in enumerate(ends_a):
        s = e - a[i]
        over = [j for j, f in enumerate(ends_b) if f > s and f - b[j] < e]
        assert [first[i], last[i]] == [over[0], over[-1]]


def plain_table(docs):
    found = [(d, plain_alignment(t)) for d, t in docs]
    n = Counter(link for _, x in found if x for link in x[3])
    most = {}
    for (a, b), k in n.items():
        most[b] = max(k, most.get(b, 0))
    return sorted(
        (
            (d, 0, 0, 0, 0, 0, 0, "") if x is None
            else (d, x[0], x[1], len(x[2]), len(x[3]), sum(n[l] == most[l[1]] for l in x[3]), sum(n[l] for l in x[3]), sha256(shown(x[2]).encode()).hexdigest())
            for d, x in found
        ),
        key=repr,
    )


def test_alignment_query(spark):
    from corpusmill.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    df = queries.QUERIES["op12_interval_index"](spark, DATA)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, df.select(columns).collect()), key=repr) == plain_table(rows)


def test_alignment_of_odd_rows(spark):
    texts = [None, "", *ODD, "same text here", "same text here", "long " * 50_000 + "\n" * 3000]
    rows = [(i if i % 5 else None, t, None) for i, t in enumerate(texts)]
    got = al.alignment(documents(spark, rows), digest=True).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    assert sorted(map(tuple, got), key=repr) == plain_table([r[:2] for r in rows])
    plain = al.alignment(documents(spark, rows[5:9])).collect()
    assert {r["groups"] for r in plain} == {shown(x[2]) if (x := plain_alignment(t)) else "" for _, t, _ in rows[5:9]}
    assert al.alignment(documents(spark, rows).limit(0)).count() == 0


def test_pair_bound(aligner):
    a, b = [b"a", b"ba", b" c"], [b"a", b"a", b"c", b"xba"]
    linked = sum(x.endswith(y) or y.endswith(x) for x in a for y in b)
    assert al.pair_bound(a, b) == linked
    assert 10_000 < al.pair_bound(aligner.a.bytes, aligner.b.bytes) < 1_000_000


# Sharding.


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    rows = np.arange(n)
    for seed in (0, 7, sh.SEED):
        places = sh.permuted(rows, n, seed)
        assert sorted(places.tolist()) == list(range(n)) and (sh.unpermuted(places, n, seed) == rows).all()
        for i in (0, n // 2, n - 1):  # one at a time, without the others
            assert sh.permuted(np.array([i]), n, seed)[0] == places[i]
    assert n < 100 or (sh.permuted(rows, n, 1) != sh.permuted(rows, n, 2)).mean() > 0.9


def test_permutation_scatters():
    p = sh.permuted(np.arange(100_000), 100_000)
    shard = p % 16
    runs = np.bincount(shard[:1000], minlength=16)  # the first rows, as those of one source, go everywhere
    assert runs.min() > 30 and abs(np.corrcoef(np.arange(100_000), p)[0, 1]) < 0.02
    big = 10**15 + 37
    some = np.array([0, 5, big - 1])
    assert (sh.unpermuted(sh.permuted(some, big), big) == some).all()


def check_shards(rows, got, shards):
    n = len(rows)
    at = {}
    for x in got:
        at.setdefault(x["shard"], []).append(x["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in at.values())
    sizes = [len(at.get(s, [])) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_shards(spark):
    texts = [None, "", "x", "same", "same", "é漢", "long " * 100_000]
    rows = [(i if i % 4 else None, texts[i % 7], None) for i in range(100)] + [(5, "same", None)] * 30
    df = documents(spark, rows).repartition(3)
    got = sh.sharded(sh.digests(df), "doc_id", "text_crc32", "size").collect()
    check_shards(rows, got, 16)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    # The row, and so the place, of every row is that of its rank; other partitions and another order of the input give the same.
    ranked = sorted(want.elements(), key=lambda x: (x[0] is not None, x[0] or 0, x[2], x[1]))
    place = sh.permuted(np.arange(len(ranked)), len(ranked)).tolist()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got), key=repr) == sorted(((*x, p % 16, p // 16) for x, p in zip(ranked, place)), key=repr)
    again = sh.sharded(sh.digests(df.orderBy(F.desc("doc_id")).repartition(7)), "doc_id", "text_crc32", "size").drop("row").collect()
    assert sorted(map(tuple, again), key=repr) == sorted((tuple(r)[:3] + (r["shard"], r["slot"]) for r in got), key=repr)
    assert sh.sharded(df.limit(0), "doc_id").count() == 0


def test_query_has_every_document(spark):
    from corpusmill.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    df = queries.QUERIES["op13_feistel"](spark, DATA)
    got = df.collect()
    check_shards(rows, got, 16)
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows}
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)} and df.dtypes[-1] == ("grown_shard", "int")


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i}", "s") for i in range(83)]
    sh.write_shards(documents(spark, rows), str(tmp_path / "out"), "doc_id", "text", shards=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    got = back.collect()
    check_shards(rows, got, 5)
    assert sorted((r["doc_id"], r["text"], r["part"]) for r in got) == [(i, t, "p") for i, t, _ in rows]
    import pyarrow.parquet as pq

    files = sorted((tmp_path / "out").rglob("*.parquet"))
    slots = [pq.read_table(f, partitioning=None)["slot"].to_pylist() for f in files]
    assert all(x == sorted(x) for x in slots) and len(files) <= 20
    # A row is found from its shard and slot alone.
    for r in got[:10]:
        assert sh.unpermuted(np.array([r["slot"] * 5 + r["shard"]]), 83)[0] == r["row"] == r["doc_id"]
