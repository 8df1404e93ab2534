"""Suffix sorting, suffix-array dedup and suffix-tree dedup against brute force."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from corpusmill.llm import suffix_array as sa, suffix_tree as tree

SCHEMA = "doc_id long, text string, doc string, h long"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_sort_suffixes(symbols):
    x = symbols + [0]
    order = sa.sort_suffixes(x)
    assert order == sorted(range(len(x)), key=lambda i: x[i:])
    shared = sa.common_prefixes(x, order)
    for k in range(1, len(x)):
        assert x[order[k] :][: shared[k]] == x[order[k - 1] :][: shared[k]]


def test_branches_are_where_strings_part():
    assert sa.branches([b"abcd", b"abce", b"abx", b"q"]) == [[2, 3], [2, 3], [2], []]


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{r.randint(0, 400)}é" for _ in range(3000)]
    passage = " ".join(words[:60])
    base = words[100:260]
    docs = [(None, "null id " + passage), (1, None), (2, ""), (3, " ".join(base)), (4, " ".join(base)), (5, "x" * 99), (6, "x" * 450), (7, passage), (8, "y " * 5000)]
    for i in range(9, 60):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"n{r.randint(0, 999)}"
        w[r.randrange(len(w)) : 0] = passage.split() if r.random() < 0.4 else []
        docs.append((i, ("\n" if r.random() < 0.2 else " ").join(w[r.randint(0, 30) :])))
    docs.append((70, " ".join(words[500:1500])))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_remove_repeated_bytes(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], SCHEMA)
    got = {r["doc_id"]: tuple(r)[1:] for r in sa.remove_repeats(df).collect()}
    want = sa.brute_force([(-1 if d is None else d, t) for d, t in docs])
    assert {(-1 if k is None else k): v for k, v in got.items()} == want


@pytest.mark.parametrize("group", [2000, 2])
def test_remove_repeated_words(spark, monkeypatch, group):
    monkeypatch.setattr(tree, "GROUP", group)
    docs = corpus(3)
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], SCHEMA)
    got = {r["doc_id"]: tuple(r)[1:] for r in tree.remove_repeats(df).collect()}
    assert got == tree.brute_force(docs)


def test_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"word{i}" for i in range(50))
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r["n_removed"] for r in sa.remove_repeats(df).collect()] == [0, 0]
    assert [r["n_removed"] for r in tree.remove_repeats(df).collect()] == [50, 50]
    assert sa.remove_repeats(df.limit(0)).count() == 0 and tree.remove_repeats(df.limit(0)).count() == 0


def test_subtree_nodes():
    nodes = tree.subtree([["a", "b"], ["a", "b", "c"], ["a", "d"], ["e"]])
    assert sorted(nodes) == [(0, 0, 4), (1, 0, 3), (2, 0, 2)]


def test_one_very_long_text(spark):
    r = random.Random(7)
    words = [f"x{r.randint(0, 10**6)}" for _ in range(150_000)]
    words[100_000:100_050] = words[500:550]
    docs = [(1, " ".join(words)), (2, "short " + " ".join(words[70_000:70_060]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x["doc_id"]: tuple(x)[1:] for x in sa.remove_repeats(df).collect()}
    assert got == sa.brute_force(docs)
    assert {x["doc_id"]: tuple(x)[1:] for x in tree.remove_repeats(df).collect()} == tree.brute_force(docs)


def test_structured_words_do_not_meet(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rest = " ".join(f"w{i}" for i in range(34))
    docs = [(1, f"{a} {rest}"), (2, f"{b} {rest}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert [x["n_removed"] for x in tree.remove_repeats(df).orderBy("doc_id").collect()] == [0, 0]
    assert {x["doc_id"]: tuple(x)[1:] for x in sa.remove_repeats(df).collect()} == sa.brute_force(docs)


def test_many_copies_in_one_batch(spark):
    base = " ".join(f"c{i}" for i in range(45))
    docs = [(i % 7 * 1000 + i, base + (f" end{i}" if i % 3 else "")) for i in range(90)] + [(9000 + i, f"lead{i} " + base) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert {x["doc_id"]: tuple(x)[1:] for x in sa.remove_repeats(df).collect()} == sa.brute_force(docs)
    assert {x["doc_id"]: tuple(x)[1:] for x in tree.remove_repeats(df).collect()} == tree.brute_force(docs)
