"""Work by blocks with a carry against plain loops, with block sizes small enough that every key has many."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import runs

SIZES = (1, 3, 7, 4096)


def rows_of(seed, n, hot=0.6):
    r = random.Random(seed)
    keys = [None, "a", "b", "c"]
    return [("hot" if r.random() < hot else r.choice(keys), i, r.choice([True, True, False, None])) for i in r.sample(range(3 * n), n)]


def by_key(rows):
    out = {}
    for k, i, f in sorted(rows, key=lambda x: x[1]):
        out.setdefault(k, []).append((i, bool(f)))
    return out


def plain_summary(flags):
    n = len(flags)
    prefix = next((i for i, f in enumerate(flags) if not f), n)
    suffix = next((i for i, f in enumerate(reversed(flags)) if not f), n)
    return prefix, suffix, max(len(x) for x in "".join("x" if f else " " for f in flags).split(" ")), n


@pytest.fixture(scope="module")
def table(spark):
    rows = rows_of(1, 160)
    return rows, spark.createDataFrame(rows, "k string, i long, f boolean").repartition(3).cache()


@pytest.mark.parametrize("size", SIZES)
def test_run_summaries(table, size):
    rows, df = table
    got = {r["k"]: tuple(r)[1:] for r in runs.run_summaries(df, "k", ["i"], F.col("f"), size).collect()}
    assert got == {k: plain_summary([f for _, f in v]) for k, v in by_key(rows).items()}


def test_summaries_merge_with_those_of_another_day(table):
    rows, df = table
    cut = sorted(i for _, i, _ in rows)[70]
    early, late = (runs.run_summaries(df.where(c), "k", ["i"], F.col("f")) for c in (F.col("i") < cut, F.col("i") >= cut))
    got = {r["k"]: tuple(r)[1:] for r in runs.joined_summaries(early, late, "k").collect()}
    assert got == {k: plain_summary([f for _, f in v]) for k, v in by_key(rows).items()}
    assert runs.joined_summaries(early.limit(0), late, "k").count() == late.count()


@pytest.mark.parametrize("size", SIZES)
def test_run_lengths_and_limit(table, size):
    rows, df = table
    want, kept = {}, {}
    for k, seq in by_key(rows).items():
        run, stopped = 0, False
        for i, f in seq:
            run = run + 1 if f else 0
            want[k, i] = run
            if not stopped:
                stopped = run >= 3
                kept[k, i] = (run, stopped)
    got = runs.run_lengths(df, "k", ["i"], F.col("f"), size)
    assert got.columns == [*df.columns, "run"] and {(r["k"], r["i"]): r["run"] for r in got.collect()} == want
    assert {(r["k"], r["i"]): (r["run"], r["stopped"]) for r in runs.until_limit(df, "k", ["i"], F.col("f"), 3, size).collect()} == kept
    assert runs.until_limit(df, "k", ["i"], F.col("f"), 0, size).count() == len(rows)


@pytest.mark.parametrize("size", SIZES)
def test_next_match(table, size):
    rows, df = table
    for key in ("k", None):
        groups = by_key(rows) if key else by_key([(0, i, f) for _, i, f in rows])
        want = {i: next((j for j, g in seq if j > i and not g), None) for seq in groups.values() for i, f in seq if f}
        d = df.withColumn("g", F.coalesce("f", F.lit(False)))
        assert {r["i"]: r["end_at"] for r in runs.next_match(d, key, "i", F.col("g"), ~F.col("g"), size).collect()} == want


def test_numbers_within_a_key(table):
    rows, df = table
    want = {(k, i): n for k, seq in by_key(rows).items() for n, (i, _) in enumerate(seq, 1)}
    assert {(r["k"], r["i"]): r["within"] for r in runs.numbered_within(df, "k", ["i"]).collect()} == want


def test_a_hot_key_lies_in_many_blocks(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("k"), "id")
    d = runs.in_blocks(df, "k", ["id"])
    assert d.where("k = 99").select("_b").distinct().count() >= 4
    assert d.groupBy("_b").count().agg(F.max("count")).first()[0] <= runs.BLOCK
    assert runs.longest_runs(df, "k", ["id"], F.lit(True)).where("k = 99").first()["longest"] == 18_000


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, i long, f boolean")
    assert runs.longest_runs(df, "k", ["i"], F.col("f")).collect() == [] and runs.until_limit(df, "k", ["i"], F.col("f"), 2).collect() == []
    assert runs.next_match(df, "k", "i", F.col("f"), ~F.col("f")).collect() == []
    assert runs.top_by_threshold(df, ["k"], "i", F.lit(2)).collect() == []


def test_automaton_states(spark):
    r = random.Random(3)
    table = [[(3 * s + c * c + 1) % 5 for c in range(4)] for s in range(5)]
    rows = [(k, i, r.choice([0, 1, 2, 3, 9, None])) for k in ("x", "y", None) for i in range(90)]
    want = {}
    for k in ("x", "y", None):
        s = 2
        for kk, i, c in rows:
            if kk == k:
                want[k, i] = s
                s = table[s][c if c in (0, 1, 2, 3) else 0]
    df = spark.createDataFrame(rows, "k string, i long, c int").repartition(4)
    for size in (2, 5, 256):
        got = runs.states_before(df, "k", "i", F.col("c"), table, 2, size)
        assert {(x["k"], x["i"]): x["state"] for x in got.collect()} == want


def test_tag_table():
    r = random.Random(8)
    for tags in ([[10, 11]], [[1, 2, 1], [2, 1, 3], [2]], [[1, 1, 1], []], []):
        symbols, table, full = runs.tag_table(tags)
        for _ in range(200):
            seq = [r.choice([1, 2, 3, 10, 11, 5]) for _ in range(12)]
            s = 0
            for n, t in enumerate(seq):
                s = table[s][symbols.get(t, 0)]
                assert (s in full) == any(tag and seq[: n + 1][-len(tag) :] == tag for tag in tags)


START, END, LINE, TALL, WIDE, STOP = 100, 101, 102, 200, 201, 7
SPEC = dict(start=START, end=END, newline=LINE, codes=(155000, 171383), sizes=(TALL, WIDE), rows=2, columns=3, tags=[[10, 11], [10, 12, 13]])


def plain_grammar(seq, stop_after=0, stop=None, ended=0):
    """Each place judged anew from the tokens before it."""
    out = []
    for n, token in enumerate(seq):
        before = seq[:n]
        starts, ends = before.count(START), before.count(END)
        code = 155000 <= token <= 171383
        word = not code and token not in (START, END, LINE)
        if stop is not None and stop_after and max(0, ends - ended) >= stop_after:
            out.append(("stop", token == stop))
        elif starts == ends:
            tagged = any(before[-len(t) :] == t for t in SPEC["tags"])
            out.append(("open", word or token == START) if tagged else ("text", word))
        elif starts != ends + 1:
            out.append(("any", True))
        else:
            gone = n - 1 - max(i for i, t in enumerate(before) if t == START)
            if gone < 2:
                out.append((("height", "width")[gone], token == (TALL, WIDE)[gone]))
            elif gone - 1 == 2 * 4 + 1:
                out.append(("end", token == END))
            elif (gone - 1) % 4 == 0:
                out.append(("line", token == LINE))
            else:
                out.append(("code", code))
    return out


def image():
    return [10, 11, START, TALL, WIDE, *([155001] * 3 + [LINE]) * 2, END]


def test_grammar(spark):
    r = random.Random(5)
    streams = {"good": [5, 6, *image(), 9, 10, 12, 13, *image()[2:], STOP, STOP], "empty": [], "long": image() * 40}
    for i in range(25):
        seq = list(streams["good"])
        for _ in range(r.randint(1, 4)):
            seq[r.randrange(len(seq))] = r.choice([START, END, LINE, TALL, 155003, 5, 10, 11, None])
        streams[f"bad{i}"] = [t if t is not None else 5 for t in seq]
    df = spark.createDataFrame([(k, n, t) for k, s in streams.items() for n, t in enumerate(s)], "id string, pos long, token long").repartition(4)
    for more in ({}, {"stop_after": 2, "stop": STOP}, {"stop_after": 1, "stop": STOP, "ended": 1}):
        got = {}
        for x in runs.grammar(df, "id", **SPEC, **more).collect():
            got.setdefault(x["id"], {})[x["pos"]] = (x["expected"], x["ok"])
        assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: plain_grammar(s, **more) for k, s in streams.items() if s}
        assert all(x[1] for x in got["good"].values()) == (more.get("stop_after") != 1 or more.get("ended") == 1)


def test_top_by_threshold(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(8)]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, s int, i int").repartition(3)
    of = {"a": 3, "b": 40, None: 0}
    k = F.when(F.col("g") == "a", 3).when(F.col("g") == "b", 40).otherwise(0)
    want = set()
    for g in of:
        mine = sorted((s for gg, s, _ in rows if gg == g and s is not None), reverse=True)
        least = mine[: max(1, of[g])][-1]
        want |= {i for gg, s, i in rows if gg == g and s is not None and s >= least}
    assert {x["i"] for x in runs.top_by_threshold(df, ["g"], "s", k, 4).collect()} == want
    whole = sorted((s for _, s, _ in rows if s is not None), reverse=True)[6]
    assert {x["i"] for x in runs.top_by_threshold(df, [], "s", F.lit(7)).collect()} == {i for _, s, i in rows if s is not None and s >= whole}


def test_k_of_state(spark):
    seq = "s..ee.sss.e"
    df = spark.createDataFrame([("k", i, c) for i, c in enumerate(seq)], "k string, i int, c string")
    got = [x["k2"] for x in runs.k_of_state(df.withColumnRenamed("k", "g"), "g", ["i"], F.col("c") == "s", F.col("c") == "e", 5, 1).select("i", F.col("k").alias("k2")).orderBy("i").collect()]
    assert got == [5 if seq[:i].count("s") == seq[:i].count("e") + 1 else 1 for i in range(len(seq))]


def test_contexts_number_starts_and_ends_alone(spark, monkeypatch):
    numbered, plain_blocks = [], runs.in_blocks
    monkeypatch.setattr(runs, "in_blocks", lambda df, *a, **k: numbered.append(df.count()) or plain_blocks(df, *a, **k))
    tokens = spark.createDataFrame([(1, p, t) for p, t in enumerate([7, 8, 1, 5, 5, 5, 2, 7])], "id long, pos long, token long")
    got = [tuple(r) for r in runs.context_blocks(tokens, "id", 1, 2).collect()]
    assert got == [(1, 0, 2, 6)] and numbered[0] == 2


def test_states_carry_counts_and_last_places(spark):
    r = random.Random(9)
    table = [[(2 * s + c) % 3 for c in range(4)] for s in range(3)]
    rows = [(k, 7 * i, r.choice([0, 1, 2, 3, 9, None])) for k in ("x", "y", None) for i in range(90)]
    want = {}
    for k in ("x", "y", None):
        s, gone = 1, []
        for kk, i, c in rows:
            if kk == k:
                want[k, i] = (c, s, gone.count(1), gone.count(2), next((n for n, x in enumerate(reversed(gone)) if x == 1), None))
                s = table[s][c if c in (0, 1, 2, 3) else 0]
                gone.append(c)
    df = spark.createDataFrame(rows, "k string, i long, c int").repartition(4)
    for size in (2, 5, 256):
        got = runs.with_states(df, "k", "i", F.col("c"), table, 1, size, counts={"ones": 1, "twos": 2}, lasts={"at": 1}).withColumn("since", F.col("_o") - F.col("at") - 1)
        assert {(x["k"], x["i"]): (x["c"], x["state"], x["ones"], x["twos"], x["since"]) for x in got.collect()} == want


def test_grammar_numbers_its_tokens_once(spark, monkeypatch):
    numbered, plain_blocks = [], runs.in_blocks
    monkeypatch.setattr(runs, "in_blocks", lambda df, *a, **k: numbered.append(df.count()) or plain_blocks(df, *a, **k))
    tokens = spark.createDataFrame([(1, p, t) for p, t in enumerate([START, None, START, 10, START])], "id long, pos long, token long")
    got = runs.grammar(tokens, "id", **SPEC | {"tags": [[START, 10]]}).orderBy("pos").collect()
    assert [x["expected"] for x in got] == ["text", "height", "width", "any", "any"] and numbered == [5]


def test_numbering_joins_no_rows(spark):
    plan = runs.in_blocks(spark.range(50).withColumn("k", F.col("id") % 3), "k", ["id"])._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1
