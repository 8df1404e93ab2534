"""Ordered work by blocks with a carry: running aggregates, runs, next matches and automata over sequences of any length.

Rows are numbered once in the order (key, order) by range partitions, so a key with most rows lies in many blocks of fixed size. What a
block does to the state of a sequence is one value of a monoid (sums, maxima, run summaries, transition vectors): it is made in each block by itself, carried
over the blocks of a key, and applied in each block again. No window or array holds more than a block, or one value a block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.tables import written
from .normalize import with_ordinal

#: Rows of a block, and blocks of a superblock.
BLOCK = 4096
SYMBOLS = 256


def in_blocks(df: DataFrame, key: str | None, order: list[str], size: int = BLOCK) -> DataFrame:
    """df with _o, a dense number in the order (key, order), and _b, its block; with _k, the key (0 without one). Name columns that leave no ties: tied rows keep no fixed order."""
    d = with_ordinal(df.withColumn("_k", F.col(key) if key else F.lit(0)), "_k", *order, name="_o")
    return d.withColumn("_b", F.floor(F.col("_o") / size))


def carried(blocks: DataFrame, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, minima: dict[str, Column] | None = None, *, inclusive: bool = True, backward: bool = False) -> DataFrame:
    """Running sums (0 at first), maxima and minima (null at first) of in_blocks() rows, over the rows of the key up to this one.

    inclusive: with this row itself. backward: over the rows from this one on. One window runs inside blocks, one over the blocks of a key.
    """
    parts = [(n, c, f) for given, f in ((sums, F.sum), (maxima, F.max), (minima, F.min)) for n, c in (given or {}).items()]
    d = blocks.select("*", *[c.alias(f"_v_{n}") for n, c, _ in parts])
    toward = F.desc if backward else F.asc
    inner = W.partitionBy("_k", "_b").orderBy(toward("_o")).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    whole = d.groupBy("_k", "_b").agg(*[f(f"_v_{n}").alias(f"_w_{n}") for n, _, f in parts])
    outer = W.partitionBy("_k").orderBy(toward("_b")).rowsBetween(W.unboundedPreceding, -1)
    whole = whole.select(F.col("_k").alias("_k2"), F.col("_b").alias("_b2"), *[f(f"_w_{n}").over(outer).alias(f"_c_{n}") for n, _, f in parts])
    d = d.select("*", *[f(f"_v_{n}").over(inner).alias(f"_i_{n}") for n, _, f in parts])
    d = d.join(whole, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_b") == F.col("_b2")))
    both = {F.sum: lambda i, c: F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0)), F.max: F.greatest, F.min: F.least}
    return d.select(*blocks.columns, *[both[f](F.col(f"_i_{n}"), F.col(f"_c_{n}")).alias(n) for n, _, f in parts])


def numbered_within(df: DataFrame, key: str, order: list[str], name: str = "within") -> DataFrame:
    """df with a dense number from 1 within its key: the number over all less the key's first one, so no window runs over a key."""
    d = in_blocks(df, key, order)
    first = d.groupBy(F.col("_k").alias("_k2")).agg(F.min("_o").alias("_first"))
    d = d.join(first, F.col("_k").eqNullSafe(F.col("_k2"))).withColumn(name, F.col("_o") - F.col("_first") + 1)
    return plain(d.drop("_k2", "_first"))


def plain(blocks: DataFrame) -> DataFrame:
    """Without the columns of in_blocks()."""
    return blocks.drop("_k", "_o", "_b")


# Run summaries: of a sequence of flags, the flagged rows it starts with, ends with, the most in a row, and its length.


def summary(flags: Column) -> Column:
    """struct(prefix, suffix, best, length) of an array of booleans."""
    one = lambda x: F.struct(*[x.cast("long").alias(n) for n in ("prefix", "suffix", "best")], F.lit(1).cast("long").alias("length"))
    return F.aggregate(flags, empty(), lambda s, x: merged(s, one(x)))


def empty() -> Column:
    return F.struct(*[F.lit(0).cast("long").alias(n) for n in ("prefix", "suffix", "best", "length")])


def merged(a: Column, b: Column) -> Column:
    """The summary of one sequence followed by another."""
    return F.struct(
        F.when(a["prefix"] == a["length"], a["length"] + b["prefix"]).otherwise(a["prefix"]).alias("prefix"),
        F.when(b["suffix"] == b["length"], b["length"] + a["suffix"]).otherwise(b["suffix"]).alias("suffix"),
        F.greatest(a["best"], b["best"], a["suffix"] + b["prefix"]).alias("best"),
        (a["length"] + b["length"]).alias("length"),
    )


def _in_order(place: str, value: str) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(place, value))), lambda x: x[value])


def run_summaries(df: DataFrame, key: str | None, order: list[str], flag: Column, size: int = BLOCK) -> DataFrame:
    """key, prefix, suffix, best, length of each key's rows in order; a null flag is not set. No rows, no keys.

    Blocks of rows, then blocks of blocks, then the rest: three levels hold 4096 values each for 6.9e10 rows of one key. Rows are read once, so
    their places need no table and no dense numbers: range partitions in order, and places in them.
    """
    d = df.select((F.col(key) if key else F.lit(0)).alias("_k"), *order, F.coalesce(flag, F.lit(False)).alias("_f"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(parts, "_k", *order).sortWithinPartitions("_k", *order).select("_k", "_f", F.monotonically_increasing_id().alias("_o"))
    d = d.withColumn("_b", F.floor(F.col("_o") / size))
    s = d.groupBy("_k", "_b").agg(summary(_in_order("_o", "_f")).alias("_s"))
    fold = lambda values: F.aggregate(values, empty(), merged)
    s = s.groupBy("_k", F.floor(F.col("_b") / size).alias("_b")).agg(fold(_in_order("_b", "_s")).alias("_s"))
    s = s.groupBy("_k").agg(fold(_in_order("_b", "_s")).alias("_s"))
    return s.select(*([F.col("_k").alias(key)] if key else []), "_s.*")


def joined_summaries(earlier: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """Summaries of the rows of two tables, all of `earlier` before all of `later`, from theirs alone; keys of one table are taken as they are."""
    names = ("prefix", "suffix", "best", "length")
    pack = lambda d, n: d.select(F.col(key).alias(f"_{n}"), F.struct(*names).alias(n))
    j = pack(earlier, "a").join(pack(later, "b"), F.col("_a").eqNullSafe(F.col("_b")), "full")
    # A key without rows on one side has a null summary there.
    out = j.select(F.when(F.col("a").isNull(), F.col("_b")).otherwise(F.col("_a")).alias(key), merged(F.coalesce("a", empty()), F.coalesce("b", empty())).alias("s"))
    return out.select(key, "s.*")


def longest_runs(df: DataFrame, key: str | None, order: list[str], flag: Column) -> DataFrame:
    """key, longest: the most flagged rows in a row."""
    s = run_summaries(df, key, order, flag)
    return s.select(*([key] if key else []), F.col("best").alias("longest"))


def _with_run(df: DataFrame, key: str | None, order: list[str], flag: Column, size: int) -> DataFrame:
    d = in_blocks(df.withColumn("_f", F.coalesce(flag, F.lit(False))), key, order, size)
    d = carried(d, maxima={"_reset": F.when(~F.col("_f"), F.col("_o"))}, minima={"_first": F.col("_o")})
    return d.withColumn("run", F.col("_o") - F.coalesce("_reset", F.col("_first") - 1)).drop("_f", "_reset", "_first")


def run_lengths(df: DataFrame, key: str | None, order: list[str], flag: Column, size: int = BLOCK) -> DataFrame:
    """df with run: how many flagged rows in a row end with this one."""
    return plain(_with_run(df, key, order, flag, size))


def until_limit(df: DataFrame, key: str | None, order: list[str], flag: Column, limit: int, size: int = BLOCK) -> DataFrame:
    """Rows up to the one at which a run first reaches the limit, that one with stopped true; the rest of the key is left out. A limit under 1 stops nothing. Adds run and stopped."""
    d = _with_run(df, key, order, flag, size)
    d = d.withColumn("_at", (F.col("run") >= limit) if limit >= 1 else F.lit(False))
    d = carried(d, sums={"_before": F.col("_at").cast("long")}, inclusive=False)
    return plain(d.where("_before = 0").withColumn("stopped", F.col("_at")).drop("_at", "_before"))


def next_match(df: DataFrame, key: str | None, order: str, start: Column, end: Column, size: int = BLOCK) -> DataFrame:
    """Start rows with end_at: the place (the value of `order`) of the first end row behind each, null without one."""
    d = in_blocks(df.withColumn("_start", start), key, [order], size)
    return plain(carried(d, minima={"end_at": F.when(end, F.col(order))}, inclusive=False, backward=True).where("_start").drop("_start"))


# Automata: a block's transition vector says for each state it may start in where it ends.


def _walked(start: Column, values: Column, step, number: Column) -> Column:
    """The states before each of several values, from a start state."""
    return F.slice(F.aggregate(values, F.array(start), lambda s, v: F.concat(s, F.array(step(F.element_at(s, -1), v)))), 1, number)


def with_states(df: DataFrame, key: str, order: str, symbol: Column, table: list[list[int]], start: int = 0, size: int = SYMBOLS, counts: dict[str, int] | None = None, lasts: dict[str, int] | None = None) -> DataFrame:
    """df with _o of in_blocks() and state, the automaton's state before each row of a sequence; for each name in counts how many earlier rows of the key have that symbol, in lasts the _o of the last one (null without).

    table[state][symbol] is the next state; a symbol that is null or outside the table is symbol 0. Orders are unique within a key. Rows are numbered once and lie in
    blocks of 256, written once: what a block does (its vector, counts and last places) is composed to what 256 blocks do; starts are carried down over
    superblocks, blocks and rows. Every step but the first holds 256 values, and rows move once into their blocks and once to meet the starts.
    """
    n, counts, lasts = len(table), counts or {}, lasts or {}
    by_symbol = F.array(*[F.array(*[F.lit(table[s][c]) for s in range(n)]) for c in range(len(table[0]))])
    sym = F.when(symbol.between(0, len(table[0]) - 1), symbol.cast("int")).otherwise(F.lit(0))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    # A value has what rows do to the state: v, counts and last places. A state has q instead of v.
    value = lambda v, count, last: F.struct(v, *[count(c).alias(c) for c in counts], *[last(c).alias(c) for c in lasts])
    both = lambda v, a, b: value(v, lambda c: a[c] + b[c], lambda c: F.coalesce(b[c], a[c]))
    nothing = value(F.sequence(F.lit(0), F.lit(n - 1)).alias("v"), lambda c: zero, lambda c: none)
    first = value(F.lit(start).alias("q"), lambda c: zero, lambda c: none)
    folded = lambda values: F.aggregate(values, nothing, lambda a, b: both(F.transform(a["v"], lambda x: F.get(b["v"], x)).alias("v"), a, b))
    before = lambda state, values, number: _walked(state, values, lambda s, b: both(F.get(b["v"], s["q"]).alias("q"), s, b), number)
    listed = lambda *columns: F.sort_array(F.collect_list(F.struct(*columns)))

    rest = [c for c in df.columns if c != key]
    rows = in_blocks(df, key, [order], size).withColumn("_y", sym).groupBy("_k", "_b").agg(F.min("_o").alias("_first"), listed("_o", *rest, "_y").alias("_rows"))
    rows = rows.withColumn("_rows", F.transform("_rows", lambda x: F.struct(*[x[c].alias(c) for c in (*rest, "_y")])))
    done = F.transform("_rows", lambda x, i: value(F.get(by_symbol, x["_y"]).alias("v"), lambda c: (x["_y"] == counts[c]).cast("long"), lambda c: F.when(x["_y"] == lasts[c], F.col("_first") + i)))
    rows = written(rows.withColumn("_v", folded(done)), "blocks")
    supers = rows.groupBy("_k", F.floor(F.col("_b") / size).alias("_s")).agg(listed("_b", "_v").alias("_blocks"))
    whole = supers.select("_k", "_s", folded(F.transform("_blocks", lambda x: x["_v"])).alias("_v")).groupBy("_k").agg(listed("_s", "_v").alias("_supers"))
    places = lambda of, name, state: F.explode(F.arrays_zip(F.transform(of, lambda x: x[name]).alias("b"), before(state, F.transform(of, lambda x: x["_v"]), F.size(of)).alias("q"))).alias("z")
    begin = lambda d: d.select(F.col("_k").alias("_k2"), F.col("z.b").alias("_b2"), F.col("z.q").alias("_q"))
    same = lambda b: F.col("_k").eqNullSafe(F.col("_k2")) & (F.col(b) == F.col("_b2"))
    # Left joins, though each block has its start: rows of few bytes as Parquet are many, and no side to broadcast.
    down = supers.join(begin(whole.select("_k", places("_supers", "_s", first))), same("_s"), "left")
    down = begin(down.select("_k", places("_blocks", "_b", F.col("_q"))))
    out = rows.join(down, same("_b"), "left").select("_k", "_first", F.posexplode(F.arrays_zip(F.col("_rows").alias("r"), before(F.col("_q"), done, F.size("_rows")).alias("q"))).alias("_i", "z"))
    out = out.select("_k", (F.col("_first") + F.col("_i")).alias("_o"), *[F.col(f"z.r.{c}").alias(c) for c in rest], F.col("z.q.q").alias("state"), *[F.col(f"z.q.{c}").alias(c) for c in (*counts, *lasts)])
    return out.withColumnRenamed("_k", key)


def states_before(df: DataFrame, key: str, order: str, symbol: Column, table: list[list[int]], start: int = 0, size: int = SYMBOLS) -> DataFrame:
    """key, order, state: with_states() without the rest."""
    d = df.select(key, order, symbol.alias("_symbol"))
    return with_states(d, key, order, F.col("_symbol"), table, start, size).select(key, order, "state")


def tag_table(tags: list[list[int]], more: tuple[int, ...] = ()) -> tuple[dict[int, int], list[list[int]], set[int]]:
    """An automaton that follows which tags the symbols read so far end with: (symbol of each token, those in `more` too, table, states in which a tag has just ended)."""
    symbols = {t: i + 1 for i, t in enumerate(sorted({t for tag in tags for t in tag} | set(more)))}
    heads = sorted({()} | {tuple(tag[:i]) for tag in tags for i in range(len(tag) + 1)}, key=lambda h: (len(h), h))
    number = {h: i for i, h in enumerate(heads)}
    ends = lambda read: next(read[i:] for i in range(len(read) + 1) if read[i:] in number)  # noqa: E731  # the longest tail that a tag starts with
    table = [[number[ends(h + (t,))] if t is not None else 0 for t in (None, *symbols)] for h in heads]
    full = {tuple(tag) for tag in tags if tag}
    return symbols, table, {number[h] for h in heads if any(h[i:] in full for i in range(len(h)))}


def grammar(tokens: DataFrame, key: str, *, start: int, end: int, newline: int, codes: tuple[int, int], sizes: tuple[int, int], rows: int, columns: int, tags: list[list[int]], stop_after: int = 0, stop: int | None = None, ended: int = 0) -> DataFrame:
    """key, pos, token, expected, ok: what may come at each place of recorded token streams, and whether it did.

    tokens: key, pos (unique in a key), token. Expected: `stop` once `stop_after` images (over the first `ended`) are done; outside images `text`
    (no code, start, end or line end), or `open` behind one of the tags (a start may come as well); in an image `height` and `width` (the two of `sizes`), `code`,
    `line` behind each row of `columns` codes, `end` behind `rows` rows; `any` where starts and ends do not pair. All of it depends on the tokens before alone, so
    it is made of running counts and of the tags' automaton, both by the same blocks: a stream of any length is checked in parallel.
    """
    t = F.col("token")
    symbols, table, open_states = tag_table(tags, (start, end))
    symbol = reduce(lambda c, kv: c.when(t == kv[0], kv[1]), symbols.items(), F.when(F.lit(False), 0)).otherwise(0)
    d = with_states(tokens.select(key, "pos", "token"), key, "pos", symbol, table, counts={"_starts": symbols[start], "_ends": symbols[end]}, lasts={"_last": symbols[start]})
    d = d.withColumn("_open", F.col("state").isin(*open_states) if open_states else F.lit(False))
    since, width = F.col("_o") - F.col("_last") - 1, columns + 1
    at = since - 1  # places behind the two sizes, from 1
    inside = F.when(since == 0, "height").when(since == 1, "width").when(at == width * rows + 1, "end").when(at % width == 0, "line").otherwise("code")
    outside = F.when(F.col("_open"), "open").otherwise("text")
    expected = F.when(F.col("_starts") == F.col("_ends"), outside).when(F.col("_starts") == F.col("_ends") + 1, inside).otherwise("any")
    if stop is not None and stop_after > 0:
        expected = F.when(F.greatest(F.col("_ends") - ended, F.lit(0)) >= stop_after, "stop").otherwise(expected)
    d = d.withColumn("expected", expected)
    e, code = F.col("expected"), t.between(*codes)
    words = ~(code | t.isin(start, end, newline))
    ok = F.when(e == "stop", t == (stop if stop is not None else -1)).when(e == "text", words).when(e == "open", words | (t == start)).when(e == "height", t == sizes[0]).when(e == "width", t == sizes[1])
    ok = ok.when(e == "line", t == newline).when(e == "end", t == end).when(e == "code", code).otherwise(F.lit(True))
    return d.select(key, "pos", "token", "expected", F.coalesce(ok, F.lit(False)).alias("ok"))


# Top-k by a threshold.


def top_by_threshold(df: DataFrame, keys: list[str], score: str, k: Column, parts: int = 32) -> DataFrame:
    """Rows whose score is that of the k-th greatest of their group, or more; ties are kept, as are all rows where k is not under their number. k (1 at least) may differ from group to group, not within one.

    The k best of each of `parts` parts of a group are found first, then the k-th of these, and rows are kept by comparing with it: no group is ordered as a whole, no rank is
    taken without a key. Rows with a null score go. keys may be empty: one group.
    """
    d = df.where(F.col(score).isNotNull()).withColumn("_n", F.greatest(F.lit(1), k.cast("long"))).withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    first = W.partitionBy(*keys, "_part").orderBy(F.desc(score))
    best = d.select(*keys, "_part", "_n", score).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= F.col("_n"))
    group = [F.struct(*keys).alias("_g")] if keys else [F.lit(0).alias("_g")]
    best = best.select(*group, "_n", F.col(score).alias("_s"))
    # Ordered among k rows a part, within the group.
    last = best.withColumn("_r", F.row_number().over(W.partitionBy("_g").orderBy(F.desc("_s")))).where(F.col("_r") <= F.col("_n")).groupBy("_g").agg(F.min("_s").alias("_least"))
    return d.withColumn("_g", group[0]).join(last.withColumnRenamed("_g", "_g2"), F.col("_g").eqNullSafe(F.col("_g2"))).where(F.col(score) >= F.col("_least")).select(*df.columns)


def k_of_state(tokens: DataFrame, key: str, order: list[str], start: Column, end: Column, inside: int, outside: int) -> DataFrame:
    """tokens with k: `inside` where one more start than ends lies before the row, else `outside`."""
    d = carried(in_blocks(tokens, key, order), sums={"_open": F.coalesce(start, F.lit(False)).cast("long") - F.coalesce(end, F.lit(False)).cast("long")}, inclusive=False)
    return plain(d.withColumn("k", F.when(F.col("_open") == 1, inside).otherwise(outside)).drop("_open"))


# Contexts of image blocks.


def context_blocks(tokens: DataFrame, key: str, start: int, end: int, first: Column | int = 0, least: int = 3) -> DataFrame:
    """key, block, start_at, end_at: the contexts in which image tokens are predicted, [start_at, end_at) of a stream, numbered over all streams in the order (key, start).

    tokens: key, pos (0, 1, 2 ... in each stream), token. Starts before `first` make no block. Each start takes the first end behind it that no earlier start took, so
    the i-th start takes the end number i + max over j <= i of (ends before start j) - j, a running maximum; without one it runs to the stream's end. The end itself is not in.
    Blocks under `least` tokens go. A null key is a stream.
    """
    t = F.col("token")
    # Only starts and ends are counted, so only they are numbered.
    of = tokens.select(key, "pos", "token", (F.col("pos") >= first).alias("_in")).where(t.isin(start, end))
    d = carried(in_blocks(of, key, ["pos"]), sums={"_e": (t == end).cast("long"), "_s": ((t == start) & F.col("_in")).cast("long")}, inclusive=False).drop("_o", "_b")
    starts = d.where((t == start) & F.col("_in")).select("_k", "pos", "_s", (F.col("_e") - F.col("_s")).alias("_lead"))
    s = carried(in_blocks(starts.withColumnRenamed("_k", key), key, ["pos"]), maxima={"_most": F.col("_lead")})
    s = s.select("_k", F.col("pos").alias("start_at"), (F.col("_s") + F.col("_most")).alias("_nth"))
    ends = d.where(t == end).select(F.col("_k").alias("_k2"), F.col("_e").alias("_nth2"), F.col("pos").alias("end_at"))
    length = tokens.groupBy(F.col(key).alias("_k3")).agg((F.max("pos") + 1).alias("_length"))
    s = s.join(ends, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_nth") == F.col("_nth2")), "left").join(length, F.col("_k").eqNullSafe(F.col("_k3")))
    s = s.select(F.col("_k").alias(key), "start_at", F.coalesce("end_at", "_length").alias("end_at")).where(F.col("end_at") - F.col("start_at") >= least)
    return with_ordinal(s, key, "start_at").select(key, F.col("ordinal").alias("block"), "start_at", "end_at")


def context_map(tokens: DataFrame, blocks: DataFrame, key: str, skip: int = 2) -> DataFrame:
    """key, pos, block, offset: for each place that is predicted in a block (behind its first `skip` tokens), where it stands there; the last block to start has it.

    Ends ascend with starts, so that is the last block whose start + skip is not behind the place, if it has not ended: one running maximum over places and marks.
    """
    place = lambda d, at, mark: d.select(key, at.alias("_place"), mark.alias("_mark"))
    mark = F.struct("start_at", "end_at", "block")
    none = F.lit(None).cast(blocks.select(mark.alias("m")).schema["m"].dataType)
    rows = place(tokens, F.col("pos"), none).unionByName(place(blocks, F.col("start_at") + skip, mark)).withColumn("_last", F.col("_mark").isNull())
    d = carried(in_blocks(rows, key, ["_place", "_last"]), maxima={"_in": F.col("_mark")}).where("_last and _place < _in.end_at")
    return d.select(F.col("_k").alias(key), F.col("_place").alias("pos"), F.col("_in.block").alias("block"), (F.col("_place") - F.col("_in.start_at")).alias("offset"))


def context_places(places: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """places (block, offset) with key and pos, the way back."""
    return places.join(blocks.select(key, "block", "start_at"), "block").withColumn("pos", F.col("start_at") + F.col("offset")).drop("start_at")
