"""Filter interaction audit: what each filter removes at each place of every order of the filters.

Documents are counted once for each part and pattern of failure flags; a CUBE over the flags and the part of these counts gives,
in the grouping-set rows whose selected flags are all false, how many documents each subset of filters leaves. A step of an order
is a pair of such subsets, without and with its filter, so all orders come from the same 80 pairs a part.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, written

#: The letters of the filters of the query, in their order as bits.
FILTERS = "ABCDE"


def text_flags(text: Column) -> dict[str, Column]:
    """A to D of the query: few words, few different words, many capitals, a sign. Null text is empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    # Bound once by a lambda, so that the words are found once for both counts.
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("different")))[0]
    return {
        "sizes": sizes,
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")).cast("long") > 2 * F.char_length(t).cast("long"),
        "D": t.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (failed), good, toxic: a row for each row of docs.

    The part is the source, null as the empty string. E: the same text (by SHA-256, null as empty) stands under a smaller doc_id;
    a null doc_id is smaller than none and has none smaller; rows of one doc_id do not repeat each other. A document is good or toxic if any of
    its labels rows says so; without one, or with nulls, it is neither. Texts are read once: what the flags say is written, and
    the least doc_id of each text joined back to it by plain exchanges, which split a text that most documents hold.
    """
    f = text_flags(F.col("text"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        f["sizes"].alias("sizes"), f["C"].alias("C"), f["D"].alias("D"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    )
    rows = rows.select("doc_id", "part", (F.col("sizes.n") < 200).alias("A"), (100 * F.col("sizes.different") < 50 * F.col("sizes.n")).alias("B"), "C", "D", "digest")
    rows = written(rows, "flags")
    least = written(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "least")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    out = rows.join(least, "digest", "left").join(marks, "doc_id", "left")
    return out.select("part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("least"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def survivors(rows: DataFrame, filters: list[str], part: str = "part", measures: tuple[str, ...] = ()) -> DataFrame:
    """part, mask, kept and a count for each flag of `measures`: documents left by each subset of filters (bit i of mask: filter i), zeros included."""
    counts = [F.count(F.lit(1)).alias("kept"), *[F.count_if(F.col(m)).alias(m) for m in measures]]
    patterns = written(rows.groupBy(part, *filters).agg(*counts), "patterns")
    names = ["kept", *measures]
    cube = patterns.cube(part, *filters).agg(*[F.sum(n).alias(n) for n in names], F.grouping(part).alias("_all"), *[F.grouping(f).alias(f"_{f}") for f in filters])
    chosen = reduce(lambda a, b: a & b, [(F.col(f"_{f}") == 1) | ~F.col(f) for f in filters])
    mask = reduce(lambda a, b: a + b, [(1 - F.col(f"_{f}").cast("int")) * (1 << i) for i, f in enumerate(filters)])
    found = cube.where((F.col("_all") == 0) & chosen).select(F.col(part).alias("part"), mask.alias("mask"), *names)
    every = patterns.select(F.col(part).alias("part")).distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("mask"))
    return every.join(found, ["part", "mask"], "left").na.fill(0, names)


def steps(filters: list[str]) -> list[tuple[str, int, int, int]]:
    """(filter_order, step, filter, mask before) of every order of the filters: a fixed table, k! * k rows for k filters."""
    out = []
    for order in permutations(range(len(filters))):
        before = 0
        for k, i in enumerate(order):
            out.append(("".join(filters[x] for x in order), k + 1, i, before))
            before |= 1 << i
    return out


def audit(rows: DataFrame, filters: list[str], part: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order and step.

    rows has a boolean for each filter (failed), none null, and the flags good and toxic. A part is any value of its column; no rows, no parts.
    shapley is the filter's removed summed over all orders: each pair of subsets counts as often as orders have it.
    """
    spark, k = rows.sparkSession, len(filters)
    s = written(survivors(rows, filters, part, (good, toxic)), "survivors")
    pairs = [(b, i, b | 1 << i, factorial(b.bit_count()) * factorial(k - 1 - b.bit_count())) for b in range(1 << k) for i in range(k) if not b >> i & 1]
    pairs = spark.createDataFrame(pairs, "mask int, filter int, after int, orders long")
    after = s.select(F.col("part").alias("_part"), F.col("mask").alias("after"), F.col("kept").alias("_kept"), F.col(good).alias("_good"), F.col(toxic).alias("_toxic"))
    d = s.join(pairs, "mask").join(after, (F.col("part") == F.col("_part")) & (pairs["after"] == after["after"]))
    d = written(d.select("part", "mask", "filter", "orders", F.col("_kept").alias("kept"), (F.col("kept") - F.col("_kept")).alias("removed"), (F.col(good) - F.col("_good")).alias("good_lost"), (F.col(toxic) - F.col("_toxic")).alias("toxic_lost")), "pairs")
    alone = (1 << k) - 1 - F.call_function("shiftleft", F.lit(1), F.col("filter"))  # all filters but this
    whole = d.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("mask") == 0, F.col("removed"))).alias("fails"), F.sum(F.when(F.col("mask") == alone, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * F.col("orders")).alias("shapley")
    )
    plan = spark.createDataFrame(steps(filters), "filter_order string, step int, filter int, mask int")
    out = d.join(plan, ["filter", "mask"]).join(whole, ["part", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_cube(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(flagged(docs, labels), list(FILTERS))


#: DuckDB. Every order's steps are counted on the documents themselves.
SQL = r"""
with w as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1),
f as (
  select part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
      100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
      coalesce(w.doc_id > min(w.doc_id) over (partition by text), false)] as fail,
    coalesce(good, false) as good, coalesce(toxic, false) as toxic
  from w left join l on w.doc_id = l.doc_id
), g as (select part, fail, count(*) as n, count_if(good) as good, count_if(toxic) as toxic from f group by 1, 2),
x as (select unnest([1, 2, 3, 4, 5]) as i),
o as (select [a.i, b.i, c.i, d.i, e.i] as ord from x a, x b, x c, x d, x e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select ord, i as step, ord[i] as fl, ord[1:i - 1] as prev from o, x),
t as (
  select part, ord, step, fl, fail[fl] as own, list_bool_or([fail[p] for p in prev] || [false]) as gone, len(list_filter(fail, lambda z: z)) as fails, n, good, toxic from g, s
), r as (
  select part, ord, step, fl, coalesce(sum(n) filter (not gone and not own), 0)::bigint as kept, coalesce(sum(n) filter (not gone and own), 0)::bigint as removed,
    coalesce(sum(n) filter (gone and own), 0)::bigint as redundant, coalesce(sum(n) filter (own and fails = 1), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (not gone and own), 0)::bigint as good_lost, coalesce(sum(toxic) filter (not gone and own), 0)::bigint as toxic_lost
  from t group by 1, 2, 3, 4
)
select part, array_to_string([substr('ABCDE', p, 1) for p in ord], '') as filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) over (partition by part, fl)::bigint as shapley from r
"""
