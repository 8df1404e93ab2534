"""Mixing sources to target weights by capped water-filling.

Sources in code point order (null last) take the given weights in rotation and share the whole size
of the input. A source stops at `max_epochs` times its own size; what it leaves is reshared by weight
until no target is above its cap. Then each document is taken a whole number of times, and one seeded
pass takes the rest of the target: documents in the order of a seeded hash, the last one in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import WORD


def targets(sizes: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """source, source_size -> also target (double), whole (epochs, long), rest (words of a further, partial epoch, long).

    A row per source; the null source is one, and comes last. Sources of size 0 get 0. All of it is
    integer arithmetic up to one division, so reruns agree. The one ordered window is over sources, not rows.
    """
    s = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  # products beyond a long at some 10^19 words times sources
    turn = F.array(*[F.lit(int(w)) for w in weights])
    s = s.withColumn("w", F.get(turn, F.pmod("rank", F.lit(len(weights)))).cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    fill = W.orderBy(F.col("cap") / F.col("w"), "rank")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.partitionBy()
    s = s.withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("left", F.sum("source_size").over(all_rows) - F.col("caps_before"))
    s = s.withColumn("w_left", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("full", wide("cap") * wide("w_left") <= wide("left") * wide("w"))
    s = s.withColumn("level", F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("w")).alias("ratio"), "rank", "left", "w_left"))).over(all_rows))
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("level.left") * F.col("w")).cast("double") / F.col("level.w_left").cast("double")))
    goal = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0).cast("long"))
    return s.withColumn("whole", whole).withColumn("rest", goal - F.col("whole") * F.col("source_size")).select("source", "source_size", "target", "whole", "rest")


def plan(docs: DataFrame, *, weights=(5, 2, 1), max_epochs: int = 3, seed: str = "mix", text: str = "text") -> DataFrame:
    """doc_id, source, text -> doc_id, source, size, source_size, target, whole, extra, taken; a row per row.

    Null text: size 0. Repeated rows are mixed like any others. Empty input: no rows. Other columns are not kept.
    The order of a source's partial epoch is that of md5(seed:doc_id), cut in 4096 parts first, so that a
    source with most of the rows is summed by part and only ordered within one part at a time.
    """
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"))
    rows = rows.withColumn("part", F.substring("key", 1, 3))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    sums = parts.withColumn("before", F.sum("part_size").over(W.partitionBy("source").orderBy("part")) - F.col("part_size"))
    goals = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, max_epochs)
    control = sums.alias("a").join(goals.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "part", "before", "source_size", "target", "whole", "rest")
    r = rows.alias("r").join(control.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.part") == F.col("c.part"))).select("r.*", "before", "source_size", "target", "whole", "rest")
    within = W.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    r = r.withColumn("extra", F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("rest") - at)))
    return r.withColumn("taken", F.col("size") * F.col("whole") + F.col("extra")).select("doc_id", "source", "size", "source_size", "target", "whole", "extra", "taken")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves: each document `whole` times, and once more cut after `extra` words where that is above 0.

    Keeps the columns of docs; n_chars, if there, is that of the text returned. Rows with a null doc_id get one share by (doc_id, source, size).
    """
    p = plan(docs, **options)
    share = p.groupBy("doc_id", "source", "size").agg(F.max("whole").alias("_whole"), F.sort_array(F.collect_list("extra")).alias("_extras"))
    nth = W.partitionBy("doc_id", "source", "_size").orderBy("text")
    d = docs.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    d = d.withColumn("_n", F.row_number().over(nth))
    on = d["doc_id"].eqNullSafe(share["doc_id"]) & d["source"].eqNullSafe(share["source"]) & (d["_size"] == share["size"])
    j = d.join(share, on).select(*[d[c] for c in d.columns], "_whole", F.get("_extras", F.col("_n") - 1).alias("_extra"))
    whole = F.when(F.col("_whole") > 0, F.array_repeat(F.lit(-1).cast("long"), F.col("_whole").cast("int"))).otherwise(F.expr("array()").cast("array<long>"))
    once = F.when((F.col("_extra") > 0) & (F.col("_extra") < F.col("_size")), F.array("_extra")).when(F.col("_extra") > 0, F.array(F.lit(-1).cast("long"))).otherwise(F.expr("array()").cast("array<long>"))
    j = j.withColumn("_cut", F.explode(F.concat(whole, once)))
    ends = F.expr(r"array_join(slice(regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0), 1, cast(_cut as int)), '')")
    j = j.withColumn("text", F.when(F.col("_cut") >= 0, ends).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        j = j.withColumn("n_chars", F.when(F.col("_cut") >= 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return j.select(*docs.columns)


def op10_water_filling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB. {documents} is the table.
SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, '')) as key from documents
), s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source),
w as (select *, (case rank % 3 when 0 then 5 when 1 then 2 else 1 end)::bigint as w, source_size * 3 as cap from s),
f as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over b, 0))::bigint as lft, (sum(w) over () - coalesce(sum(w) over b, 0))::bigint as w_left
  from w window b as (order by cap / w, rank rows between unbounded preceding and 1 preceding)
), g as (select *, cap * w_left <= lft * w as is_full from f),
l as (select lft, w_left from g where not is_full order by cap / w, rank limit 1),
t as (select source, source_size, case when is_full then cap::double else (l.lft * w)::double / l.w_left::double end as target from g left join l on true),
q as (select *, case when source_size > 0 then floor(target + 0.5)::bigint // source_size else 0 end as whole from t),
r as (select *, floor(target + 0.5)::bigint - whole * source_size as rest from q),
o as (select d.*, r.source_size, r.target, r.whole, r.rest,
        coalesce(sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as pos
      from d join r on d.source is not distinct from r.source)
select doc_id, size, source_size, target, (size * whole + least(size, greatest(0, rest - pos)))::bigint as taken from o
"""
