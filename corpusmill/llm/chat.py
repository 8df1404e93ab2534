"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant, all
others as named users and narrators (system) as they are. The rendered dialogue is a row for each turn: its piece of
text and where that starts, and the part of it that is trained on (the assistant's text and end mark).
No conversation is collected: offsets are sums over blocks of turns, so one that holds most rows is still many small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import written

NARRATORS = ("system",)
END = "<|end|>\n"
BLOCK = 256


def _plain(c: Column) -> Column:
    """Text in which no mark of the template can stand."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotated(turns: DataFrame, narrators=NARRATORS) -> DataFrame:
    """conv_id, speaker, turn, as_role, piece, start, mask_start, mask_end of every turn in every participant's view.

    Turns are ordered by turn (null first), role, text; rows that agree in all are interchangeable. A null or empty role
    is the participant 'unknown'. Null text is empty. A conversation of narrators only has no participant and no rows.
    A null conv_id is a conversation. Offsets count characters; turns not trained on have null masks. Other columns are
    not kept. Empty table: no rows.
    """
    t = turns.select("conv_id", "turn", F.coalesce(F.nullif("role", F.lit("")), F.lit("unknown")).alias("role"), _plain(F.col("text")).alias("text"))
    told = F.col("role").isin(*narrators)
    # Written, so that the join has plain exchanges on both sides: AQE splits a conversation that holds most turns.
    speakers = written(t.where(~told).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct(), "speakers")
    j = t.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    mine = F.col("role") == F.col("speaker")
    as_role = F.when(told, F.col("role")).when(mine, F.lit("assistant")).otherwise(F.lit("user"))
    head = F.when(told, F.concat(F.lit("<|"), _plain(F.col("role")), F.lit("|>\n"))).when(mine, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user "), _plain(F.col("role")), F.lit("|>\n")))
    j = j.select("conv_id", "speaker", "turn", "role", as_role.alias("as_role"), F.concat(head, "text", F.lit(END)).alias("piece"), F.length(head).cast("long").alias("_head"))
    j = j.withColumn("_n", F.length("piece").cast("long")).withColumn("_block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 40))))
    group = ["conv_id", "speaker", "_block"]
    sums = j.groupBy(*group).agg(F.sum("_n").alias("_all"))
    sums = sums.select(*[F.col(c).alias(f"{c}2") for c in group], (F.sum("_all").over(W.partitionBy("conv_id", "speaker").orderBy("_block")) - F.col("_all")).alias("_before"))
    inner = W.partitionBy(*group).orderBy(F.col("turn").asc_nulls_first(), "role", "piece").rowsBetween(W.unboundedPreceding, -1)
    j = j.withColumn("_within", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    on = F.col("conv_id").eqNullSafe(F.col("conv_id2")) & (F.col("speaker") == F.col("speaker2")) & (F.col("_block") == F.col("_block2"))
    j = j.join(sums, on).withColumn("start", F.col("_before") + F.col("_within"))
    trained = F.col("as_role") == "assistant"
    return j.select("conv_id", "speaker", "turn", "as_role", "piece", "start", F.when(trained, F.col("start") + F.col("_head")).alias("mask_start"), F.when(trained, F.col("start") + F.col("_n") - 1).alias("mask_end"))


def assembled(views: DataFrame) -> DataFrame:
    """conv_id, speaker, text, masks [(start, end)]: each view as one row. For conversations that fit a row."""
    rows = views.groupBy("conv_id", "speaker").agg(F.sort_array(F.collect_list(F.struct("start", "piece", "mask_start", "mask_end"))).alias("t"))
    masks = F.transform(F.filter("t", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")))
    return rows.select("conv_id", "speaker", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("text"), masks.alias("masks"))


def op1_perspectives(spark, sf_dir: str) -> DataFrame:
    return rotated(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
with t as (select conv_id, turn, coalesce(nullif(role, ''), 'unknown') as role, replace(coalesce(text, ''), '<|', '< |') as text from conversations),
s as (select distinct conv_id, role as speaker from t where role <> 'system'),
j as (
  select t.conv_id, speaker, turn, role, case when role = 'system' then role when role = speaker then 'assistant' else 'user' end as as_role,
    case when role = 'system' then '<|system|>' || chr(10) when role = speaker then '<|assistant|>' || chr(10) else '<|user ' || replace(role, '<|', '< |') || '|>' || chr(10) end as head, text
  from t join s on t.conv_id is not distinct from s.conv_id
), p as (select *, head || text || '<|end|>' || chr(10) as piece from j),
o as (
  select *, coalesce(sum(length(piece)) over (partition by conv_id, speaker order by turn nulls first, role, piece rows between unbounded preceding and 1 preceding), 0)::bigint as start from p
)
select conv_id, speaker, turn, as_role, piece, start, case when as_role = 'assistant' then start + length(head) end as mask_start,
  case when as_role = 'assistant' then start + length(piece) - 1 end as mask_end from o
"""
