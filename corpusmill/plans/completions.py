"""Queries on completions, their contexts and their side tables; they register in the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import assembly, normalize, reports, runs
from ..sources import elements
from ..sources.tables import written
from ..streaming import rewards
from .catalogue import big, query
from .streams import TOKENS_SQL, token_streams


@query(f"""
with {TOKENS_SQL}, e as (select id, pos, row_number() over (partition by id order by pos) - 1 as n from t where token = 151666), z as (select id, max(pos) + 1 as len from t group by 1),
s as (select id, pos, row_number() over (partition by id order by pos) - 1 as i, (select count(*) from e where e.id = t.id and e.pos < t.pos) as f from t where token = 151665),
p as (select *, i + max(f - i) over (partition by id order by i) as n from s),
b as (select p.id, p.pos as a, coalesce(e.pos, len) as z from p left join e on p.id = e.id and p.n = e.n join z on p.id = z.id),
k as (select *, row_number() over (order by id, a) - 1 as block from b where z - a >= 3),
m as (select t.id, t.pos, max(a) as a from t join k on t.id = k.id and t.pos >= a + 2 and t.pos < z group by 1, 2)
select m.id, m.pos::bigint as pos, block, (m.pos - m.a)::bigint as place from m join k on m.id = k.id and m.a = k.a
""")
def image_contexts(lineitem):
    """Where each predicted image token stands in the context of its block."""
    # Read three times, so made once.
    tokens = written(token_streams(lineitem), "tokens")
    blocks = runs.context_blocks(tokens, "id", vocab.IMAGE_START, vocab.IMAGE_END)
    return runs.context_map(tokens, blocks, "id").select("id", "pos", big("block").alias("block"), big("offset").alias("place"))


@query("""
with i as (select l_orderkey as k, bool_or(l_linenumber = 1) as a, bool_or(l_linenumber = 2) as b, bool_or(l_linenumber = 3) as c from lineitem group by 1)
select o_orderkey, case when o_totalprice > 150000 then o_orderpriority else '' end as text,
  array_to_string(list_filter([case when o_orderstatus = 'P' then 'sample' end, case when o_totalprice > 150000 then null else 'text' end, case when coalesce(a, false) then null else 'infrared' end,
    case when coalesce(b, false) then null else 'visible' end, case when coalesce(c, false) then null else 'fused' end], lambda x: x is not null), ',') as missing
from orders left join i on o_orderkey = k
""")
def completion_assembly(orders, lineitem):
    """Orders as completions' folders: samples of those not pending, texts of the dear ones, images by the first three line numbers; all in buckets of the folder."""
    folder = F.col("o_orderkey").alias("folder")
    modality = F.element_at(F.array(*[F.lit(m) for m in assembly.MODALITIES]), F.col("l_linenumber"))
    sides = [
        orders.select(folder, "o_orderstatus"), orders.where("o_orderstatus <> 'P'").select(folder, "o_custkey"), orders.where("o_totalprice > 150000").select(folder, F.col("o_orderpriority").alias("text")),
        lineitem.where("l_linenumber between 1 and 3").select(F.col("l_orderkey").alias("folder"), modality.alias("modality"), F.concat(F.lit("part/"), "l_partkey").alias("path")),
    ]
    out = assembly.assembled(*[assembly.bucketed(s, "folder") for s in sides])
    return out.select(F.col("folder").alias("o_orderkey"), "text", F.array_join("missing", ",").alias("missing"))


@query("""
with l as (select l_orderkey as id, l_linenumber as m, max(l_extendedprice / l_quantity) as x, max(l_partkey) as p, max(l_tax) as t from lineitem where l_linenumber <= 3 group by 1, 2),
r as (select id, m, x, p_retailprice as y from l left join part on p = p_partkey and t > 0.03)
select id, coalesce(bool_or(m = 1 and y is not null), false) as infrared_pair, round(max(abs(x - y)) filter (m = 1), 9) as infrared_error, round(max(abs(x - y)) filter (m = 2), 9) as visible_error,
  round(max(abs(x - y)) filter (m = 3), 9) as fused_error, count(y) = 3 as complete from r group by 1
""")
def completion_pairs(lineitem, part):
    """Unit prices of an order's first three lines beside the parts' retail prices, paired by order and line."""
    modality = F.element_at(F.array(*[F.lit(m) for m in assembly.MODALITIES]), F.col("l_linenumber")).alias("modality")
    lines = lineitem.where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("id"), modality).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("x"), F.max("l_partkey").alias("p"), F.max("l_tax").alias("t"))
    truths = lines.where("t > 0.03").join(part.select("p_partkey", "p_retailprice"), F.col("p") == F.col("p_partkey")).select("id", "modality", F.col("p_retailprice").alias("y"))
    pairs = assembly.paired(*[assembly.bucketed(s, "id", "modality") for s in (lines.select("id", "modality", "x"), truths)])
    record = assembly.metric_record(pairs, "id", {"error": F.abs(F.col("prediction.x") - F.col("truth.y"))})
    return record.select("id", F.col("infrared.truth_exists").alias("infrared_pair"), *[F.round(F.col(m)["error"], 9).alias(f"{m}_error") for m in assembly.MODALITIES], "complete")


@query("""
with o as (select *, o_totalprice as p, o_orderstatus as s, o_orderkey % 10 as k from orders)
select '/runs/a' as eval_root, count(*)::bigint as num_samples, count_if(s = 'F')::bigint as num_gate_ok, round(avg(p), 3) as mean_total_reward, round(avg(case when s <> 'P' then p / 2 end), 3) as mean_gated_reward,
  round(avg(length(o_orderpriority)), 3) as mean_label_score, round(avg(case when s = 'O' then null else p end), 3) as mean_visible_psnr, null::double as mean_fused_ssim from o
""")
def evaluation_report(orders):
    """Orders as evaluation records, of which some lack parts, hold text where a number belongs, or NaN."""
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    nested = F.struct(
        F.struct(p.alias("score"), F.when(s != "P", p / 2).alias("gated_score")).alias("reward"), F.struct(F.struct(F.length("o_orderpriority").alias("score")).alias("label_score")).alias("text_reward"),
        F.struct(F.struct(F.when(s == "O", F.lit("12")).alias("text"), F.when(s != "O", p).alias("psnr")).alias("visible"), F.struct(F.lit("high").alias("ssim")).alias("fused")).alias("reference_reward"),
        F.struct((s == "F").alias("ok")).alias("format_gate"),
    )
    report = reports.evaluation(orders.select(F.parse_json(F.to_json(nested)).alias("record")), "/runs/a")
    some = ("mean_total_reward", "mean_gated_reward", "mean_label_score", "mean_visible_psnr", "mean_fused_ssim")
    return report.select("eval_root", "num_samples", "num_gate_ok", *[F.round(c, 3).alias(c) for c in some])


@query("""
with b as (select *, row_number() over (order by p_partkey) - 1 as o, lower(string_split(p_type, ' ')[1]) as label, case when p_size < 5 then '' when p_size % 9 = 0 then '/' else '/level_2/' end as level from part),
i as (select o, case when level = '' then null else 'root' || level || case when p_size % 7 = 0 then '_' else label end || '/' || p_name || '.png' end as path, level, label, p_size, 'p' || (p_partkey // 2) as id from b),
e as (select *, case when path is null then ['sample index=' || o || ' missing paths: infrared_degraded_path'] when level = '/' then ['sample index=' || o || ' no infrared_label: '] when p_size % 7 = 0 then ['sample index=' || o || ' no infrared_label: _'] else [] end as errors,
  count(*) over (partition by id) as n from i)
select o::bigint as ordinal, id, array_to_string(errors || case when n > 1 then ['duplicate id: ' || id] else [] end, ';') as errors from e
""")
def rl_sample_rules(part):
    """Parts as items: the type's first word is the label, folders and gaps come from the size; two parts share an id."""
    size = F.col("p_size")
    level = F.when(size < 5, "").when(size % 9 == 0, "/").otherwise("/level_2/")
    label = F.when(size % 7 == 0, "_").otherwise(F.lower(F.split("p_type", " ")[0]))
    path = F.when(level != "", F.concat(F.lit("root"), level, label, F.lit("/"), "p_name", F.lit(".png")))
    rest = {p: F.lit("root/level_2/haze/x.png") for p in normalize.PATHS[1:]}
    blank = F.lit(None).cast("string")
    items = part.select("p_partkey", F.concat(F.lit("p"), F.floor(F.col("p_partkey") / 2)).alias("id"), path.alias(normalize.PATHS[0]), *[c.alias(p) for p, c in rest.items()], *[blank.alias(c) for c in ("infrared_label", "visible_label", "infrared_level", "visible_level", "base_image")])
    out = normalize.rl_samples(normalize.with_ordinal(items, "p_partkey"))
    return out.select(big("ordinal").alias("ordinal"), "id", F.array_join("errors", ";").alias("errors"))


@query("""
with e as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as element, event_type, (props->>'k')::int as k from events)
select user_id, element::int as element, case when event_type = 'error' then null else k end as k, case when event_type = 'error' then 'no object' end as error from e
""")
def array_elements(events):
    """Each user's properties as one array, in which a number stands for an error's; its elements by number, typed, with what is wrong."""
    one = F.when(F.col("event_type") == "error", F.lit("7")).otherwise(F.col("props"))
    arrays = events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", one.alias("one")))).alias("a"))
    text = F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["one"]), ","), F.lit("]"))
    found = elements.typed(elements.exploded(arrays.select("user_id", text.alias("text")), "text"), "k int")
    return found.select("user_id", "element", F.col("item.k").alias("k"), F.substring_index("error", ":", 1).alias("error"))


@query("select doc_id, (length(text) - length(replace(text, ' ', '')))::double as score, null::varchar as score_error from documents")
def listed_scores(documents):
    """A callback that takes lists of eight texts and counts their spaces."""
    return rewards.scored_lists(documents.select("doc_id", "text"), lambda: lambda rows: [float(r["text"].count(" ")) for r in rows], 8).select("doc_id", "score", "score_error")
