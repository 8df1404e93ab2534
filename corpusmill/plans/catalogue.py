"""Registry: a query for each operator over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import scoring, text as T, vocab
from ..operators import groups, normalize, reports, rules, runs, sampling
from ..sources import readers
from ..sources.tables import parted, written
from ..streaming import rewards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in f.__code__.co_varnames[: f.__code__.co_argcount]])

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def big(c: str):
    return F.col(c).cast("long")


def rows_of(df: DataFrame):
    """The number of rows as a scalar subquery, so that no job runs while a plan is built."""
    return df.agg(F.count(F.lit(1))).scalar()


# Groups of rewards: events stand for reward rows, user_id for the group.


@query("""
with s as (select *, avg(value) over (partition by user_id) as m, stddev_pop(value) over (partition by user_id) as d from events)
select event_id, user_id, round((value - m) / (d + 1e-4), 6) as advantage from s where d > 0
""")
def group_advantage(events):
    return groups.advantages(events, "user_id", "value").select("event_id", "user_id", F.round("advantage", 6).alias("advantage"))


@query("""
with s as (select user_id, stddev_pop(value) as d from events group by 1)
select count(*)::bigint as groups, round(avg(case when d > 1e-4 then 1.0 else 0.0 end), 6) as rate from s
""")
def group_signal_rate(events):
    return groups.signal_rate(events, "user_id", "value").withColumn("rate", F.round("rate", 6))


@query("""
select event_id, user_id, value from events
where user_id not in (select user_id from events where event_type = 'error' and value > 60)
""")
def group_error_drop(events):
    return groups.without_failed_groups(events, "user_id", (F.col("event_type") == "error") & (F.col("value") > 60)).select("event_id", "user_id", "value")


@query("""
select user_id, count(*)::bigint as n from events group by 1 having count(*) % 4 <> 0
""")
def group_size_gate(events):
    return groups.wrong_size(events, "user_id", 4)


@query("""
with f as (select *, case when event_type = 'error' then 1 else 0 end as f from events),
i as (select *, sum(1 - f) over (partition by user_id order by ts, event_id) as island from f),
r as (select user_id, island, sum(f) as n from i group by 1, 2)
select user_id, max(n)::bigint as longest from r group by 1
""")
def no_signal_runs(events):
    return runs.longest_runs(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", big("longest").alias("longest"))


@query("""
select event_type, count(*)::bigint as n, round(avg(case when isnan(value) then null else value end), 6) as mean_value,
  round(sum(case when value > 20 then 1 else 0 end) / greatest(1, count(*)), 6) as high_rate,
  round(sum(case when value > 20 and user_id % 2 = 0 then 1 else 0 end) / greatest(1, sum(case when user_id % 2 = 0 then 1 else 0 end)), 6) as high_rate_even
from events group by 1
""")
def conditional_rates(events):
    high, even = F.col("value") > 20, F.col("user_id") % 2 == 0
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(reports.mean_skip_nan(F.col("value")), 6).alias("mean_value"),
        F.round(reports.share(high), 6).alias("high_rate"), F.round(reports.share(high, even), 6).alias("high_rate_even"),
    )


@query("""
with g as (select avg(case when d > 1e-4 then 1.0 else 0.0 end) as signal from (select user_id, stddev_pop(value) as d from events group by 1)),
m as (select count(*)::bigint as n, round(avg(case when event_type <> 'error' then 1.0 else 0.0 end), 6) as ok_rate, round(max(value), 6) as max_value,
  round((max(event_id) - min(event_id)) / nullif(count(distinct user_id), 0), 6) as per_step from events)
select n, ok_rate, max_value, per_step, round(per_step * 33 / 3600, 6) as hours_33, round(signal, 6) as signal, ok_rate >= 0.5 as ok_rate_ok,
  signal >= 0.9 as signal_ok, max_value <= 1e6 as max_value_ok, ok_rate >= 0.5 and signal >= 0.9 and max_value <= 1e6 as passed from m, g
""")
def preflight_summary(events):
    m = events.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("event_type") != "error").cast("double")), 6).alias("ok_rate"), F.round(F.max("value"), 6).alias("max_value"),
        F.round(F.try_divide(F.max("event_id") - F.min("event_id"), F.count_distinct("user_id")), 6).alias("per_step"),
    )
    g = groups.signal_rate(events, "user_id", "value").select(F.round("rate", 6).alias("signal"))
    row = m.withColumn("hours_33", F.round(F.col("per_step") * 33 / 3600, 6)).join(g)  # two rows of one
    return rules.threshold_gate(row, {"ok_rate": (">=", 0.5), "signal": (">=", 0.9), "max_value": ("<=", 1e6)})


@query("""
select user_id, event_id, value from (
  select *, row_number() over (partition by user_id order by event_type desc, event_id) as n from events) where n = 1
""")
def latest_state(events):
    return reports.latest(events, ["user_id"], ["event_type"], ["event_id"]).select("user_id", "event_id", "value")


@query("""
select user_id, event_type, event_id from (
  select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1
""")
def last_write_wins(events):
    e = events.select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("at"))
    return readers.last_write_wins(e, ["user_id", "event_type"], "at").drop("at")


@query("""
select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events where json_extract_string(props, '$.k') is not null
""")
def props_extract(events):
    return readers.json_fields(events.select("event_id", "props"), "props", "k string", "k").select("event_id", F.col("k").try_cast("long").alias("k"))


@query("""
with e as (select event_id, (event_id % 10) / 10.0 as txt, (event_id % 7) / 6.0 as judge, event_type = 'error' as failed, least(1.0, greatest(0.0, value / 100)) as ref, case when event_type = 'view' then 0.0 else 1.0 end as gate from events)
select event_id, round(least(1.0, greatest(0.0, gate * (0.1 * txt + 0.9 * (case when failed then ref else 0.9 * ref + 0.1 * judge end)))), 6) as score from e
""")
def two_level_score(events):
    txt, judge = (F.col("event_id") % 10) / 10.0, (F.col("event_id") % 7) / 6.0
    score = scoring.two_level(F.when(F.col("event_type") == "view", 0.0).otherwise(1.0), txt, judge, F.col("event_type") == "error", scoring.unit(F.col("value") / 100))
    return events.select("event_id", F.round(score, 6).alias("score"))


@query("""
select event_id, user_id, (select min(b.event_id) from events b where b.user_id = a.user_id and b.event_id > a.event_id and b.event_type <> 'error') as end_at
from events a where event_type = 'error'
""")
def token_blocks(events):
    bad = F.col("event_type") == "error"
    return runs.next_match(events.select("event_id", "user_id", "event_type"), "user_id", "event_id", bad, ~bad).select("event_id", "user_id", "end_at")


@query("""
with n as (select *, row_number() over (order by ts, event_id) - 1 as o from events), c as (select count(*) as c from events)
select event_id, (o // 12)::bigint as batch, ((o % 12) // 4)::bigint as rank, (o % 4)::bigint as slot from n, c where o < (c // 12) * 12
""")
def batch_slots(events):
    e = normalize.with_ordinal(events.select("ts", "event_id"), "ts", "event_id")
    return sampling.batch_slots(e, "ordinal", rows_of(events), 3, 4).select("event_id", big("batch").alias("batch"), big("rank").alias("rank"), big("slot").alias("slot"))


@query("select event_id, value from events where event_id % 8 = 3")
def shard_modulo(events):
    return sampling.modulo_shard(events, "event_id", 8, 3).select("event_id", "value")


@query("""
with c as (select ceil(count(*) / 8.0)::bigint as b from events) select event_id, value from events, c where event_id >= 2 * b and event_id < 3 * b
""")
def shard_range(events):
    return sampling.range_shard(events, "event_id", rows_of(events), 8, 2).select("event_id", "value")


@query("""
with a as (select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*)::bigint as n, round(avg(value), 6) as mean_value, round(avg(case when event_type = 'error' then 1.0 else 0.0 end), 6) as share from events group by 1, 2)
select strftime(window_start, '%Y-%m-%d %H:%M:%S') as window_start, event_type, n, mean_value, share from a
""")
def windowed_rates(events):
    out = rewards.windowed_rates(events)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"), F.round("share", 6).alias("share"))


@query("""
select event_id, event_type, value from (select *, rank() over (partition by event_type order by round(value, 0) desc) as r from events) where r <= 5
""")
def topk_ties(events):
    e = events.withColumn("_v", F.round("value", 0))
    return groups.top_with_ties(e, 5, "_v", "event_type").select("event_id", "event_type", "value")


# Items: documents stand for items, lang for the stratum, source for the scene.
_PICK = "row_number() over (partition by lang order by md5('7:' || lang || ':' || doc_id), doc_id)"


@query(f"select doc_id, lang, pick from (select doc_id, lang, {_PICK}::bigint as pick from documents) where pick <= case lang when 'en' then 40 when 'de' then 25 else 10 end")
def quota_sample(documents):
    quotas = documents.select("lang").distinct().withColumn("quota", F.when(F.col("lang") == "en", 40).when(F.col("lang") == "de", 25).otherwise(10))
    return sampling.quota_sample(documents.select("doc_id", "lang"), quotas, "lang", "doc_id", "7").select("doc_id", "lang", big("pick").alias("pick"))


@query(f"""
with p as (select doc_id, {_PICK} as pick from documents), s as (select * from p where pick <= 5), l as (select * from p where pick <= 12), e as (select * from l where doc_id not in (select doc_id from s))
select not exists (select doc_id from s except select doc_id from l) as nested, not exists (select doc_id from s intersect select doc_id from e) as disjoint,
  not exists ((select doc_id from s union select doc_id from e) except select doc_id from l) as union_equals
""")
def nested_samples(documents):
    p = sampling.ranked(documents.select("doc_id", "lang"), "lang", "doc_id", "7")
    small, large = p.where("pick <= 5"), p.where("pick <= 12")
    return rules.splits_gate(small, large, reports.pending(large, small, "doc_id"), "doc_id")


@query(f"select doc_id, lang from (select doc_id, lang, {_PICK} as pick from documents) where pick > 5 and pick <= 12")
def extra_split(documents):
    p = sampling.ranked(documents.select("doc_id", "lang"), "lang", "doc_id", "7")
    return reports.pending(p.where("pick <= 12"), p.where("pick <= 5"), "doc_id").select("doc_id", "lang")


def _disjoint_sql(n: int) -> str:
    parts, earlier = [], []
    for lang in ("de", "en", "es", "fr"):
        used = " union all ".join(f"select source from x_{x}" for x in earlier) or "select null where false"
        parts.append(f"""x_{lang} as (select doc_id, lang, source from (select doc_id, lang, source, row_number() over (partition by source order by md5('7:' || lang || ':' || doc_id), doc_id) as n,
          md5('7:' || lang || ':' || doc_id) as o from documents where lang = '{lang}' and source not in ({used})) where n = 1 order by o, doc_id limit {n})""")
        earlier.append(lang)
    return "with " + ", ".join(parts) + " " + " union all ".join(f"select * from x_{x}" for x in earlier)


@query(_disjoint_sql(3))
def disjoint_sample(documents):
    return sampling.scene_disjoint_sample(documents.select("doc_id", "lang", "source"), dict.fromkeys(("de", "en", "es", "fr"), 3), "lang", "source", "doc_id", "7", save=written, split=parted)


def _balanced_sql(n: int, strata: int) -> str:
    """Strata from the smallest; in each the rows of the scenes that are used least so far."""
    parts = [f"st as (select lang, row_number() over (order by count(*), lang) as k from documents group by 1 having count(*) >= {n})"]
    for k in range(1, strata + 1):
        used = " union all ".join(f"select source from x_{j}" for j in range(1, k)) or "select null as source where false"
        parts.append(f"""x_{k} as (select doc_id, lang, source from documents join st using (lang) left join (select source, count(*) as c from ({used}) group by 1) u using (source)
          where st.k = {k} order by coalesce(c, 0), md5('7:' || lang || ':' || doc_id), doc_id limit {n})""")
    return "with " + ", ".join(parts) + " " + " union all ".join(f"select * from x_{k}" for k in range(1, strata + 1))


@query(_balanced_sql(8, 4))
def balanced_topk(documents):
    d = documents.select("doc_id", "lang", "source").withColumn("level", F.lit("level_2"))
    return sampling.balanced_sample(d, 8, "lang", "source", "level", "doc_id", "7", save=written, split=parted).select("doc_id", "lang", "source")


@query("""
with j as (select d.doc_id, lower(regexp_replace(trim(text), '[ \\t\\n\\r]+', ' ', 'g')) as k, coalesce(quality, -1) as q from documents d left join labels l on d.doc_id = l.doc_id)
select doc_id, q::bigint as q from (select *, row_number() over (partition by md5(k) order by q desc, doc_id) as n from j) where n = 1
""")
def priority_dedup(documents, labels):
    key = F.md5(F.lower(F.regexp_replace(F.trim("text"), r"[ \t\n\r]+", " ")))
    j = documents.join(labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", key.alias("k"), F.coalesce("quality", F.lit(-1)).cast("long").alias("q"))
    return sampling.priority_dedup(j, ["k"], "q", "doc_id").select("doc_id", "q")


@query("select lang, source, count(*)::bigint as n from documents group by 1, 2")
def stratum_counts(documents):
    return reports.counts(documents, "lang", "source")


@query("select n as times, count(*)::bigint as keys from (select user_id, count(*)::bigint as n from events group by 1) group by 1")
def exposure_histogram(events):
    return reports.histogram_of_counts(events, "user_id")


@query("select lang, min(n)::bigint as least, max(n)::bigint as most, count(*)::bigint as keys from (select lang, source, count(*) as n from documents group by 1, 2) group by 1")
def exposure_bounds(documents):
    return reports.count_bounds(documents, "source", "lang")


@query("select distinct d.source from documents d where d.source not in (select d2.source from documents d2 join labels l on d2.doc_id = l.doc_id where l.toxic = 1)")
def missing_strata(documents, labels):
    toxic = documents.join(labels.where("toxic = 1"), "doc_id").select("source")
    return reports.missing_from(documents, toxic, "source")


@query("select d.doc_id, d.lang, l.quality::bigint as quality, l.toxic::bigint as toxic from documents d left join labels l on d.doc_id = l.doc_id")
def label_join(documents, labels):
    return reports.with_cache(documents.select("doc_id", "lang"), labels, "doc_id")[0].select("doc_id", "lang", big("quality").alias("quality"), big("toxic").alias("toxic"))


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels) and doc_id not in (select item_id from benchmark)")
def pending_anti(documents, labels, benchmark):
    b = benchmark.select(F.col("item_id").alias("doc_id"))
    return reports.pending(documents, labels, "doc_id", (b, "doc_id")).select("doc_id", "lang")


_ERR = """
with e as (select doc_id, list_filter([case when length(text) < 400 then 'short_text' end, case when text like '%|%' then 'table_marks' end,
  case when lang not in ('en', 'de', 'fr') then 'lang' end, case when n_chars <> length(text) then 'n_chars' end], lambda x: x is not null) as errs from documents)
"""


def _document_errors(documents):
    return documents.select("doc_id", rules.errors(
        rules.rule(F.length("text") >= 400, "short_text"), rules.rule(~F.contains("text", F.lit("|")), "table_marks"),
        rules.rule(F.col("lang").isin("en", "de", "fr"), "lang"), rules.rule(F.col("n_chars") == F.length("text"), "n_chars"),
    ).alias("errors"))


@query(_ERR + "select doc_id, array_to_string(errs, ',') as codes, len(errs)::bigint as n from e")
def record_validation(documents):
    return _document_errors(documents).select("doc_id", F.array_join("errors", ",").alias("codes"), F.size("errors").cast("long").alias("n"))


@query(_ERR + "select code, count(*)::bigint as n from (select unnest(errs) as code from e) group by 1")
def error_summary(documents):
    return rules.error_summary(_document_errors(documents))


@query(_ERR + "select doc_id, array_to_string(errs, ',') as codes from e where len(errs) > 0 order by doc_id limit 10")
def error_examples(documents):
    return rules.error_examples(_document_errors(documents), "doc_id").select("doc_id", F.array_join("errors", ",").alias("codes"))


@query("select conv_id, turn, count(*)::bigint as n from (select * from conversations union all select * from conversations where turn = 0) group by 1, 2 having count(*) > 1")
def unique_gate(conversations):
    return rules.repeated_keys(conversations.unionAll(conversations.where("turn = 0")), "conv_id", "turn")


# Marked-up text: pages.


@query("""
select page_id, coalesce(list_filter(list_transform(regexp_extract_all(html, '(?is)<\\s*h1\\s*>(.*?)<\\s*/\\s*h1\\s*>', 1), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[-1], '') as h1,
  coalesce(list_transform(regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))[-1], '') as title from pages
""")
def tag_extract(pages):
    return pages.select("page_id", T.last_tag(F.col("html"), "h1").alias("h1"), T.last_tag(F.col("html"), "title", strict=True, keep_empty=True).alias("title"))


@query("select page_id, ((length(html) - length(replace(html, '<p>', ''))) / 3)::bigint as p, ((length(html) - length(replace(html, '<a ', ''))) / 3)::bigint as a from pages")
def placeholder_count(pages):
    return pages.select("page_id", T.placeholders(F.col("html"), "<p>").alias("p"), T.placeholders(F.col("html"), "<a ").alias("a"))


#: Pages with their tags renamed to those of the staged format, so that the scores have something to find.
_RENAMED = (("<article>", "<infrared_cot>"), ("</article>", "</infrared_cot>"), ("<h1>", "<think>"), ("</h1>", "</think>"), ("<footer>", "<clean_fused_image>"), ("</footer>", "</clean_fused_image>"), ("<br>", "<|image|>"))


def _staged(c):
    for a, b in _RENAMED:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _sql_staged(c: str) -> str:
    for a, b in _RENAMED:
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _format_sql() -> str:
    """The format score over renamed pages, tag by tag."""
    cols, names = [], []
    for i, tag in enumerate(vocab.OUTER_TAGS):
        cols.append(f"regexp_extract_all(t, '(?s)<{tag}>(.*?)</{tag}>', 1) as o{i}")
        names.append((f"o{i}", tag))
    inner = []
    for i, tag in enumerate(vocab.OUTER_TAGS):
        for j, sub in enumerate(vocab.INNER_TAGS.get(tag, ())):
            inner.append(f"regexp_extract_all(coalesce(o{i}[1], ''), '(?s)<{sub}>(.*?)</{sub}>', 1) as i{i}_{j}")
            names.append((f"i{i}_{j}", f"{tag}.{sub}"))
    trimmed = lambda c: f"regexp_replace({c}[1], '^\\s+|\\s+$', '', 'g')"
    missing = " + ".join(f"(case when len({c}) = 0 then 1 else 0 end)" for c, _ in names)
    empty = " + ".join(f"(case when len({c}) > 0 and {trimmed(c)} = '' then 1 else 0 end)" for c, _ in names)
    twice = " + ".join(f"(case when len({c}) > 1 then 1 else 0 end)" for c, _ in names)
    at = [f"(case when len(o{i}) > 0 then strpos(t, '<{tag}>') end)" for i, tag in enumerate(vocab.OUTER_TAGS)]
    order = " and ".join(f"{a} < {b}" for a, b in zip(at, at[1:]))
    return f"""
with s as (select page_id, {_sql_staged('html')} as t from pages), a as (select *, {', '.join(cols)} from s), b as (select *, {', '.join(inner)} from a),
c as (select page_id, {missing} as miss, {empty} as emp, {twice} as dup, coalesce({order}, false) as ord, ((length(t) - length(replace(t, '<|image|>', ''))) / 9)::bigint as marks from b),
d as (select *, greatest(0.0, 1.0 - abs(marks - 3) / 3.0) as near from c),
e as (select *, least(1.0, greatest(0.0, 0.75 * greatest(0.0, ({len(names)} - miss - emp) / {len(names)}.0) + 0.15 * (case when ord then 1.0 else 0.0 end) + 0.10 * near - least(0.20, 0.04 * dup))) as txt from d)
select page_id, (miss + emp + dup + (case when ord then 0 else 1 end))::bigint as n_problems, marks as placeholders, round(least(1.0, greatest(0.0, 0.70 * txt + 0.30 * near)), 6) as score from e
"""


@query(_format_sql())
def tag_format_score(pages):
    t = _staged(F.col("html"))
    s = pages.select("page_id", scoring.format_score(t, T.placeholders(t)).alias("s"))
    return s.select("page_id", F.size("s.problems").cast("long").alias("n_problems"), F.col("s.placeholders").alias("placeholders"), F.round("s.score", 6).alias("score"))


@query("""
select page_id, case when regexp_matches(html, '(?i)<\\s*article\\s*>') then 'full' else 'unknown' end as protocol from pages
""")
def protocol_infer(pages):
    p = T.protocol(_staged(F.col("html")))
    return pages.select("page_id", p.alias("protocol"))


@query("""
select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, coalesce(nullif(string_split(url, '/')[-2], ''), 'unknown') as parent,
  coalesce(nullif(substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.+-]', '_', 'g'), '^_+|_+$', '', 'g'), 1, 160), ''), 'sample') as name from pages
""")
def path_names(pages):
    return pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), T.parent_label(F.col("url")).alias("parent"), T.safe_name(F.col("url")).alias("name"))


@query("""
with p as (select page_id, 'root/level_' || (page_id % 4) || '/haze_' || (page_id % 3) || '/' || page_id || '.png' as path from pages)
select page_id, regexp_extract(path, '(?:^|/)(level_[012])/([^/]+)', 1) as level, regexp_extract(path, '(?:^|/)level_[12]/([^/]+)', 1) as label from p
""")
def path_label(pages):
    path = F.concat(F.lit("root/level_"), F.col("page_id") % 4, F.lit("/haze_"), F.col("page_id") % 3, F.lit("/"), "page_id", F.lit(".png"))
    return pages.select("page_id", T.path_level(path).alias("level"), T.path_label(path).alias("label"))


# Fixed stand-in: words of the synthetic languages that take the place of lexicon patterns.
_WORDS = {"haze": ("tion", "heit"), "rain": ("erre", "keit"), "noise": (r"\bthe\b", r"\bder\b")}


def _lexicon_sql(name: str) -> str:
    return f"regexp_matches(text, '(?i){'|'.join(_WORDS[name])}')"


@query(f"select doc_id, round(({' + '.join(f'(case when {_lexicon_sql(n)} then 1 else 0 end)' for n in ('noise', 'haze', 'rain'))}) / 3.0, 6) as coverage from documents")
def lexicon_coverage(documents):
    return documents.select("doc_id", F.round(scoring.coverage(F.lit("rain+noise_haze"), F.col("text"), _WORDS), 6).alias("coverage"))


@query("""
with l as (select p_partkey, ['noise_stripe_noise', 'stripe_noise_noise', 'foo_stripe_noise', 'blur4+haze', '_noise', 'rainx'][(p_partkey % 6)::int + 1] as label from part),
h as (select *, replace(label, '+', '_') as t, regexp_extract(replace(label, '+', '_'), '^((?:(?:stripe_noise|blur2|blur4|haze|noise|rain)(?:_+|$))*)', 1) as head from l),
p as (select *, list_concat(regexp_extract_all(head, '(stripe_noise|blur2|blur4|haze|noise|rain)', 1), list_filter(string_split(substr(t, length(head) + 1), '_'), lambda x: x <> '')) as parts from h)
select p_partkey, label, array_to_string(list_transform(list_sort(list_transform(parts, lambda x: {'r': coalesce(nullif(list_position(['blur2', 'blur4', 'haze', 'noise', 'rain', 'stripe_noise'], x), 0), 999), 'p': x})), lambda x: x.p), '+') as canonical from p
""")
def component_split(part):
    names = ["noise_stripe_noise", "stripe_noise_noise", "foo_stripe_noise", "blur4+haze", "_noise", "rainx"]
    label = F.get(F.array(*[F.lit(x) for x in names]), (F.col("p_partkey") % 6).cast("int"))
    return part.select("p_partkey", label.alias("label")).withColumn("canonical", T.canonical_label(F.col("label")))


@query("""
with c as (select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10)) as t from documents),
h as (select doc_id, t, substr(t, 1, 200) as h from c),
k as (select *, greatest(case when contains(h, '. ') then 200 - strpos(reverse(h), ' .') - 1 else -1 end, case when contains(h, chr(10)) then 200 - strpos(reverse(h), chr(10)) else -1 end, case when contains(h, '; ') then 200 - strpos(reverse(h), ' ;') - 1 else -1 end) as cut from h)
select doc_id, md5(case when length(t) <= 200 then t else regexp_replace(substr(t, 1, case when cut < 100 then 200 else cut end), '^\\s+|\\s+$', '', 'g') end) as digest, md5(t) as whole from k
""")
def text_clean(documents):
    whole = T.collapsed(F.col("text"))
    return documents.select("doc_id", F.md5(T.truncated(whole, 200)).alias("digest"), F.md5(whole).alias("whole"))


@query("select doc_id, sha256(length(lang) || ':' || lang || ';' || length(text) || ':' || text || ';') as key from documents")
def content_key(documents):
    return documents.select("doc_id", T.content_key(F.col("lang"), F.col("text")).alias("key"))


@query("""
select conv_id, string_agg(role, '>' order by turn) as roles, count(*)::bigint as n, md5(string_agg('<' || role || '>' || text || '</' || role || '>', chr(10) order by turn)) as flat from conversations group by 1
""")
def conversation_build(conversations):
    return normalize.flat_conversations(conversations).withColumn("flat", F.md5("flat"))


@query("""
with t as (select *, lag(role) over (partition by conv_id order by turn) as before from conversations)
select conv_id, bool_and(case when role = 'system' then before is null when role = 'user' then before is null or before <> 'user' else before = 'user' end) as ordered from t group by 1
""")
def conversation_grammar(conversations):
    return rules.turns_in_order(conversations)


# Vectors stand for pixels.


@query("""
with p as (select a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda x: abs(x[1]::double - x[2]::double)) as d from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
m as (select vec_id, list_sum(list_transform(d, lambda x: x * x)) / len(d) as mse, list_max(d) as worst from p)
select vec_id, round(mse, 6) as mse, round(case when mse <= 0 then 100 else 10 * log10(1 / mse) end, 6) as psnr, round(worst, 6) as worst from m
""")
def pair_metrics(embeddings):
    nxt = embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    error = scoring.mse(F.col("embedding"), F.col("other"))
    worst = F.array_max(F.zip_with("embedding", "other", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return embeddings.join(nxt, "vec_id").select("vec_id", F.round(error, 6).alias("mse"), F.round(scoring.psnr(error), 6).alias("psnr"), F.round(worst, 6).alias("worst"))


@query("""
with e as (select vec_id, unnest(embedding)::double as x from embeddings)
select vec_id, count(*)::bigint as n, round(avg(x), 6) as mean, round(var_pop(x), 6) as var, sum(case when abs(x) > 1e-8 then 1 else 0 end)::bigint as nonzero from e group by 1
""")
def vector_stats(embeddings):
    return embeddings.select("vec_id", scoring_stats(F.col("embedding")).alias("s")).select("vec_id", "s.*")


def scoring_stats(v):
    def stats(d):
        variance = lambda s: F.aggregate(d, F.lit(0.0), lambda a, x: a + (x - s["mean"]) * (x - s["mean"])) / F.size(d)
        return T.bound(groups.sequence_stats(d), lambda s: F.struct(s["count"].cast("long").alias("n"), F.round(s["mean"], 6).alias("mean"), F.round(variance(s), 6).alias("var"), s["nonzero"].cast("long").alias("nonzero")))

    return T.bound(F.transform(v, lambda x: x.cast("double")), stats)


@query("""
with v as (select vec_id, least(1.0, greatest(0.0, 0.5 + embedding[1]::double)) as a, least(1.0, greatest(0.0, 0.5 + embedding[2]::double)) as b, least(1.0, greatest(0.0, 0.5 + embedding[3]::double)) as c, label % 10 = 0 as failed from embeddings)
select vec_id, round(case when failed then 0.0 else least(1.0, greatest(0.0, 0.70 * (0.25 * a + 0.25 * b + 0.50 * c) + 0.30 * least(a, b, c))) end, 6) as score from v
""")
def modality_score(embeddings):
    a, b, c = (scoring.unit(0.5 + F.col("embedding")[i].cast("double")) for i in range(3))
    return embeddings.select("vec_id", F.round(scoring.three_image_score(a, b, c, F.col("label") % 10 == 0), 6).alias("score"))


@query("""
with p as (select a.vec_id, unnest(a.embedding)::double as x, unnest(b.embedding)::double as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
s as (select vec_id, avg(x) as mx, avg(y) as my, var_pop(x) as vx, var_pop(y) as vy, covar_pop(x, y) as c from p group by 1)
select vec_id, round((2 * mx * my + 0.0001) * (2 * c + 0.0009) / ((mx * mx + my * my + 0.0001) * (vx + vy + 0.0009)), 5) as ssim from s
""")
def global_ssim(embeddings):
    nxt = embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    long = embeddings.join(nxt, "vec_id").select("vec_id", F.explode(F.arrays_zip("embedding", "other")).alias("z")).select("vec_id", F.col("z.embedding").cast("double").alias("x"), F.col("z.other").cast("double").alias("y"))
    s = long.groupBy("vec_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"))
    return s.select("vec_id", F.round(scoring.global_ssim(*[F.col(k) for k in ("mx", "my", "vx", "vy", "c")], top=1.0), 5).alias("ssim"))


# Facts: lineitem and orders.


@query("""
select l_returnflag, l_linestatus, count(case when l_quantity > 10 then 1 end)::bigint as n, round(sum(case when l_quantity > 10 then l_quantity end), 4) as weight,
  round(sum(case when l_quantity > 10 then l_quantity * l_discount end) / greatest(1.0, sum(case when l_quantity > 10 then l_quantity end)), 6) as mean from lineitem group by 1, 2
""")
def masked_weighted_mean(lineitem):
    m = groups.masked_mean(lineitem, ["l_returnflag", "l_linestatus"], F.col("l_discount"), F.col("l_quantity"), F.col("l_quantity") > 10)
    return m.select("l_returnflag", "l_linestatus", "n", F.round("weight", 4).alias("weight"), F.round("mean", 6).alias("mean"))


@query("""
select round(avg(m), 6) as value from (select l_orderkey, avg(case when l_returnflag <> 'N' then l_discount end) as m from lineitem group by 1)
""")
def mean_of_means(lineitem):
    return groups.mean_of_means(lineitem, "l_orderkey", F.col("l_discount"), F.col("l_returnflag") != "N").select(F.round("value", 6).alias("value"))


@query("""
with l as (select l_orderkey, l_linenumber, -l_discount as logp, -l_tax as old, (l_quantity - 25) / 25 as adv from lineitem)
select l_orderkey, round(avg(least(exp(logp - old) * adv, greatest(0.8, least(1.2, exp(logp - old))) * adv)), 6) as objective, round(avg(exp(old - logp) - (old - logp) - 1), 6) as kl from l group by 1
""")
def clipped_objective(lineitem):
    logp, old, adv = -F.col("l_discount"), -F.col("l_tax"), (F.col("l_quantity") - 25) / 25
    return lineitem.groupBy("l_orderkey").agg(F.round(F.avg(scoring.clipped_objective(logp, old, adv)), 6).alias("objective"), F.round(F.avg(scoring.k3_divergence(logp, old)), 6).alias("kl"))


@query("select l_orderkey, l_linenumber, k as key, v as value from (select l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) as k, unnest([l_quantity, l_discount, l_tax]) as v from lineitem) where v = 0")
def unpivot_missing(lineitem):
    return normalize.unpivoted_paths(lineitem, ["l_orderkey", "l_linenumber"], ("l_quantity", "l_discount", "l_tax"), "value").where("value = 0")


@query("select o_orderstatus, o_orderpriority, count(*)::bigint as n, round(sum(o_totalprice), 2) as total from orders group by rollup (o_orderstatus, o_orderpriority)")
def tier_rollup(orders):
    return reports.rolled_up(orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice").withColumn("total", F.round("total", 2))


@query("select round(avg(m), 4) as value from (select o_orderpriority, avg(o_totalprice) as m from orders group by 1)")
def macro_average(orders):
    return reports.macro_average(orders, "o_orderpriority", "o_totalprice").select(F.round("value", 4).alias("value"))


@query("select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) as l_discount, round(max(l_tax), 6) as l_tax from lineitem group by 1")
def merged_metrics(lineitem):
    merged = reports.merged_metrics(lineitem, {"l_discount": "l_quantity"}, ["l_tax"], "l_returnflag")
    return merged.select("l_returnflag", F.round("l_discount", 6).alias("l_discount"), F.round("l_tax", 6).alias("l_tax"))


@query("""
select n_name, m from nation, (select distinct c_mktsegment as m from customer) where (n_nationkey, m) not in (select c_nationkey, c_mktsegment from customer where c_acctbal > 9500)
""")
def catalog_pending(nation, customer):
    done = customer.where("c_acctbal > 9500").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("m"))
    return reports.not_yet(nation.select("n_nationkey", "n_name"), customer.select(F.col("c_mktsegment").alias("m")), done, "n_nationkey", "m").select("n_name", "m")


@query("select c_nationkey::bigint as c_nationkey, count(distinct c_mktsegment)::bigint as payloads from customer group by 1 having count(distinct c_mktsegment) > 1")
def merge_conflicts(customer):
    return reports.conflicts(customer, "c_nationkey", "c_mktsegment").select(big("c_nationkey").alias("c_nationkey"), "payloads")


@query("""
select c_custkey, row_number() over (order by c_custkey) - 1 as ordinal, row_number() over (partition by c_mktsegment order by c_custkey) as within from customer
""")
def global_numbering(customer):
    c = normalize.with_ordinal(customer.select("c_custkey", "c_mktsegment"), "c_custkey")
    return runs.numbered_within(c, "c_mktsegment", ["c_custkey"]).select("c_custkey", big("ordinal").alias("ordinal"), big("within").alias("within"))


@query("select doc_id, md5('100010:' || doc_id) as place from documents")
def epoch_permutation(documents):
    return documents.select("doc_id", sampling.epoch_order("doc_id", 100010 - 100003, 1).alias("place"))


#: The sanitizer in DuckDB, whose patterns have no lookahead: texts are cut at opening tags, and each rest is read to the closing one.
def _opened_sql(text: str, tag: str) -> str:
    parts = f"regexp_split_to_array({text}, '(?i)<\\s*{tag}\\s*>')"
    rest = f"list_transform(range(2, len({parts}) + 1), lambda i: array_to_string({parts}[i:], '<{tag}>'))"
    closed = f"list_transform(list_filter({rest}, lambda r: regexp_matches(r, '(?i)<\\s*/\\s*{tag}\\s*>')), lambda r: trim(regexp_split_to_array(r, '(?i)<\\s*/\\s*{tag}\\s*>')[1], {_SQL_SPACE}))"
    return f"list_filter({closed}, lambda c: c <> '')"


_SQL_SPACE = "' ' || chr(9) || chr(10) || chr(13)"
_SQL_POLLUTED = " or ".join("lower(x) like '%" + p.replace("'", "''") + "%'" for p in vocab.POLLUTION)
_SQL_COLLAPSE = "array_to_string(list_filter(list_transform({}, lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), " + _SQL_SPACE + ")), lambda x: x <> ''), chr(10))"


def _tidy_sql(c: str) -> str:
    lines = f"string_split(regexp_replace({c}, '</?[^<>]+>', ' ', 'g'), chr(10))"
    return _SQL_COLLAPSE.format(f"list_filter({lines}, lambda x: not ({_SQL_POLLUTED}))")


def _cut_sql(c: str, most: int) -> str:
    last = lambda m, n: f"case when contains({c}[1:{most}], {m}) then {most} - (strpos(reverse({c}[1:{most}]), reverse({m})) - 1) - {n} else -1 end"
    at = f"greatest({last(repr('. '), 2)}, {last('chr(10)', 1)}, {last(repr('; '), 2)})"
    return f"case when length({c}) <= {most} then {c} else trim({c}[1:case when {at} < {most // 2} then {most} else {at} end], {_SQL_SPACE}) end"


@query(f"""
with d as (select doc_id, length(text) // 3 as k, text from documents),
r as (select doc_id, trim('<think>' || text[1:k] || '</think><answer><fused_understand>' || text[k + 1:2 * k] || '</fused_understand><fused_image>' || text[2 * k + 1:] || '</fused_image></answer>', {_SQL_SPACE}) as t from d),
p as (select doc_id, t, coalesce({_opened_sql('t', 'think')}[1], '') as closed, coalesce({_opened_sql('t', 'fused_understand')}[-1], '') as a, coalesce({_opened_sql('t', 'fused_image')}[-1], '') as b from r),
c as (select doc_id, closed, {_tidy_sql("regexp_split_to_array(case when closed <> '' then closed else regexp_split_to_array(t, '(?i)</think>')[1] end, '(?i)<answer>')[1]")} as th,
  trim({_tidy_sql('a')}, {_SQL_SPACE} || ':"' || chr(39)) as a, trim({_tidy_sql('b')}, {_SQL_SPACE} || ':"' || chr(39)) as b from p),
f as (select doc_id, closed, {_cut_sql('th', 1800)} as th, {_cut_sql('a', 900)} as a, {_cut_sql('b', 900)} as b from c),
s as (select *, {_SQL_COLLAPSE.format("string_split('" + vocab.SYNTHESIS['fused'].replace("{fused_understand}", "' || a || '").replace("{fused_image}", "' || b || '") + "', chr(10))")} as told from f),
w as (select *, case when length(th) < 100 or regexp_matches(closed, '(?i)<\\s*(fused_understand|fused_image)\\s*>') then {_cut_sql('told', 1800)} else th end as think from s)
select doc_id, md5('<think>' || chr(10) || think || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || '<fused_understand>' || case when a = '' then '{vocab.NO_FIELD}' else a end || '</fused_understand>' || chr(10)
  || '<fused_image>' || case when b = '' then '{vocab.NO_FIELD}' else b end || '</fused_image>' || chr(10) || '</answer>') as digest from w
""")
def stage_sanitizer(documents):
    # The whole text, by thirds of its length; the last one takes the rest. Only the sanitizer's own limits cut.
    third = F.floor(F.length("text") / 3).cast("int")
    parts = [F.substring("text", F.lit(1), third), F.substring("text", third + 1, third), F.substring("text", 2 * third + 1, F.length("text"))]
    t = F.concat(F.lit("<think>"), parts[0], F.lit("</think><answer><fused_understand>"), parts[1], F.lit("</fused_understand><fused_image>"), parts[2], F.lit("</fused_image></answer>"))
    return documents.select("doc_id", F.md5(T.sanitized_stage(t, "fused")).alias("digest"))


@query()
def local_ssim(embeddings):
    nxt = embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    side = F.floor(F.sqrt(F.size("embedding"))).cast("int")
    n = side * side
    return embeddings.join(nxt, "vec_id").select("vec_id", F.round(scoring.local_ssim(F.slice("embedding", F.lit(1), n), F.slice("other", F.lit(1), n), side, side), 6).alias("ssim"))


@query(SQL["no_signal_runs"].replace("as longest", "as longest_run"))
def failure_runs_batch(events):
    """The greatest of the runs that end with each row."""
    return runs.run_lengths(events.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").groupBy("user_id").agg(F.max(big("run")).alias("longest_run"))
