"""Queries on streams and on long sequences; they register in the catalogue. Streams read the driver's tables where they lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import vocab
from ..operators import runs
from ..sources.tables import new_path, written
from ..streaming import counters, resumable
from .catalogue import QUERIES, SQL, big, query


def _failed():
    return F.col("event_type") == "error"


def stream_query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The events as a table and as a stream."""
    path = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    # A pattern, as a stream over a plain path takes it for a folder; it matches a file and a folder of files alike.
    return table, resumable.file_stream(spark, path[:-1] + "[t]", table.schema)


class _Killed(RuntimeError):
    pass


def _killed(batch: int) -> None:
    raise _Killed(f"after the rows of batch {batch}, before its commit")


@stream_query("select event_id, user_id, event_type, round(value * 2, 6) as twice from events")
def events_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Killed once its first batch is written but not committed, and started again: each event once."""
    table, stream = _events(spark, sf_dir)
    target, checkpoint = new_path(spark, "resumed"), new_path(spark, "checkpoint")
    rows = stream.select("event_id", "user_id", "event_type", F.round(F.col("value") * 2, 6).alias("twice"))
    try:
        resumable.start(rows, target, checkpoint, after=_killed).awaitTermination()
    except Exception as e:  # the stream's own error, which carries the callback's
        if _Killed.__name__ not in str(e):
            raise
    resumable.start(rows, target, checkpoint).awaitTermination()
    return resumable.committed(spark, target, rows.schema).drop(resumable.BATCH)


@stream_query("select event_type, count(*)::bigint as committed, (select count(*)::bigint from events) as reported, true as agree from events group by 1")
def events_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream reported of its batches beside what it committed."""
    table, stream = _events(spark, sf_dir)
    target = new_path(spark, "target")
    listener = resumable.ProgressTable(new_path(spark, "progress"))
    spark.streams.addListener(listener)
    try:
        q = resumable.start(stream.select("event_id", "event_type"), target, new_path(spark, "checkpoint"))
        q.awaitTermination()
        if not listener.wait_ended(q):
            raise TimeoutError("the stream's end was not reported")
    finally:
        spark.streams.removeListener(listener)
    rows = resumable.committed(spark, target, "event_id long, event_type string")
    told = resumable.batches_of(listener.table(spark))
    both = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).join(told.where("rows > 0"), "batch", "full")
    agree = both.agg(F.coalesce(F.bool_and(F.col("n").eqNullSafe(F.col("rows"))), F.lit(True))).scalar()
    reported = told.agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar()
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("committed")).withColumn("reported", reported).withColumn("agree", agree)


@stream_query("""
with e as (select *, event_type = 'error' as f from events where ts <= (select max(ts) - interval 12 hours from events)),
r as (select *, row_number() over w as n, sum(case when f then 0 else 1 end) over w as island from e window w as (partition by user_id order by ts, event_id)),
c as (select *, sum(case when f then 1 else 0 end) over (partition by user_id, island order by n) as run from r),
l as (select *, max(run) over (partition by user_id order by n) as longest, coalesce(max(run) over (partition by user_id order by n rows between unbounded preceding and 1 preceding), 0) as earlier from c)
select user_id, event_id, run::bigint as run, longest::bigint as longest, run >= 3 as stopped from l where earlier < 3
""")
def run_stops_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in a row of each user as state of a stream, to the third; the last 12 hours still wait for late rows."""
    table, stream = _events(spark, sf_dir)
    with counters.with_rocksdb(spark):
        out = counters.counted(stream, "user_id", "ts", "event_id", _failed(), limit=3, late="12 hours")
        target = new_path(spark, "counted")
        resumable.start(out, target, new_path(spark, "checkpoint")).awaitTermination()
    return resumable.committed(spark, target, out.schema).select("user_id", "event_id", "run", "longest", "stopped")


_RUNS = """
r as (select *, row_number() over w as n, sum(case when f then 0 else 1 end) over w as island from e window w as (partition by user_id order by ts, event_id)),
c as (select *, sum(case when f then 1 else 0 end) over (partition by user_id, island order by n) as run, max(n) over (partition by user_id) as last from r)"""


@query(f"""
with e as (select *, event_type = 'error' as f from events), {_RUNS}, l as (select *, coalesce(max(run) over (partition by user_id order by n rows between unbounded preceding and 1 preceding), 0) as earlier from c)
select user_id, event_id, run::bigint as run, run >= 2 as stopped from l where earlier < 2
""")
def run_stops(events):
    out = runs.until_limit(events.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], _failed(), 2)
    return out.select("user_id", "event_id", big("run").alias("run"), "stopped")


@query(f"""
with e as (select *, event_type <> 'error' as f from events), {_RUNS}
select user_id, coalesce(max(run) filter (island = 0), 0)::bigint as prefix, coalesce(max(run) filter (n = last), 0)::bigint as suffix, max(run)::bigint as best, count(*)::bigint as length from c group by 1
""")
def run_summaries_merged(events):
    """Summaries of the first half of the month and of the rest, merged without their rows."""
    half = F.lit("2024-01-16").cast("timestamp")
    early, late = (runs.run_summaries(events.where(c), "user_id", ["ts", "event_id"], ~_failed()) for c in (F.col("ts") < half, F.col("ts") >= half))
    return runs.joined_summaries(early, late, "user_id")


#: An image block of one row of two codes, told by the line numbers of orders; the sizes and the end of a line are tokens of our own.
_OPEN, _TALL, _WIDE, _LINE = 10, 201, 202, 203


TOKENS_SQL = f"""
t as (
  select l_orderkey // 50 as id, row_number() over (partition by l_orderkey // 50 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as pos,
    case when l_returnflag = 'R' and l_linenumber > 1 then 155000 + l_suppkey
      else case l_linenumber when 1 then {_OPEN} when 2 then 151665 when 3 then {_TALL} when 4 then {_WIDE} when 5 then 155000 + l_suppkey when 6 then {_LINE} else 151666 end end as token
  from lineitem
)"""


def token_streams(lineitem: DataFrame) -> DataFrame:
    """id, pos, token: fifty orders' lines as one stream."""
    number = F.col("l_linenumber")
    code = vocab.CODE_FIRST + F.col("l_suppkey")
    token = F.when(number == 1, _OPEN).when((F.col("l_returnflag") == "R") | (number == 5), code).when(number == 2, vocab.IMAGE_START).when(number == 3, _TALL).when(number == 4, _WIDE).when(number == 6, _LINE).otherwise(vocab.IMAGE_END)
    stream = F.floor(F.col("l_orderkey") / 50)
    pos = F.row_number().over(W.partitionBy(stream).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")) - 1
    return lineitem.select(stream.alias("id"), pos.cast("long").alias("pos"), token.cast("long").alias("token"))


@query(f"""
with {TOKENS_SQL}, b as (
  select *, coalesce(sum(case when token = 151665 then 1 else 0 end) over p, 0) as s, coalesce(sum(case when token = 151666 then 1 else 0 end) over p, 0) as e,
    pos - max(case when token = 151665 then pos end) over p - 1 as gone, lag(token) over (partition by id order by pos) as before
  from t window p as (partition by id order by pos rows between unbounded preceding and 1 preceding)
), x as (
  select *, case when e >= 4 then 'stop' when s = e then case when before = {_OPEN} then 'open' else 'text' end when s <> e + 1 then 'any'
    when gone = 0 then 'height' when gone = 1 then 'width' when gone - 1 = 4 then 'end' when (gone - 1) % 3 = 0 then 'line' else 'code' end as expected,
    token between 155000 and 171383 as code from b
)
select id, pos::bigint as pos, expected, case expected when 'stop' then token = 7 when 'any' then true when 'height' then token = {_TALL} when 'width' then token = {_WIDE} when 'line' then token = {_LINE}
  when 'end' then token = 151666 when 'code' then code when 'open' then not code and token not in (151666, {_LINE}) else not code and token not in (151665, 151666, {_LINE}) end as ok from x
""")
def token_grammar(lineitem):
    # The range partitions of their numbers are sampled first, so they are read twice and made once.
    tokens = written(token_streams(lineitem), "tokens")
    out = runs.grammar(tokens, "id", start=vocab.IMAGE_START, end=vocab.IMAGE_END, newline=_LINE, codes=(vocab.CODE_FIRST, vocab.CODE_LAST), sizes=(_TALL, _WIDE), rows=1, columns=2, tags=[[_OPEN]], stop_after=4, stop=7)
    return out.select("id", "pos", "expected", "ok")


@query("""
with o as (
  select o_orderkey, case when coalesce(sum(case o_orderstatus when 'O' then 1 when 'F' then -1 else 0 end) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding), 0) = 1
    then 3 else 1 end as k from orders
), r as (select l.*, k, rank() over (partition by l_orderkey order by l_quantity desc) as r from lineitem l join o on l_orderkey = o_orderkey)
select l_orderkey, l_linenumber, l_partkey, l_quantity, k::bigint as k from r where r <= k
""")
def topk_by_state(orders, lineitem):
    """The greatest quantities of each order, ties kept: three where one more of the customer's orders is open than done before it, else one."""
    status = F.col("o_orderstatus")
    state = runs.k_of_state(orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), "o_custkey", ["o_orderdate", "o_orderkey"], status == "O", status == "F", 3, 1)
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").join(state.select(F.col("o_orderkey").alias("l_orderkey"), big("k").alias("k")), "l_orderkey")
    return runs.top_by_threshold(rows, ["l_orderkey"], "l_quantity", F.col("k"))
