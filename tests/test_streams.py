"""Streams killed and started again, their progress as a table, and the state counter with late and repeated rows."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import runs
from corpusmill.sources import tables
from corpusmill.streaming import counters, resumable

SCHEMA = "id long, v double"


@pytest.fixture
def source(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i in range(6):
        spark.createDataFrame([(10 * i + k, float(k)) for k in range(10)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


def stop_at(batch):
    def after(b):
        if b == batch:
            raise RuntimeError("killed")

    return after


def test_killed_between_write_and_commit(spark, source, tmp_path):
    target, check = str(tmp_path / "out"), str(tmp_path / "check")
    stream = lambda: resumable.file_stream(spark, source, SCHEMA, files_per_batch=1)
    tries = []

    def each(rows, batch):
        tries.append(batch)
        return rows.withColumn("twice", F.col("v") * 2)

    for dead in (1, 3, 3, None):
        q = resumable.start(stream(), target, check, each=each, after=stop_at(dead))
        if dead is None:
            q.awaitTermination()
        else:
            with pytest.raises(Exception, match="killed"):
                q.awaitTermination()
    assert tries == [0, 1, 1, 2, 3, 3, 3, 4, 5] and resumable.committed_batches(target) == list(range(6))
    out = resumable.committed(spark, target, "id long, v double, twice double")
    assert sorted(r["id"] for r in out.collect()) == list(range(60)) and out.where("twice <> 2 * v").count() == 0
    assert sorted({r["batch"] for r in resumable.committed(spark, target, SCHEMA, since=4).collect()}) == [4, 5]
    # Nothing new: no batch. New files alone are taken.
    resumable.start(stream(), target, check).awaitTermination()
    spark.createDataFrame([(999, 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    resumable.start(stream(), target, check).awaitTermination()
    assert resumable.committed(spark, target, SCHEMA).count() == 61


def test_a_broken_batch_is_not_read_and_replaced(spark, source, tmp_path):
    target, check = tmp_path / "out", str(tmp_path / "check")
    broken = target / "batch=0"
    broken.mkdir(parents=True)
    (broken / "part-x.json").write_text('{"id": 12345, "v": 1.0}\n')
    assert resumable.committed_batches(str(target)) == [] and resumable.committed(spark, str(target), SCHEMA, kind="json").count() == 0
    resumable.start(resumable.file_stream(spark, source, SCHEMA, files_per_batch=4), str(target), check, kind="json").awaitTermination()
    got = [r["id"] for r in resumable.committed(spark, str(target), SCHEMA, kind="json").collect()]
    assert sorted(got) == list(range(60)) and resumable.committed_batches(str(target)) == [0, 1]


def test_start_without_a_checkpoint(spark, source, tmp_path):
    target = str(tmp_path / "out")
    rows = spark.read.parquet(source)
    rows.where("id < 25").write.parquet(target + "/batch=0")
    left = resumable.unfinished(rows, resumable.committed(spark, target, SCHEMA), "id")
    assert sorted(r["id"] for r in left.collect()) == list(range(25, 60))


def test_progress_is_a_table(spark, source, tmp_path):
    listener = resumable.ProgressTable(str(tmp_path / "progress"))
    spark.streams.addListener(listener)
    try:
        target, check = str(tmp_path / "out"), str(tmp_path / "check")
        stream = lambda: resumable.file_stream(spark, source, SCHEMA, files_per_batch=2)
        q = resumable.start(stream(), target, check, name="first", after=stop_at(1))
        with pytest.raises(Exception, match="killed"):
            q.awaitTermination()
        assert listener.wait_ended(q)
        q = resumable.start(stream(), target, check, name="second")
        q.awaitTermination()
        assert listener.wait_ended(q)
    finally:
        spark.streams.removeListener(listener)
    table = listener.table(spark)
    rows = {r["kind"] + str(r["name"]): r["n"] for r in table.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert rows["startedfirst"] == rows["startedsecond"] == 1 and rows["endedNone"] == 2
    assert table.where("kind = 'ended' and error like '%killed%'").count() == 1
    got = {r["batch"]: r["rows"] for r in resumable.batches_of(table).collect() if r["rows"]}
    want = {r["batch"]: r["count"] for r in resumable.committed(spark, target, SCHEMA).groupBy("batch").count().collect()}
    assert got == want == {0: 20, 1: 20, 2: 20}
    assert table.where("kind = 'batch' and phases['addBatch'] is null and rows > 0").count() == 0


def run_counter(spark, batches, tmp_path, **options):
    """Feed lists of (user, second, id, flag) as one batch each; what came out."""
    folder, target, check = (str(tmp_path / x) for x in ("cin", "cout", "ccheck"))
    schema = "user long, ts timestamp, id long, flag boolean"
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(u, s, i, f) for u, s, i, f in rows], "user long, s long, id long, flag boolean")
        df.select("user", F.timestamp_seconds("s").alias("ts"), "id", "flag").coalesce(1).write.mode("append").parquet(folder)
        with counters.with_rocksdb(spark):
            out = counters.counted(resumable.file_stream(spark, folder, schema), "user", "ts", "id", F.col("flag"), **options)
            resumable.start(out, target, check).awaitTermination()
    got = resumable.committed(spark, target, out.schema).select("user", F.unix_seconds("ts").alias("s"), "id", "run", "longest", "stopped").collect()
    assert spark.conf.get(counters.with_rocksdb.KEY) != counters.PROVIDER
    return sorted(tuple(r) for r in got)


def plain_runs(rows, limit, until):
    out = []
    for user in sorted({r[0] for r in rows}):
        run = longest = 0
        for u, s, i, f in sorted(set(r for r in rows if r[0] == user), key=lambda r: r[1:3]):
            if s <= until:
                run = run + 1 if f else 0
                longest = max(longest, run)
                out.append((u, s, i, run, longest, 0 < limit <= run))
                if 0 < limit <= run:
                    break
    return sorted(out)


def test_counter_with_late_and_repeated_rows(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.randint(1, 3), 1000 + 5 * k, k, r.random() < 0.7) for k in range(60)]
    # Neighbours change places within the delay of 60 s, and a third of the rows come again in the same or the next batch.
    mixed = sorted(rows, key=lambda x: x[1] + r.randint(0, 50))
    batches = [mixed[:20] + mixed[:7], mixed[12:40], mixed[40:] + mixed[38:44]]
    batches.append([(9, 1300, 500, False)])  # moves the watermark to 1240; every row before is due
    got = run_counter(spark, batches, tmp_path, limit=3, late="60 seconds")
    assert got == plain_runs(rows, 3, 1240) and any(x[5] for x in got)


def test_rows_behind_the_watermark_and_forgetting(spark, tmp_path):
    batches = [[(1, 1000, 1, True), (1, 1010, 2, True)], [(1, 2000, 3, True)], [(1, 1005, 4, False), (1, 2010, 5, True)], [(2, 9000, 6, False)]]
    got = run_counter(spark, batches, tmp_path, late="10 seconds", forget_ms=500_000)
    assert got == [(1, 1000, 1, 1, 1, False), (1, 1010, 2, 2, 2, False), (1, 2000, 3, 1, 1, False), (1, 2010, 5, 2, 2, False)]


def test_counter_asks_its_state_once_a_key():
    """A call of the state goes over a socket; a call for each row took most of the time."""
    import pandas as pd

    calls = []

    class State:
        value = None

        def __getattr__(self, name):
            calls.append(name)
            return {"get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "containsKey": lambda k: False}.get(name, lambda *a: None)

    class Handle:
        def getValueState(self, *a):
            return State()

        getMapState = getValueState

        def registerTimer(self, at):
            calls.append("timer")

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    counter = counters.RunCounter(0, 0)
    counter.init(Handle())
    frames = [pd.DataFrame({"at": [1_000_000 * k + 5_000_000], "id": [k], "flag": [k % 3 > 0]}) for k in reversed(range(300))]
    got = pd.concat(counter.handleInputRows((1,), iter(frames), Times()))
    assert calls == ["get", "update"] and list(got["id"]) == list(range(300)) and list(got["run"]) == [k % 3 for k in range(300)]


def test_stream_and_blocks_agree(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(path)
    target, check = tables.new_path(spark, "counted"), tables.new_path(spark, "check")
    with counters.with_rocksdb(spark):
        out = counters.counted(resumable.file_stream(spark, path[:-1] + "[t]", events.schema), "user_id", "ts", "event_id", F.col("event_type") == "error", limit=2, late="12 hours")
        resumable.start(out, target, check).awaitTermination()
    last = events.agg(F.max("ts") - F.expr("interval 12 hours")).first()[0]
    want = runs.until_limit(events.where(F.col("ts") <= last), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2)
    pick = ("user_id", "event_id", "run", "stopped")
    got = sorted(map(tuple, resumable.committed(spark, target, out.schema).select(*pick).collect()))
    assert len(got) > 100 and got == sorted(map(tuple, want.select(*pick).collect()))
