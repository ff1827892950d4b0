"""Live tables of a run log: merged versions, replay, pauses, late lines, one stream for all sinks."""
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import runlog as R
from corpusmill.session import local_path, scratch_dir
from corpusmill.streaming import live as L

BAR = "Epoch 1/3:  {p}%|###| {s}/150 [00:{t}<01:02, 1.25it/s]"
SHAPES = [lambda i: BAR.format(p=i % 100, s=i, t=f"{i % 60:02d}"), lambda i: f"{{'loss': 0.{i}, 'epoch': 1.5}}",
          lambda i: f"  {i % 100}%|##| {i}/77 [00:11<01:01, 2.5it/s]", lambda i: f"ValueError: <{i}>", lambda i: f"line {i} & more"]
SCHEMA = "run_id long, line_no long, line string, ts timestamp_ntz"


def log_rows(seed, n=600, runs=5):
    rng = random.Random(seed)
    return [(rng.randrange(runs), i, rng.choice(SHAPES)(i)) for i in range(n)]


def frame(spark, rows, ts="2024-01-01 00:00:00"):
    return spark.createDataFrame(rows, "run_id long, line_no long, line string").withColumn("ts", F.to_timestamp_ntz(F.lit(ts)))


def add_file(df, src):
    df.coalesce(1).write.mode("append").parquet(src)


def stream_of(spark, src):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)


def run(spark, src, root, ck, **how):
    q = L.start_live(stream_of(spark, src), root, ck, **how)
    q.awaitTermination()


def progress(df):
    return {r.run_id: tuple(r[c] for c in R.PROGRESS_COLS) for r in df.collect()}


def same_as_batch(spark, root, log):
    assert progress(L.latest(spark, root)) == progress(R.progress_latest(R.parse_progress(log)))
    got = {r.run_id: r.excerpt for r in L.errors(spark, root).collect()}
    assert got == {r.run_id: r.excerpt for r in R.error_excerpt(log, None).collect()}


def folders(root, table):
    at = local_path(f"{root}/{table}")
    return [f for f in os.listdir(at) if f.startswith(("delta-", "base-"))], os.listdir(f"{at}/_commits")


@pytest.mark.parametrize("every", [1, 3])
def test_many_batches_equal_the_batch_job(spark, every):
    rows = log_rows(1)
    random.Random(4).shuffle(rows)                              # disordered lines
    src, root = scratch_dir(spark, "l-src"), scratch_dir(spark, "l-root")
    for i in range(0, len(rows), 120):
        add_file(frame(spark, rows[i:i + 120]), src)
    run(spark, src, root, scratch_dir(spark, "l-ck"), every=every)
    same_as_batch(spark, root, frame(spark, rows))
    for table in ("progress", "tails"):
        kept, commits = folders(root, table)
        assert len(kept) <= every + 1 + 3 and len([c for c in commits if c.endswith(".json") and not c.startswith(".")]) <= 3
    assert L.stats(spark, root) == {"lines": len(rows), "late": 0}


def test_a_run_that_pauses_keeps_its_fields(spark):
    """A day between two parts of a run, far beyond the watermark: nothing is lost, late lines are counted."""
    src, root, ck = scratch_dir(spark, "p-src"), scratch_dir(spark, "p-root"), scratch_dir(spark, "p-ck")
    first = frame(spark, [(1, 0, SHAPES[0](7)), (1, 1, SHAPES[1](5))])
    other = frame(spark, [(2, i, SHAPES[0](i)) for i in range(5)], "2024-01-02 00:00:00")
    again = frame(spark, [(1, 5, SHAPES[2](33))], "2024-01-02 12:00:00")
    late = frame(spark, [(2, 9, SHAPES[1](9))], "2024-01-01 06:00:00")
    for df in (first, other, again, late):
        add_file(df, src)
        run(spark, src, root, ck, watermark="1 hour")            # restarted each time
    same_as_batch(spark, root, first.union(other).union(again).union(late))
    one = {r.run_id: r for r in L.latest(spark, root).collect()}
    assert one[1].epoch_cur == 1 and one[1].loss == 0.5 and one[1].pct == 33 and one[2].loss == 0.9
    assert L.stats(spark, root) == {"lines": 9, "late": 1}


def test_state_store_stream_keeps_fields_of_evicted_runs(spark):
    from corpusmill.streaming.progress import latest_from_updates, start_progress_stream
    src, sink, ck = scratch_dir(spark, "e-src"), scratch_dir(spark, "e-sink"), scratch_dir(spark, "e-ck")
    parts = [([(1, 0, SHAPES[0](7)), (1, 1, SHAPES[1](5))], "2024-01-01 00:00:00"), ([(2, 0, SHAPES[0](1))], "2024-01-03 00:00:00"),
             ([(2, 1, SHAPES[0](2))], "2024-01-05 00:00:00"), ([(1, 5, SHAPES[2](33))], "2024-01-06 00:00:00")]
    for rows, ts in parts:
        add_file(frame(spark, rows, ts), src)
        start_progress_stream(stream_of(spark, src), sink, ck, watermark="1 hour").awaitTermination()
    got = {r.run_id: r for r in latest_from_updates(spark, sink).collect()}
    assert (got[1].epoch_cur, got[1].loss, got[1].pct, got[1].last_line) == (1, 0.5, 33, 5)


@pytest.mark.parametrize("step", ["before", "after"])
def test_a_batch_that_is_replayed_counts_once(spark, monkeypatch, step):
    rows = log_rows(2, 300)
    src, root, ck = scratch_dir(spark, "r-src"), scratch_dir(spark, "r-root"), scratch_dir(spark, "r-ck")
    for i in range(0, 300, 100):
        add_file(frame(spark, rows[i:i + 100]), src)
    real, calls = L.LiveTable._put, []

    def put(self, manifest):
        calls.append(manifest["version"])
        if len(calls) == 4 and step == "before":                # the folder is written, the version is not
            raise RuntimeError("lost")
        real(self, manifest)
        if len(calls) == 4 and step == "after":                 # the version is there, the stream does not know
            raise RuntimeError("lost")
    monkeypatch.setattr(L.LiveTable, "_put", put)
    with pytest.raises(Exception, match="lost"):
        run(spark, src, root, ck)
    run(spark, src, root, ck)
    same_as_batch(spark, root, frame(spark, rows))
    assert L.stats(spark, root)["lines"] == 300


def test_commit_is_idempotent_and_refuses_two_writers(spark):
    root = scratch_dir(spark, "t-root")
    t = L.tail_table(spark, root, 3)
    assert t.read() is None and L.latest(spark, root) is None and L.errors(spark, root) is None
    assert L.stats(spark, root) == {"lines": 0, "late": 0}
    lines = spark.createDataFrame([(1, i, f"l{i}") for i in range(5)], "run_id long, line_no long, line string")
    assert t.commit(lines, "s", 0) and not t.commit(lines, "s", 0)
    assert t.commit(lines, "other", 0)                          # another stream, the same lines: no change
    assert sorted(r.line_no for r in t.read().collect()) == [2, 3, 4]
    with pytest.raises(RuntimeError, match="two writers"):
        t._put({"version": t.versions()[-1], "folders": [], "streams": {}, "stats": {}})


def test_readable_while_the_stream_runs(spark):
    """A reader that comes between micro-batches sees a whole version; versions only grow."""
    rows = log_rows(5, 400)
    src, root = scratch_dir(spark, "w-src"), scratch_dir(spark, "w-root")
    for i in range(0, 400, 50):
        add_file(frame(spark, rows[i:i + 50]), src)
    seen, q = [], L.start_live(stream_of(spark, src), root, scratch_dir(spark, "w-ck"), every=3, keep=50)
    while q.isActive:
        now = L.latest(spark, root)
        if now is not None:
            seen.append(sum(r.last_line for r in now.collect()))
        threading.Event().wait(0.05)
    assert q.exception() is None and seen == sorted(seen)
    same_as_batch(spark, root, frame(spark, rows))


def test_null_and_repeated_lines(spark):
    rows = [(1, 0, None), (1, 1, "x"), (1, 1, "x"), (None, 0, SHAPES[0](3)), (1, 2, "")]
    root = L.run_live_once(spark, frame(spark, rows))
    got = {r.run_id: r for r in L.latest(spark, root).collect()}
    assert got[None].pct == 3 and got[1].last_line == 2 and got[1].pct is None
    assert L.tail_table(spark, root).read().where("run_id = 1").count() == 3
    empty = L.run_live_once(spark, frame(spark, rows).limit(0))
    assert L.latest(spark, empty) is None or L.latest(spark, empty).count() == 0


def test_runlog_command_streams_latest_and_errors(spark, tmp_path, capsys):
    from corpusmill import cli
    rows, out = log_rows(7, 200), scratch_dir(spark, "cli-live")
    log = frame(spark, rows)
    log.repartition(3).write.parquet(f"{out}/log")
    spark.createDataFrame([(i, i % 2) for i in range(5)], "run_id long, rc int").write.parquet(f"{out}/exits")
    base = ["runlog", "--log", f"{out}/log", "--exits", f"{out}/exits", "--output", f"{out}/live"]
    cli.main([*base, "--stream", "--once", "--watermark", "1 hour"])
    assert '"lines": 200' in capsys.readouterr().out
    assert progress(spark.read.parquet(f"{out}/live/latest")) == progress(R.progress_latest(R.parse_progress(log)))
    want = {r.run_id: r.excerpt for r in R.error_excerpt(log, spark.read.parquet(f"{out}/exits")).collect()}
    assert {r.run_id: r.excerpt for r in spark.read.parquet(f"{out}/live/errors").collect()} == want
    cli.main(["runlog", "--current", "--output", f"{out}/live"])   # no log: only the live tables
    assert spark.read.parquet(f"{out}/live/errors").count() > 0
