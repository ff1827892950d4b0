"""Progress parsing precedence, carry-forward, error excerpt, stream = batch."""
from pyspark.sql import functions as F

from corpusmill.operators import runlog as R

# each line, and by hand what it sets
STEPS = [
    ("epoch 4/9 running  12%|..| 30/250 [00:45<05:30, 0.7it/s]",
     dict(epoch_cur=4, epoch_total=9, pct=12, step_cur=30, step_total=250, elapsed="00:45", eta="05:30")),
    ("   33%|---| 8/24 [2:10<4:20]", dict(pct=33, step_cur=8, step_total=24, elapsed="2:10", eta="4:20")),
    ("{'loss': 0.875, 'epoch': 0.25, 'grad': 3}", dict(loss=0.875, epoch_float=0.25)),
    ("save 91%|-| 9/10 [00:01<00:02]", {}),                      # the bar does not open the line
    ("{'loss': 4e-3, 'epoch': 7.0}", dict(loss=4.0, epoch_float=7.0)),
    ("{'loss': 1..2}", {}),                                      # not a number
    ("{'valid_loss': 0.5}", {}),                                 # another key
    ("Epoch 5 / 9 | 70%|--| 7/10 [00:09<00:03, 3it/s] {'loss': 9.5}",
     dict(epoch_cur=5, epoch_total=9, pct=70, step_cur=7, step_total=10, elapsed="00:09", eta="00:03")),
]
LINES = [line for line, _ in STEPS]
FINAL = dict(epoch_cur=5, epoch_total=9, pct=70, step_cur=7, step_total=10, elapsed="00:09", eta="00:03", loss=4.0, epoch_float=7.0)


def _log(spark, lines, run=1):
    return spark.createDataFrame([(run, i, ln) for i, ln in enumerate(lines)], "run_id long, line_no long, line string")


def test_carry_forward_keeps_the_last_value_of_each_field(spark):
    parsed = R.parse_progress(_log(spark, LINES))
    for chunk in (None, 2, 1 << 20):
        rows = R.carry_forward(parsed.select("run_id", "line_no", *R.PROGRESS_COLS), chunk=chunk) \
                .orderBy("line_no").collect()
        seen = {}
        for (line, sets), r in zip(STEPS, rows):
            seen |= sets
            assert {c: r[c] for c in R.PROGRESS_COLS} == {c: seen.get(c) for c in R.PROGRESS_COLS}, (chunk, line)


def test_latest_and_display(spark):
    latest = R.progress_latest(R.parse_progress(_log(spark, LINES)))
    assert {c: latest.first()[c] for c in R.PROGRESS_COLS} == FINAL
    disp = R.progress_display(latest, total_epochs=3).first()
    assert (disp.loss_label, disp.pct_label, disp.epoch_label) == ("4.0000", "70%", "5/9")


def test_sci_loss_option(spark):
    p = R.parse_progress(_log(spark, ["{'loss': 1.2e-05}"]), sci=True).first()
    assert p.loss == 1.2e-05
    p = R.parse_progress(_log(spark, ["{'loss': 1.2e-05}"])).first()
    assert p.loss == 1.2


def test_error_excerpt_cases(spark):
    runs = {
        1: (["fine"] * 3, "fine\nfine\nfine"),                                    # no error line: the whole tail
        2: (["go", "Traceback (most recent call last):", "if a <&> b", "KeyError: 3"], "KeyError: 3"),   # the last of two
        3: (["Error early"] + [f"row {i}" for i in range(40)], "\n".join(f"row {i}" for i in range(10, 40))),   # older than the tail
        4: (["   ", " "], "No output captured."),
        5: (["before", "  ImportError: <lib> & more", "after"], "ImportError: &lt;lib&gt; &amp; more\nafter"),
    }
    rows = [(r, i, ln) for r, (lines, _) in runs.items() for i, ln in enumerate(lines)]
    df = spark.createDataFrame(rows, "run_id long, line_no long, line string")
    assert {r.run_id: r.excerpt for r in R.error_excerpt(df).collect()} == {r: text for r, (_, text) in runs.items()}


def test_stream_final_state_equals_batch(spark):
    from corpusmill.streaming.progress import run_progress_stream_once
    lines = LINES * 3
    log = spark.createDataFrame([(1 + i % 2, i, None, ln) for i, ln in enumerate(lines)],
                                "run_id long, line_no long, ts timestamp_ntz, line string")
    final = {r.run_id: r for r in run_progress_stream_once(spark, log.repartition(3), files_per_batch=1).collect()}
    batch = {r.run_id: r for r in R.progress_latest(R.parse_progress(log)).collect()}
    assert set(final) == set(batch)
    for k in batch:
        for c in R.PROGRESS_COLS:
            assert final[k][c] == batch[k][c]


def test_tail_two_level_equals_plain(spark):
    log = spark.range(0, 4000, 1, 10).select((F.col("id") % 3).alias("run_id"), F.col("id").alias("line_no"))
    plain = sorted(tuple(r) for r in R.tail_n(log, n=30, fanout=None).collect())
    two = sorted(tuple(r) for r in R.tail_n(log, n=30, fanout=4).collect())
    assert plain == two and len(plain) == 90


def test_stateful_tail_stream_equals_batch(spark):
    from corpusmill.streaming.tail import run_tail_stream_once
    lines = []
    for i in range(400):
        run = 1 + i % 3
        ln = "Traceback (most recent call last):" if i % 37 == 0 else ("ValueError: x <y>" if i % 41 == 0 else f"l{i} & z")
        lines.append((run, i, ln))
    log = spark.createDataFrame(lines, "run_id long, line_no long, line string")
    got = {r.run_id: (r.n_lines, r.excerpt) for r in run_tail_stream_once(spark, log.repartition(3), files_per_batch=1, n=30).collect()}
    batch = {r.run_id: r.excerpt for r in R.error_excerpt(log, None, failed_only=False).collect()}
    assert set(got) == set(batch)
    for k in batch:
        assert got[k] == (30, batch[k])


def test_progress_stream_with_watermark(spark):
    from corpusmill.session import scratch_dir
    from corpusmill.streaming.progress import progress_stream
    src = scratch_dir(spark, "wm-src")
    log = spark.createDataFrame([(1, i, ln) for i, ln in enumerate(LINES)], "run_id long, line_no long, line string") \
        .withColumn("ts", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    log.write.parquet(src)
    st = spark.readStream.schema("run_id bigint, line_no bigint, line string, ts timestamp_ntz").parquet(src)
    name = "wm_progress_test"
    q = (progress_stream(st, watermark="1 hour").writeStream.outputMode("update").format("memory")
         .queryName(name).option("checkpointLocation", scratch_dir(spark, "wm-ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql(f"select * from {name}").collect()
    assert len(got) == 1 and got[0].last_line == len(LINES) - 1


def _daily_runs(spark, days=6):
    """One file per run; each run a day after the one before."""
    from corpusmill.session import scratch_dir
    src = scratch_dir(spark, "daily")
    for day in range(days):
        spark.createDataFrame([(day, i, ln) for i, ln in enumerate(LINES)], "run_id long, line_no long, line string") \
            .withColumn("ts", F.to_timestamp_ntz(F.lit(f"2024-01-0{day + 1} 00:00:00"))).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema("run_id bigint, line_no bigint, line string, ts timestamp_ntz") \
        .option("maxFilesPerTrigger", 1).parquet(src)


def _state_rows(spark, df):
    from corpusmill.session import scratch_dir
    q = (df.writeStream.outputMode("update").foreachBatch(lambda b, _: b.write.format("noop").mode("overwrite").save())
         .option("checkpointLocation", scratch_dir(spark, "evict-ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    ops = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    return max(o["numRowsTotal"] for o in ops), sum(o["numRowsRemoved"] for o in ops)


def test_watermark_removes_idle_runs_from_the_state(spark):
    from corpusmill.streaming.progress import progress_stream
    from corpusmill.streaming.tail import tail_stream
    for stream in (lambda s: progress_stream(s, watermark="1 hour"), lambda s: tail_stream(s, watermark="1 hour")):
        most, removed = _state_rows(spark, stream(_daily_runs(spark)))
        assert most <= 3 and removed >= 4


from hypothesis import given, settings, strategies as st  # noqa: E402


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from(LINES + ["noise", ""])), min_size=1, max_size=60),
       st.integers(1, 7))
def test_segmented_carry_forward_equals_plain(spark, rows, chunk):
    data = [(run, i * 3, line) for i, (run, line) in enumerate(rows)]   # gaps in line numbers
    df = R.parse_progress(spark.createDataFrame(data, "run_id long, line_no long, line string"))
    df = df.select("run_id", "line_no", *R.PROGRESS_COLS)
    seg = sorted(tuple(r) for r in R.carry_forward(df, chunk=chunk).collect())
    plain = sorted(tuple(r) for r in R.carry_forward(df, chunk=None).collect())
    assert seg == plain


def test_latest_with_repeated_and_null_lines(spark):
    bar = "Epoch 1/3:  5%|#| 7/150 [{e}<01:02, 1.25it/s]"
    rows = [(1, 3, bar.format(e="00:09")), (1, 3, bar.format(e="00:11")), (1, 9, "{'loss': 0.5}"), (None, 1, bar.format(e="00:01")),
            (2, None, bar.format(e="00:02")), (3, 1, None), (3, 2, "text")]
    df = R.parse_progress(spark.createDataFrame(rows, "run_id long, line_no long, line string"))
    for parsed in (df, df.drop("line")):                       # with the line at hand, and without
        got = {r.run_id: r for r in R.progress_latest(parsed).collect()}
        assert len(got) == 4 and got[1].elapsed == "00:11" and got[1].loss == 0.5 and got[1].step_cur == 7
        assert got[None].elapsed == "00:01" and got[2].elapsed is None and got[3].eta is None
    assert R.progress_latest(df.limit(0)).count() == 0
