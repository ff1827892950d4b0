"""Run progress kept in the state store of a stream (L3).

Log lines arrive as files (or any streaming source) -> each line is parsed
with the batch parser -> latest progress per run is kept in the state
store in update mode. The state is order-insensitive (the value with the
largest line number wins). Without a watermark the state is a native aggregate that keeps
every run; with one, a run that has been idle for longer is removed from the
state (event-time timeout), so the state holds live runs only, and Spark drops
and counts lines later than the watermark (``numRowsDroppedByWatermark``).

Updates carry the line number of every value and go into a ``LiveTable``: a
run that goes on after its removal keeps the fields it had. Where no line may be
dropped, use ``streaming.live``, which needs no state store.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from corpusmill.operators.runlog import PROGRESS_COLS, parse_progress
from corpusmill.session import scratch_dir
from corpusmill.streaming.live import latest, progress_rows, progress_table, stream_id


def idle_ms(text: str) -> int:
    """Milliseconds of an interval like '1 hour' or '90 seconds'."""
    n, unit = text.split()
    return int(float(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])


def _latest(by: str, ord_col: str, idle: int):
    """State per run: for each progress column its value and line number."""

    def update(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get) if state.exists else [None, None, *[None] * (2 * len(PROGRESS_COLS))]
        for pdf in batches:
            for i, c in enumerate(PROGRESS_COLS):
                some = pdf[pdf[c].notna()]
                if len(some):
                    row = some.loc[some[ord_col].idxmax()]
                    if held[3 + 2 * i] is None or row[ord_col] >= held[3 + 2 * i]:
                        held[2 + 2 * i], held[3 + 2 * i] = row[c], int(row[ord_col])
            last, seen = int(pdf[ord_col].max()), int(pdf["ts"].max().value // 1_000_000)
            held[0] = last if held[0] is None else max(held[0], last)
            held[1] = seen if held[1] is None else max(held[1], seen)
        held = [None if x is None else x.item() if hasattr(x, "item") else x for x in held]
        state.update(tuple(held))
        state.setTimeoutTimestamp(max(held[1] + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([[key[0], *held[2:], held[0]]], columns=[by, *[x for c in PROGRESS_COLS for x in (c, f"{c}_at")], "last_line"])

    return update


def progress_stream(stream: DataFrame, watermark: str | None = None, by: str = "run_id",
                    ord_col: str = "line_no") -> DataFrame:
    parsed = parse_progress(stream)
    if not watermark:
        return progress_rows(parsed, by, ord_col)
    # event time must be TIMESTAMP (logs often carry TIMESTAMP_NTZ)
    parsed = parsed.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    kinds = {f.name: f.dataType.simpleString() for f in parsed.schema}
    held = ", ".join(f"{c} {kinds[c]}, {c}_at bigint" for c in PROGRESS_COLS)
    out = f"{by} {kinds[by]}, {held}, last_line bigint"
    return parsed.select(by, ord_col, "ts", *PROGRESS_COLS).groupBy(by).applyInPandasWithState(
        _latest(by, ord_col, idle_ms(watermark)), out, f"last_line bigint, seen bigint, {held}", "update",
        GroupStateTimeout.EventTimeTimeout)


def start_progress_stream(stream: DataFrame, sink_path: str, checkpoint: str,
                          trigger: dict | None = None, watermark: str | None = None):
    """Start the update-mode query; every micro-batch's updated rows are merged
    into the live table at ``sink_path`` (see ``latest_from_updates``), once,
    although ``foreachBatch`` is at-least-once. The checkpoint in the shared folder
    makes the query restartable after a lost driver or executor."""
    agg = progress_stream(stream, watermark=watermark)

    def write_batch(bdf: DataFrame, batch_id: int):
        spark = bdf.sparkSession
        progress_table(spark, sink_path).commit(bdf, stream_id(spark, checkpoint), batch_id)

    w = (agg.writeStream.outputMode("update").foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint))
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def latest_from_updates(spark: SparkSession, sink_path: str) -> DataFrame:
    """Current state per run, field by field by line number; readable while the stream runs."""
    return latest(spark, sink_path)


def run_progress_stream_once(spark: SparkSession, log: DataFrame, files_per_batch: int = 1000,
                             watermark: str | None = None) -> DataFrame:
    """Replay a run log through the stream in the partitions it has,
    ``files_per_batch`` files per micro-batch; return the final state."""
    src = scratch_dir(spark, "runlog-src")
    log.select("run_id", "line_no", "ts", "line").write.parquet(src)
    stream = spark.readStream.schema("run_id bigint, line_no bigint, ts timestamp_ntz, line string") \
        .option("maxFilesPerTrigger", files_per_batch).parquet(src)
    sink = scratch_dir(spark, "progress-updates")
    q = start_progress_stream(stream, sink, scratch_dir(spark, "progress-ckpt"), watermark=watermark)
    q.awaitTermination()
    return latest_from_updates(spark, sink)
