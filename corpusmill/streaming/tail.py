"""Live tail of every run (W2 as a stateful stream) and its error excerpt (L4).

The state of a run is its last ``n`` lines (bounded, whatever the length of
the run), kept by ``applyInPandasWithState``; each micro-batch emits the
updated tails. Rows are trimmed to ``n`` while a group's batches stream in,
so a run with many new lines in one micro-batch never holds more than a few
Arrow batches in memory.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from corpusmill.functions import constants as K
from corpusmill.operators.runlog import error_start, excerpt_from_lines
from corpusmill.session import scratch_dir
from corpusmill.streaming.progress import idle_ms

STATE_SCHEMA = "line_nos array<bigint>, lines array<string>"
OUT_SCHEMA = "run_id bigint, line_nos array<bigint>, lines array<string>"


def _keep_last(n: int, idle: int | None = None):
    def update(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        seen = 0
        if state.exists:
            nos, lines = state.get
            nos, lines = list(nos), list(lines)
        else:
            nos, lines = [], []
        for pdf in batches:
            if idle is not None:
                seen = max(seen, int(pdf["ts"].max().value // 1_000_000))
            pdf = pdf.nlargest(n, "line_no")           # no row-at-a-time work on the rest
            nos.extend(int(x) for x in pdf["line_no"])
            lines.extend(pdf["line"].tolist())
            if len(nos) > 4 * n:                       # trim as we go: bounded memory
                keep = sorted(range(len(nos)), key=nos.__getitem__)[-n:]
                nos, lines = [nos[i] for i in keep], [lines[i] for i in keep]
        keep = sorted(range(len(nos)), key=nos.__getitem__)[-n:]
        nos, lines = [nos[i] for i in keep], [lines[i] for i in keep]
        state.update((nos, lines))
        if idle is not None:
            state.setTimeoutTimestamp(max(seen + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"run_id": [int(key[0])], "line_nos": [nos], "lines": [lines]})
    return update


def tail_stream(stream: DataFrame, n: int = K.TAIL_LINES, watermark: str | None = None) -> DataFrame:
    """Streaming (run_id, line_nos, lines): the last ``n`` lines of every run
    that received lines in the micro-batch. With ``watermark`` (on column
    ``ts``) a run that has been idle for longer leaves the state."""
    if watermark:
        timed = stream.select("run_id", "line_no", "line", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
        return timed.groupBy("run_id").applyInPandasWithState(_keep_last(n, idle_ms(watermark)), OUT_SCHEMA, STATE_SCHEMA, "update",
                                                              GroupStateTimeout.EventTimeTimeout)
    return (stream.select("run_id", "line_no", "line").groupBy("run_id")
                  .applyInPandasWithState(_keep_last(n), OUT_SCHEMA, STATE_SCHEMA, "update",
                                          GroupStateTimeout.NoTimeout))


def _zipped():
    return F.arrays_zip(F.col("line_nos").alias("o"), F.col("lines").alias("l"))


def with_excerpt(tails: DataFrame) -> DataFrame:
    """Error excerpt of every tail; uses the stored ``err_start`` when the
    tails carry it (the error start is then not searched again per line)."""
    start = F.col("err_start") if "err_start" in tails.columns else None
    return tails.select("run_id", excerpt_from_lines(_zipped(), start=start).alias("excerpt"))


def run_tail_stream_once(spark: SparkSession, log: DataFrame, files_per_batch: int = 1000, n: int = K.TAIL_LINES) -> DataFrame:
    """Replay a run log, in the partitions it has, through the stateful tail;
    return the final tail of every run with its error excerpt."""
    src = scratch_dir(spark, "tail-src")
    log.select("run_id", "line_no", "line").write.parquet(src)
    stream = spark.readStream.schema("run_id bigint, line_no bigint, line string") \
        .option("maxFilesPerTrigger", files_per_batch).parquet(src)
    sink = scratch_dir(spark, "tail-updates").rstrip("/")

    def write_batch(bdf: DataFrame, batch_id: int):
        # replay-safe; the error start is computed once per updated tail and stored with it
        bdf.withColumn("err_start", error_start(_zipped())) \
           .write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    q = (tail_stream(stream, n).writeStream.outputMode("update").foreachBatch(write_batch)
            .option("checkpointLocation", scratch_dir(spark, "tail-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    u = spark.read.parquet(sink)
    last = (u.groupBy("run_id").agg(F.max_by(F.struct("line_nos", "lines", "err_start"), F.col("batch_id")).alias("s"))
             .select("run_id", "s.line_nos", "s.lines", "s.err_start"))
    return with_excerpt(last).join(last, "run_id").select("run_id", F.size("line_nos").alias("n_lines"), "excerpt")
