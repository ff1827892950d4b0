"""Live tables of a run log: progress and tails from one stream.

``LiveTable`` is a keyed table that micro-batches are merged into while
readers use it. A micro-batch adds a small delta folder; every few batches the
deltas are merged into a new base; a manifest, put in place by a rename, says
which folders make up a version. A reader merges the base and its few deltas.
The merge must not care about order or repetition (a maximum by line
number, the last lines of a run), so a micro-batch that is replayed after a
failure changes nothing, and each folder is written whole before its manifest.

``start_live`` feeds two such tables from one read of the stream: the
latest value of every progress field with its line number, and the last lines
per run. There is no state store: a run may pause for any time and goes on with its
earlier fields; late and disordered lines count like all others. Lines older than the
watermark are counted as late, none is dropped. A task holds the aggregate
of its share of one micro-batch.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import constants as K
from corpusmill.operators.runlog import PROGRESS_COLS, error_excerpt, parse_progress, tail_n
from corpusmill.session import scratch_dir

LOG_SCHEMA = "run_id bigint, line_no bigint, ts timestamp_ntz, line string"


# ---------------------------------------------------------------- table
class LiveTable:
    """``merge`` maps rows of any number of deltas and bases to the table's
    rows. ``every`` deltas are merged into a base; manifests of the last ``keep``
    versions, and their folders, stay for readers."""

    def __init__(self, spark: SparkSession, root: str, merge: Callable[[DataFrame], DataFrame], every: int = 8, keep: int = 3):
        self.spark, self.root, self.merge, self.every, self.keep = spark, root.rstrip("/"), merge, every, keep
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(name)

    def versions(self) -> list[int]:
        """Committed versions, oldest first (``keep`` of them at most)."""
        at = self._path(f"{self.root}/_commits")
        if not self.fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            found = self.versions()
            if not found:
                return {"version": -1, "folders": [], "streams": {}, "stats": {}}
            version = found[-1]
        stream = self.fs.open(self._path(f"{self.root}/_commits/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _rows(self, folders: list[str]) -> DataFrame:
        frames = [self.spark.read.parquet(f"{self.root}/{f}") for f in folders]
        return self.merge(reduce(lambda a, b: a.unionByName(b), frames))

    def read(self) -> DataFrame | None:
        """The table's rows at the newest version; None before the first."""
        folders = self.manifest()["folders"]
        return self._rows(folders) if folders else None

    def done(self, stream: str, batch: int) -> bool:
        return self.manifest()["streams"].get(stream, -1) >= batch

    def commit(self, delta: DataFrame, stream: str, batch: int, stats: dict | None = None) -> bool:
        """Add the rows of micro-batch ``batch`` of ``stream``; False when that
        micro-batch is in the table already."""
        held = self.manifest()
        if held["streams"].get(stream, -1) >= batch:
            return False
        version = held["version"] + 1
        self.merge(delta).write.mode("overwrite").parquet(f"{self.root}/delta-{version}")
        folders = held["folders"] + [f"delta-{version}"]
        if len(folders) > self.every:
            self._rows(folders).write.mode("overwrite").parquet(f"{self.root}/base-{version}")
            folders = [f"base-{version}"]
        self._put({"version": version, "folders": folders, "streams": {**held["streams"], stream: batch}, "stats": stats or held["stats"]})
        self._clean()
        return True

    def _put(self, manifest: dict) -> None:
        at = f"{self.root}/_commits"
        self.fs.mkdirs(self._path(at))
        made, final = self._path(f"{at}/.{manifest['version']}.tmp"), self._path(f"{at}/{manifest['version']}.json")
        out = self.fs.create(made, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if not self.fs.rename(made, final):
            raise RuntimeError(f"version {manifest['version']} of {self.root} is there already: two writers")

    def _clean(self) -> None:
        """Old manifests go, then the folders that none of the rest names."""
        versions = self.versions()
        for v in versions[:-self.keep]:
            self.fs.delete(self._path(f"{self.root}/_commits/{v}.json"), False)
        used = {f for v in versions[-self.keep:] for f in self.manifest(v)["folders"]}
        for s in self.fs.listStatus(self._path(self.root)):
            name = s.getPath().getName()
            if name.startswith(("delta-", "base-")) and name not in used:
                self.fs.delete(s.getPath(), True)


# ---------------------------------------------------------------- the two tables
def progress_rows(parsed: DataFrame, by: str = "run_id", ord_col: str = "line_no") -> DataFrame:
    """Per run the latest value of each progress field with its line number (``_at``)."""
    aggs = []
    for c in PROGRESS_COLS:
        at = F.when(F.col(c).isNotNull(), F.col(ord_col))
        aggs += [F.max_by(F.col(c), at).alias(c), F.max(at).alias(f"{c}_at")]
    return parsed.groupBy(by).agg(*aggs, F.max(ord_col).alias("last_line"))


def merge_progress(rows: DataFrame, by: str = "run_id") -> DataFrame:
    """Field by field, the value of the largest line number."""
    aggs = []
    for c in PROGRESS_COLS:
        at = F.col(f"{c}_at")
        aggs += [F.max_by(F.col(c), at).alias(c), F.max(at).alias(f"{c}_at")]
    return rows.groupBy(by).agg(*aggs, F.max("last_line").alias("last_line"))


def merge_tails(n: int) -> Callable[[DataFrame], DataFrame]:
    """The last ``n`` different lines of every run."""
    return lambda rows: tail_n(rows.dropDuplicates(["run_id", "line_no", "line"]), "run_id", "line_no", n)


def progress_table(spark: SparkSession, root: str, **how) -> LiveTable:
    return LiveTable(spark, f"{root.rstrip('/')}/progress", merge_progress, **how)


def tail_table(spark: SparkSession, root: str, n: int = K.TAIL_LINES, **how) -> LiveTable:
    return LiveTable(spark, f"{root.rstrip('/')}/tails", merge_tails(n), **how)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint keeps over restarts."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first().value)["id"]


def start_live(stream: DataFrame, root: str, checkpoint: str, trigger: dict | None = None, watermark: str | None = None,
               n: int = K.TAIL_LINES, **how):
    """Start the stream of log lines (run_id, line_no, line, ts) into the
    live tables under ``root``; restartable from ``checkpoint``. With ``watermark`` lines that
    are older than the newest line before their micro-batch by more than it are counted as late."""
    from corpusmill.streaming.progress import idle_ms
    idle = idle_ms(watermark) if watermark else None

    def write(batch: DataFrame, number: int):
        spark = batch.sparkSession
        progress, tails = progress_table(spark, root, **how), tail_table(spark, root, n, **how)
        me = stream_id(spark, checkpoint)
        if progress.done(me, number) and tails.done(me, number):
            return
        seen = progress.manifest()["stats"]
        lines = parse_progress(batch.select("run_id", "line_no", "line", "ts")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            ms = F.unix_millis(F.col("ts").cast("timestamp"))
            late = F.count_if(ms < seen["newest_ms"] - idle) if idle is not None and seen.get("newest_ms") is not None else F.lit(0)
            now = lines.agg(F.count("*").alias("n"), F.max(ms).alias("newest"), late.alias("late")).first()
            newest = max((x for x in (now.newest, seen.get("newest_ms")) if x is not None), default=None)
            stats = {"lines": seen.get("lines", 0) + now.n, "late": seen.get("late", 0) + now.late, "newest_ms": newest}
            tails.commit(lines.select("run_id", "line_no", "line"), me, number)
            progress.commit(progress_rows(lines), me, number, stats)
        finally:
            lines.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, root: str) -> DataFrame | None:
    """Latest progress per run, at any time while the stream runs."""
    rows = progress_table(spark, root).read()
    return None if rows is None else rows.select("run_id", *PROGRESS_COLS, "last_line")


def errors(spark: SparkSession, root: str, exits: DataFrame | None = None, n: int = K.TAIL_LINES) -> DataFrame | None:
    """Error excerpt per (failed) run from its live tail."""
    rows = tail_table(spark, root, n).read()
    return None if rows is None else error_excerpt(rows, exits, n=n, failed_only=exits is not None)


def stats(spark: SparkSession, root: str) -> dict:
    """Lines read and lines that came late, so far."""
    held = progress_table(spark, root).manifest()["stats"]
    return {"lines": held.get("lines", 0), "late": held.get("late", 0)}


def run_live_once(spark: SparkSession, log: DataFrame, files_per_batch: int = 1000, watermark: str | None = None,
                  n: int = K.TAIL_LINES, **how) -> str:
    """Replay a run log, in the partitions it has, through one stream; returns the live tables' folder."""
    src, root = scratch_dir(spark, "live-src"), scratch_dir(spark, "live")
    log.select("run_id", "line_no", "ts", "line").write.parquet(src)
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(src)
    start_live(stream, root, scratch_dir(spark, "live-ckpt"), watermark=watermark, n=n, **how).awaitTermination()
    return root
