"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

# Settings that matter at any scale: AQE re-plans joins and coalesces
# partitions from runtime sizes, splits skewed shuffle partitions, and
# Arrow keeps the few Python steps batched.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HTML pages are large; Arrow batches are bounded by rows and by bytes so
    # a batch of pages stays far below executor memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "corpusmill",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def sizing_conf(input_bytes: int, target_partition_bytes: int = 256 << 20, expansion: float = 2.0,
                min_partitions: int = 200) -> dict:
    """Partition sizing for a cluster run.

    Scan splits and shuffle partitions aim at ``target_partition_bytes``
    (256 MB: fits executor memory with room for sort/aggregate buffers).
    The shuffle starts from enough partitions for the expanded data and AQE
    coalesces small ones at runtime; skewed partitions are split by AQE.
    For 100 TB of input this gives ~800k initial shuffle partitions.
    """
    n = max(min_partitions, int(input_bytes * expansion // target_partition_bytes) + 1)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the session's Arrow batches to ``rows`` rows where they are larger:
    whole texts make the default of 10,000 rows tens of megabytes, which the
    JVM and the Python worker of each task both hold."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session has none and runs on a ``local[...]`` master
    (tests) is a private folder made and registered, so that
    ``DataFrame.checkpoint()`` works there too; on a cluster a missing
    setting is an error, never a machine-local folder.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: no SparkContext on the client)
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
        if conf:
            sc.setCheckpointDir(conf)
            return sc.getCheckpointDir() or conf
    if conf:
        return conf
    master = ""
    try:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    except Exception:  # noqa: BLE001
        pass
    if master and not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster: written tables "
                           "and stream checkpoints must not go to a machine-local folder")
    local = tempfile.mkdtemp(prefix="corpusmill-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(local)
        return sc.getCheckpointDir() or local
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root for written tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/corpusmill-scratch/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (works on any store);
    without a JVM handle (Spark Connect) a metadata-only read decides. Errors
    of the store are raised, not taken for a missing path."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: no SparkContext on the client)
        try:
            spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
            return True
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return False
            raise
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jpath.getFileSystem(sc._jsc.hadoopConfiguration()).exists(jpath))


def local_path(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


__all__ = ["build_session", "checkpoint_root", "scratch_dir", "small_batches", "path_exists",
           "local_path", "sizing_conf", "DEFAULT_CONF"]
