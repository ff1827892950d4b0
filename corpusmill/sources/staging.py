"""Sources staged one by one, each with its own commit.

Every chosen source (page sources of one folder together, as they share a
parse) is written to its own folder before the union. A source that fails, while
its plan is made or while it is read, costs neither the others nor its own
last complete version: that one is used in its place, as a cache.
"""

from __future__ import annotations

import logging
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators.combine import union_sources
from corpusmill.sources.registry import source_units

log = logging.getLogger(__name__)


def _versions(fs, Path, root: str) -> list[tuple[int, bool]]:
    """(version, complete) of the folders under ``root``, oldest first."""
    at = Path(root)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted((int(n[2:]), bool(fs.exists(Path(f"{root}/{n}/_SUCCESS")))) for n in names if n.startswith("v-") and n[2:].isdigit())


def stage(spark: SparkSession, root: str, build: Callable[[], DataFrame], keep: int = 2) -> tuple[DataFrame | None, str]:
    """Write ``build()`` under ``root`` as a new version and read it back:
    ("built"). When that fails, the newest complete version: "cached", or
    (None, "failed") where there is none. The last ``keep`` complete versions stay."""
    root = root.rstrip("/")
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = _versions(fs, Path, root)
    new = 1 + max((v for v, _ in found), default=0)
    state = "built"
    try:
        build().write.mode("errorifexists").parquet(f"{root}/v-{new}")
    except Exception as e:  # noqa: BLE001  (whatever a source raises, the others go on)
        log.warning("source at %s failed: %s", root, str(e)[:300])
        state = "cached"
    found = _versions(fs, Path, root)
    whole = [v for v, complete in found if complete]
    for v, complete in found:
        if not complete or v not in whole[-keep:]:
            fs.delete(Path(f"{root}/v-{v}"), True)
    if not whole:
        return None, "failed"
    return spark.read.parquet(f"{root}/v-{whole[-1]}"), state


def build_staged(spark: SparkSession, chosen: list[str], params: dict | None, root: str, to_pairs=None) -> tuple[DataFrame | None, dict[str, str]]:
    """Like ``registry.build_sources``, over staged sources; also the state of
    each. None where every source failed and none has a cache."""
    frames, states = [], {}
    for name, build in source_units(spark, chosen, params, to_pairs):
        df, states[name] = stage(spark, f"{root.rstrip('/')}/{name}", build)
        if df is not None:
            frames.append(df)
    return (union_sources(frames) if frames else None), states
