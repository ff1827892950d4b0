"""Licence policy (F5) and the rejected-by-licence report.

The policy is a dimension table keyed by ``license_type``; its size is the
number of licence types (a handful), so it is broadcast: dealt out by licence
type, the texts of one type would be read by one task. A type listed twice
fails the job. Unknown licence types find no row: by default they pass, as in the collector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import constants as K
from corpusmill.operators.pairs import unique_keys

POLICY_SCHEMA = ("license_type string, scraping_allowed boolean, commercial_use boolean, "
                 "attribution_required boolean, share_alike boolean, citation_required boolean, "
                 "fair_use_summary_only boolean, years_before int, regions array<string>")

POLICY_ROWS = K.POLICY_ROWS


def policy_table(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or POLICY_ROWS, POLICY_SCHEMA)


def _joined(df: DataFrame, policy: DataFrame, license_col: str) -> DataFrame:
    p = policy.select(F.col("license_type").alias("_lt"), "scraping_allowed", "commercial_use")
    return df.join(F.broadcast(unique_keys(p, "_lt")), F.col(license_col) == F.col("_lt"), "left")


def license_filter(df: DataFrame, policy: DataFrame, license_col: str = "license_type",
                   commercial: bool = False, check: bool = True, unknown: str = "allow") -> DataFrame:
    """Drop rows whose licence forbids scraping, or forbids commercial use
    when the commercial mode is on. ``check=False`` keeps every row."""
    if not check:
        return df
    j = _joined(df, policy, license_col)
    ok = ~(F.col("scraping_allowed").eqNullSafe(F.lit(False)))
    if commercial:
        ok = ok & ~(F.col("commercial_use").eqNullSafe(F.lit(False)))
    if unknown == "deny":
        ok = ok & F.col("_lt").isNotNull()
    return j.where(ok).select(*df.columns)


def license_rejects(df: DataFrame, policy: DataFrame, license_col: str = "license_type",
                    commercial: bool = False, unknown: str = "allow",
                    by: str = "source") -> DataFrame:
    """Rejected rows per (source, reason): the warnings the collector logs."""
    j = _joined(df, policy, license_col)
    reason = F.when(F.col("scraping_allowed").eqNullSafe(F.lit(False)), F.lit("scraping_not_permitted"))
    if commercial:
        reason = reason.when(F.col("commercial_use").eqNullSafe(F.lit(False)), F.lit("commercial_use_prohibited"))
    if unknown == "deny":
        reason = reason.when(F.col("_lt").isNull(), F.lit("unknown_license"))
    return (j.select(F.col(by), reason.alias("reason"))
             .where(F.col("reason").isNotNull())
             .groupBy(by, "reason").agg(F.count(F.lit(1)).alias("n_rejected")))
