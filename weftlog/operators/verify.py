"""Verification of a log: contiguous versions, expected tokens, running balances, reconciliation, response contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contiguity(log: DataFrame) -> DataFrame:
    """(stream_id, events, last_version, contiguous): versions 1, 2, 3 ... without a gap or repeat; no sort is needed."""
    agg = log.groupBy("stream_id").agg(
        F.count("*").alias("events"), F.max("stream_version").alias("last_version"), F.min("stream_version").alias("_low"),
        F.count_distinct("stream_version").alias("_n"),
    )
    whole = (F.col("_low") == 1) & (F.col("last_version") == F.col("events")) & (F.col("_n") == F.col("events"))
    return agg.select("stream_id", "events", "last_version", whole.alias("contiguous"))


def gaps(log: DataFrame) -> DataFrame:
    """(stream_id, stream_version, expected): rows whose version does not follow the one before."""
    rows = log.selectExpr("stream_id", "stream_version", "coalesce(lag(stream_version) OVER (PARTITION BY stream_id ORDER BY stream_version), 0) + 1 AS expected")
    return rows.where("stream_version <> expected")


def token_errors(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """(token, problem): tokens that are missing, unexpected or seen more than once."""
    n = seen.groupBy("token").agg(F.count("*").alias("n"))
    both = expected.select("token").distinct().withColumn("_e", F.lit(True)).join(n, "token", "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return both.select("token", problem.alias("problem")).where("problem IS NOT NULL")


def reconcile(expected: DataFrame, actual: DataFrame, key: str, values: list[str], tolerance: float = 0.005) -> DataFrame:
    """(key, expected_*, actual_*, matches): full outer join of what should be and what is; a missing side does not match."""
    e = expected.select(key, *(F.col(v).alias(f"expected_{v}") for v in values))
    a = actual.select(key, *(F.col(v).alias(f"actual_{v}") for v in values))
    same: Column = F.lit(True)
    for v in values:
        same = same & (F.abs(F.col(f"expected_{v}") - F.col(f"actual_{v}")) <= tolerance)
    return e.join(a, key, "full_outer").withColumn("matches", F.coalesce(same, F.lit(False)))


def response_errors(responses: DataFrame) -> DataFrame:
    """Rows of (version, deposit_count, balance, deposit_total, events_appended) that break the contract of a response."""
    held = (F.col("version") >= F.col("deposit_count") + 1) & (F.col("balance") == F.col("deposit_total")) & (F.col("events_appended") <= 1)
    return responses.where(~F.coalesce(held, F.lit(False)))
