"""Optimistic appends as plans: versions for new events and the check of expected versions, stream by stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conflict(expected: Column, actual: Column) -> Column:
    """-1 wants no stream, 0 anything, other numbers just that head."""
    return F.when(expected == -1, actual != 0).when(expected == 0, F.lit(False)).otherwise(actual != expected)


def checked(requests: DataFrame, head: DataFrame) -> DataFrame:
    """``requests`` (stream_id, expected_version, ...) with actual_version and conflict, from ``head`` (stream_id, version)."""
    joined = requests.join(head.select("stream_id", F.col("version").alias("_v")), "stream_id", "left")
    joined = joined.withColumn("actual_version", F.coalesce("_v", F.lit(0))).drop("_v")
    return joined.withColumn("conflict", conflict(F.col("expected_version"), F.col("actual_version")))


def numbered(batch: DataFrame, head: DataFrame) -> DataFrame:
    """``batch`` (stream_id, input_order, ...) with from_version and stream_version: heads plus 1, 2, 3 ... in input order."""
    joined = batch.join(head.select("stream_id", F.col("version").alias("_v")), "stream_id", "left")
    joined = joined.withColumn("from_version", (F.coalesce("_v", F.lit(0)) + 1).cast("int")).drop("_v")
    n = F.expr("row_number() OVER (PARTITION BY stream_id ORDER BY input_order)")
    return joined.withColumn("stream_version", (F.col("from_version") + n - 1).cast("int"))
