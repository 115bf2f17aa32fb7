"""The highest position below which no open transaction can still add a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def safe_watermark(log: DataFrame, xmin: int) -> DataFrame:
    """One row (watermark): one below the first position of a transaction from ``xmin`` on, else the last position, else 0.

    One pass with two map-side combined aggregates.
    """
    unsafe = F.min(F.when(F.col("txid") >= xmin, F.col("global_position"))) - 1
    return log.agg(F.coalesce(unsafe, F.max("global_position"), F.lit(0).cast("long")).alias("watermark"))
