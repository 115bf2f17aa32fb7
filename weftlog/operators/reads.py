"""Reads of the log: by stream, by position, the newest of a type, heads and stream names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.functions.validation import SNAPSHOT_SUFFIX


def stream(log: DataFrame, stream_id: str, from_version: int = 1, max_events: int | None = None) -> DataFrame:
    """One stream's rows from a version on, in version order; none if there is no such stream."""
    rows = log.where((F.col("stream_id") == stream_id) & (F.col("stream_version") >= from_version)).orderBy("stream_version")
    return rows if max_events is None else rows.limit(max_events)


def domain_events(log: DataFrame, stream_id: str, max_events: int | None = None) -> DataFrame:
    """As :func:`stream` without snapshot rows; the limit holds before they are left out, so fewer may come."""
    return stream(log, stream_id, 1, max_events).where(~F.col("event_type").endswith(SNAPSHOT_SUFFIX))


def latest_of_type(log: DataFrame, event_type: str | None = None, stream_id: str | None = None) -> DataFrame:
    """The row of highest version for each stream and type: one map-side combined maximum, no sort."""
    rows = log
    if event_type is not None:
        rows = rows.where(F.col("event_type") == event_type)
    if stream_id is not None:
        rows = rows.where(F.col("stream_id") == stream_id)
    keys = ["stream_id", "event_type"]
    rest = [c for c in log.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "stream_version").alias("_row"))
    return best.select(*keys, "_row.*").select(*log.columns)


def top_of_streams(log: DataFrame, limit: int, descending: bool = True, after: int | None = None) -> DataFrame:
    """Each stream's ``limit`` newest rows (or oldest), after a version if one is given: tasks cut their own rows before the
    shuffle (a limit of the rank)."""
    rows = log if after is None else log.where(F.col("stream_version") > after)
    order = "stream_version DESC" if descending else "stream_version"
    return rows.selectExpr("*", f"row_number() OVER (PARTITION BY stream_id ORDER BY {order}) AS _r").where(F.col("_r") <= limit).drop("_r")


def heads(log: DataFrame) -> DataFrame:
    """(stream_id, version, events) of every stream."""
    return log.groupBy("stream_id").agg(F.max("stream_version").alias("version"), F.count("*").alias("events"))


def head(log: DataFrame, stream_id: str) -> DataFrame:
    """One row: the stream's highest version, 0 if there is none."""
    return log.where(F.col("stream_id") == stream_id).agg(F.coalesce(F.max("stream_version"), F.lit(0)).alias("version"))


def streams(log: DataFrame, prefix: str = "", limit: int = 100) -> DataFrame:
    """The last ``limit`` stream names, descending; % and _ in a prefix are wildcards, and no prefix means all."""
    names = log.select("stream_id")
    if prefix:
        names = names.where(F.col("stream_id").like(f"{prefix}-%"))
    return names.distinct().orderBy(F.desc("stream_id")).limit(limit)


def after_position(log: DataFrame, position: int, watermark: int | None = None, predicate: Column | None = None, limit: int | None = None) -> DataFrame:
    """Rows after a position up to a watermark, in position order: a range that row groups are skipped by."""
    rows = log.where(F.col("global_position") > position)
    if watermark is not None:
        rows = rows.where(F.col("global_position") <= watermark)
    if predicate is not None:
        rows = rows.where(predicate)
    rows = rows.orderBy("global_position")
    return rows if limit is None else rows.limit(limit)


