"""Event-backed snapshots: folds that start from the newest stored state, and when a state is stored."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlog.functions.validation import SNAPSHOT_SUFFIX


def bases(log: DataFrame, name: str, state: Column, tombstoned: Column | None = None) -> DataFrame:
    """(stream_id, base_version, base): each stream's newest snapshot ``name``, only that one; none if it is a tombstone."""
    rows = log.where(F.col("event_type") == f"{name}{SNAPSHOT_SUFFIX}")
    dead = F.lit(False) if tombstoned is None else tombstoned
    best = rows.groupBy("stream_id").agg(
        F.max_by(F.struct(F.col("stream_version").alias("v"), state.alias("s"), dead.alias("dead")), "stream_version").alias("b")
    )
    return best.where("NOT b.dead").select("stream_id", F.col("b.v").alias("base_version"), F.col("b.s").alias("base"))


def load(log: DataFrame, found: DataFrame, state: Mapping[str, Column], handled: Sequence[str]) -> DataFrame:
    """(stream_id, version, snapshot_version, replayed, *state): folds over the events after each stream's base.

    ``found`` is from :func:`bases`, ``base`` a struct that ``state``'s aggregates may read as column base (null where
    there is none). ``replayed`` counts handled events only; ``version`` is the last event's, else the base's.
    """
    joined = log.join(found, "stream_id", "left")
    fresh = joined.where(F.col("base_version").isNull() | (F.col("stream_version") >= F.col("base_version")))
    later = F.col("base_version").isNull() | (F.col("stream_version") > F.col("base_version"))
    hit = later & F.col("event_type").isin(list(handled))
    return fresh.withColumn("replayed", hit).groupBy("stream_id", "base_version").agg(
        F.max("stream_version").alias("version"), F.count_if("replayed").alias("replayed_events"), *(c.alias(k) for k, c in state.items())
    ).withColumnRenamed("base_version", "snapshot_version")


def stored_versions(log: DataFrame, handled: Sequence[str], every: int) -> DataFrame:
    """Where one-event appends with a snapshot every ``every`` handled events put each event: closed form, one window.

    Adds stored_version (snapshots before it shift it) and snapshot_after (a snapshot follows it); ``every`` under 1 stores
    none.
    """
    hit = F.col("event_type").isin(list(handled)).cast("int")
    rows = log.withColumn("_hit", hit).withColumn(
        "_upto", F.expr("sum(_hit) OVER (PARTITION BY stream_id ORDER BY stream_version ROWS UNBOUNDED PRECEDING)")
    )
    if every < 1:
        return rows.withColumns({"stored_version": F.col("stream_version"), "snapshot_after": F.lit(False)}).drop("_hit", "_upto")
    before = F.floor((F.col("_upto") - F.col("_hit")) / every)
    return rows.withColumns(
        {
            "stored_version": (F.col("stream_version") + before).cast("int"),
            "snapshot_after": (F.col("_hit") == 1) & (F.col("_upto") % every == 0),
        }
    ).drop("_hit", "_upto")


def batched_appends(appends: DataFrame, every: int) -> DataFrame:
    """``appends`` (stream_id, n, events, handled: one row for each append, n from 1) with first_version and snapshot_at.

    The counter of handled events starts anew after each snapshot, so that an append's outcome depends on all before it:
    one pass over each partition's rows in order, which holds one batch. snapshot_at is null where none is stored.
    """
    schema = T.StructType([*appends.schema.fields, T.StructField("first_version", T.LongType()), T.StructField("snapshot_at", T.LongType())])
    names = appends.columns
    at = [names.index(c) for c in ("stream_id", "events", "handled")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, head, seen = None, 0, 0
        for b in batches:
            first, stored = [], []
            for name, events, handled in zip(*(b.column(k).to_pylist() for k in at)):
                if name != stream:
                    stream, head, seen = name, 0, 0
                first.append(head + 1)
                head, seen = head + events, seen + handled
                due = handled > 0 and every > 0 and seen >= every
                if due:
                    head, seen = head + 1, 0
                stored.append(head if due else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first, pa.int64()), pa.array(stored, pa.int64())], schema.names)

    return appends.repartition("stream_id").sortWithinPartitions("stream_id", "n").mapInArrow(run, schema)


def carried(log: DataFrame, name: str, state: Column) -> DataFrame:
    """``log`` with snapshot_version and snapshot of each row's stream: the newest snapshot ``name`` up to the row; null before any."""
    own = F.col("event_type") == f"{name}{SNAPSHOT_SUFFIX}"
    rows = log.withColumn("_s", F.when(own, F.struct(F.col("stream_version").alias("v"), state.alias("s"))))
    last = F.expr("last_value(_s) IGNORE NULLS OVER (PARTITION BY stream_id ORDER BY stream_version ROWS UNBOUNDED PRECEDING)")
    return rows.withColumn("_l", last).withColumns({"snapshot_version": F.col("_l.v"), "snapshot": F.col("_l.s")}).drop("_s", "_l")
