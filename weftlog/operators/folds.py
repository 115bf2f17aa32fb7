"""Ordered folds: each stream's state rebuilt from its events in version order.

Three ways, from the fastest: algebraic (the state is a set of aggregates, combined map-side), by expressions (a fold in the
JVM over a stream's events, one stream in memory at a time) and by Python functions (one group in a worker).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(value: Column, event_types: Sequence[str], sign: int = 1) -> Column:
    """Sum of ``value`` over events of some types; 0 without any."""
    return F.coalesce(F.sum(F.when(F.col("event_type").isin(list(event_types)), value * sign)), F.lit(0.0))


def last(value: Column, event_types: Sequence[str]) -> Column:
    """``value`` of the newest event of some types."""
    return F.max_by(value, F.when(F.col("event_type").isin(list(event_types)), F.col("stream_version")))


def handled(event_types: Sequence[str]) -> Column:
    return F.count_if(F.col("event_type").isin(list(event_types)))


def algebraic(log: DataFrame, state: Mapping[str, Column], up_to: Column | None = None) -> DataFrame:
    """(stream_id, version, *state): every stream at once, by aggregates that commute or pick by version.

    ``version`` is the last event's, handled or not. ``up_to`` cuts the streams first: state as of a version or position.
    """
    rows = log if up_to is None else log.where(up_to)
    return rows.groupBy("stream_id").agg(F.max("stream_version").alias("version"), *(c.alias(k) for k, c in state.items()))


def by_expression(log: DataFrame, initial: Column, evolve: Mapping[str, Callable[[Column, Column], Column]], event: Sequence[str]) -> DataFrame:
    """(stream_id, version, state): a left fold in version order; ``evolve`` maps a type to (state, event) -> state.

    ``initial`` fixes the state's type; ``event`` names the columns that events carry. Types without a function leave the
    state as it is. A stream's events are gathered in one row: streams of more than some 10^5 events want :func:`algebraic`.
    """
    fields = [F.col("stream_version"), F.col("event_type"), *(F.col(c) for c in event)]
    events = F.array_sort(F.collect_list(F.struct(*fields)))

    def step(state: Column, e: Column) -> Column:
        out = None
        for kind, change in evolve.items():
            hit = e["event_type"] == kind
            out = F.when(hit, change(state, e)) if out is None else out.when(hit, change(state, e))
        return state if out is None else out.otherwise(state)

    gathered = log.groupBy("stream_id").agg(F.max("stream_version").alias("version"), events.alias("_events"))
    return gathered.select("stream_id", "version", F.aggregate("_events", initial, step).alias("state"))


def by_function(log: DataFrame, initial: Any, evolve: Mapping[str, Callable[[Any, Mapping[str, Any]], Any]], schema: str, event: Sequence[str]) -> DataFrame:
    """(stream_id, version, *schema): the same with Python functions on one stream's rows, sorted, in a worker.

    ``schema``: DDL of the state's fields; a state is a mapping, or None for a stream without a handled event.
    """
    names = [f.split()[0] for f in schema.split(",")]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        state = initial
        rows = rows.sort_values("stream_version")
        for e in rows.to_dict("records"):
            if change := evolve.get(e["event_type"]):
                state = change(state, e)
        flat = {n: [None if state is None else state.get(n)] for n in names}
        return pd.DataFrame({"stream_id": [rows.stream_id.iloc[0]], "version": [rows.stream_version.max()], **flat})

    wanted = log.select("stream_id", "stream_version", "event_type", *event)
    return wanted.groupBy("stream_id").applyInPandas(fold, f"stream_id string, version int, {schema}")


def running(log: DataFrame, change: Column, name: str = "balance") -> DataFrame:
    """``log`` with the running total of ``change`` in each stream up to each event."""
    out = log.withColumn("_change", change)
    return out.withColumn(name, F.expr("sum(_change) OVER (PARTITION BY stream_id ORDER BY stream_version ROWS UNBOUNDED PRECEDING)")).drop("_change")
