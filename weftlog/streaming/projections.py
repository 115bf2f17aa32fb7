"""Read models from streams of events, exactly once.

A micro-batch's part of a read model is written under its batch number, in place of what an earlier try of the same batch
left; the model is the merge of the parts, and of what was merged before. So a restart from the checkpoint repeats a batch without counting it twice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftlog.functions import filters
from weftlog.sources.commitlog import Files


def dispatched(events: DataFrame, prefix: str, handlers: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Rows of each type through its function, united; other prefixes and types are passed over.

    A function gets entity_id, stream_id, global_position, stream_version, created_at and data; all return one schema.
    """
    base = events.where(filters.in_prefix(prefix)).withColumn("entity_id", filters.entity_id(prefix))
    out = None
    for kind, handler in handlers.items():
        part = handler(base.where(F.col("event_type") == kind))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no handlers")
    return out


def materialise(
    events: DataFrame, part: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: Mapping[str, Any] | None = None, merge: tuple[Sequence[str], Sequence[Column]] | None = None, every: int = 50
) -> StreamingQuery:
    """Start writing ``part`` of each micro-batch under ``path``; by default until what is there now is done.

    With ``merge`` (keys and columns, as for :func:`read_model`) the parts of finished batches become one every so many
    batches, so that a model that has run for long is read from few files.
    """

    def write(batch: DataFrame, number: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if merge is not None and number and number % every == 0:
            merge_parts(batch.sparkSession, path, *merge, upto=number - 1)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _parts(spark: SparkSession, path: str) -> tuple[Files, list[str], list[str]]:
    """(files, what the model is read from, what a merge has made superfluous): the last whole merge and the batches after it."""
    files = Files(spark, path)
    numbers: dict[str, list[int]] = {"batch": [], "merged": []}
    for name in files.names("."):
        kind, _, n = name.partition("=")
        if kind in numbers and n.isdigit() and (kind == "batch" or files.exists(f"{name}/_SUCCESS")):
            numbers[kind].append(int(n))
    last = max(numbers["merged"], default=-1)
    live = [f"merged={last}"] * (last >= 0) + [f"batch={n}" for n in sorted(numbers["batch"]) if n > last]
    return files, live, [f"merged={n}" for n in numbers["merged"] if n < last] + [f"batch={n}" for n in numbers["batch"] if n <= last]


def merge_parts(spark: SparkSession, path: str, keys: Sequence[str], merge: Sequence[Column], upto: int) -> None:
    """Make one part of all up to a batch, all of them finished; what it replaces is deleted. Again is the same."""
    files, live, _ = _parts(spark, path)
    old = [f for f in live if int(f.partition("=")[2]) <= upto]
    if len(old) > 1:
        _merged(spark, files, old, keys, merge).write.mode("overwrite").parquet(files.at(f"merged={upto}"))
    files, _, dead = _parts(spark, path)
    for f in dead:
        files.delete(f)


def _merged(spark: SparkSession, files: Files, parts: Sequence[str], keys: Sequence[str], merge: Sequence[Column]) -> DataFrame:
    return spark.read.parquet(*map(files.at, parts)).groupBy(*keys).agg(*merge)


def read_model(spark: SparkSession, path: str, keys: Sequence[str], merge: Sequence[Column]) -> DataFrame:
    """The parts merged by key; ``merge`` names its results like the columns of the parts, so that a merge can be merged again."""
    files, live, _ = _parts(spark, path)
    return _merged(spark, files, live, keys, merge)
