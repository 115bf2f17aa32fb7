"""Predicates and keys of the log as Columns, all of which reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlog.functions.validation import SNAPSHOT_SUFFIX


def all_of(predicates: Iterable[Column]) -> Column:
    """The conjunction; true if there are none."""
    return reduce(and_, predicates, F.lit(True)) if (predicates := list(predicates)) else F.lit(True)


def subject_is(subject: str, recursive: bool = False) -> Column:
    """Exactly this subject, or everything that begins with it: a literal prefix, in which % and _ mean themselves."""
    return F.col("subject").startswith(subject) if recursive else F.col("subject") == subject


def type_in(event_types: Sequence[str] | None) -> Column | None:
    """No predicate for an empty list."""
    return F.col("event_type").isin(list(event_types)) if event_types else None


def start_position(lower_bound: Mapping[str, str] | None) -> int:
    """The position after which a subscription begins."""
    if not lower_bound:
        return 0
    return int(lower_bound["id"]) - (lower_bound.get("type", "exclusive") == "inclusive")


def subscription(subject: str | None = None, recursive: bool = False, event_types: Sequence[str] | None = None) -> Column:
    parts = [subject_is(subject, recursive)] if subject else []
    return all_of(parts + [p for p in (type_in(event_types),) if p is not None])


def in_prefix(prefix: str) -> Column:
    return F.col("stream_id").startswith(f"{prefix}-")


def entity_id(prefix: str) -> Column:
    """What follows the prefix and its hyphen; the id may hold hyphens itself."""
    return F.expr(f"substring(stream_id, {len(prefix) + 2})")


def stream_id(prefix: str, entity: str) -> str:
    return f"{prefix}-{entity}"


def is_snapshot(column: str = "event_type") -> Column:
    return F.col(column).endswith(SNAPSHOT_SUFFIX)


def after_key(position: int, stream: str, event: str, descending: bool = False) -> Column:
    """Rows after (or before) a (global_position, stream_id, id) key. The position alone is a range that files are skipped by."""
    key = F.struct("global_position", "stream_id", "id")
    at = F.struct(F.lit(position).cast("long").alias("global_position"), F.lit(stream).alias("stream_id"), F.lit(event).alias("id"))
    if descending:
        return (F.col("global_position") <= position) & (key < at)
    return (F.col("global_position") >= position) & (key > at)


def visible(commit_id: int, in_flight: Sequence[int] = ()) -> Column:
    """Rows of commits up to ``commit_id`` that were not open when it was taken."""
    seen = F.col("txid") <= commit_id
    return seen & ~F.col("txid").isin(list(in_flight)) if in_flight else seen
