"""Stateful tracking of when a snapshot is due: a counter of handled events for each stream that a snapshot resets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def due_snapshots(events: DataFrame, handled: Sequence[str], every: int) -> DataFrame:
    """(stream_id, stream_version, seen): the events of a stream of ``events`` after which a snapshot is due.

    State is one number for each stream. A micro-batch's events of a stream are sorted by version before they count.
    """

    def track(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        versions = sorted(v for f in frames for v in f.stream_version.tolist())
        seen, out = (state.get[0] if state.exists else 0), []
        for v in versions:
            seen += 1
            if every > 0 and seen >= every:
                out.append((key[0], v, seen))
                seen = 0
        state.update((seen,))
        yield pd.DataFrame(out, columns=["stream_id", "stream_version", "seen"])

    wanted = events.where(F.col("event_type").isin(list(handled))).select("stream_id", "stream_version")
    return wanted.groupBy("stream_id").applyInPandasWithState(
        track, "stream_id string, stream_version int, seen int", "seen int", "append", GroupStateTimeout.NoTimeout
    )
