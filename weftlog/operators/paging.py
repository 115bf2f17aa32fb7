"""Pages over several streams that stay the same while the log grows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from weftlog.functions.codecs import decode_cursor, encode_cursor
from weftlog.functions.filters import after_key, visible
from weftlog.functions.validation import page_options

#: Allow-lists up to this size are a predicate that the scan sees; longer ones are joined.
_INLINE = 1000


def page_rows(log: DataFrame, stream_ids: Sequence[str], limit: int, order: str = "asc", after: tuple[int, str, str] | None = None, commit_id: int | None = None, watermark: int | None = None) -> DataFrame:
    """``limit`` rows of the streams by position, after (or before) a key, as of a commit and a position.

    One top-k over the filtered scan: each task keeps its best ``limit``, so no stream is sorted.
    """
    down = order == "desc"
    if len(stream_ids) <= _INLINE:
        rows = log.where(F.col("stream_id").isin(list(stream_ids)))
    else:
        wanted = log.sparkSession.createDataFrame([(s,) for s in stream_ids], "stream_id string")
        rows = log.join(wanted, "stream_id", "left_semi")
    if commit_id is not None:
        rows = rows.where(visible(commit_id))
    if watermark is not None:
        rows = rows.where(F.col("global_position") <= watermark)
    if after is not None:
        rows = rows.where(after_key(*after, descending=down))
    keys = ("global_position", "stream_id", "id")
    return rows.orderBy(*(F.desc(k) if down else F.asc(k) for k in keys)).limit(limit)


@dataclass(frozen=True)
class Page:
    events: list[Row]
    has_next_page: bool
    next_cursor: str | None


def read_page(log: DataFrame, stream_ids: Sequence[str], limit: int, cursor: str | None = None, order: str = "asc", commit_id: int = 0, watermark: int | None = None) -> Page:
    """A page and the cursor of the next. The first page pins ``commit_id`` and the watermark; later ones reuse the cursor's.

    ``log`` may hold later commits: what they added stays out of the pages of an older cursor.
    """
    page_options(stream_ids, limit, cursor, order)
    ids, after = list(stream_ids), None
    if cursor is not None:
        at = decode_cursor(cursor, order, ids)
        commit_id, watermark = at["commitId"], at["watermark"]
        after = (at["globalPosition"], at["streamId"], at["eventId"])
    if not ids:
        return Page([], False, None)
    if watermark is None:
        watermark = log.where(visible(commit_id)).agg(F.coalesce(F.max("global_position"), F.lit(0)).alias("w")).first().w
    rows = page_rows(log, ids, limit + 1, order, after, commit_id, watermark).collect()
    events, more = rows[:limit], len(rows) > limit
    last = events[-1] if events else None
    following = encode_cursor(order, ids, commit_id, watermark, last.global_position, last.stream_id, last.id) if more and last else None
    return Page(events, more, following)
