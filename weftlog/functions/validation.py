"""Checks of arguments, on the driver, before any plan is built.

The reasons that refusals state are fixed values: callers may compare them.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from weftlog.functions.errors import InvalidArgumentError, InvalidSchemaNameError, ReservedSnapshotEventTypeError

MAX_READ_EVENTS_PAGE_LIMIT = 1000
SNAPSHOT_SUFFIX = "Snapshot"
_LARGEST = 2**53 - 1
_DECIMAL = re.compile(r"0|[1-9][0-9]*")
_NAME = re.compile(r"[a-z_][a-z0-9_]{0,62}")
# Steps that no path of an encrypted field may have.
_UNSAFE = {"", "__proto__", "constructor", "prototype"}


def _integer(value: Any, least: int) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and least <= value <= _LARGEST


def _text(value: Any) -> bool:
    return isinstance(value, str) and value != ""


def require(held: bool, argument: str, reason: str) -> None:
    if not held:
        raise InvalidArgumentError(argument, reason)


def schema_name(name: str) -> str:
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise InvalidSchemaNameError(str(name))
    return name


def positive(value: Any, argument: str) -> None:
    require(_integer(value, 1), argument, "must be a positive safe integer")


def not_negative(value: Any, argument: str) -> None:
    require(_integer(value, 0), argument, "must be a non-negative safe integer")


def texts(value: Any, argument: str, distinct: bool = False) -> None:
    listed = isinstance(value, Sequence) and not isinstance(value, str)
    require(listed and all(map(_text, value)), argument, "must be a list of non-empty strings")
    require(not distinct or len(set(value)) == len(value), argument, "must not contain duplicates")


def is_decimal(value: Any) -> bool:
    return isinstance(value, str) and bool(_DECIMAL.fullmatch(value))


def is_snapshot_type(event_type: str) -> bool:
    return event_type.endswith(SNAPSHOT_SUFFIX)


def reserved_types(event_types: Sequence[str], snapshots: bool) -> None:
    """Callers may append everything but snapshots, snapshots nothing else."""
    for t in event_types:
        if is_snapshot_type(t) != snapshots:
            raise ReservedSnapshotEventTypeError(t)


def append_input(given: Any) -> None:
    """``given``: stream_id, expected_version, events (type, data, and at will source, extensions, encrypted_fields,
    crypto_key_id, schema_version) and at will outbox_topics."""
    require(isinstance(given, Mapping), "input", "must be a mapping")
    require(_text(given.get("stream_id")), "stream_id", "must be a non-empty string")
    require(_integer(given.get("expected_version"), -1), "expected_version", "must be -1, 0 or a positive safe integer")
    events = given.get("events")
    require(isinstance(events, Sequence) and not isinstance(events, str), "events", "must be a list")
    for e in events:
        event_input(e)
    if given.get("outbox_topics") is not None:
        texts(given["outbox_topics"], "outbox_topics", distinct=True)


def event_input(e: Any) -> None:
    require(isinstance(e, Mapping) and _text(e.get("type")), "events[].type", "must be a non-empty string")
    if e.get("schema_version") is not None:
        require(_integer(e["schema_version"], 1), "events[].schema_version", "must be a positive safe integer")
    if e.get("source") is not None:
        require(_text(e["source"]), "events[].source", "must be a non-empty string")
    fields = e.get("encrypted_fields")
    if fields is not None:
        texts(fields, "events[].encrypted_fields")
        require(not fields or isinstance(e.get("data"), Mapping), "events[].data", "must be an object when encrypted_fields are configured")


def page_options(stream_ids: Any, limit: Any, cursor: Any, order: Any) -> None:
    texts(stream_ids, "stream_ids", distinct=True)
    positive(limit, "limit")
    require(limit <= MAX_READ_EVENTS_PAGE_LIMIT, "limit", f"must not exceed {MAX_READ_EVENTS_PAGE_LIMIT}")
    require(order in ("asc", "desc"), "order", 'must be "asc" or "desc"')
    require(cursor is None or _text(cursor), "cursor", "must be a non-empty string")


def subscribe_options(subject: Any = None, recursive: Any = None, event_types: Any = None, lower_bound: Any = None, batch_size: Any = None, poll_interval_ms: Any = None) -> None:
    require(subject is None or _text(subject), "subject", "must be a non-empty string")
    require(recursive is None or isinstance(recursive, bool), "recursive", "must be a boolean")
    if event_types is not None:
        texts(event_types, "event_types")
    if batch_size is not None:
        positive(batch_size, "batch_size")
    if poll_interval_ms is not None:
        not_negative(poll_interval_ms, "poll_interval_ms")
    if lower_bound is not None:
        held = isinstance(lower_bound, Mapping) and is_decimal(lower_bound.get("id"))
        require(held, "lower_bound.id", "must be a non-negative integer string")
        kind = lower_bound.get("type", "exclusive")
        require(kind in ("exclusive", "inclusive"), "lower_bound.type", 'must be "exclusive" or "inclusive"')


def event_map(events: Any) -> None:
    """A definition's event types: a non-empty mapping with string keys."""
    held = isinstance(events, Mapping) and len(events) > 0 and all(map(_text, events))
    require(held, "events", "must be a non-empty mapping from event types")


def encrypted_paths(fields: Sequence[str]) -> None:
    """Distinct dot paths of safe steps, none inside another."""
    seen: list[list[str]] = []
    for path in fields:
        steps = path.split(".")
        require(not any(s in _UNSAFE for s in steps), "encrypted_fields", f'has an unsafe path "{path}"')
        for other in seen:
            short = min(len(other), len(steps))
            require(other[:short] != steps[:short], "encrypted_fields", f'has overlapping paths at "{path}"')
        seen.append(steps)
