"""Encodings: page cursors, strict base64, big-endian numbers, timestamps, 32-bit mixing, JSON paths."""

from __future__ import annotations

import base64
import binascii
import copy
import json
import struct
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlog.functions.errors import InvalidArgumentError
from weftlog.functions.validation import is_decimal


def encode_cursor(order: str, stream_ids: list[str], commit_id: int, watermark: int, position: int, stream_id: str, event_id: str) -> str:
    """An opaque page cursor: base64url of JSON; positions are decimal strings, exact beyond 2^53."""
    body = {
        "v": 1, "order": order, "streamIds": sorted(stream_ids), "commitId": str(commit_id), "watermark": str(watermark),
        "globalPosition": str(position), "streamId": stream_id, "eventId": event_id,
    }
    return base64.urlsafe_b64encode(json.dumps(body).encode()).rstrip(b"=").decode()


def decode_cursor(cursor: str, order: str, stream_ids: list[str]) -> dict[str, Any]:
    """The cursor's fields, numbers as int; refused if malformed or of another request."""
    try:
        raw = base64.b64decode(cursor.encode() + b"=" * (-len(cursor) % 4), altchars=b"-_", validate=True)
        body = json.loads(raw)
    except (ValueError, binascii.Error, UnicodeError):
        raise InvalidArgumentError("cursor", "must be a cursor of this store") from None
    numbers = ("commitId", "watermark", "globalPosition")
    held = (
        isinstance(body, dict)
        and body.get("v") == 1
        and body.get("order") in ("asc", "desc")
        and isinstance(ids := body.get("streamIds"), list)
        and all(isinstance(x, str) and x for x in ids)
        and len(set(ids)) == len(ids)
        and all(is_decimal(body.get(k)) for k in numbers)
        and all(isinstance(body.get(k), str) and body[k] for k in ("streamId", "eventId"))
    )
    if not held:
        raise InvalidArgumentError("cursor", "must be a cursor of this store")
    if body["order"] != order or set(ids) != set(stream_ids):
        raise InvalidArgumentError("cursor", "does not match stream_ids and order of the first request")
    return body | {k: int(body[k]) for k in numbers}


def strict_base64(text: str, length: int | None = None) -> bytes:
    """Bytes of canonical base64 only: what they encode to must be the text."""
    try:
        raw = base64.b64decode(text, validate=True)
    except (ValueError, TypeError):
        raise ValueError("not base64") from None
    if base64.b64encode(raw).decode() != text or length is not None and len(raw) != length:
        raise ValueError("not canonical base64 of the right length")
    return raw


def unbase64_strict(text: Column, length: int | None = None) -> Column:
    """The same for a column: what is not canonical, or not of the length, fails the plan; null stays null."""
    raw = F.try_to_binary(text, F.lit("base64"))
    held = F.coalesce(F.base64(raw) == text, F.lit(False))
    if length is not None:
        held = held & (F.octet_length(raw) == length)
    return F.when(text.isNull(), F.lit(None).cast("binary")).when(held, raw).otherwise(F.raise_error(F.lit("not canonical base64 of the right length")).cast("binary"))


def bound(*parts: Column) -> Column:
    """Texts as one binary value that no other texts give: each as its length in bytes, a colon and itself."""
    return F.concat(*(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts)).cast("binary")


def bound_value(*parts: str) -> bytes:
    """The same for values."""
    return b"".join(b"%d:%s" % (len(b), b) for b in (p.encode() for p in parts))


def uint32(number: int) -> bytes:
    return struct.pack(">I", number)


def read_uint32(column: Column, start: int) -> Column:
    """The big-endian unsigned 32-bit number at byte ``start`` (from 1) of a binary column."""
    return F.conv(F.hex(F.substring(column, start, 4)), 16, 10).cast("long")


def iso_ms(column: Column) -> Column:
    """ISO-8601 in UTC with milliseconds."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _imul(a: Column, b: int) -> Column:
    """The low 32 bits of a product of unsigned 32-bit numbers, by halves, so that no long overflows."""
    low, high = a.bitwiseAND(0xFFFF), F.shiftright(a, 16).bitwiseAND(0xFFFF)
    return (low * b + F.shiftleft((high * b).bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFFFFFF)


def mix32(value: Column, rounds: tuple[tuple[int, int], ...]) -> Column:
    """A 32-bit integer hash, as a signed number in a long: each round multiplies and folds the high bits down."""
    x = value.cast("long").bitwiseAND(0xFFFFFFFF)
    for factor, shift in rounds:
        x = _imul(x, factor)
        x = x.bitwiseXOR(F.shiftright(x, shift))
    return F.when(x >= 2**31, x - 2**32).otherwise(x)


# JSON text by dot path, as columns: the same rules as for values, below. Objects keep their other keys, numbers their value.


def _object(json_: Column) -> Column:
    return F.from_json(F.when(F.substring(F.ltrim(json_), 1, 1) == "{", json_), "map<string,variant>")


def _list(json_: Column) -> Column:
    return F.from_json(F.when(F.substring(F.ltrim(json_), 1, 1) == "[", json_), "array<variant>")


def _place(step: Column) -> Column:
    """The index from 0 that a step of a path means in a list; null if it is no number."""
    return F.when(F.rlike(step, F.lit("^[0-9]{1,9}$")), step.cast("int"))


def _steps(path: str | Column) -> Column:
    return F.split(F.lit(path) if isinstance(path, str) else path, F.lit("[.]"))


def json_get(json_: Column, path: str | Column) -> Column:
    """The JSON text of what is at a dot path: own keys of objects, and elements of lists by number; null if there is nothing."""

    def inner(at: Column, step: Column) -> Column:
        of_list = F.get(_list(at), _place(step))
        return F.coalesce(F.to_json(F.element_at(_object(at), step)), F.to_json(of_list))

    return F.aggregate(_steps(path), json_, inner)


def json_delete(json_: Column, path: str) -> Column:
    """JSON text without what is at the path; its parent stays, if need be empty. List elements become null."""
    return _changed(json_, path.split("."), None)


def json_set(json_: Column, path: str | Column, value: Column) -> Column:
    """JSON text with a value (JSON text) at the path; parents that are no objects are replaced, list elements set by number.

    A column of paths takes each path apart row by row: from the innermost object outwards.
    """
    if isinstance(path, str):
        return _changed(json_, path.split("."), value)
    steps = _steps(path)
    depth = F.size(steps)
    parents = F.transform(F.sequence(F.lit(0), depth - 1), lambda k: F.when(k == 0, json_).otherwise(json_get(json_, F.array_join(F.slice(steps, 1, k), "."))))
    pairs = F.reverse(F.arrays_zip(parents.alias("p"), steps.alias("s")))
    return F.aggregate(pairs, value, lambda new, x: _put(x["p"], x["s"], new))


def _changed(json_: Column, steps: list[str], value: Column | None) -> Column:
    step, rest = F.lit(steps[0]), steps[1:]
    if not rest:
        return _put(json_, step, value) if value is not None else _without(json_, step)
    at = json_get(json_, steps[0])
    inner = _changed(at, rest, value)
    # A delete changes nothing where there is no such parent.
    return _put(json_, step, inner) if value is not None else F.when(at.isNull(), json_).otherwise(_put(json_, step, inner))


def _put(json_: Column, step: Column, value: Column) -> Column:
    new = F.parse_json(value)
    items, place = _list(json_), _place(step)
    of_list = F.to_json(F.transform(items, lambda v, k: F.when(k == place, new).otherwise(v)))
    fits = F.coalesce(place < F.size(items), F.lit(False))
    held = F.coalesce(_object(json_), F.create_map().cast("map<string,variant>"))
    of_object = F.to_json(F.map_concat(F.map_filter(held, lambda k, v: k != step), F.create_map(step, new)))
    refused = F.raise_error(F.concat(F.lit("no element "), step, F.lit(" in a list"))).cast("string")
    return F.when(items.isNull(), of_object).when(fits, of_list).otherwise(refused)


def _without(json_: Column, step: Column) -> Column:
    items, place = _list(json_), _place(step)
    nothing = F.parse_json(F.lit("null"))
    of_list = F.to_json(F.transform(items, lambda v, k: F.when(k == place, nothing).otherwise(v)))
    return F.coalesce(F.to_json(F.map_filter(_object(json_), lambda k, v: k != step)), of_list, json_)


def get_path(data: Any, path: str) -> tuple[bool, Any]:
    """(found, value) at a dot path: own keys of objects, and elements of lists by number."""
    for step in path.split("."):
        if isinstance(data, dict) and step in data:
            data = data[step]
        elif isinstance(data, list) and step.isdigit() and int(step) < len(data):
            data = data[int(step)]
        else:
            return False, None
    return True, data


def set_path(data: Any, path: str, value: Any) -> Any:
    """A copy of ``data`` with ``value`` at the path; parents that are no objects are replaced, list elements set by number."""
    out = copy.deepcopy(data) if isinstance(data, (dict, list)) else {}
    at, steps = out, path.split(".")
    for k, step in enumerate(steps):
        key: Any = int(step) if isinstance(at, list) and step.isdigit() and int(step) < len(at) else step
        if isinstance(at, list) and isinstance(key, str):
            raise ValueError(f"no element {step!r} in a list")
        if k + 1 == len(steps):
            at[key] = value
        else:
            inner = at[key] if isinstance(key, int) else at.get(key)
            if not isinstance(inner, (dict, list)):
                inner = at[key] = {}
            at = inner
    return out


def delete_path(data: Any, path: str) -> Any:
    """A copy of ``data`` without what is at the path; its parent stays, if need be empty. List elements become null."""
    out = copy.deepcopy(data)
    *parents, last = path.split(".")
    found, parent = get_path(out, ".".join(parents)) if parents else (True, out)
    if found and isinstance(parent, dict):
        parent.pop(last, None)
    elif found and isinstance(parent, list) and last.isdigit() and int(last) < len(parent):
        parent[int(last)] = None
    return out
