"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Executors tokenise whole texts and cut only documents longer than a sequence. What the packer needs of them is a
histogram of piece lengths (at most one row per length), so the driver packs the whole corpus at once whatever its
size: a bin is filled greedily, then its smallest document gives way to two unpacked ones where these fit the
expanded gap more tightly; the bin so found is repeated as often as the histogram allows. Executors then look up
each piece's place from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm.common import with_fields, written

LENGTH = 4096
END = 1
#: Parts whose ids a worker remembers; beyond it starts anew.
_REMEMBER = 600_000
_LONGEST = 64
#: Parts of a text that are encoded together.
_RUN = 1 << 16
#: Pieces of one length that are ranked together.
_RANKED = 4096


# Fixed values of the known kind of file: its pre-tokenizer's pattern, and the bytes that stand for themselves.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
# Letters and marks for which that pattern, NFC and lower case need no Unicode tables (no dotted capital I).
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_MARKS = r"!-/:-@\[-`{-~¡¿«»§©®°·£\u2010-\u2027€"


def _byte_chars() -> dict[int, str]:
    rest = [b for b in range(256) if b not in _PLAIN]
    return {b: chr(b) for b in _PLAIN} | {b: chr(256 + k) for k, b in enumerate(rest)}


class TextIds:
    """Token ids of texts, part by part of the pre-tokenizer; ids of short parts are remembered, up to a bound.

    Where the file's normalizer and pre-tokenizer are the known ones and a text has only Latin letters, ASCII digits and
    common marks, its parts are found by a regular expression and go to the BPE model. Any other text goes to the whole
    tokenizer, as every text does with other files.
    """

    odd = re.compile(rf"[^ \t-\r0-9{_LETTERS}{_MARKS}]").search
    split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[{_MARKS}]+").findall

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.chars = self.tokenizer.model, _byte_chars()
        how = json.loads(self.tokenizer.to_str())
        pre = (how["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.known_kind = (
            [x["type"] for x in (how["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"].get("Regex") == _SPLIT
            and all(x["content"].startswith("<|") for x in how["added_tokens"])
        )
        self.part: dict[str, bytes] = {}

    def _of_part(self, s: str) -> bytes:
        found = self.model.tokenize(s.encode().decode("latin-1").translate(self.chars))
        x = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        if len(s) <= _LONGEST:
            self.part[s] = x
        return x

    def _bytes(self, parts: list[str]) -> bytes:
        if len(self.part) > _REMEMBER:
            self.part = {}
        found = list(map(self.part.get, parts))
        if None in found:
            get, learn = self.part.get, self._of_part
            found = [get(w) or learn(w) if x is None else x for w, x in zip(parts, found)]
        return b"".join(found)

    def __call__(self, text: str) -> np.ndarray:
        if not self.known_kind or "<|" in text or self.odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        parts = self.split(text.lower())
        return np.frombuffer(b"".join(self._bytes(parts[a : a + _RUN]) for a in range(0, len(parts), _RUN)), "<u4")


@cache
def text_ids(path: str) -> TextIds:
    return TextIds(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece: documents over ``length`` tokens are cut, others are one piece.

    Null and empty texts are the end token alone.
    """
    schema = with_fields(docs.select(F.col(id_col).alias("id")).schema, "piece int, start long, length long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_ids(tokenizer)
        for b in batches:
            row, piece, start, size, crc = [], [], [], [], []
            for k, text in enumerate(b.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                for p, a in enumerate(range(0, len(ids), length)):
                    part = ids[a : a + length]
                    row.append(k), piece.append(p), start.append(a), size.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Bins:
    """``count`` sequences from number ``first`` on, each of the same lengths in the same order."""

    lengths: tuple[int, ...]
    first: int
    count: int


def best_two_fit(histogram: dict[int, int], length: int = LENGTH) -> list[Bins]:
    """Bins that hold every piece of a histogram of lengths (1 to ``length``).

    Each bin is filled with the largest piece that still fits, again and again. Then, while two unpacked pieces a + b
    fit in the gap left after taking out the smallest piece and take more of it than that piece did, the tightest such
    two replace it. The choice depends only on which lengths are left, so the bin is repeated while they last.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    have = sorted(left)
    out: list[Bins] = []
    first = 0

    def largest(room: int, used: dict[int, int]) -> int:
        k = bisect_right(have, room) - 1
        while k >= 0 and left[have[k]] <= used.get(have[k], 0):
            k -= 1
        return have[k] if k >= 0 else 0

    while have:
        used: dict[int, int] = {}
        gap = length
        while gap and (n := largest(gap, used)):
            used[n] = used.get(n, 0) + 1
            gap -= n
        while gap:
            small = min(used)
            room = gap + small
            used[small] -= 1
            free = np.array([n for n in have[: bisect_right(have, room)] if left[n] > used.get(n, 0)], np.int64)
            two = _two(free, room, left, used)
            if two is None or sum(two) <= small:
                used[small] += 1
                break
            if not used[small]:
                del used[small]
            for n in two:
                used[n] = used.get(n, 0) + 1
            gap = room - sum(two)
        used = {n: c for n, c in used.items() if c}
        times = min(left[n] // c for n, c in used.items())
        out.append(Bins(tuple(n for n in sorted(used, reverse=True) for _ in range(used[n])), first, times))
        first += times
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
                have.remove(n)
    return out


def _two(free: np.ndarray, room: int, left: dict[int, int], used: dict[int, int]) -> tuple[int, int] | None:
    """The two free lengths of largest sum within room, the more unequal two first."""
    if not len(free):
        return None
    at = np.searchsorted(free, room - free, "right") - 1
    ok = at >= 0
    b = free[np.maximum(at, 0)]
    for k in np.nonzero(ok & (b == free))[0]:  # a length twice needs two of it
        if left[int(free[k])] - used.get(int(free[k]), 0) < 2:
            at[k] -= 1
            ok[k] = at[k] >= 0
            b[k] = free[max(at[k], 0)]
    total = np.where(ok, free + b, -1)
    k = int(total.argmax())
    return (int(free[k]), int(b[k])) if total[k] > 0 else None


def places(bins: list[Bins]) -> dict[str, np.ndarray]:
    """For the pieces of each length, by rank: where the run of ranks begins, its bins, and its place in them."""
    rows: list[tuple[int, int, int, int, int]] = []
    ranked: dict[int, int] = {}
    for b in bins:
        offset = 0
        for n in dict.fromkeys(b.lengths):
            each = b.lengths.count(n)
            rows.append((n, ranked.get(n, 0), b.first, each, offset))
            ranked[n] = ranked.get(n, 0) + each * b.count
            offset += n * each
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {k: table[:, i] for i, k in enumerate(("length", "rank", "first", "each", "offset"))}


def packed(pieces_df: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces_df`` (a written table with id, piece, start, length, ids_crc32 and no, a number of its own for each row) with
    sequence_id and offset.

    The driver holds the histogram and the kinds of bins: each ends a length or all but a few of it, so both are
    bounded by ``length``, not by the rows. A length of many pieces is ranked in parts of about 4096 by hash of no, so that
    repeated rows spread like others.
    """
    spark = pieces_df.sparkSession
    histogram = {r.length: r.n for r in pieces_df.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(best_two_fit(histogram, length)))
    parts = spark.createDataFrame([(n, -(-c // _RANKED)) for n, c in histogram.items()], "length long, parts long")
    salted = pieces_df.join(F.broadcast(parts), "length").withColumn(
        "part", F.pmod(F.xxhash64("no"), F.col("parts"))
    )
    counts = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.selectExpr("length", "part", "sum(n) OVER (PARTITION BY length ORDER BY part) - n AS before")
    numbered = salted.selectExpr(
        "*", "row_number() OVER (PARTITION BY length, part ORDER BY no) - 1 AS row"
    )
    ranked = numbered.join(before, ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("row") + F.col("before")).alias("rank")
    )
    schema = with_fields(pieces_df.select("id", "piece", "start", "length", "ids_crc32").schema, "sequence_id long, offset long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = t["length"] * (1 << 40) + t["rank"]
        for b in batches:
            n, rank = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            k = np.searchsorted(key, n * (1 << 40) + rank, "right") - 1
            each = t["each"][k]
            at = rank - t["rank"][k]
            seq, off = t["first"][k] + at // each, t["offset"][k] + at % each * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], schema.names)

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """Every document's pieces with their sequence and place: (id, piece, start, length, ids_crc32, sequence_id, offset).

    Null and empty texts are packed as the end token; very long ones are encoded whole and cut; a null id stays null; repeated
    rows are packed each; other columns are not read; an empty table gives no rows. Sequences are gapless from 0.
    """
    numbered = pieces(docs, tokenizer, id_col, text_col, length, end).withColumn("no", F.monotonically_increasing_id())
    return packed(written(numbered, "packing-pieces"), length)
