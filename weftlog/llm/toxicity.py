"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates and L1 sparsity (McMahan et al., "Ad Click Prediction", 2013) leave few weights, which are
broadcast as one small array of a fixed number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from weftlog.llm.common import boxed, drop_written, unboxed, with_fields, written
from weftlog.llm.quality import sample

BITS = 20
#: Most labelled rows of either label that the fit sees: the first in seeded order.
SAMPLE = 3000
#: Rows that a bucket must occur in to be learnt.
INCLUDED = 3
#: Bytes, at most, of the sample's buckets that reach the driver, four each: rows in seeded order up to there.
BYTES = 1 << 26
#: Bytes of them, at most, that reach it at once (or one row).
SENT = 1 << 23
SEED = 11
_CHUNK = 1 << 16
_TRIM = b".,;:!?\"'()[]{}<>|%#$&*-_"
# Fixed multipliers of the bucket hashes, odd and far from one another.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _spread(h: np.ndarray, bits: int) -> np.ndarray:
    return (h * _MIX[0]) >> np.uint64(64 - bits)


def buckets(text: bytes | None, bits: int = BITS) -> Iterator[np.ndarray]:
    """Buckets of a text's features, chunk by chunk and with repeats.

    Words (ASCII lower case, outer marks cut) alone, their beginnings of four and five characters, pairs of neighbours,
    triples, and pairs that skip one word.
    """
    words = [w.strip(_TRIM) for w in (text or b"").lower().split()]
    words = [w for w in words if w]
    digest = xxhash.xxh3_64_intdigest
    for low in range(0, len(words), _CHUNK):
        part = words[max(0, low - 2) : low + _CHUNK]
        new = len(part) - min(low, 2)
        h = np.array(list(map(digest, part)), np.uint64)
        begin = [(w[:4], w[:5]) if w.isascii() else _begin(w) for w in part[-new:]]
        stems = np.array([digest(a, 1) for a, _ in begin] + [digest(b, 2) for _, b in begin], np.uint64)
        one, two = h[:-1], h[1:]
        pair = one * _MIX[1] ^ two
        skip = h[:-2] * _MIX[2] ^ h[2:]
        three = pair[:-1] * _MIX[2] ^ h[2:] * _MIX[1]
        yield _spread(np.concatenate([h[-new:], stems, pair[-new:], skip[-new:], three[-new:]]), bits)


def _begin(w: bytes) -> tuple[bytes, bytes]:
    s = w.decode("utf-8", "replace")
    return s[:4].encode(), s[:5].encode()


@dataclass(frozen=True)
class Weights:
    """Weights by bucket (most are 0) and the intercept."""

    table: np.ndarray
    intercept: float
    bits: int = BITS

    def score(self, text: bytes | None) -> float:
        """Each feature counts once however often it occurs."""
        live = [b[self.table[b] != 0] for b in buckets(text, self.bits)]
        hit = np.unique(np.concatenate(live)) if live else np.zeros(0, np.int64)
        z = self.intercept + float(self.table[hit].sum(dtype=np.float64))
        return 1 / (1 + np.exp(-max(-40.0, min(40.0, z))))


def ftrl(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS, rounds: int = 8, alpha: float = 0.6, beta: float = 1.0, l1: float = 5.0, l2: float = 0.2, seed: int = SEED) -> Weights:
    """FTRL-proximal over rows of distinct buckets, in seeded order each round."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    free = 1 << bits  # the intercept's place; L1 does not hold it back
    rng = np.random.default_rng(seed)

    def weights(k: np.ndarray) -> np.ndarray:
        short = np.where(k == free, 0.0, l1)
        return np.where(np.abs(z[k]) <= short, 0.0, -(z[k] - np.sign(z[k]) * short) / ((beta + np.sqrt(n[k])) / alpha + l2))

    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            k = np.append(rows[i], free)
            w = weights(k)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -40, 40)))
            g = p - y[i]
            sigma = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha
            z[k] += g - sigma * w
            n[k] += g * g
    table = np.empty(free, np.float32)
    for low in range(0, free, _CHUNK):
        table[low : low + _CHUNK] = weights(np.arange(low, min(free, low + _CHUNK)))
    return Weights(table, float(weights(np.array([free]))[0]), bits)


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of y to held-out scores z, label 1 weighed by the root of how rare it is.

    Newton steps, shortened, on a loss that holds the slope near 1; a slope that is not positive gives (1, 0).
    """
    weight = np.where(y == 1, np.sqrt(max(1.0, (y == 0).sum() / max(1, (y == 1).sum()))), 1.0)
    at, x = np.array([1.0, 0.0]), np.stack([z, np.ones(len(z))], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        gradient = x.T @ ((p - y) * weight) + 0.1 * (at - [1.0, 0.0])
        hessian = (x * (p * (1 - p) * weight)[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        at = at - step * min(1.0, 0.5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def fit(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS, seed: int = SEED, included: int = INCLUDED, **how: float) -> Weights:
    """FTRL over buckets that occur in ``included`` rows or more, its scores calibrated on halves it was not fitted on.

    Rows are of distinct buckets, of any integer type; only those that lose some are copied.
    """
    seen = np.zeros(1 << bits, np.int64)
    for r in rows:
        seen[r] += 1
    rows = [r if (often := seen[r] >= included).all() else r[often] for r in rows]
    half, z = np.random.default_rng(seed).permutation(len(rows)) % 2, np.zeros(len(rows))
    for k in (0, 1):
        own = np.nonzero(half == k)[0]
        m = ftrl([rows[i] for i in own], y[own], bits, seed=seed, **how)
        for i in np.nonzero(half != k)[0]:
            z[i] = m.intercept + m.table[rows[i]].sum(dtype=np.float64)
    slope, shift = calibrated(z, y)
    m = ftrl(rows, y, bits, seed=seed, **how)
    return Weights((m.table * slope).astype(np.float32), m.intercept * slope + shift, bits)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE, seed: int = SEED, bits: int = BITS, included: int = INCLUDED, most_bytes: int = BYTES, sent: int = SENT
) -> Weights:
    """Fit on a bounded, seeded sample of the labelled rows: 2 x ``most`` rows and ``most_bytes`` of buckets at most.

    Buckets, not texts, reach the driver, ``sent`` bytes (or one row) at a time, and only those of ``included`` rows or more: how
    many rows have each is counted in the tasks. Null and empty texts are rows without a bucket; null ids and labels other than 0
    and 1 are passed over; an id given twice counts twice, up to the bound; ties go by id, then by a hash of the buckets, then by
    label, and equal rows by a number that each is given, so that no more than the bound come. Without both labels every score is a half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.unique(np.concatenate([np.zeros(0, np.uint64), *buckets(t.as_py(), bits)])).astype("<u4").tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary()), b.column(3)], ["_i", "o", "x", "y"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, np.int64)
        for b in batches:
            for x in b.column(0):
                seen[np.frombuffer(x.as_buffer(), "<u4")] += 1
        hit = np.nonzero(seen)[0]
        for low in range(0, len(hit), _CHUNK):
            k = hit[low : low + _CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(seen[k])], ["k", "n"])

    met = sample(docs, labels, label, id_col, text_col, most, seed)
    schema = met.select("_i", "o", F.col("t").alias("x"), "y").schema
    rows = written(met.mapInArrow(run, schema).withColumn("u", F.monotonically_increasing_id()), "toxicity-sample")
    key = F.struct("o", "_i", F.xxhash64("x").alias("h"), "y", "u")

    def within(some: DataFrame, after: Row | None, last: Row | None) -> DataFrame:
        """Rows of keys beyond ``after`` (none: from the first) up to ``last`` (none: no row)."""
        at = lambda k: F.struct(*(F.lit(k[c]).cast("long" if c == "h" else rows.schema[c].dataType).alias(c) for c in k.asDict()))
        upto = F.lit(False) if last is None else key <= at(last)
        return some.where(upto if after is None else upto & (key > at(after)))

    firsts = rows.select(key.alias("k")).orderBy("k").limit(2 * most).collect()
    few = within(rows, None, firsts[-1].k if firsts else None)
    often = few.select("x").mapInArrow(counted, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= included)
    live = np.zeros(1 << bits, bool)
    live[often.select("k").toArrow().column(0).to_numpy()] = True
    shared, names = docs.sparkSession.sparkContext.broadcast(live), rows.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [k[shared.value[k]].tobytes() for k in (np.frombuffer(v.as_buffer(), "<u4") for v in b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary()), b.column(3), b.column(4)], names)

    # Only keys and lengths are ordered; rows beyond the byte that the bound ends at stay where they are, the others go one
    # after the other into one array of four bytes a bucket.
    kept = written(few.mapInArrow(cut, rows.schema), "toxicity-kept")
    sizes = kept.select(key.alias("k"), (F.octet_length("x") / 4).cast("long").alias("n")).orderBy("k").collect()
    ends = np.cumsum([0, *(r.n for r in sizes)])
    held = int(np.searchsorted(ends[1:], most_bytes // 4, "right"))
    keys = [r.k for r in sizes[:held]]
    place, found, low = {k.u: j for j, k in enumerate(keys)}, np.empty(ends[held], "<u4"), 0
    while low < held:
        high = min(held, max(low + 1, int(np.searchsorted(ends, ends[low] + sent // 4, "right")) - 1))
        for r in within(kept, keys[low - 1] if low else None, keys[high - 1]).select("u", "x").collect():
            found[ends[place[r.u]] : ends[place[r.u] + 1]] = np.frombuffer(r.x, "<u4")
        low = high
    drop_written(rows)
    drop_written(kept)
    shared.destroy()
    y = np.array([k.y for k in keys], np.float64)
    if len(set(y)) < 2:
        return Weights(np.zeros(1 << bits, np.float32), 0.0, bits)
    return fit([found[ends[j] : ends[j + 1]] for j in range(held)], y, bits, seed, included)


def score(docs: DataFrame, model: Weights, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1, higher: toxic likelier) and ``text_col`` dropped; every whole text is read.

    Null and empty texts score by the intercept alone; very long ones are read in chunks; repeated rows score alike; an empty
    table gives no rows; a column of that name is replaced, others of any name stay.
    """
    sent = docs.select(boxed(docs, (name, text_col)), F.col(text_col).cast("binary").alias("_text"))
    schema = with_fields(sent.select("_row").schema, "_score double")
    live = np.nonzero(model.table)[0]
    shared = docs.sparkSession.sparkContext.broadcast((live.astype(np.int32), model.table[live], model.intercept, model.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, intercept, bits = shared.value
        table = np.zeros(1 << bits, np.float32)
        table[at] = values
        model = Weights(table, intercept, bits)
        for b in batches:
            s = [model.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], schema.names)

    return unboxed(sent.mapInArrow(run, schema), F.col("_score").alias(name))
