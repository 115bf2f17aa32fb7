"""Embedding near-duplicates by cross-polytope hashing.

A vector is turned by fast Hadamard rotations with random signs; the coordinate of largest magnitude, with its sign, is
its cell (Andoni et al., "Practical and Optimal LSH for Angular Distance", 2015). A bucket of a table is the cells of a
few rotations; besides its best bucket each vector enters the next best ones (multiprobe). Candidates that share a bucket
are verified by exact cosine, in tiles; each pair counts in the first bucket it shares, so that no list of pairs is
needed to count links, and tiles return counts and spanning edges only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm.common import components, drop_written, written
from weftlog.llm.simhash import local_roots

THRESHOLD = 0.9
SEED = 6
#: Chance, at least, that a pair just at the threshold shares a bucket: see :func:`reach`.
TARGET = 0.995
#: Most rotations of a bucket.
ROTATIONS = 4
#: Vectors that are compared together, and those of a crowded bucket that a task holds while others stream past them.
TILE = 1024
HELD = 8192
#: Vectors that a bucket may hold, about, before another rotation is added.
BUCKET = 1024
_PROBES = (1, 2, 3, 4, 6, 8)
_TRIALS = (512, 16)


@dataclass(frozen=True)
class CrossPolytope:
    """``tables`` tables of ``rotations`` rotations in ``dim`` (a power of two) dimensions."""

    dim: int
    tables: int
    rotations: int
    seed: int = SEED

    @cached_property
    def signs(self) -> np.ndarray:
        return np.random.default_rng(self.seed).choice([-1.0, 1.0], (self.tables, self.rotations, 3, self.dim))

    def buckets(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(rows, tables, probes) bucket numbers of unit vectors, the best first, all distinct within a table."""
        n, signs = len(x), self.signs
        wide = np.zeros((n, self.dim))
        wide[:, : x.shape[1]] = x
        out = np.empty((n, self.tables, probes), np.int64)
        depth = min(self.dim, probes)
        for t in range(self.tables):
            # Sums over rotations of what a probe loses, best probes first; merged one rotation at a time.
            code, loss = np.zeros((n, 1), np.int64), np.zeros((n, 1))
            for r in range(self.rotations):
                y = wide
                for s in signs[t, r]:
                    y = hadamard(y * s)
                best = np.argpartition(-np.abs(y), depth - 1, axis=1)[:, :depth]
                value = np.take_along_axis(y, best, 1)
                order = np.argsort(-np.abs(value), axis=1, kind="stable")
                best, value = np.take_along_axis(best, order, 1), np.take_along_axis(value, order, 1)
                cell = best * 2 + (value < 0)
                lost = (np.abs(value[:, :1]) - np.abs(value)) ** 2
                code = (code[:, :, None] * (2 * self.dim) + cell[:, None, :]).reshape(n, -1)
                loss = (loss[:, :, None] + lost[:, None, :]).reshape(n, -1)
                first = np.argsort(loss, axis=1, kind="stable")[:, :probes]
                code, loss = np.take_along_axis(code, first, 1), np.take_along_axis(loss, first, 1)
            out[:, t] = code
        return out


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the orthonormal Walsh-Hadamard matrix, by butterflies."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def valid(column: str) -> str:
    """SQL text: the vector is not null, not zero and has finite components only."""
    return f"{column} IS NOT NULL AND size({column}) > 0 AND forall({column}, c -> c IS NOT NULL AND abs(c) < double('infinity')) AND exists({column}, c -> c <> 0)"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) between unit vectors x and y, or within x if y is None."""
    i, j = np.nonzero((x @ (x if y is None else y).T) >= threshold - 1e-9)
    if y is None:
        i, j = i[i < j], j[i < j]
    exact = (x[i] * (x if y is None else y)[j]).sum(1) >= threshold
    return i[exact], j[exact]


@cache
def reach(width: int, rotations: int, threshold: float, target: float = TARGET) -> tuple[int, int]:
    """Tables and probes of the fewest entries for which a pair at the threshold shares a bucket with chance ``target``.

    Chances of one table are measured on random pairs at just that cosine in ``width`` dimensions, less two standard errors;
    nearer pairs meet more surely, so that the same holds at every width, threshold and number of rotations.
    """
    pairs, tables = _TRIALS
    rng = np.random.default_rng(SEED)
    x = unit(rng.normal(size=(pairs, width)))
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    size = np.sqrt((off * off).sum(1, keepdims=True))
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * off / np.where(size > 1e-9, size, 1)
    trial = CrossPolytope(padded(width), tables, rotations, SEED + 1)
    a, b = (trial.buckets(unit(v), max(_PROBES)) for v in (x, y))
    best = None
    for probes in _PROBES:
        met = (a[:, :, :probes, None] == b[:, :, None, :probes]).any((2, 3)).mean()
        sure = min(1 - 1e-9, max(1e-4, met - 2 * np.sqrt(met * (1 - met) / (pairs * tables))))
        needed = int(np.ceil(np.log(1 - target) / np.log1p(-sure)))
        if best is None or needed * probes < best[0] * best[1]:
            best = needed, probes
    return best


def padded(width: int) -> int:
    """The dimensions that vectors of a width are rotated in."""
    return 1 << max(3, (width - 1).bit_length())


class Buckets:
    """Buckets of the rows of x, found when they are first asked for, and only for those."""

    def __init__(self, lsh: CrossPolytope, x: np.ndarray, probes: int) -> None:
        self.lsh, self.x, self.probes = lsh, x, probes
        self.at = np.full(len(x), -1)
        self.keys = np.zeros((0, lsh.tables, probes), np.int64)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Places in ``keys`` of the rows."""
        wanted = np.zeros(len(self.at), bool)
        wanted[rows] = True
        new = np.nonzero(wanted & (self.at < 0))[0]
        if len(new):
            self.at[new] = len(self.keys) + np.arange(len(new))
            self.keys = np.concatenate([self.keys, *(self.lsh.buckets(self.x[new[a : a + 4096]], self.probes) for a in range(0, len(new), 4096))])
        return self.at[rows]


def first_shared(left: Buckets, i: np.ndarray, right: Buckets, j: np.ndarray, table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Which pairs of row i of left and j of right were met in their first shared bucket, pair k in bucket[k] of table[k].

    The first is in the smallest table in which they share one, and there the smallest.
    """
    i, j = left.of(i), right.of(j)
    ours = np.ones(len(i), bool)
    for t in range(left.lsh.tables):
        live = np.nonzero(ours & (t <= table))[0]
        a, b = left.keys[i[live], t], right.keys[j[live], t]
        same = a[:, :, None] == b[:, None, :]
        here = np.where(same.any(2), a, np.iinfo(np.int64).max).min(1) == bucket[live]
        ours[live] = np.where(table[live] == t, here, ~same.any((1, 2)))
    return ours


#: Linked pairs that are held before their first buckets are looked up.
_PAIRS = 1 << 20
_OUT = "id long, count long, edge long"


def links(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, bucket: int = BUCKET, seed: int = SEED, held: int = HELD) -> DataFrame:
    """(id, count, edge): of distinct vectors (id long, v array of finite components, copies long), a written table.

    Rows with a count say how many copies other vectors linked to id have (by part); rows with an edge join id to a vector
    of its component. All vectors are of one width. More vectors need buckets of more rotations; :func:`reach` sees to it that
    they find as much.

    Buckets of up to ``tile`` vectors are compared whole. A crowded one is cut into blocks of about ``held`` by hash: a task
    holds one block and the vectors of the later ones stream past it, so that a vector is sent once a block, not once a tile,
    and no task holds more than a block.
    """
    spark = vectors.sparkSession
    first = vectors.select(F.size("v").alias("d")).first()
    if first is None:
        return spark.createDataFrame([], _OUT)
    n, rotations = vectors.count(), 1
    tables, probes = reach(first.d, 1, threshold)
    while rotations < ROTATIONS and (2 * padded(first.d)) ** rotations * bucket < n * probes:
        rotations += 1
        tables, probes = reach(first.d, rotations, threshold)
    lsh = CrossPolytope(padded(first.d), tables, rotations, seed)
    block = max(tile, min(held, (1 << 22) // first.d))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                b = whole.slice(low, 1024)
                keys, m = lsh.buckets(unit(_matrix(b.column(1))), probes), b.num_rows
                row = pa.array(np.repeat(np.arange(m), tables * probes))
                t = pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), m))
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), t, pa.array(keys.reshape(-1))], ["id", "t", "b"])

    entries = written(vectors.select("id", "v").mapInArrow(enter, "id long, t int, b long"), "embedding-buckets")
    sizes = entries.groupBy("t", "b").agg(F.count("*").alias("m")).where("m > 1")
    sized = written(entries.join(sizes, ["t", "b"]), "embedding-entries")
    drop_written(entries)
    few = sized.where(F.col("m") <= tile).select("t", "b", F.lit(0).alias("p"), F.lit(False).alias("later"), "id")
    many = sized.where(F.col("m") > tile).withColumn("s", F.pmod(F.xxhash64("id", "t"), F.ceil(F.col("m") / block)).cast("int"))
    many = many.withColumn("p", F.explode(F.sequence(F.lit(0), "s"))).select("t", "b", "p", (F.col("p") < F.col("s")).alias("later"), "id")
    group = ["t", "b", "p"]

    def grouped(keys: DataFrame) -> DataFrame:
        met = keys.join(vectors.select("id", "v", "copies"), "id").select(*group, "later", "id", "copies", "v")
        return met.repartition(*group).sortWithinPartitions(*group, "later")

    def told(table: pa.Table, x: np.ndarray, met: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """Counts and spanning edges from pairs of rows (i, j, table, bucket)."""
        i, j, t, b = (np.concatenate(c) for c in zip(*met))
        keys = Buckets(lsh, x, probes)
        ours = first_shared(keys, i, keys, j, t, b)
        ids, copies = table["id"].to_numpy(), table["copies"].to_numpy()
        i, j = i[ours], j[ours]
        count = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
        return _rows([_counts(ids, count), _edges(ids, local_roots(len(x), i, j))])

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets of the sorted rows, one after the other; at most one batch and one bucket are held."""
        rest = None
        for batch in _and_end(batches):
            table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            table = table.combine_chunks()
            key = np.stack([table[k].to_numpy() for k in range(2)], 1)
            bounds = np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1
            ends = [*bounds.tolist(), *([table.num_rows] if batch is None else [])]
            x = unit(_matrix(table["v"].chunk(0)))
            low, met, pairs = 0, [], 0
            for high in ends:
                if high - low > 1:
                    t, b = key[low]
                    i, j = tile_links(x[low:high], None, threshold)
                    if len(i):
                        met.append((i + low, j + low, np.full(len(i), t), np.full(len(i), b)))
                        pairs += len(i)
                    if pairs > _PAIRS:
                        yield told(table, x, met)
                        met, pairs = [], 0
                low = high
            rest = table.slice(low)
            if met:
                yield told(table, x, met)

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the sorted rows, each before the vectors that stream past it; a block and a batch are held."""
        now, own = None, None
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)], 1)
            bounds = [0, *(np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1).tolist(), batch.num_rows]
            for low, high in zip(bounds, bounds[1:]):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                rows = part.column(4).to_numpy(), part.column(5).to_numpy(), unit(_matrix(part.column(6)))
                if own is None or tuple(key[low, :3]) != now:
                    if own is not None:
                        yield from own.closed()
                    now = tuple(key[low, :3])
                    own = _Block(lsh, probes, threshold, tile, now[0], now[1])
                if key[low, 3]:
                    yield from own.past(*rows)
                else:
                    own.hold(*rows)
        if own is not None:
            yield from own.closed()

    return grouped(few).mapInArrow(small, _OUT).unionByName(grouped(many).mapInArrow(crowded, _OUT))


def _counts(ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    hit = np.nonzero(count)[0]
    return ids[hit], count[hit].astype(np.int64), ids[hit]


def _edges(ids: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, ...]:
    moved = np.nonzero(root != np.arange(len(root)))[0]
    return ids[moved], np.zeros(len(moved), np.int64), ids[root[moved]]


def _rows(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["id", "count", "edge"])


class _Block:
    """Some vectors of a crowded bucket, compared among themselves and with those that stream past, a tile at a time."""

    def __init__(self, lsh: CrossPolytope, probes: int, threshold: float, tile: int, table: int, bucket: int) -> None:
        self.lsh, self.probes, self.threshold, self.tile = lsh, probes, threshold, tile
        self.table, self.bucket = table, bucket
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.keys: Buckets | None = None

    def hold(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray) -> None:
        self.parts.append((ids, copies, x))

    def _sealed(self) -> Iterator[pa.RecordBatch]:
        if self.keys is not None:
            return
        # A slice of the hash may be empty, so that all of a group streams past nothing.
        parts = self.parts or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, self.lsh.dim)))]
        self.ids, self.copies, x = (np.concatenate(c) for c in zip(*parts))
        self.parts, self.keys, self.count = [], Buckets(self.lsh, x, self.probes), np.zeros(len(x))
        for a in range(0, len(x), self.tile):
            for b in range(a, len(x), self.tile):
                yield from self._met(a, self.keys, self.ids, self.copies, self.count, b, a == b)

    def _met(self, a: int, keys: Buckets, ids: np.ndarray, copies: np.ndarray, count: np.ndarray, b: int, same: bool) -> Iterator[pa.RecordBatch]:
        i, j = tile_links(self.keys.x[a : a + self.tile], None if same else keys.x[b : b + self.tile], self.threshold)
        i, j = i + a, j + b
        ours = first_shared(self.keys, i, keys, j, np.full(len(i), self.table), np.full(len(i), self.bucket))
        i, j = i[ours], j[ours]
        if len(i):
            self.count += np.bincount(i, copies[j], len(self.count))
            count += np.bincount(j, self.copies[i], len(count))
            own = slice(a, a + self.tile)
            both = np.concatenate([self.ids[own], ids[b : b + self.tile]])
            yield _rows([_edges(both, local_roots(len(both), i - a, j - b + len(self.ids[own])))])

    def past(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from self._sealed()
        keys, count = Buckets(self.lsh, x, self.probes), np.zeros(len(x))
        for a in range(0, len(self.ids), self.tile):
            for b in range(0, len(x), self.tile):
                yield from self._met(a, keys, ids, copies, count, b, False)
        yield _rows([_counts(ids, count)])

    def closed(self) -> Iterator[pa.RecordBatch]:
        yield from self._sealed()
        yield _rows([_counts(self.ids, self.count)])


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, **how: int) -> DataFrame:
    """(id, n_links, component, kept) of every row, by verified cosine of ``threshold`` or more.

    Vectors that are null, zero or hold null or non-finite components link with nothing and are their own component.
    Equal vectors are compared once and link with one another. A null id is never the smallest (a component of null ids
    only has a null component and is not kept); repeated rows are vectors each; vectors of another width than most
    link only within their width; other columns are not read; an empty table gives no rows. Pairs at just the threshold are
    found with a chance of :data:`TARGET` or more, nearer ones more surely, whatever the width, threshold and number of rows.
    """
    base = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    ok = F.expr(valid("v"))
    zero = F.expr("transform(v, c -> c + cast(0 as float))")  # -0.0 becomes 0.0
    good = base.where(ok).select("id", zero.alias("v"))
    keyed = written(good.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(SEED), "v").alias("h2"), F.size("v").alias("d")), "embedding-rows")
    same = keyed.groupBy("h1", "h2", "d").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.min("v").alias("v"))
    # 128 bits of hash and the width tell classes apart; numbers are their own once the table is written.
    classes = written(same.withColumn("id", F.monotonically_increasing_id()), "embedding-classes")
    parts = []
    for d in sorted(r.d for r in classes.select("d").distinct().collect()):
        parts.append(written(links(written(classes.where(F.col("d") == d), "embedding-width"), threshold, **how), "embedding-links"))
    none = rows.sparkSession.createDataFrame([], "id long, count long, edge long")
    found = none
    for p in parts:
        found = found.unionByName(p)
    roots = components(found.where("edge <> id").select(F.col("id").alias("u"), F.col("edge").alias("v")), "embedding-components")
    counts = found.groupBy("id").agg(F.sum("count").alias("others"))
    nodes = classes.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    nodes = nodes.select("h1", "h2", "d", "least", "copies", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("root", "id").alias("root"))
    whole = nodes.groupBy("root").agg(F.min("least").alias("component"))
    lookup = nodes.join(whole, "root").select("h1", "h2", "d", (F.col("others") + F.col("copies") - 1).alias("n_links"), "component")
    linked = keyed.join(lookup, ["h1", "h2", "d"]).select("id", "n_links", "component")
    alone = base.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))
