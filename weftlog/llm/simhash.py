"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are 64-bit SimHashes over word shingles. Distinct fingerprints are cut into tiles by the population
counts of their quarters; only tile pairs whose counts can differ by the radius or less are compared, in numpy, with
exclusive-or and bit counts over all their members (exact: no banding, no missed link). A tile pair returns the
edges of a spanning forest, never all its pairs, and components are found by joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.llm.common import again, boxed, components, drop_written, unboxed, with_fields, written

SEED = 42
WORDS = 3
RADIUS = 3
#: Distinct fingerprints in a tile, about.
TILE = 2048
#: Tiles of a block: others are sent to it once, not once for each of its tiles.
BLOCK = 8
#: Links that are held before they are cut down to a spanning forest.
_HELD = 1 << 20
_SUB = 256
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """SimHash of one text (UTF-8); null and wordless texts give 0. Memory is bounded by the text and one chunk of shingles."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        parts, words = [b" ".join(parts)], 1
    total, n = np.zeros(64, np.int64), len(parts) - words + 1
    digest = xxhash.xxh64_intdigest
    for low in range(0, n, _CHUNK):
        k = min(_CHUNK, n - low)
        part = parts[low : low + k + words - 1]
        joined = b" ".join(part)
        size = np.fromiter(map(len, part), np.int64, len(part))
        end = np.cumsum(size + 1) - 1
        first, last = (end - size)[:k].tolist(), end[words - 1 :].tolist()
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, fp long) of each row; the id keeps its type and nulls."""
    schema = with_fields(docs.select(F.col(id_col).alias("id")).schema, "fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(x.as_py(), words) for x in b.column(1)]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, schema)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each of n nodes' component, given links i[k]-j[k]."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (root[root] != root).any():
            root = root[root]
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]
    return root


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _ordered(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """x in the order of its quarters' bit counts, its runs, and the least and largest counts of each run."""
    q = _quarters(x)
    order = np.lexsort(q.T)
    x, q = x[order], q[order]
    runs = [(a, min(a + _SUB, len(x))) for a in range(0, len(x), _SUB)]
    return x, runs, np.array([q[a:b].min(0) for a, b in runs]), np.array([q[a:b].max(0) for a, b in runs])


class _Forest:
    """Links among n nodes, held as the edges of a spanning forest and a bounded number of new ones."""

    def __init__(self, n: int) -> None:
        self.n, self.left, self.right, self.held = n, [], [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.left.append(i)
        self.right.append(j)
        self.held += len(i)
        if self.held > _HELD + self.n:
            root = self.roots()
            hit = np.nonzero(root != np.arange(self.n))[0]
            self.left, self.right, self.held = [hit], [root[hit]], len(hit)

    def roots(self) -> np.ndarray:
        if not self.left:
            return np.arange(self.n)
        return local_roots(self.n, np.concatenate(self.left), np.concatenate(self.right))


def tile_links(x: np.ndarray, y: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, root fp) of a spanning forest of the links within ``radius`` between x and y, or within x if y is None.

    Runs whose quarter counts differ by more than the radius in all are skipped.
    """
    x, xr, xlow, xhigh = _ordered(x)
    y2, yr, ylow, yhigh = (x, xr, xlow, xhigh) if y is None else _ordered(y)
    shift = 0 if y is None else len(x)
    nodes = x if y is None else np.concatenate([x, y2])
    forest = _Forest(len(nodes))
    for k, (a, b) in enumerate(xr):
        gap = np.maximum(0, np.maximum(xlow[k] - yhigh, ylow - xhigh[k])).sum(1)
        for m in np.nonzero(gap <= radius)[0]:
            if y is None and m < k:
                continue
            c, d = yr[m]
            i, j = np.nonzero(np.bitwise_count(x[a:b, None] ^ y2[None, c:d]) <= radius)
            i, j = i + a, j + c + shift
            if y is None:
                i, j = i[i < j], j[i < j]
            if len(i):
                forest.add(i, j)
    root = forest.roots()
    hit = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[hit], nodes[root[hit]]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints of ``fps`` (fp long) linked within ``radius`` bits.

    A class is the population counts of a fingerprint's four quarters: 17^4 of them at most, whatever the rows. Linked
    fingerprints are in classes whose counts differ by the radius or less in all (129 for radius 3, a twenty-fifth of the
    pairs). A large class is cut into tiles of about ``tile`` by hash and those into blocks; each block meets one group of
    tiles at a time, one for each class in reach, so that no task holds more than some 140 tiles.
    """
    quarter = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)))
    code = sum((quarter(k) * 32**k for k in range(1, 4)), quarter(0)).cast("int")
    classed = fps.select("fp", code.alias("a"))
    sizes = written(classed.groupBy("a").agg(F.ceil(F.count("*") / tile).cast("int").alias("k")), "simhash-classes")
    cut = classed.join(F.broadcast(sizes), "a").withColumn("s", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    tiles = written(cut.groupBy("a", "s").agg(F.collect_list("fp").alias("x")), "simhash-tiles")
    # Only towards smaller classes, and within a class smaller tiles: each pair is met once.
    steps = [sum(d * 32**k for k, d in enumerate(o)) for o in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, o)) <= radius]
    count = lambda c, k: F.shiftright(c, 5 * k).bitwiseAND(F.lit(31))
    reached = lambda b: (b >= 0) & (sum(F.abs(count(b, k) - count(F.col("a"), k)) for k in range(4)) <= radius)
    targets = F.filter(F.transform(F.array(*(F.lit(d) for d in steps if d <= 0)), lambda d: F.col("a") + d), reached)
    sent = tiles.select("a", "s", "x", F.explode(targets).alias("b")).join(F.broadcast(sizes.withColumnRenamed("a", "b")), "b")
    blocks = F.sequence(F.lit(0), F.floor((F.col("k") - 1) / block).cast("int"))
    sent = sent.withColumn("t", F.explode(blocks)).where(f"b < a OR t * {block} <= s")
    met = sent.groupBy("b", "t", "s").agg(F.collect_list(F.struct((F.col("a") == F.col("b")).alias("own"), F.col("x").alias("y"))).alias("ys"))
    held = tiles.groupBy(F.col("a").alias("b"), F.floor(F.col("s") / block).cast("int").alias("t")).agg(F.collect_list(F.struct("s", "x")).alias("xs"))
    pairs = met.join(held, ["b", "t"]).select("s", "xs", "ys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, xs, ys in zip(*batch.columns):
                s, no, x = s.as_py(), xs.values.field("s").to_numpy(), [_fp(v.values) for v in xs.values.field("x")]
                others, found = [], []
                for own, y in zip(ys.values.field("own"), ys.values.field("y")):
                    if not own.as_py():
                        others.append(_fp(y.values))
                        continue
                    found += [tile_links(x[k], None, radius) for k in np.nonzero(no == s)[0]]
                    if len(lower := np.nonzero(no < s)[0]):
                        found.append(tile_links(_fp(y.values), np.concatenate([x[k] for k in lower]), radius))
                if others:
                    found.append(tile_links(np.concatenate(x), np.concatenate(others), radius))
                for u, v in found:
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def _fp(v: pa.Array) -> np.ndarray:
    return v.to_numpy(zero_copy_only=False).view(np.uint64)


def hex_fp(col: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Each row's (id, fp, component): the smallest id reachable through links of ``radius`` or fewer differing bits.

    Null and wordless texts have fingerprint 0 and are linked like any other; very long ones are read whole; a null id is never the smallest (a
    component of null ids only has a null component); repeated rows each come back; other columns are not read;
    an empty table gives no rows. Exact copies share a fingerprint and are compared once.
    """
    rows = written(fingerprints(docs, id_col, text_col, words), "simhash-rows")
    each = rows.groupBy("fp").agg(F.min("id").alias("least"))
    edges = written(links(each.select("fp"), radius), "simhash-links")
    roots = components(edges, "simhash-components").select(F.col("node").alias("fp"), "root")
    drop_written(edges)
    nodes = each.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = nodes.groupBy("root").agg(F.min("least").alias("component"))
    lookup = nodes.join(whole, "root").select("fp", "component")
    return rows.join(lookup, "fp").select("id", "fp", "component")


# Near-duplicates by shingle similarity: wide fingerprints and shared shingles find candidates, the sets themselves decide.

#: 64-bit words of a wide fingerprint.
WIDE = 8
SIMILARITY = 0.8
#: Differing bits of 512 that make a candidate, no more: two sets of equal size and Jaccard similarity 0.8 differ in 77 of 512
#: on average, with a standard deviation of 8 (fewer bits if sizes differ), so that this is four deviations further out.
WIDE_RADIUS = 110
#: Sets of so many shingles or fewer are also met by the shingles they share, which misses none.
SMALL = 64
_GROWTH = 1.0625
#: Words of a wide fingerprint that decide for most pairs: unrelated ones differ in 160 of 320 bits, with a deviation of 9.
_FIRST = 5
#: Sets, and shingles, of a slice of candidates whose sets are compared together.
_SETS, _SHINGLES = 512, 1 << 18
_COLUMNS = 4096


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit hash of each 64-bit hash (SplitMix64's finish)."""
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, sorted; the whole sequence if it is shorter than one."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        parts, words = [b" ".join(parts)], 1
    digest, out, n = xxhash.xxh64_intdigest, [], len(parts) - words + 1
    for low in range(0, n, _CHUNK):
        k = min(_CHUNK, n - low)
        part = parts[low : low + k + words - 1]
        joined, size = b" ".join(part), np.fromiter(map(len, part), np.int64, len(part))
        end = np.cumsum(size + 1) - 1
        first, last = (end - size)[:k].tolist(), end[words - 1 :].tolist()
        out.append(np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64)))
    return out[0] if len(out) == 1 else np.unique(np.concatenate(out))


def wide_fingerprint(h: np.ndarray) -> bytes:
    """Wide SimHash of a set of shingle hashes."""
    total = np.zeros(64 * WIDE, np.int64)
    for low in range(0, len(h), 4080):
        x = h[low : low + 4080]
        bits = np.unpackbits(np.stack([_mixed(x, k) for k in range(1, WIDE + 1)], 1).view(np.uint8), axis=1, bitorder="little")
        for a in range(0, len(bits), 255):
            total += np.add.reduce(bits[a : a + 255], axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(h), bitorder="little").tobytes()


def _class(h: np.ndarray) -> bytes:
    """A 128-bit hash of a set of hashes: sets that share it are taken as one."""
    return xxhash.xxh3_128_digest(h.tobytes(), SEED)


def set_links(sets: list[np.ndarray], first: np.ndarray | None, similarity: float) -> np.ndarray:
    """Root of each of ``sets`` (of distinct hashes), by links of that Jaccard similarity or more: between the sets marked
    ``first`` and the others, or among all if it is None. Exact."""
    size = np.array([len(h) for h in sets], np.int64)
    rows, cols = (np.arange(len(sets)),) * 2 if first is None else (np.nonzero(first)[0], np.nonzero(~first)[0])
    shared = np.zeros((len(rows), len(cols)))
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    at = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[token]
    doc = np.repeat(np.arange(len(sets)), size)[at >= 0]
    at = at[at >= 0]
    order = np.argsort(at, kind="stable")
    doc, at = doc[order], at[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, _COLUMNS):
        a, b = np.searchsorted(at, [low, low + _COLUMNS])
        has = np.zeros((len(sets), min(_COLUMNS, int(at[-1]) + 1 - low)), np.float32)
        has[doc[a:b], at[a:b] - low] = 1
        shared += has[rows] @ has[cols].T
    i, j = np.nonzero(shared >= similarity * (size[rows][:, None] + size[cols] - shared) - 1e-9)
    return local_roots(len(sets), rows[i], cols[j])


def wide_links(x: np.ndarray, nx: np.ndarray, y: np.ndarray | None, ny: np.ndarray | None, radius: int, similarity: float) -> np.ndarray:
    """Root (a row number) of each row of x and then y, by links within x and y or, if y is None, within x.

    Rows are wide fingerprints; a link differs in ``radius`` bits at most and its sizes are not too far apart for the
    similarity. Runs whose population counts differ beyond the radius are skipped; the first words decide for most pairs.
    """
    own = y is None
    order = np.argsort(np.bitwise_count(x).sum(1), kind="stable")
    other = order if own else np.argsort(np.bitwise_count(y).sum(1), kind="stable")
    a_all, b_all = x[order], (x if own else y)[other]
    na, nb = nx[order], (nx if own else ny)[other]
    pa_, pb = np.bitwise_count(a_all).sum(1), np.bitwise_count(b_all).sum(1)
    forest = _Forest(len(x) + (0 if own else len(y)))
    for low in range(0, len(a_all), _SUB):
        high = min(low + _SUB, len(a_all))
        c, d = np.searchsorted(pb, [pa_[low] - radius if pa_[low] > radius else 0, pa_[high - 1] + radius + 1])
        if own:
            c = max(c, low)
        if c >= d:
            continue
        part, rest = a_all[low:high], b_all[c:d]
        diff = np.zeros((high - low, d - c), np.uint16)
        for k in range(_FIRST):
            diff += np.bitwise_count(part[:, k, None] ^ rest[None, :, k])
        i, j = np.nonzero(diff <= radius)
        more = diff[i, j] + np.bitwise_count(part[i, _FIRST:] ^ rest[j, _FIRST:]).sum(1)
        i, j = i[more <= radius] + low, j[more <= radius] + c
        near = np.minimum(na[i], nb[j]) >= similarity * np.maximum(na[i], nb[j])
        if own:
            near &= i < j
        forest.add(order[i[near]], other[j[near]] + (0 if own else len(x)))
    return forest.roots()


def similar(classes: DataFrame, radius: int = WIDE_RADIUS, similarity: float = SIMILARITY, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect candidates: classes (c long, n long, fp binary), a written table of distinct sets.

    Classes are put into bands of size (about one for each 6 %, so that the driver sees some hundreds of them at most); a band
    meets the few in which a similar set can be. Large bands are cut into tiles by hash and those into blocks, which tiles
    are sent to once.
    """
    spark = classes.sparkSession
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / math.log(_GROWTH) + 1e-9).cast("int")
    banded = classes.select("c", "n", "fp", band.alias("a"))
    parts = {r.a: -(-r.n // tile) for r in banded.groupBy("a").agg(F.count("*").alias("n")).collect()}
    reach = math.ceil(math.log(1 / similarity) / math.log(_GROWTH))
    near = [(a, k, b, (parts[b] - 1) // block) for a, k in parts.items() for b in range(a, a + reach + 1) if b in parts]
    near_df = spark.createDataFrame(near, "a int, k int, b int, last int")
    cut = banded.join(F.broadcast(near_df.select("a", "k").distinct()), "a").withColumn("s", F.pmod(F.xxhash64("c"), F.col("k")).cast("int"))
    tiles = written(cut.groupBy("a", "s").agg(F.collect_list(F.struct("c", "n", "fp")).alias("x")), "simhash-tiles")
    left = tiles.join(F.broadcast(near_df), "a").withColumn("t", F.explode(F.sequence(F.lit(0), "last"))).where(f"a < b OR s < (t + 1) * {block}")
    right = tiles.groupBy(F.col("a").alias("b"), F.floor(F.col("s") / block).cast("int").alias("t")).agg(F.collect_list(F.struct("s", "x")).alias("ys"))
    pairs = left.join(right, ["b", "t"]).select(F.when(F.col("a") == F.col("b"), F.col("s")).alias("own"), "x", "ys")

    def unpacked(v: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = v.values
        fp = np.frombuffer(b"".join(rows.field("fp").to_pylist()), np.uint64).reshape(-1, WIDE)
        return rows.field("c").to_numpy(), rows.field("n").to_numpy(), fp

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x, ys in zip(*batch.columns):
                c, n, fp = unpacked(x)
                own = own.as_py()
                for s, y in zip(ys.values.field("s").to_pylist(), ys.values.field("x")):
                    if own is not None and s < own:
                        continue
                    if s == own:
                        every, root = c, wide_links(fp, n, None, None, radius, similarity)
                    else:
                        c2, n2, fp2 = unpacked(y)
                        every, root = np.concatenate([c, c2]), wide_links(fp, n, fp2, n2, radius, similarity)
                    hit = np.nonzero(root != np.arange(len(root)))[0]
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array(every[hit]), pa.array(every[root[hit]])], ["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def sharing(small: DataFrame, similarity: float) -> DataFrame:
    """(c, g long) for each class of ``small`` (c long, n long, few array: its whole set) and each shingle by which it is met.

    In the order of how many sets have a shingle, rarest first, the first n - ceil(similarity * n) + 1 of a set must share one
    with those of any similar set; so the frequent ones meet nobody, and what only one set has is dropped before it is shuffled.
    """
    each = small.select("c", "n", F.explode("few").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    shared = each.join(often.select(again("h").alias("w"), "m"), F.col("h") == F.col("w")).drop("w")
    own = shared.groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct("m", "h"))).alias("t"))
    first = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("t"))
    kept = own.where(first > 0).select("c", F.explode(F.slice("t", 1, F.least(first, F.size("t")).cast("int"))["h"]).alias("g"))
    met = kept.groupBy("g").agg(F.count("*").alias("m")).where("m > 1")
    return kept.join(met.select(again("g").alias("w")), F.col("g") == F.col("w")).drop("w")


def verified(sets: DataFrame, similarity: float, most: int = _SETS) -> DataFrame:
    """Edges (u, v) that connect the similar sets of each group of candidates: (c, g long, s array of shingle hashes), a written table.

    A group of about ``most`` sets or fewer is compared whole. In a larger one all sets are first compared with one of them, its
    pivot: what is similar to that is connected already, so that only the others must be compared with all. These go by slices
    of both. So a crowd of near copies costs one comparison each, and no task holds more than two slices.
    """
    parts = F.ceil(F.greatest(F.count("*") / most, F.sum(F.size("s")) / _SHINGLES)).cast("int").alias("parts")
    sized = sets.groupBy("g").agg(parts, F.count("*").alias("m")).where("m > 1").select(again("g").alias("w"), "parts")
    all_ = written(sets.join(sized, F.col("g") == F.col("w")).drop("w"), "simhash-sets")
    few, many = all_.where("parts = 1"), all_.where("parts > 1")
    slice_of = lambda n: F.pmod(F.xxhash64("c"), n).cast("int")
    pivots = many.groupBy("g", "parts").agg(F.min(F.struct("c", "s")).alias("p")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("g", "k", "p")
    asked = many.withColumn("k", slice_of(F.col("parts"))).join(pivots, ["g", "k"]).select("g", "c", "parts", "s", F.col("p.c").alias("v"), F.col("p.s").alias("t"))

    def with_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for s, t in zip(b.column(3), b.column(5)):
                s, t = _fp(s.values), _fp(t.values)
                both = len(np.intersect1d(s, t, assume_unique=True))
                near.append(both >= similarity * (len(s) + len(t) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(near, pa.bool_()), pa.array(list(map(len, b.column(3))), pa.int64())], ["g", "c", "parts", "v", "near", "n"])

    told = written(asked.mapInArrow(with_pivot, "g long, c long, parts int, v long, near boolean, n long"), "simhash-pivots")
    rest = told.where("NOT near").select("g", "c", "parts", "n")
    slices = rest.groupBy("g", "parts").agg(F.ceil(F.greatest(F.count("*") / most, F.sum("n") / _SHINGLES)).cast("int").alias("rest_parts"))
    cut = slices.select(again("g").alias("w"), "rest_parts")
    left = rest.drop("n").join(many.drop("parts"), ["g", "c"]).join(cut, F.col("g") == F.col("w")).drop("w")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = left.withColumns({"p": slice_of(F.col("rest_parts")), "q": F.explode(every("parts"))}).select("g", "p", "q", "c", F.lit(True).alias("first"), "s")
    right = many.join(cut, F.col("g") == F.col("w")).drop("w")
    right = right.withColumns({"q": slice_of(F.col("parts")), "p": F.explode(every("rest_parts"))}).select("g", "p", "q", "c", F.lit(False).alias("first"), "s")
    whole = few.select("g", F.lit(-1).alias("p"), F.lit(-1).alias("q"), "c", F.lit(True).alias("first"), "s")
    met = whole.unionByName(left).unionByName(right).groupBy("g", "p", "q").agg(F.collect_list(F.struct("c", "first", "s")).alias("x")).select((F.col("p") < 0).alias("whole"), "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole, x in zip(*batch.columns):
                rows = x.values
                c, first = rows.field("c").to_numpy(), rows.field("first").to_numpy(zero_copy_only=False)
                if len(c) < 2 or not whole.as_py() and first.all():
                    continue
                root = set_links([_fp(v.values) for v in rows.field("s")], None if whole.as_py() else first, similarity)
                hit = np.nonzero(c != c[root])[0]
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(c[hit]), pa.array(c[root[hit]])], ["u", "v"])

    return told.where("near AND c <> v").select(F.col("c").alias("u"), "v").unionByName(met.mapInArrow(run, "u long, v long"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = SIMILARITY, radius: int = WIDE_RADIUS) -> DataFrame:
    """The rows of ``docs`` to keep: of each component of similar texts the one of smallest id (a null id last; of rows with
    that id the one of smallest text hash, of wholly equal rows one). All columns stay.

    Texts are similar if the Jaccard similarity of their sets of shingles is ``similarity`` or more, told by the sets; null and
    wordless texts are alike; very long ones are read whole. Candidates are the components of sets whose 512-bit SimHashes are
    within ``radius`` and, of sets of :data:`SMALL` shingles or fewer, those that share one of their rarest shingles, by which all
    similar ones are met. An empty table gives no rows. Texts are shuffled twice: to make the candidates' sets anew, and to keep
    the chosen rows.
    """
    names = ["_no", "_id", "_h"]
    key = [
        F.col(id_col).isNull().alias("_no"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
        F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("_h"),
    ]
    marked = docs.select(F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("raw"), *key).alias("id"), F.col(text_col).cast("binary").alias("t"))
    schema = with_fields(marked.select("id").schema, "n long, fp binary, h binary, few array<long>")
    most = math.floor(SMALL / similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(len(h), wide_fingerprint(h), _class(h), h.view(np.int64) if len(h) <= most else None) for h in (shingle_hashes(x.as_py(), words) for x in b.column(1))]
            cols = [pa.array(list(v), t) for v, t in zip(zip(*found), (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())))] if found else []
            if found:
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], schema.names)

    rows = written(marked.mapInArrow(run, schema), "simhash-rows")
    each = rows.groupBy("h").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("few").alias("few"))
    # Numbers of classes are their own once the table is written, however its tasks were run.
    classes = written(each.drop("h").withColumn("c", F.monotonically_increasing_id()), "simhash-classes")
    likely = written(similar(classes, radius, similarity), "simhash-candidates")
    groups = components(likely, "simhash-groups").select(F.col("node").alias("c"), F.col("root").alias("g"))
    drop_written(likely)
    chosen = written(classes.join(groups, "c").select("c", "g", *(F.col(f"least.{k}").alias(k) for k in names)), "simhash-chosen")
    texts = docs.select(*key, F.col(text_col).cast("binary").alias("t")).join(chosen, names).select("c", "g", "t")

    def anew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array([shingle_hashes(x.as_py(), words).view(np.int64) for x in b.column(2)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], s], ["c", "g", "s"])

    near = texts.mapInArrow(anew, "c long, g long, s array<long>").dropDuplicates(["c"])
    small = classes.where("few IS NOT NULL AND n > 0")
    by_shingle = sharing(small, similarity).join(small.select("c", F.col("few").alias("s")), "c").select("c", F.xxhash64("g").alias("g"), "s")
    # Numbers of both kinds of groups are hashes; should two be equal, their sets are compared with one another too.
    edges = written(verified(written(near.withColumn("g", F.xxhash64(F.lit(1), "g")).unionByName(by_shingle), "simhash-likely"), similarity), "simhash-links")
    roots = components(edges, "simhash-components").select(F.col("node").alias("c"), "root")
    drop_written(edges)
    drop_written(chosen)
    best = classes.join(roots, "c", "left").groupBy(F.coalesce("root", "c").alias("root")).agg(F.min("least").alias("k"))
    keep = best.select(*(F.col(f"k.{n}").alias(n) for n in names))
    return unboxed(docs.select(boxed(docs), *key).join(keep, names, "left_semi").dropDuplicates(names))
