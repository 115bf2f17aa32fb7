"""Embedding near-duplicates and nearest neighbours: against brute force and on edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_texts import grouped
from weftlog.llm import embeddings, neighbours

RNG = np.random.default_rng(4)


def near(x: np.ndarray, cos: float) -> np.ndarray:
    noise = RNG.normal(size=x.shape)
    x = x / np.linalg.norm(x)
    noise -= noise @ x * x
    return cos * x + math.sqrt(1 - cos * cos) * noise / np.linalg.norm(noise)


def table() -> list[tuple[int, list[float]]]:
    base = RNG.normal(size=(300, 24))
    rows = list(base)
    rows += [base[0] * k for k in (1, 1, 2, 0.5)]  # copies, some scaled
    rows += [near(base[k], c) for k, c in enumerate(np.linspace(0.86, 0.999, 80))]
    rows += [near(base[5], 0.99) for _ in range(60)]
    return [(k * 10, [float(np.float32(v)) for v in r]) for k, r in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return table()


@pytest.fixture(scope="module")
def frame(spark, rows):
    odd = [(7, None), (8, [0.0] * 24), (9, [float("nan")] * 24), (11, [float("inf")] + [1.0] * 23), (12, [None] + [1.0] * 23), (None, [1.0] * 24)]
    return spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, v string")


@pytest.mark.parametrize(("bucket", "tile", "held"), [(8, 1024, 8192), (1024, 32, 8192), (1024, 8, 16)])
def test_near_duplicates_equal_brute_force(spark, rows, frame, bucket, tile, held):
    x = np.array([r[1] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    at = {i: k for k, (i, _) in enumerate(rows)}
    want = grouped({i: i for i in at}, lambda a, b: cos[at[a], at[b]] >= 0.9)
    got = {r.id: r for r in embeddings.near_duplicates(frame, bucket=bucket, tile=tile, held=held).collect()}
    links = {i: int((cos[k] >= 0.9).sum()) - 1 for i, k in at.items()}
    total = sum(links.values())
    found = sum(got[i].n_links for i in at)
    assert all(got[i].n_links <= links[i] for i in at)
    assert found >= 0.99 * total
    if found == total:
        assert {i: got[i].component for i in at} == want
    assert all(got[i].kept == (got[i].component == i) for i in at)
    for i in (7, 8, 9, 11, 12):
        assert (got[i].n_links, got[i].component, got[i].kept) == (0, i, True)
    assert not got[None].kept


def test_empty_vectors_and_repeated_ids(spark, frame):
    assert embeddings.near_duplicates(frame.limit(0)).collect() == []
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.id, r.n_links, r.component) for r in embeddings.near_duplicates(twice).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_blocks_without_vectors():
    lsh, x = embeddings.CrossPolytope(8, 2, 1), embeddings.unit(RNG.normal(size=(5, 8)))
    block = embeddings._Block(lsh, 2, 0.9, 4, 0, 0)
    out = [*block.past(np.arange(5), np.ones(5, np.int64), x), *block.closed()]
    assert all(b.num_rows == 0 for b in out)


def test_hadamard_keeps_lengths():
    x = RNG.normal(size=(7, 32))
    y = embeddings.hadamard(x)
    assert np.allclose((y * y).sum(1), (x * x).sum(1)) and np.allclose(embeddings.hadamard(y), x)


REACHED = [(24, 0.9, 4), (64, 0.9, 4), (64, 0.8, 4), (384, 0.9, 3), (1024, 0.9, 3), (1024, 0.8, 2)]


@pytest.mark.parametrize(("width", "threshold", "rotations"), [(w, t, r) for w, t, most in REACHED for r in range(1, most + 1)])
def test_reach_of_tables_and_probes(width, threshold, rotations):
    """Pairs at just the threshold, other ones than those that tables and probes are chosen by."""
    tables, probes = embeddings.reach(width, rotations, threshold)
    lsh = embeddings.CrossPolytope(embeddings.padded(width), tables, rotations)
    pairs = 600 if width < 500 else 200
    x = embeddings.unit(RNG.normal(size=(pairs, width)))
    y = np.array([near(v, threshold) for v in x])
    same = (lsh.buckets(x, probes)[:, :, :, None] == lsh.buckets(y, probes)[:, :, None, :]).any((1, 2, 3))
    print("reach", width, threshold, rotations, tables, probes, same.mean())
    assert same.mean() >= 0.98


def test_reach_of_one_dimension():
    assert embeddings.reach(1, 1, 0.9)[0] == 1


def test_neighbours_recall_and_order(spark, rows, frame):
    indexed, model = neighbours.index(frame)
    out = neighbours.search(indexed, model, F.col("id") % 50 == 0, chunk=20).collect()
    x = {i: np.array(v) for i, v in rows}
    score = lambda a, b: float(x[a] @ x[b] / math.sqrt((x[a] @ x[a]) * (x[b] @ x[b])))
    hits = total = 0
    for q in [i for i in x if i % 50 == 0]:
        got = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [r for r, _, _ in got] == [1, 2, 3, 4, 5] and all(v != q for _, v, _ in got)
        assert [s for _, _, s in got] == pytest.approx([score(q, v) for _, v, _ in got], abs=1e-12)
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        best = sorted((score(q, i) for i in x if i != q), reverse=True)[4]
        hits += sum(s >= best - 1e-12 for _, _, s in got)
        total += 5
    assert hits / total >= 0.95


def test_neighbours_of_few_rows(spark, frame):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [0.0, 2.0]), (2, [0.0, 1.0]), (4, None)], "vec_id long, embedding array<float>")
    indexed, models = neighbours.index(few)
    out = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(indexed, models, F.col("id") % 50 == 0).collect())
    assert out == [(0, 1, 2, 0.0), (0, 2, 3, 0.0)]
    none, models = neighbours.index(frame.limit(0))
    assert models == {} and neighbours.search(none, models, F.lit(True)).collect() == []


def exact(rows: dict[int, np.ndarray], queries: list[int], k: int = 5) -> dict[int, list[tuple[int, float]]]:
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    u = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = u[np.searchsorted(ids, queries)] @ u.T
    return {q: [(int(ids[j]), c[j]) for j in np.lexsort((ids, -c)) if ids[j] != q][:k] for q, c in zip(queries, cos)}


def found_by(out) -> dict[int, list[tuple[int, float]]]:
    got: dict[int, list[tuple[int, float]]] = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


@pytest.mark.parametrize("scale", [1.0, 1e60, 1e-200])
def test_neighbours_keep_doubles(spark, scale):
    """Small enough that each is compared with all: scores are those of the given doubles, of any magnitude."""
    rng = np.random.default_rng(21)
    x = {k: rng.normal(size=9) * scale for k in range(70)}
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in x.items()], "vec_id long, embedding array<double>")
    got = found_by(neighbours.search(*neighbours.index(frame), F.col("id") % 10 == 0).collect())
    for q, want in exact(x, list(range(0, 70, 10))).items():
        assert [v for v, _ in got[q]] == [v for v, _ in want]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=1e-12, rel=0)


def test_neighbours_of_every_width(spark):
    rng = np.random.default_rng(22)
    x = {k: rng.normal(size=4 if k % 3 else 6) for k in range(60)}
    frame = spark.createDataFrame([(k, v.tolist(), "o") for k, v in x.items()], "vec_id long, embedding array<float>, v string")
    indexed, models = neighbours.index(frame)
    assert sorted(models) == [4, 6] and indexed.count() == 60
    got = found_by(neighbours.search(indexed, models, F.col("id") % 5 == 0, chunk=2).collect())
    for width in (4, 6):
        same = {k: v.astype(np.float32).astype(float) for k, v in x.items() if len(v) == width}
        for q, want in exact(same, [k for k in same if k % 5 == 0]).items():
            assert [v for v, _ in got[q]] == [v for v, _ in want]
    assert set(got) == {k for k in x if k % 5 == 0}


def test_repeated_rows_leave_room_for_others(spark):
    """More repeats of one row than the exact ranking of a block sees."""
    rng = np.random.default_rng(23)
    x = {k: rng.normal(size=8) for k in range(40)}
    x[1] = x[0] * 2
    rows = [(k, v.tolist()) for k, v in x.items()] + [(1, x[1].tolist())] * 300
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = found_by(neighbours.search(*neighbours.index(frame), F.col("id") == 0).collect())
    assert [v for v, _ in got[0]] == [v for v, _ in exact(x, [0])[0]]


@pytest.mark.parametrize("width", [64, 384])
def test_neighbours_recall_in_whole_blocks(spark, width):
    """Blocks of 4096 rows, of which 80 are ranked exactly; clusters of several sizes and lone vectors."""
    rng = np.random.default_rng(width)
    centre = rng.normal(size=(600, width))
    x = np.concatenate([centre[rng.integers(0, 600, 6000)] + rng.normal(size=(6000, width)) * rng.uniform(0.2, 1.5, (6000, 1)), rng.normal(size=(6288, width))]).astype(np.float32)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = found_by(neighbours.search(*neighbours.index(frame, sample=4096), F.col("id") % 50 == 0, chunk=100).collect())
    want = exact(dict(enumerate(x.astype(float))), list(range(0, len(x), 50)))
    recall = np.mean([len({v for v, _ in got[q]} & {v for v, _ in best}) / 5 for q, best in want.items()])
    print("recall", width, recall)
    assert recall >= 0.97


def test_anisotropic_codes_favour_inner_products():
    x = embeddings.unit(RNG.normal(size=(2000, 16)))
    plain, aware = neighbours.fit(x, eta=1.0), neighbours.fit(x, eta=4.0)

    def parallel(q):
        code = q.encode(x)
        back = q.books[np.arange(len(q.books))[None], code].reshape(len(x), -1)
        return np.abs(((x - back) * x).sum(1)).mean()

    assert parallel(aware) < parallel(plain)
    lut = aware.tables(x[:3])
    code = aware.encode(x[:50])
    packed = aware.packed(x[:50])
    back = aware.books[np.arange(len(aware.books))[None], code].reshape(50, -1)
    scanned = sum(lut[:, s].take(packed[:, s], axis=1) for s in range(packed.shape[1]))
    assert np.allclose(scanned, x[:3] @ back.T, atol=1e-5)
