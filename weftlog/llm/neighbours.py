"""Approximate nearest neighbours by score-aware (anisotropic) quantisation.

Residual error parallel to a vector changes its inner products with the queries that matter; error across it hardly
does. Codebooks and codes minimise a loss that weighs the parallel part more (Guo et al., "Accelerating Large-Scale
Inference with Anisotropic Vector Quantization", 2020). Codes have four bits for two dimensions; a scan adds up table
entries, two codes at a time, and the best of each block are ranked again by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.llm.common import folder, with_fields, written
from weftlog.llm.embeddings import _matrix, unit, valid

#: Rows that the codebooks are fitted on, at most: the first in seeded order. Every row is encoded.
SAMPLE = 16_384
SEED = 8
CODES = 16
#: Weight of the parallel residual against the rest.
ETA = 4.0
#: Rows of a block that exact ranking sees, for each query, and ties with the last of them.
RERANK = 80
#: Queries that are broadcast at once, about.
CHUNK = 16_384
_BLOCK = 4096
_QUERIES = 512
#: Numbers that tables of a run of queries, and gathered components, hold at once.
_HELD = 1 << 22


@dataclass(frozen=True)
class Quantizer:
    """Codebooks (sub-spaces, 16, 2) over vectors padded to an even width."""

    books: np.ndarray
    eta: float = ETA

    def _split(self, x: np.ndarray) -> np.ndarray:
        m = len(self.books)
        wide = np.zeros((len(x), 2 * m))
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), m, 2)

    def encode(self, x: np.ndarray, sweeps: int = 2, start: np.ndarray | None = None) -> np.ndarray:
        """Codes (rows, sub-spaces) by coordinate descent on the anisotropic loss of unit vectors."""
        parts = self._split(x)
        books = self.books
        error = ((parts[:, :, None] - books[None]) ** 2).sum(3)
        along = (parts[:, :, None] * (parts[:, :, None] - books[None])).sum(3)
        code = error.argmin(2) if start is None else start.copy()
        rows = np.arange(len(x))
        total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for m in range(len(books)):
                rest = total - along[rows, m, code[:, m]]
                loss = error[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2
                code[:, m] = loss.argmin(1)
                total = rest + along[rows, m, code[:, m]]
        return code.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For unit queries: (queries, pairs of sub-spaces, 256) sums of two codes' inner products."""
        one = np.einsum("qmd,mkd->qmk", self._split(q), self.books).astype(np.float32)
        if one.shape[1] % 2:
            one = np.concatenate([one, np.zeros((len(q), 1, CODES), np.float32)], 1)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), -1, CODES * CODES)

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Two codes to a byte: (rows, pairs of sub-spaces)."""
        code = self.encode(x)
        if code.shape[1] % 2:
            code = np.concatenate([code, np.zeros((len(x), 1), np.uint8)], 1)
        return code[:, 0::2] * np.uint8(CODES) + code[:, 1::2]


def fit(x: np.ndarray, eta: float = ETA, rounds: int = 8, seed: int = SEED) -> Quantizer:
    """Codebooks from unit vectors: plain k-means in each sub-space, then rounds on the anisotropic loss."""
    rng = np.random.default_rng(seed)
    m = -(-x.shape[1] // 2)
    parts = Quantizer(np.zeros((m, CODES, 2)))._split(x)
    books = parts[rng.integers(len(x), size=CODES)].transpose(1, 0, 2) + rng.normal(0, 1e-3, (m, CODES, 2))
    for _ in range(10):
        code = ((parts[:, :, None] - books[None]) ** 2).sum(3).argmin(2)
        for s in range(m):
            n = np.bincount(code[:, s], minlength=CODES)
            for k in range(2):
                mean = np.bincount(code[:, s], parts[:, s, k], CODES) / np.maximum(n, 1)
                books[s, :, k] = np.where(n > 0, mean, books[s, :, k])
    code = None
    for _ in range(rounds):
        code = Quantizer(books, eta).encode(x, 1, code)
        chosen = books[np.arange(m)[None], code]
        along = (parts * (parts - chosen)).sum(2)
        total = along.sum(1)
        for s in range(m):
            p, k = parts[:, s], code[:, s]
            rest = total - along[:, s]
            for c in range(CODES):  # least squares for one codeword, the others held
                own = p[k == c]
                if not len(own):
                    continue
                a = len(own) * np.eye(2) + (eta - 1) * own.T @ own
                b = own.sum(0) + (eta - 1) * (own * ((own * own).sum(1) + rest[k == c])[:, None]).sum(0)
                books[s, c] = np.linalg.solve(a, b)
            along[:, s] = (p * (p - books[s, k])).sum(1)
            total = rest + along[:, s]
    return Quantizer(books, eta)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, exactly, so that their largest component is 1/2 to 1 and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _ranked(i: np.ndarray, j: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query row, id, score) of the k best pairs (i, j) of each query row by exact cosine; equal ids and scores count once."""
    norm_q, norm_x = (np.sqrt((m * m).sum(1)) for m in (q, x))
    step = max(1, _HELD // x.shape[1])
    score = np.concatenate([np.zeros(0), *((x[j[a : a + step]] * q[i[a : a + step]]).sum(1) for a in range(0, len(i), step))])
    return _first(i, ids[j], score / (norm_x[j] * norm_q[i]), k)


def _first(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])
    row, ids, score = row[new], ids[new], score[new]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], score[keep]


def _best(q_id: np.ndarray, q: np.ndarray, lut: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, ...]:
    """(query row, id, score) of the k best of a block for each query: table scan, then exact cosine.

    A query that finds fewer than k, since rows repeat, is compared with the whole block.
    """
    sums = np.zeros((len(q), len(x)), np.float32)
    for s in range(codes.shape[1]):
        sums += lut[:, s].take(codes[:, s], axis=1)
    least = np.partition(sums, len(x) - rerank, axis=1)[:, len(x) - rerank] if len(x) > rerank else np.full(len(q), -np.inf)

    def of(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        other = ids[j] != q_id[i]
        return _ranked(i[other], j[other], q, x, ids, k)

    found = of(*np.nonzero(sums >= least[:, None]))
    few = np.nonzero(np.bincount(found[0], minlength=len(q)) < k)[0]
    if len(few) and len(x) > rerank:
        more = of(np.repeat(few, len(x)), np.tile(np.arange(len(x)), len(few)))
        found = _first(*(np.concatenate(c) for c in zip(found, more)), k)
    return found


def index(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, seed: int = SEED) -> tuple[DataFrame, dict[int, Quantizer]]:
    """A written table (id, d int, v array<double>, code binary) of every usable row, and a quantizer for each width d.

    A quantizer is fitted on ``sample`` rows of its width at most; every row is encoded. Vectors that are null, zero or
    hold null or non-finite components, and null ids, are left out; repeated rows stay; other columns are not read; an
    empty table gives no rows and no quantizer. Floats are widened, doubles kept as they are, of any magnitude.
    """
    good = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.expr(f"id IS NOT NULL AND {valid('v')}"))
    good = good.select("id", F.size("v").alias("d"), F.col("v").cast("array<double>").alias("v"))
    models: dict[int, Quantizer] = {}
    coded = None
    for width in sorted(r.d for r in good.select("d").distinct().collect()):
        own = good.where(F.col("d") == width)
        few = own.orderBy(F.xxhash64(F.lit(seed), "id"), "id", "v").limit(sample).select("v").toArrow().column(0).combine_chunks()
        models[width] = fit(unit(_matrix(few)), seed=seed)

        def run(batches: Iterator[pa.RecordBatch], model: Quantizer = models[width]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for low in range(0, whole.num_rows, 1024):
                    b = whole.slice(low, 1024)
                    code = model.packed(unit(_matrix(b.column(2))))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in code], pa.binary())], ["id", "d", "v", "code"])

        part = own.mapInArrow(run, with_fields(good.schema, "code binary"))
        coded = part if coded is None else coded.unionByName(part)
    return written(good.withColumn("code", F.lit(b"")) if coded is None else coded, "ann-index"), models


def search(indexed: DataFrame, models: dict[int, Quantizer], queries: Column, k: int = 5, rerank: int = RERANK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each indexed row for which ``queries`` (of id and v) holds,
    among the rows of its width.

    Queries are written to the shared folder and met in rounds of about ``chunk``: a round is broadcast, each task scans its rows
    once and keeps k for each query, a window ranks what the tasks kept, the result is written and the broadcast destroyed
    before the next, so that neither driver nor executors hold more than one. Rows of the query's id are its own and no
    candidates; rows equal in id and vector count once; ties go to the smaller id; fewer candidates than k all come.
    """
    spark = indexed.sparkSession
    out = f"{folder(spark, 'ann-found')}/part="
    asked = written(indexed.where(queries).select("id", "d", "v").distinct(), "ann-queries")
    rounds = {r.d: -(-r.n // chunk) for r in asked.groupBy("d").agg(F.count("*").alias("n")).collect()}
    rank = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"
    ranked = lambda df: df.distinct().selectExpr("query_id", "vec_id", "score", f"{rank} AS rank").where(F.col("rank") <= k)
    for width, number in rounds.items():
        own, rows = asked.where(F.col("d") == width), indexed.where(F.col("d") == width)
        block = max(8, min(_QUERIES, _HELD // (-(-width // 4) * CODES * CODES)))
        for r in range(number):
            part = own.where(F.pmod(F.xxhash64("id", "v"), F.lit(number)) == r).orderBy("id", "v").select("id", "v").toArrow().combine_chunks()
            if not part.num_rows:
                continue
            held = spark.sparkContext.broadcast((part.column(0).to_numpy(), _matrix(part.column(1).combine_chunks()), models[width]))

            def run(batches: Iterator[pa.RecordBatch], held=held, block: int = block) -> Iterator[pa.RecordBatch]:
                q_id, q, quantizer = held.value
                q_unit, q = unit(q), _scaled(q)
                # Tables of few queries are made once, those of many for each block of rows.
                luts = quantizer.tables(q_unit) if len(q) <= block else None
                best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                for whole in batches:
                    for low in range(0, whole.num_rows, _BLOCK):
                        b = whole.slice(low, _BLOCK)
                        ids, x = b.column(0).to_numpy(), _scaled(_matrix(b.column(1)))
                        codes = np.array([np.frombuffer(c.as_py(), np.uint8) for c in b.column(2)])
                        runs = [best]
                        for a in range(0, len(q), block):
                            lut = luts if luts is not None else quantizer.tables(q_unit[a : a + block])
                            i, j, s = _best(q_id[a : a + block], q[a : a + block], lut, ids, x, codes, k, rerank)
                            runs.append((i + a, j, s))
                        best = _first(*(np.concatenate(c) for c in zip(*runs)), k)
                if len(best[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(q_id[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "vec_id", "score"])

            found = rows.select("id", "v", "code").mapInArrow(run, "query_id long, vec_id long, score double")
            ranked(found).select("query_id", "vec_id", "score").write.parquet(f"{out}{width}-{r}")
            held.destroy()
    if not rounds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    whole = spark.read.schema("query_id long, vec_id long, score double").parquet(*(f"{out}{d}-*" for d in rounds))
    return ranked(whole).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
