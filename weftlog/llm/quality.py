"""Quality by Bradley-Terry pairwise ranking.

A document's worth is linear in its features, and of two documents the better one wins with the logistic probability of
the difference of their worths. The weights are learnt from preference pairs (a document of label 1 over one of label 0)
by logistic loss on feature differences. A quantile of the learnt scores sets the threshold, and the worth is scaled so
that the threshold falls on a stated score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.llm.common import boxed, with_fields

#: Most labelled rows of either label that the fit sees: the first in seeded order.
SAMPLE = 4000
#: Preference pairs drawn from them.
PAIRS = 60_000
SEED = 7
#: The score at which the threshold falls.
CUT = 0.7
_CHUNK = 1 << 20
_SPACES = b" \t\n\r\x0b\x0c"


def features(text: bytes | None) -> np.ndarray:
    """Features of a text (UTF-8) in which no single word counts.

    Shares of byte classes and of single ASCII marks, shapes and lengths of words, repetition of words and lines, and (as the
    inverse root of the number of words) how short the text is. Memory is bounded by the text and one chunk.
    """
    text = text or b""
    hist = np.zeros(256, np.int64)
    for low in range(0, len(text), _CHUNK):
        hist += np.bincount(np.frombuffer(text[low : low + _CHUNK], np.uint8), minlength=256)
    solid = max(1, len(text) - int(sum(hist[c] for c in _SPACES)))
    upper, lower, digit = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum()
    words = text.split()
    n = max(1, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    twice = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    shout = sum(map(bytes.isupper, words))
    marks = np.array([hist[c] for c in range(33, 127) if not chr(c).isalnum()])
    dense = [
        upper / max(1, upper + lower), digit / solid, marks.sum() / solid, hist[128:].sum() / solid,
        hist[:32].sum() / max(1, len(text)) - hist[10] / max(1, len(text)), hist[10] / n, shout / n, twice / n,
        len(set(words)) / n**0.8, min(1.0, size.mean() / 20), min(1.0, size.std() / 20), (size > 25).mean(),
        len(set(lines)) / m, min(1.0, n / m / 50), float(not words), 1 / n**0.5,
    ]
    return np.concatenate([np.array(dense, np.float64), np.sqrt(marks / n)])


@dataclass(frozen=True)
class Ranking:
    """``score`` = logistic(logit(CUT) + scale * (worth - threshold)): over CUT exactly where the worth is over it."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float
    cut: float = CUT

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.log(self.cut / (1 - self.cut)) + self.scale * (self.worth(x) - self.threshold)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = SEED, cut: float = CUT, quantile: float | None = None, ridge: float = 1e-3) -> Ranking:
    """Bradley-Terry weights from pairs of rows of label 1 and 0, by Newton steps on the ridge logistic loss.

    ``quantile`` of the scores sets the threshold: scores of the sample, each label given half the weight. By default the
    quantile that parts the labels with the fewest errors. Without both labels every score is ``cut``.
    """
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    spread = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(x.shape[1])
    good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return Ranking(mean, spread, w, 0.0, 1.0, cut)
    rng = np.random.default_rng(seed)
    z = np.clip((x - mean) / spread, -8, 8)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        gradient = d.T @ (p - 1) / pairs + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    mass = np.where(y[order] == 1, 0.5 / len(good), 0.5 / len(bad))
    upto = np.cumsum(mass)
    if quantile is None:
        wrong = np.cumsum(np.where(y[order] == 1, mass, -mass))
        quantile = float(upto[int(wrong.argmin())])
    k = min(int(np.searchsorted(upto, quantile + 1e-12)), len(s) - 1)
    threshold = float((s[order[max(k - 1, 0)]] + s[order[k]]) / 2)
    gap = float(np.median(s[good]) - np.median(s[bad]))
    return Ranking(mean, spread, w, threshold, 8 / gap if gap > 0 else 1.0, cut)


def sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int, seed: int) -> DataFrame:
    """(t binary, y): at most 2 x ``most`` texts of labelled rows, of either label the first ``most`` in seeded order.

    Labels are cut before they meet the texts, so that what is broadcast has at most that many rows; rows that repeat an
    id are cut again afterwards.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).select(F.col(id_col).alias("_i"), F.col(label).cast("int").alias("y"))
    known = known.withColumn("o", F.xxhash64(F.lit(seed), "_i"))
    few = known.where("y = 1").orderBy("o", "_i").limit(most).unionByName(known.where("y = 0").orderBy("o", "_i").limit(most))
    met = docs.select(F.col(id_col).alias("_i"), F.col(text_col).cast("binary").alias("t")).join(F.broadcast(few), "_i")
    return met.select("_i", "o", "t", "y")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE, seed: int = SEED) -> Ranking:
    """Fit on a bounded, seeded sample of the labelled rows; only features reach the driver, at most 2 x ``most`` rows.

    Null and empty texts have features like any other; null ids and labels other than 0 and 1 are passed over; an id given
    twice counts twice, up to the bound; ties go by id, then by features. Without both labels every score is the cut.
    """
    width = len(features(b""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).astype(np.float32).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary()), b.column(3)], ["_i", "o", "x", "y"])

    met = sample(docs, labels, label, id_col, text_col, most, seed)
    schema = met.select("_i", "o", F.col("t").alias("x"), "y").schema
    rows = met.mapInArrow(run, schema).orderBy("o", "_i", "x").limit(2 * most).select("x", "y").collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float64).reshape(-1, width)
    return fit(x, np.array([r.y for r in rows]), seed=seed)


def score(docs: DataFrame, model: Ranking, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1): every whole text scored, null like empty.

    Very long texts are read in chunks; repeated rows score alike; an empty table gives no rows; a column of that name is
    replaced, others of any name stay.
    """
    sent = docs.select(boxed(docs, (name, text_col)), F.col(text_col).cast("string").alias("_text"))
    schema = with_fields(sent.schema, "_score double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1).cast(pa.binary())]).reshape(b.num_rows, -1)
            s = shared.value.score(x) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], schema.names)

    kept_names = [c for c in docs.columns if c != name]
    texts = {text_col: F.col("_text").alias(text_col)}
    return sent.mapInArrow(run, schema).select(*(texts.get(c, F.col(f"_row.`{c}`")) for c in kept_names), F.col("_score").alias(name))


def kept(docs: DataFrame, labels: DataFrame, train_on: Column | None = None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose score is ``cut`` or more, all columns as they were.

    ``train_on`` restricts the labelled rows that are learnt from. Null and empty texts are scored like any other;
    without labels of both kinds every row stays; an empty table gives no rows.
    """
    model = train(docs, labels if train_on is None else labels.where(train_on), label, id_col, text_col)
    name = "_score"
    while name in docs.columns:
        name += "_"
    return score(docs, model, text_col, name).where(F.col(name) >= cut).drop(name)
