"""Run metrics: counters, percentiles by two rank rules, bounded samples, objectives and capacity."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.functions.codecs import mix32

# Fixed values of the sampling rules.
RING = 2000
RESERVOIR = 10_000
ROUNDS = ((0x9E3779B1, 16), (0x85EBCA6B, 13))
SUSTAINED = 0.95
#: Accuracy of the sketches that bracket a percentile: ranks are off by the SKETCH-th part of all at most.
SKETCH = 10_000


def nearest_rank(rows: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int]) -> DataFrame:
    """(*keys, n, p50, p95 ...): the value of rank ceil(p/100 * n) of the sorted values, exactly; nulls are no values."""
    return _ranked(rows, keys, value, {f"p{p}": (p / 100, lambda n, p=p: F.greatest(F.ceil(n * F.lit(p) / 100) - 1, F.lit(0))) for p in percents})


def floor_index(rows: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float]) -> DataFrame:
    """(*keys, n, *fractions): the value at index floor((n - 1) * f) of the sorted values, exactly; nulls are no values."""
    return _ranked(rows, keys, value, {k: (f, lambda n, f=f: F.floor((n - 1) * f)) for k, f in fractions.items()})


def _ranked(rows: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """Values at wanted indexes of each key's sorted values, whatever their number: ``wanted`` is (about which fraction, index of n).

    Sketches with a known error bracket each fraction in one map-side combined pass. What lies below a bracket is only counted;
    what lies in it is counted by distinct value, and running sums over these few find the index. So no task sorts a key's
    values. Keys with few values have no bracket and are ranked whole.
    """
    value_of = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    fine, slack = SKETCH, 4 / SKETCH
    near = [(name, F.percentile_approx("_v", [max(0.0, f - slack), min(1.0, f + slack)], fine)) for name, (f, _) in wanted.items()]
    about = value_of.groupBy(*keys).agg(F.count("*").alias("n"), *(c.alias(f"_{k}") for k, (_, c) in enumerate(near)))
    many = F.col("n") > 2 * SKETCH
    brackets = F.array(
        *(
            F.struct(
                F.lit(name).alias("name"), index(F.col("n")).cast("long").alias("at"),
                F.when(many & F.lit(f > slack), F.col(f"_{k}")[0]).alias("low"), F.when(many & F.lit(f < 1 - slack), F.col(f"_{k}")[1]).alias("high"),
            )
            for k, (name, (f, index)) in enumerate(wanted.items())
        )
    )
    asked = about.select(*(F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)), "n", brackets.alias("_b"))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(keys)), F.lit(True))
    met = value_of.join(F.broadcast(asked) if not keys else asked, same).select(*keys, "n", "_v", F.explode("_b").alias("b"))
    under = F.coalesce(F.col("_v") < F.col("b.low"), F.lit(False))
    inside = ~under & F.coalesce(F.col("_v") <= F.col("b.high"), F.lit(True))
    counted = met.where(under | inside).groupBy(*keys, "n", "b.name", "b.at", F.when(inside, F.col("_v")).alias("_v")).agg(F.count("*").alias("c"))
    by = ", ".join([*keys, "n", "name", "at"])
    upto = counted.selectExpr(*keys, "n", "name", "at", "_v", f"sum(c) OVER (PARTITION BY {by} ORDER BY _v NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto")
    picks = [F.min(F.when((F.col("name") == name) & (F.col("upto") > F.col("at")), F.col("_v"))).alias(name) for name in wanted]
    return upto.groupBy(*keys, "n").agg(*picks)


def ring_sample(rows: DataFrame, sequence: str, size: int = RING) -> DataFrame:
    """What a ring of ``size`` slots holds at the end: the last ``size`` rows."""
    return rows.orderBy(F.desc(sequence)).limit(size)


def reservoir_sample(rows: DataFrame, sequence: str, size: int = RESERVOIR) -> DataFrame:
    """(slot, *rows' columns): what a deterministic reservoir holds at the end.

    The first ``size`` rows (sequence from 0) take their own slots; a later one takes slot hash(sequence + 1) mod
    (sequence + 1), the hash signed, if that is a slot. The last row of each slot stays: one map-side combined maximum.
    """
    n = F.col(sequence).cast("long")
    slot = F.when(n < size, n).otherwise(mix32(n + 1, ROUNDS) % (n + 1))
    kept = rows.withColumn("slot", slot).where((F.col("slot") >= 0) & (F.col("slot") < size))
    return kept.groupBy("slot").agg(F.max_by(F.struct(*rows.columns), sequence).alias("r")).select("slot", "r.*")


def rate(count: Column, duration_ms: Column) -> Column:
    """Per second; 0 for no time."""
    return F.when(duration_ms == 0, 0.0).otherwise(count / (duration_ms / 1000))


def improvement(without: Column, having: Column) -> Column:
    """Percent by which ``having`` is under ``without``; null if either is, or for 0."""
    return F.try_divide(without - having, without) * 100


def objectives(report: DataFrame, read_p95: float, write_p95: float, error_percent: float) -> DataFrame:
    """``report`` (read_p95, write_p95, attempted, failed) with the error rate, three checks and passed; no value passes."""
    errors = F.when(F.col("attempted") == 0, 0.0).otherwise(F.col("failed") / F.col("attempted") * 100)
    ok = lambda c, limit: c.isNull() | (c <= limit)
    out = report.withColumn("error_percent", errors).withColumns(
        {"read_ok": ok(F.col("read_p95"), read_p95), "write_ok": ok(F.col("write_p95"), write_p95), "errors_ok": F.col("error_percent") <= error_percent}
    )
    return out.withColumn("passed", F.col("read_ok") & F.col("write_ok") & F.col("errors_ok"))


def capacity(stages: DataFrame) -> DataFrame:
    """One row from ``stages`` (stage, target, achieved, passed): the last sustained target and the first that was not."""
    held = F.col("passed") & (F.col("achieved") >= F.col("target") * SUSTAINED)
    return stages.agg(
        F.max_by(F.when(held, F.col("target")), F.when(held, F.col("stage"))).alias("sustained"),
        F.min_by(F.when(~held, F.col("target")), F.when(~held, F.col("stage"))).alias("first_unsustained"),
    )
