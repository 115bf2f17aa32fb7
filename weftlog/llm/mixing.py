"""Mixing sources to target weights by capped water-filling, all in DataFrame functions.

A source's target is its weight's share of the budget, clamped at a maximum number of epochs; what a clamped source
cannot take is dealt to the others by weight, until no source is above its clamp. The end of that iteration has a
closed form over the sources in order of clamp by weight, which is what is computed here. Documents are then taken
floor(epochs) times each, and a seeded part of them once more so that the source's words come to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.llm.common import SPACE, boxed, unboxed, written

EPOCHS = 3.0
SEED = 20
#: Documents of a source that are drawn from together, about.
CELL = 4096
#: Copies of one row that a task makes at a time.
_COPIES = 1 << 16


def word_count(text: Column) -> Column:
    """Number of maximal runs outside ASCII white space; null has none."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.coalesce(F.length(F.regexp_replace(bare, f"[^{SPACE}]+[{SPACE}]*", "x")), F.lit(0)).cast("long")


def water_filled(sources: DataFrame, epochs: float = EPOCHS, budget: Column | None = None) -> DataFrame:
    """``sources`` (source, weight double, total long: one row each) with target double.

    ``budget`` is a Column over all sources' sums (by default the sum of ``total``). Weights must not be negative; a
    source of weight 0 or total 0 has target 0, and where every source is clamped the budget is not reached. The
    sources are met in one ordered pass: they are as many as there are names, not rows of the corpus.
    """
    s = sources.withColumn("cap", F.lit(float(epochs)) * F.col("total"))
    s = s.withColumn("live", (F.col("weight") > 0) & (F.col("cap") > 0))
    everything = "OVER ()"
    s = s.withColumn("ratio", F.when(F.col("live"), F.col("cap") / F.col("weight")))
    s = s.withColumn("_b", budget if budget is not None else F.expr(f"CAST(sum(total) {everything} AS double)"))
    s = s.withColumn("_w", F.expr(f"sum(IF(live, weight, 0D)) {everything}"))
    before = "OVER (ORDER BY ratio NULLS LAST, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    s = s.withColumn("_c", F.expr(f"sum(IF(live, cap, 0D)) {before}") - F.when(F.col("live"), F.col("cap")).otherwise(0.0))
    s = s.withColumn("_v", F.expr(f"sum(IF(live, weight, 0D)) {before}") - F.when(F.col("live"), F.col("weight")).otherwise(0.0))
    # The level at which this source and those of larger ratio share what the smaller ones, clamped, leave; the first
    # source that its level does not clamp gives the one that holds.
    s = s.withColumn("_level", F.when(F.col("live"), F.expr("try_divide(_b - _c, _w - _v)")))
    s = s.withColumn("_final", -F.expr(f"min(IF(_level <= ratio, struct(ratio, -_level), NULL)) {everything}")["col2"])
    target = F.when(~F.col("live"), 0.0).when(F.col("_final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("_final")))
    return s.withColumn("target", target).select(*sources.columns, "target")


def ranked_weights(totals: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """``totals`` (source, ...: one row each) with weights that repeat ``cycle`` over the sources in code-point order, null last."""
    rank = F.expr("row_number() OVER (ORDER BY source NULLS LAST) - 1")
    return totals.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), F.pmod(rank, F.lit(len(cycle))).cast("int") + 1))


def mix(docs: DataFrame, weights: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """How often each row is taken: (id, source, size, source_size, target, times long, taken long).

    ``weights``: (source, weight), a null source meeting null; a source without one has weight 0. By default the sources
    weigh 1, 2, 3 in turn. The budget is the sum of all sizes. ``times`` is floor(target / source_size) for every row
    of a source, and one more for those drawn for the fraction: rows are put into seeded cells of about 4096, and of each
    cell the first rows in seeded order are drawn while their words fit its share; the gap before the row that would
    have passed it is filled by later rows that fit there, and what then is left to the nearest half row. So a hot source is drawn in
    many tasks, and reruns agree; rows equal in id, source and text are drawn together, counted before they are shuffled.

    Null and empty texts have size 0, very long ones are read whole; null ids and sources are kept; repeated rows each count;
    columns of other names are not read; an empty table gives no rows. Texts never leave their task: only sizes and hashes
    are written and shuffled.
    """
    out = drawn(sizes(docs, id_col, text_col, source_col, seed), weights, epochs)
    # A row's copies are made in portions, dealt over all tasks.
    portions = out.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / _COPIES)))).repartition("h", "_p")
    left = F.least(F.col("copies") - F.col("_p") * _COPIES, F.lit(_COPIES))
    return portions.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), left))).drop("h", "copies", "_p", "_k")


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """A written table (id, source, size, h) of every row: what it is drawn by."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
    )
    return written(rows, "mixing-sizes")


def drawn(rows: DataFrame, weights: DataFrame | None = None, epochs: float = EPOCHS) -> DataFrame:
    """The same from ``rows`` (id, source, size, h), one row for all that are equal, with their number ``copies``."""
    rows = rows.groupBy("id", "source", "size", "h").agg(F.count("*").alias("copies")).withColumn("words", F.col("size") * F.col("copies"))
    totals = rows.groupBy("source").agg(F.sum("words").alias("total"), F.count("*").alias("n"))
    if weights is None:
        weighed = ranked_weights(totals)
    else:
        given = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        weighed = totals.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    plan = water_filled(weighed, epochs).select(
        F.col("source").alias("_s"), F.col("total").alias("source_size"), "target", F.ceil(F.col("n") / CELL).alias("cells"),
        F.expr("coalesce(try_divide(target, total), 0D)").alias("epochs"),
    )
    known = rows.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    cells = known.withColumn("cell", F.pmod(F.shiftright("h", 20), F.col("cells")))
    cell, order = "PARTITION BY source, cell", "ORDER BY h, id, size"
    cells = cells.selectExpr("*", f"(epochs - floor(epochs)) * sum(words) OVER ({cell}) AS gap", "false AS once")
    for half in (0, 0, 2):
        fits = f"(NOT once AND size > 0 AND words <= {half or 1} * gap)"
        cells = cells.selectExpr("*", f"{fits} AS fits", f"sum(IF({fits}, words, 0)) OVER ({cell} {order}) AS upto")
        cells = cells.withColumn("now", F.expr(f"fits AND upto - IF({half} > 0, words / 2, 0) <= gap"))
        cells = cells.withColumn("gap", F.expr(f"gap - max(IF(now, upto, 0)) OVER ({cell})"))
        cells = cells.withColumn("once", F.col("once") | F.col("now")).drop("fits", "upto", "now")
    times = (F.floor("epochs") + F.col("once").cast("long")).cast("long")
    return cells.withColumn("times", times).select(
        "id", "source", "h", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), "copies"
    )


def mixed(docs: DataFrame, weights: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all columns kept.

    A row drawn no time is absent; wordless rows are taken the whole number of times. Nulls, repeated rows and empty
    tables as in :func:`mix`. The plan has one row for all that are equal, so that the join multiplies nothing, and many equal
    rows can be split over tasks (adaptive skew join).
    """
    key = {
        "_i": F.coalesce(F.col("id").cast("string"), F.lit("")),
        "_in": F.col("id").isNull(),
        "_s": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "_sn": F.col("source").isNull(),
    }
    plan = drawn(sizes(docs, id_col, text_col, source_col, seed), weights, epochs).where("times > 0")
    plan = plan.select(*(c.alias(k) for k, c in key.items()), F.col("h").alias("_h"), F.col("times").alias("_times"))
    keyed = docs.select(
        boxed(docs),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_i"),
        F.col(id_col).isNull().alias("_in"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_s"),
        F.col(source_col).isNull().alias("_sn"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_h"),
    )
    out = keyed.join(plan, ["_i", "_in", "_s", "_sn", "_h"])
    return unboxed(out.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))))
