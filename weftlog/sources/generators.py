"""Deterministic workloads as DataFrames over ``spark.range``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the workloads: multipliers and shares.
SEED_FACTOR, WORKER_FACTOR, OPERATION_FACTOR = 31, 17, 13
HTTP_SEED_FACTOR, HTTP_OPERATION_FACTOR = 31, 17
HOT_PERCENT = 75
PHASES = (("off-peak", 0.1, 0.2), ("peak", 0.8, 0.6), ("cool-down", None, None))


def direct_plan(spark: SparkSession, seed: int, workers: int, operations: int, append_percent: int, hot: int, streams: int) -> DataFrame:
    """(worker_id, operation_index, append, stream_index, stream_id, token) of every operation of every worker."""
    n = spark.range(workers * operations).select((F.col("id") / operations).cast("long").alias("worker_id"), (F.col("id") % operations).alias("operation_index"))
    value = F.abs(F.lit(seed * SEED_FACTOR) + F.col("worker_id") * WORKER_FACTOR + F.col("operation_index") * OPERATION_FACTOR)
    n = n.withColumn("value", value)
    cold = streams - hot
    some_hot = (F.lit(hot > 0) & (F.col("value") % 100 < HOT_PERCENT)) | F.lit(cold == 0)
    index = F.when(some_hot, F.col("value") % max(1, hot)).otherwise(hot + F.col("value") % max(1, cold))
    return n.select(
        "worker_id", "operation_index", (F.col("value") % 100 < append_percent).alias("append"), index.alias("stream_index"),
        F.concat(F.lit("load-test-stream-"), index).alias("stream_id"),
        F.concat_ws(":", F.lit("live"), F.lit(seed), "worker_id", "operation_index").alias("token"),
    )


def http_plan(spark: SparkSession, seed: int, operations: int, users: int, per_user: int, read_percent: int) -> DataFrame:
    """(operation_index, kind, user_index, slot, amount, token): the daily profile, one account for each user."""
    n = spark.range(operations).withColumnRenamed("id", "operation_index")
    value = F.abs(F.lit(seed * HTTP_SEED_FACTOR) + F.col("operation_index") * HTTP_OPERATION_FACTOR)
    turn = F.floor(F.col("operation_index") / users)
    user = (F.col("operation_index") % users + seed) % users
    reads = int(per_user * read_percent / 100 + 0.5)
    slot = (turn + user) % per_user
    return n.select(
        "operation_index", F.when(slot < reads, "read").otherwise("deposit").alias("kind"), user.alias("user_index"), slot.alias("slot"),
        (1 + value % 10).alias("amount"), F.concat_ws(":", F.lit("http"), F.lit(seed), "operation_index").alias("token"),
    )


def retry_delay_ms(operation: Column, retry: Column) -> Column:
    """Exponential from 5 to 50 ms, and a jitter under 10 ms that the operation and retry give."""
    return F.least(F.lit(50.0), 5 * F.pow(2.0, retry)).cast("long") + (operation * 17 + retry * 13) % 10


def paced(phases: DataFrame) -> DataFrame:
    """(name, operation_index, due_ms): when each request of ``phases`` falls due at its rate, phases one after the other, whatever
    the answers take (an open loop)."""
    begin = phases.selectExpr("*", "coalesce(sum(duration_ms) OVER (ORDER BY request_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_ms")
    each = begin.where("request_count > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("request_count") - 1)))
    return each.select("name", (F.col("request_offset") + F.col("k")).alias("operation_index"), (F.col("begin_ms") + F.col("k") * 1000 / F.col("target")).alias("due_ms"))


def daily_phases(spark: SparkSession, requests: int, seconds: int) -> DataFrame:
    """(name, request_offset, request_count, duration_ms, target): the last phase takes what the others leave."""
    ms, rows, offset, spent = seconds * 1000, [], 0, 0
    for name, share, time in PHASES:
        count = requests - offset if share is None else int(requests * share)
        long = ms - spent if time is None else int(ms * time)
        rows.append((name, offset, count, long, count / (long / 1000) if long else None))
        offset, spent = offset + count, spent + long
    return spark.createDataFrame(rows, "name string, request_offset long, request_count long, duration_ms long, target double")


def capacity_phases(spark: SparkSession, first: int, last: int, step: int, seconds: int) -> DataFrame:
    """A stage for each target rate from first to last."""
    rows, offset = [], 0
    for target in range(first, last + 1, step):
        rows.append((f"capacity-{target}-rps", offset, target * seconds, seconds * 1000, float(target)))
        offset += target * seconds
    return spark.createDataFrame(rows, "name string, request_offset long, request_count long, duration_ms long, target double")


def seed_history(spark: SparkSession, seed: int, accounts: int, events: int) -> DataFrame:
    """(account_index, event_index, event_type, amount, token): an opening and deposits of 1 for every account."""
    n = spark.range(accounts * events)
    event = F.col("id") % events
    return n.select(
        F.floor(F.col("id") / events).alias("account_index"), event.alias("event_index"),
        F.when(event == 0, "AccountOpened").otherwise("MoneyDeposited").alias("event_type"), F.when(event == 0, 0).otherwise(1).alias("amount"),
        F.concat_ws(":", F.lit("seed"), F.lit(seed), F.floor(F.col("id") / events), event).alias("token"),
    )


def live_events(spark: SparkSession, plan: DataFrame, batch: int) -> DataFrame:
    """An event for each append of ``plan`` and place in its batch: what a finished run must hold."""
    return plan.where("append").withColumn("event_index", F.explode(F.sequence(F.lit(0), F.lit(batch - 1)))).select(
        "stream_id", "worker_id", "operation_index", "event_index", F.concat_ws(":", "token", "event_index").alias("token")
    )
