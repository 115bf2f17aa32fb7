"""Logs derived from plain tables: each user's, conversation's or order's rows as one stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.sources.schema import CONTENT_TYPE, DEFAULT_SOURCE, SPECVERSION


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def enveloped(log: DataFrame) -> DataFrame:
    """``log`` (stream_id, stream_version, ts) with the constant and derived columns of the envelope."""
    return log.withColumns(
        {
            "id": F.concat("stream_id", F.lit("/"), "stream_version"),
            "source": F.lit(DEFAULT_SOURCE),
            "specversion": F.lit(SPECVERSION),
            "subject": F.col("stream_id"),
            "datacontenttype": F.lit(CONTENT_TYPE),
        }
    )


def versioned(rows: DataFrame, order: str = "global_position") -> DataFrame:
    """``rows`` (stream_id, ...) with stream_version 1, 2, 3 ... by ``order``: one shuffle on the stream."""
    return rows.withColumn("stream_version", F.expr(f"CAST(row_number() OVER (PARTITION BY stream_id ORDER BY {order}) AS int)"))


def user_log(spark: SparkSession, sf_dir: str, versions: bool = True) -> DataFrame:
    """``events`` as streams User-<id>: purchases are deposits, errors withdrawals, views notes.

    Without ``versions`` no shuffle is needed: for queries by position.
    """
    e = _read(spark, sf_dir, "events")
    rows = e.select(
        (F.col("event_id").cast("long") + 1).alias("global_position"),
        F.concat(F.lit("User-"), F.col("user_id").cast("string")).alias("stream_id"),
        F.concat(F.lit("User-"), F.col("user_id").cast("string")).alias("subject"),
        "event_type",
        "value",
        "ts",
        "props",
        "user_id",
        (F.col("event_id") % 3 + 1).cast("int").alias("schema_version"),
        F.floor(F.col("event_id") / 10).cast("long").alias("txid"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("user:"), F.col("user_id").cast("string"))).alias("crypto_key_id"),
    )
    return versioned(rows) if versions else rows


def user_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key_id, revoked) of every user; those of ids divisible by 7 are revoked, those by 11 missing."""
    users = _read(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 11 <> 0 OR user_id % 7 = 0")
    return users.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key_id"), (F.col("user_id") % 7 == 0).alias("revoked"))


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as streams Conversation-<id>; a turn is a version."""
    c = _read(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("Conversation-"), F.col("conv_id").cast("string")).alias("stream_id"),
        (F.col("turn") + 1).cast("int").alias("stream_version"),
        F.col("role").alias("event_type"),
        "text",
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as streams Order-<key>: placed, then shipped (F) or cancelled (P)."""
    o = _read(spark, sf_dir, "orders")
    second = F.when(F.col("o_orderstatus") == "F", "OrderShipped").when(F.col("o_orderstatus") == "P", "OrderCancelled")
    kinds = F.filter(F.array(F.lit("OrderPlaced"), second), lambda x: x.isNotNull())
    return o.select("o_orderkey", "o_custkey", "o_totalprice", F.posexplode(kinds).alias("k", "event_type")).select(
        (F.col("o_orderkey") * 2 + F.col("k") + 1).alias("global_position"),
        F.concat(F.lit("Order-"), F.col("o_orderkey").cast("string")).alias("stream_id"),
        (F.col("k") + 1).cast("int").alias("stream_version"),
        "event_type",
        F.when(F.col("k") == 0, F.col("o_custkey")).alias("custkey"),
        F.when(F.col("k") == 0, F.col("o_totalprice")).alias("total"),
    )
