"""The transactional outbox as plans: fan-out of events to topics, what is pending, what may be cleaned up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.functions.codecs import iso_ms

# Envelope keys that an extension cannot replace.
RESERVED = ("specversion", "id", "source", "type", "subject", "time", "datacontenttype", "dataschema", "data")


def payload() -> Column:
    """Flat CloudEvents JSON of a log row; ``extensions`` (a JSON object) goes to the top level except reserved keys, values as they are."""
    kind = "map<string,variant>"
    extra = F.map_filter(F.from_json("extensions", kind), lambda k, v: ~k.isin(*RESERVED))
    base = F.map_from_arrays(
        F.array(*map(F.lit, RESERVED[:7])), F.array("specversion", "id", "source", "event_type", "subject", iso_ms(F.col("time")), "datacontenttype")
    )
    typed = F.transform_values(base, lambda k, v: F.parse_json(F.to_json(F.array(v)))).cast(kind)
    own = F.transform_values(typed, lambda k, v: F.variant_get(v, "$[0]", "variant"))
    data = F.create_map(F.lit("data"), F.parse_json(F.coalesce("data", F.lit("null"))))
    return F.to_json(F.map_concat(own, F.coalesce(extra, F.create_map().cast(kind)), data))


def fan_out(events: DataFrame, topics: Sequence[str]) -> DataFrame:
    """An entry for each event and topic, event by event: (event_global_pos, topic, k, *columns of events)."""
    return events.select(F.col("global_position").alias("event_global_pos"), F.posexplode(F.array(*map(F.lit, topics))).alias("k", "topic"), "*")


def pending(entries: DataFrame, acks: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries that nobody acknowledged, oldest first."""
    rows = entries.join(acks.select("id"), "id", "left_anti")
    return rows if limit is None else rows.orderBy("id").limit(limit)


def expired(acks: DataFrame, now: Column, older_than_ms: int) -> DataFrame:
    """Acknowledgements older than an age: their entries may go."""
    age = F.make_dt_interval(secs=F.lit(older_than_ms / 1000).cast("decimal(18,6)"))
    return acks.where(F.col("processed_at") < now - age)
