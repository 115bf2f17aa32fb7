"""The registered queries and their SQL twins, by name.

A query is a function of (spark, sf_dir), registered with the DuckDB SQL that must give the same rows. Logs are derived from the plain tables as in :mod:`weftlog.sources.fixtures`; the SQL states the same derivation in ``LOG`` and
``ORDER_LOG``. Sums of doubles are rounded to 2 digits in both.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.functions import codecs, filters
from weftlog.operators import appends, folds, metrics, outbox, paging, reads, snapshots, upcasts, verify, watermarks
from weftlog.plans.registry import query
from weftlog.sources import fixtures, generators
from weftlog.sources.commitlog import scratch_folder
from weftlog.store import EventStore

LOG = """WITH L AS (SELECT CAST(event_id AS BIGINT) + 1 AS global_position, 'User-' || user_id AS stream_id, 'User-' || user_id AS subject,
CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS stream_version, event_type, value, ts, props, user_id,
CAST(event_id % 3 + 1 AS INT) AS schema_version, CAST(event_id // 10 AS BIGINT) AS txid,
CASE WHEN event_type = 'signup' THEN 'user:' || user_id END AS crypto_key_id FROM events) """
ORDER_LOG = """WITH O AS (SELECT CAST(o_orderkey * 2 + 1 AS BIGINT) AS global_position, 'Order-' || o_orderkey AS stream_id, 1 AS stream_version,
'OrderPlaced' AS event_type, o_custkey AS custkey, o_totalprice AS total FROM orders UNION ALL
SELECT CAST(o_orderkey * 2 + 2 AS BIGINT), 'Order-' || o_orderkey, 2, CASE o_orderstatus WHEN 'F' THEN 'OrderShipped' ELSE 'OrderCancelled' END,
NULL, NULL FROM orders WHERE o_orderstatus IN ('F', 'P')) """
PAGE_COLUMNS = ["global_position", "stream_id", "stream_version", "event_type"]
_PAGE = ", ".join(PAGE_COLUMNS)


def _money(c: Column) -> Column:
    return F.round(c, 2)


def _change() -> Column:
    return F.when(F.col("event_type") == "purchase", F.col("value")).when(F.col("event_type") == "error", -F.col("value")).otherwise(0.0)


_CHANGE = "CASE event_type WHEN 'purchase' THEN value WHEN 'error' THEN -value ELSE 0.0 END"


# Reads.


@query(LOG + f"SELECT {_PAGE} FROM L WHERE stream_id = 'User-1'")
def stream_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.stream(fixtures.user_log(spark, sf_dir), "User-1").select(*PAGE_COLUMNS)


@query(LOG + f"SELECT {_PAGE} FROM L WHERE stream_id = 'User-1' AND stream_version >= 20")
def stream_load_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.stream(fixtures.user_log(spark, sf_dir), "User-1", 20).select(*PAGE_COLUMNS)


@query(LOG + f"SELECT {_PAGE} FROM L WHERE stream_id = 'User-2' ORDER BY stream_version LIMIT 10")
def stream_load_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.stream(fixtures.user_log(spark, sf_dir), "User-2", max_events=10).select(*PAGE_COLUMNS)


@query(LOG + f"SELECT {_PAGE} FROM (SELECT * FROM L WHERE stream_id = 'User-3' ORDER BY stream_version LIMIT 40) WHERE event_type NOT LIKE '%Snapshot'")
def domain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.domain_events(fixtures.user_log(spark, sf_dir), "User-3", 40).select(*PAGE_COLUMNS)


@query(LOG + f"SELECT {_PAGE} FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, event_type ORDER BY stream_version DESC) AS r FROM L) WHERE r = 1")
def latest_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.latest_of_type(fixtures.user_log(spark, sf_dir).select(*PAGE_COLUMNS))


@query(LOG + "SELECT stream_id, max(stream_version) AS version, count(*) AS events FROM L GROUP BY stream_id")
def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.heads(fixtures.user_log(spark, sf_dir))


@query("SELECT 0 AS version")
def missing_stream_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.head(fixtures.user_log(spark, sf_dir), "User-none")


@query("SELECT DISTINCT 'User-' || user_id AS stream_id FROM events ORDER BY stream_id DESC LIMIT 100")
def list_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.streams(fixtures.user_log(spark, sf_dir, versions=False))


@query("SELECT DISTINCT 'User-' || user_id AS stream_id FROM events WHERE 'User-' || user_id LIKE 'U_er-%' ORDER BY stream_id DESC LIMIT 25")
def list_streams_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.streams(fixtures.user_log(spark, sf_dir, versions=False), "U_er", 25)


@query(LOG + "SELECT global_position, stream_id, event_type FROM L WHERE global_position > 100 AND global_position <= 900 ORDER BY global_position LIMIT 500")
def global_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixtures.user_log(spark, sf_dir, versions=False)
    return reads.after_position(log, 100, 900, limit=500).select("global_position", "stream_id", "event_type")


@query(
    "SELECT CAST(event_id AS BIGINT) + 1 AS global_position, CAST(user_id AS VARCHAR) AS entity_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || "
    "lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') || 'Z' AS time FROM events WHERE 'User-' || user_id LIKE 'User-%'"
)
def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixtures.user_log(spark, sf_dir, versions=False).where(filters.in_prefix("User"))
    return log.select("global_position", filters.entity_id("User").alias("entity_id"), codecs.iso_ms(F.col("ts")).alias("time"))


# Pages.

_THREE = ["User-1", "User-2", "User-3"]
_IN_THREE = "stream_id IN ('User-1', 'User-2', 'User-3')"


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.enveloped(fixtures.user_log(spark, sf_dir))


@query(LOG + f"SELECT {_PAGE} FROM L WHERE {_IN_THREE} ORDER BY global_position LIMIT 51")
def events_page_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page_rows(_paged(spark, sf_dir), _THREE, 51).select(*PAGE_COLUMNS)


@query(LOG + f"SELECT {_PAGE} FROM L WHERE {_IN_THREE} ORDER BY global_position DESC LIMIT 51")
def events_page_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page_rows(_paged(spark, sf_dir), _THREE, 51, "desc").select(*PAGE_COLUMNS)


@query(
    LOG + f"SELECT {_PAGE} FROM L WHERE {_IN_THREE} AND txid <= 800 AND global_position <= 7000 AND "
    "(global_position, stream_id, stream_id || '/' || stream_version) > (1500, 'User-2', 'User-2/1') ORDER BY global_position LIMIT 20"
)
def events_page_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page_rows(_paged(spark, sf_dir), _THREE, 20, "asc", (1500, "User-2", "User-2/1"), 800, 7000).select(*PAGE_COLUMNS)


@query("SELECT coalesce(min(CASE WHEN event_id // 10 >= 77 THEN event_id + 1 END) - 1, max(event_id + 1), 0) AS watermark FROM events")
def safe_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watermarks.safe_watermark(fixtures.user_log(spark, sf_dir, versions=False), 77)


@query("SELECT coalesce(min(CASE WHEN event_id // 10 >= 100000000 THEN event_id + 1 END) - 1, max(event_id + 1), 0) AS watermark FROM events")
def safe_watermark_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watermarks.safe_watermark(fixtures.user_log(spark, sf_dir, versions=False), 100_000_000)


# Subscriptions.


def _subscribed(spark: SparkSession, sf_dir: str, start: dict[str, str] | None, **how: object) -> DataFrame:
    log = fixtures.user_log(spark, sf_dir, versions=False)
    return reads.after_position(log, filters.start_position(start), predicate=filters.subscription(**how)).select("global_position", "subject", "event_type")


_SUBSCRIBED = "SELECT global_position, subject, event_type FROM L WHERE "


@query(LOG + _SUBSCRIBED + "subject = 'User-1'")
def subscribe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subscribed(spark, sf_dir, None, subject="User-1")


@query(LOG + _SUBSCRIBED + "starts_with(subject, 'User-1') AND event_type IN ('purchase', 'error') AND global_position > 250")
def subscribe_recursive_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subscribed(spark, sf_dir, {"id": "250"}, subject="User-1", recursive=True, event_types=["purchase", "error"])


@query(LOG + _SUBSCRIBED + "event_type IN ('signup') AND global_position >= 251")
def subscribe_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subscribed(spark, sf_dir, {"id": "251", "type": "inclusive"}, event_types=["signup"])


# Folds.


def _balance() -> dict[str, Column]:
    value = F.col("value")
    return {
        "balance": _money(folds.total(value, ["purchase"]) + folds.total(value, ["error"], -1)),
        "deposits": folds.handled(["purchase"]),
        "last_deposit": folds.last(value, ["purchase"]),
        "handled": folds.handled(["purchase", "error"]),
    }


_BALANCE = f"""round(sum({_CHANGE}), 2) AS balance, count(*) FILTER (event_type = 'purchase') AS deposits,
arg_max(value, stream_version) FILTER (event_type = 'purchase') AS last_deposit, count(*) FILTER (event_type IN ('purchase', 'error')) AS handled"""


@query(LOG + f"SELECT stream_id, max(stream_version) AS version, {_BALANCE} FROM L GROUP BY stream_id")
def agg_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.algebraic(fixtures.user_log(spark, sf_dir), _balance())


@query(LOG + f"SELECT stream_id, max(stream_version) AS version, {_BALANCE} FROM L WHERE stream_version <= 12 GROUP BY stream_id")
def agg_as_of_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.algebraic(fixtures.user_log(spark, sf_dir), _balance(), F.col("stream_version") <= 12)


@query(LOG + f"SELECT stream_id, max(stream_version) AS version, {_BALANCE} FROM L WHERE global_position <= 4000 GROUP BY stream_id")
def agg_as_of_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.algebraic(fixtures.user_log(spark, sf_dir), _balance(), F.col("global_position") <= 4000)


@query(
    ORDER_LOG + "SELECT stream_id, max(stream_version) AS version, CASE arg_max(event_type, stream_version) WHEN 'OrderPlaced' THEN 'placed' "
    "WHEN 'OrderShipped' THEN 'shipped' ELSE 'cancelled' END AS status, max(total) AS total FROM O GROUP BY stream_id"
)
def agg_order_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.max_by("event_type", "stream_version")
    status = F.when(kind == "OrderPlaced", "placed").when(kind == "OrderShipped", "shipped").otherwise("cancelled")
    log = fixtures.order_log(spark, sf_dir)
    return folds.algebraic(log, {"status": status, "total": folds.last(F.col("total"), ["OrderPlaced"])})


@query(LOG + f"SELECT stream_id, max(stream_version) AS version, round(sum({_CHANGE}), 2) AS balance, count(*) FILTER (event_type = 'purchase') AS deposits FROM L GROUP BY stream_id")
def agg_account_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state by a fold of expressions, as any non-algebraic handler would be."""
    start = F.struct(F.lit(0.0).alias("balance"), F.lit(0).cast("long").alias("deposits"))
    change = lambda sign, more: lambda s, e: F.struct((s["balance"] + e["value"] * sign).alias("balance"), (s["deposits"] + more).alias("deposits"))
    out = folds.by_expression(fixtures.user_log(spark, sf_dir), start, {"purchase": change(1, 1), "error": change(-1, 0)}, ["value"])
    return out.select("stream_id", "version", _money(F.col("state.balance")).alias("balance"), F.col("state.deposits").alias("deposits"))


@query(LOG + f"SELECT stream_id, max(stream_version) AS version, round(sum({_CHANGE}), 2) AS balance FROM L GROUP BY stream_id")
def agg_python_reducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    evolve = {
        "purchase": lambda s, e: {"balance": s["balance"] + e["value"]},
        "error": lambda s, e: {"balance": s["balance"] - e["value"]},
    }
    out = folds.by_function(fixtures.user_log(spark, sf_dir), {"balance": 0.0}, evolve, "balance double", ["value"])
    return out.withColumn("balance", _money(F.col("balance")))


@query(LOG + f"SELECT stream_id, stream_version, round(sum({_CHANGE}) OVER (PARTITION BY stream_id ORDER BY stream_version ROWS UNBOUNDED PRECEDING), 2) AS balance FROM L")
def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folds.running(fixtures.user_log(spark, sf_dir), _change())
    return out.select("stream_id", "stream_version", _money(F.col("balance")).alias("balance"))


# Snapshots.

_EVERY = 5
_STORED = LOG + f""", H AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS hit, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)
OVER (PARTITION BY stream_id ORDER BY stream_version ROWS UNBOUNDED PRECEDING) AS upto FROM L), S AS (SELECT *,
CAST(stream_version + (upto - hit) // {_EVERY} AS INT) AS stored_version, hit = 1 AND upto % {_EVERY} = 0 AS snapshot_after FROM H) """


@query(_STORED + "SELECT stream_id, stream_version, stored_version, snapshot_after FROM S")
def snapshot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = snapshots.stored_versions(fixtures.user_log(spark, sf_dir), ["purchase"], _EVERY)
    return out.select("stream_id", "stream_version", "stored_version", "snapshot_after")


def _with_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored log: events at their stored versions and the snapshots among them (sum and count of purchases)."""
    log = snapshots.stored_versions(fixtures.user_log(spark, sf_dir), ["purchase"], _EVERY)
    over = "OVER (PARTITION BY stream_id ORDER BY stream_version ROWS UNBOUNDED PRECEDING)"
    log = log.selectExpr("*", f"round(sum(IF(event_type = 'purchase', value, 0D)) {over}, 2) AS total", f"sum(IF(event_type = 'purchase', 1, 0)) {over} AS n")
    rows = F.when(F.col("snapshot_after"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both = log.withColumn("k", F.explode(rows))
    snap = F.col("k") == 1
    return both.select(
        "stream_id",
        (F.col("stored_version") + F.col("k")).alias("stream_version"),
        F.when(snap, F.lit("PurchasesSnapshot")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(~snap, F.col("value")).alias("value"),
        F.when(snap, F.struct("total", "n")).alias("state"),
    )


@query(
    _STORED + f"""SELECT stream_id, max(stored_version + CAST(snapshot_after AS INT)) AS version, max(CASE WHEN snapshot_after THEN stored_version + 1 END) AS snapshot_version,
    CAST(sum(hit) % {_EVERY} AS BIGINT) AS replayed_events, round(sum(CASE WHEN hit = 1 THEN value ELSE 0 END), 2) AS total, CAST(sum(hit) AS BIGINT) AS n FROM S GROUP BY stream_id"""
)
def snapshot_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _with_snapshots(spark, sf_dir)
    found = snapshots.bases(log, "Purchases", F.col("state"))
    later = F.col("base_version").isNull() | (F.col("stream_version") > F.col("base_version"))
    hit = later & (F.col("event_type") == "purchase")
    state = {
        "total": _money(F.coalesce(F.max("base.total"), F.lit(0.0)) + F.coalesce(F.sum(F.when(hit, F.col("value"))), F.lit(0.0))),
        "n": F.coalesce(F.max("base.n"), F.lit(0)) + F.count_if(hit),
    }
    out = snapshots.load(log, found, state, ["purchase"])
    return out.select("stream_id", "version", "snapshot_version", "replayed_events", "total", "n")


@query(
    _STORED + f"""SELECT count(*) AS streams, CAST(sum(p) AS BIGINT) AS total_replayed, avg(p) AS average_replayed, max(p) AS most_replayed
    FROM (SELECT stream_id, CAST(sum(hit) % {_EVERY} AS BIGINT) AS p FROM S GROUP BY stream_id)"""
)
def snapshot_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_load(spark, sf_dir).agg(
        F.count("*").alias("streams"), F.sum("replayed_events").alias("total_replayed"), F.avg("replayed_events").alias("average_replayed"),
        F.max("replayed_events").alias("most_replayed"),
    )


_BATCHES = """WITH RECURSIVE B AS (SELECT 'User-' || user_id AS stream_id, n, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS handled FROM
(SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 3 + 1 AS n FROM events) GROUP BY 1, 2),
R AS (SELECT stream_id, n, events, handled, CAST(1 AS BIGINT) AS first_version, handled > 0 AND handled >= 4 AS stores, events AS head, handled AS seen FROM B WHERE n = 1
UNION ALL SELECT B.stream_id, B.n, B.events, B.handled, R.head + CAST(R.stores AS BIGINT) + 1, B.handled > 0 AND CASE WHEN R.stores THEN 0 ELSE R.seen END + B.handled >= 4,
R.head + CAST(R.stores AS BIGINT) + B.events, CASE WHEN R.stores THEN 0 ELSE R.seen END + B.handled FROM R JOIN B ON B.stream_id = R.stream_id AND B.n = R.n + 1)
SELECT stream_id, n, events, handled, first_version, CASE WHEN stores THEN head + 1 END AS snapshot_at FROM R"""


@query(_BATCHES)
def snapshot_batched_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixtures.user_log(spark, sf_dir)
    n = F.floor((F.col("stream_version") - 1) / 3) + 1
    batches = log.groupBy("stream_id", n.alias("n")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("handled"))
    return snapshots.batched_appends(batches, 4)


# Schema evolution.


@query(
    LOG + """SELECT global_position, CASE WHEN event_type = 'view' THEN CASE schema_version WHEN 3 THEN schema_version ELSE 3 END WHEN event_type = 'click' AND schema_version = 2 THEN 3
    ELSE schema_version END AS schema_version, CASE WHEN event_type = 'view' AND schema_version = 1 THEN k * 2 + 1 WHEN event_type = 'view' AND schema_version = 2 THEN k + 1
    WHEN event_type = 'click' AND schema_version = 2 THEN -k ELSE k END AS k FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM L)"""
)
def upcast_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views go 1 -> 2 -> 3; of clicks only 2 -> 3 is known, so that version 1 stays."""
    chain = upcasts.Upcasters()
    pair = lambda k, v: F.struct(k.alias("k"), F.lit(v).alias("v"))
    chain.register(
        upcasts.Upcaster("view", 2, 3, lambda d: pair(d["k"] + 1, 3)), upcasts.Upcaster("view", 1, 2, lambda d: pair(d["k"] * 2, 2)),
        upcasts.Upcaster("click", 2, 3, lambda d: pair(-d["k"], 3)),
    )
    log = fixtures.user_log(spark, sf_dir, versions=False)
    k = F.get_json_object("props", "$.k").cast("int")
    data = F.struct(k.alias("k"), F.col("schema_version").alias("v"))
    out = log.select("global_position", chain.column(data).alias("d"))
    return out.select("global_position", F.col("d.v").alias("schema_version"), F.col("d.k").alias("k"))


@query(
    LOG + """SELECT global_position, 'EUR' AS currency, value AS amount, CAST(user_id AS VARCHAR) AS customer_id, round(value * 100) / 100 AS total FROM L WHERE event_type = 'purchase'"""
)
def upcast_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field added, one renamed, one moved into an object, one cast and one dropped, from version 1 to 5 in four steps."""
    chain = upcasts.Upcasters()
    chain.register(
        upcasts.Upcaster("purchase", 1, 2, lambda d: d.withField("currency", F.lit("EUR"))),
        upcasts.Upcaster("purchase", 2, 3, lambda d: d.withField("amount", d["value"]).dropFields("value")),
        upcasts.Upcaster("purchase", 3, 4, lambda d: d.withField("customer", F.struct(d["user"].cast("string").alias("id"))).dropFields("user")),
        upcasts.Upcaster("purchase", 4, 5, lambda d: d.withField("total", F.round(d["cents"].cast("double")) / 100).dropFields("cents", "junk")),
    )
    log = fixtures.user_log(spark, sf_dir, versions=False).where("event_type = 'purchase'")
    cents = (F.col("value") * 100).cast("string")
    data = F.struct("value", F.col("user_id").alias("user"), cents.alias("cents"), F.lit("x").alias("junk"))
    # Every row is of version 1, so that the chain's last shape is the column's only one.
    out = log.select("global_position", chain.column(data, version=F.lit(1), only=("purchase", 1)).alias("d"))
    return out.select("global_position", "d.currency", "d.amount", F.col("d.customer.id").alias("customer_id"), "d.total")


# Projections and the outbox.


@query(LOG + "SELECT global_position, substr(stream_id, 6) AS entity_id, event_type, value FROM (SELECT * FROM L WHERE global_position > 1000 ORDER BY global_position LIMIT 500) WHERE event_type IN ('purchase', 'signup')")
def projection_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the handlers of one batch after a checkpoint get: events of other types are read past, not handled."""
    batch = reads.after_position(fixtures.user_log(spark, sf_dir, versions=False), 1000, limit=500)
    hit = batch.where(filters.in_prefix("User") & F.col("event_type").isin("purchase", "signup"))
    return hit.select("global_position", filters.entity_id("User").alias("entity_id"), "event_type", "value")


@query(
    LOG + "SELECT substr(stream_id, 6) AS entity_id, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 2) AS spent, "
    "count(*) FILTER (event_type = 'signup') AS signups, max(global_position) AS last_position FROM L WHERE event_type IN ('purchase', 'signup') GROUP BY 1"
)
def projection_read_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixtures.user_log(spark, sf_dir, versions=False).where(filters.in_prefix("User") & F.col("event_type").isin("purchase", "signup"))
    return log.groupBy(filters.entity_id("User").alias("entity_id")).agg(
        _money(folds.total(F.col("value"), ["purchase"])).alias("spent"), folds.handled(["signup"]).alias("signups"), F.max("global_position").alias("last_position")
    )


@query("SELECT event_id + 1 AS event_global_pos, t.topic, t.k, event_type FROM events, (VALUES ('orders', 0), ('notifications', 1)) t(topic, k) WHERE event_type = 'purchase'")
def outbox_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixtures.user_log(spark, sf_dir, versions=False).where("event_type = 'purchase'")
    return outbox.fan_out(log, ["orders", "notifications"]).select("event_global_pos", "topic", "k", "event_type")


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = fixtures.user_log(spark, sf_dir, versions=False)
    entries = log.select(F.col("global_position").alias("id"), "event_type", "ts")
    acks = entries.where("id % 3 <> 0").select("id", F.col("ts").alias("processed_at"))
    return entries, acks


@query("SELECT event_id + 1 AS id, event_type FROM events WHERE (event_id + 1) % 3 = 0 ORDER BY id LIMIT 100")
def outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.pending(*_entries(spark, sf_dir), limit=100).select("id", "event_type")


@query("SELECT event_id + 1 AS id FROM events WHERE (event_id + 1) % 3 <> 0 AND ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def outbox_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, acks = _entries(spark, sf_dir)
    now = entries.agg(F.max("ts").alias("now"))
    return outbox.expired(acks.join(F.broadcast(now)), F.col("now"), 7 * 86_400_000).select("id")


@query(
    LOG + """SELECT global_position, '1.0' AS specversion, stream_id || '/' || stream_version AS id, 'event-store' AS source, event_type AS type, stream_id AS subject,
    'application/json' AS datacontenttype, CAST(user_id AS VARCHAR) AS actorid, value AS amount FROM L WHERE event_type = 'purchase'"""
)
def cloud_events_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbox payloads, read back field by field; an extension called id must not replace the event's."""
    log = fixtures.enveloped(fixtures.user_log(spark, sf_dir)).where("event_type = 'purchase'")
    log = log.withColumns(
        {
            "time": F.col("ts").cast("timestamp"),
            "data": F.to_json(F.struct(F.col("value").alias("amount"))),
            "extensions": F.to_json(F.struct(F.col("user_id").cast("string").alias("actorid"), F.lit("x").alias("id"))),
        }
    )
    names = ["specversion", "id", "source", "type", "subject", "datacontenttype", "actorid"]
    out = log.select("global_position", outbox.payload().alias("p"))
    return out.select("global_position", *(F.get_json_object("p", f"$.{n}").alias(n) for n in names), F.get_json_object("p", "$.data.amount").cast("double").alias("amount"))


# Appends.


@query(
    LOG + """, H AS (SELECT stream_id, max(stream_version) AS v FROM L GROUP BY stream_id), Q AS (SELECT 'User-' || CAST(o_custkey AS VARCHAR) AS stream_id,
    CAST(o_orderkey AS BIGINT) AS request, CAST(o_orderkey % 80 - 1 AS INT) AS expected_version FROM orders)
    SELECT request, Q.stream_id, expected_version, coalesce(v, 0) AS actual_version, CASE expected_version WHEN -1 THEN coalesce(v, 0) <> 0 WHEN 0 THEN false
    ELSE coalesce(v, 0) <> expected_version END AS conflict FROM Q LEFT JOIN H USING (stream_id)"""
)
def occ_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").cast("long").alias("request"), F.concat(F.lit("User-"), F.col("o_custkey").cast("string")).alias("stream_id"),
        (F.col("o_orderkey") % 80 - 1).cast("int").alias("expected_version"),
    )
    out = appends.checked(requests, reads.heads(fixtures.user_log(spark, sf_dir)))
    return out.select("request", "stream_id", "expected_version", "actual_version", "conflict")


@query(
    LOG + """, H AS (SELECT stream_id, max(stream_version) AS v FROM L GROUP BY stream_id), B AS (SELECT 'User-' || CAST(o_custkey AS VARCHAR) AS stream_id,
    CAST(o_orderkey AS BIGINT) AS input_order FROM orders) SELECT B.stream_id, input_order, CAST(coalesce(v, 0) + 1 AS INT) AS from_version,
    CAST(coalesce(v, 0) + row_number() OVER (PARTITION BY B.stream_id ORDER BY input_order) AS INT) AS stream_version FROM B LEFT JOIN H USING (stream_id)"""
)
def append_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("User-"), F.col("o_custkey").cast("string")).alias("stream_id"), F.col("o_orderkey").cast("long").alias("input_order")
    )
    out = appends.numbered(batch, reads.heads(fixtures.user_log(spark, sf_dir)))
    return out.select("stream_id", "input_order", "from_version", "stream_version")


@query(
    LOG + f"""SELECT stream_id, stream_version, round(before, 2) AS balance_before, round(before, 2) < value AS refused FROM (SELECT *, coalesce(sum({_CHANGE}) OVER
    (PARTITION BY stream_id ORDER BY stream_version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM L) WHERE event_type = 'error'"""
)
def insufficient_funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The business rule of a withdrawal: what the balance was before it, and whether it would have been refused."""
    log = folds.running(fixtures.user_log(spark, sf_dir), _change())
    before = _money(F.col("balance") - _change())
    out = log.where("event_type = 'error'").withColumn("balance_before", before)
    return out.select("stream_id", "stream_version", "balance_before", (F.col("balance_before") < F.col("value")).alias("refused"))


# Through the commit log: events appended in one commit, replayed, and streamed into a read model.


def _stored(spark: SparkSession, sf_dir: str) -> EventStore:
    root = f"{scratch_folder(spark)}/store-{uuid.uuid4().hex}"
    store = EventStore(spark, root)
    store.setup()
    rows = fixtures.user_log(spark, sf_dir, versions=False)
    batch = rows.select("stream_id", "event_type", F.to_json(F.struct("value")).alias("data"), F.col("global_position").alias("input_order"))
    store.append_frame(batch)
    return store


@query(LOG + f"SELECT stream_id, max(stream_version) AS version, {_BALANCE} FROM L GROUP BY stream_id")
def store_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _stored(spark, sf_dir).events()
    return folds.algebraic(log.withColumn("value", F.get_json_object("data", "$.value").cast("double")), _balance())


@query(LOG + "SELECT substr(stream_id, 6) AS entity_id, round(sum(value), 2) AS spent, count(*) AS purchases, max(global_position) AS last_position FROM L WHERE event_type = 'purchase' GROUP BY 1")
def streamed_read_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlog.sources import positions
    from weftlog.streaming import projections

    files = _stored(spark, sf_dir).log.files
    amount = F.get_json_object("data", "$.value").cast("double")
    handler = lambda d: d.select("entity_id", "global_position", amount.alias("amount"))

    def part(batch: DataFrame) -> DataFrame:
        rows = projections.dispatched(batch, "User", {"purchase": handler})
        return rows.groupBy("entity_id").agg(F.sum("amount").alias("spent"), F.count("*").alias("purchases"), F.max("global_position").alias("last_position"))

    projections.materialise(positions.stream(spark, files.root), part, files.at("model"), files.at("model-checkpoint")).awaitTermination()
    merge = [_money(F.sum("spent")).alias("spent"), F.sum("purchases").alias("purchases"), F.max("last_position").alias("last_position")]
    return projections.read_model(spark, files.at("model"), ["entity_id"], merge)


# Verification.


@query("SELECT 'Conversation-' || conv_id AS stream_id, count(*) AS events, CAST(max(turn) + 1 AS INT) AS last_version, min(turn) = 0 AND max(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY conv_id")
def contiguity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.contiguity(fixtures.conversation_log(spark, sf_dir))


@query(LOG + ", G AS (SELECT * FROM L WHERE event_type <> 'view') SELECT * FROM (SELECT stream_id, stream_version, coalesce(lag(stream_version) OVER (PARTITION BY stream_id ORDER BY stream_version), 0) + 1 AS expected FROM G) WHERE stream_version <> expected")
def version_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.gaps(fixtures.user_log(spark, sf_dir).where("event_type <> 'view'"))


@query(
    """WITH E AS (SELECT 't' || event_id AS token FROM events WHERE event_id % 2 = 0), S AS (SELECT 't' || event_id AS token FROM events WHERE event_id % 3 = 0 UNION ALL
    SELECT 't' || event_id FROM events WHERE event_id % 12 = 0), N AS (SELECT token, count(*) AS n FROM S GROUP BY token)
    SELECT token, CASE WHEN n IS NULL THEN 'missing' WHEN e.token IS NULL THEN 'unexpected' ELSE 'duplicate' END AS problem
    FROM E FULL JOIN N USING (token) WHERE n IS NULL OR e.token IS NULL OR n > 1"""
)
def token_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    token = F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("token")
    seen = ids.where("event_id % 3 = 0").unionByName(ids.where("event_id % 12 = 0"))
    return verify.token_errors(ids.where("event_id % 2 = 0").select(token), seen.select(token))


@query(
    LOG + f""", A AS (SELECT stream_id, round(sum({_CHANGE}), 2) AS balance FROM L WHERE user_id % 5 <> 0 GROUP BY stream_id),
    E AS (SELECT stream_id, round(sum({_CHANGE}) + CASE WHEN user_id % 9 = 0 THEN 1 ELSE 0 END, 2) AS balance FROM L WHERE user_id % 4 <> 0 GROUP BY stream_id, user_id)
    SELECT stream_id, e.balance AS expected_balance, a.balance AS actual_balance, coalesce(abs(e.balance - a.balance) <= 0.005, false) AS matches FROM E FULL JOIN A USING (stream_id)"""
)
def reconcile_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixtures.user_log(spark, sf_dir, versions=False)
    actual = log.where("user_id % 5 <> 0").groupBy("stream_id").agg(_money(F.sum(_change())).alias("balance"))
    off = F.when(F.col("user_id") % 9 == 0, 1.0).otherwise(0.0)
    expected = log.where("user_id % 4 <> 0").groupBy("stream_id", "user_id").agg(_money(F.sum(_change()) + F.first(off)).alias("balance"))
    return verify.reconcile(expected, actual, "stream_id", ["balance"])


@query(
    LOG + f"""SELECT stream_id, max(stream_version) AS version, count(*) FILTER (event_type = 'purchase') AS deposit_count FROM L GROUP BY stream_id
    HAVING NOT (max(stream_version) >= count(*) FILTER (event_type = 'purchase') + 1 AND round(sum({_CHANGE}), 2) = round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 2))"""
)
def response_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = {
        "deposit_count": folds.handled(["purchase"]), "balance": _money(F.sum(_change())),
        "deposit_total": _money(folds.total(F.col("value"), ["purchase"])), "events_appended": F.lit(1),
    }
    return verify.response_errors(folds.algebraic(fixtures.user_log(spark, sf_dir), state)).select("stream_id", "version", "deposit_count")


# Crypto-shredding on derived rows: the state of a key decides what a reader gets.


@query(
    LOG + """SELECT global_position, event_type, CASE WHEN crypto_key_id IS NULL THEN 'plain' WHEN user_id % 7 = 0 OR user_id % 11 = 0 THEN 'tombstone' ELSE 'decrypted' END AS outcome,
    CASE WHEN crypto_key_id IS NULL OR NOT (user_id % 7 = 0 OR user_id % 11 = 0) THEN value END AS value FROM L"""
)
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlog.operators.crypto import outcome

    log, keys = fixtures.user_log(spark, sf_dir, versions=False), fixtures.user_keys(spark, sf_dir)
    joined = log.join(keys.withColumnRenamed("key_id", "crypto_key_id"), "crypto_key_id", "left")
    kind = outcome(F.col("crypto_key_id").isNotNull(), F.col("revoked"))
    return joined.select("global_position", "event_type", kind.alias("outcome"), F.when(kind != "tombstone", F.col("value")).alias("value"))


@query("SELECT CAST(user_id % 5 + 250 AS BIGINT) AS secret_version, count(*) AS keys FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1")
def secret_version_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key envelopes by the secret version in their bytes 5 to 8."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    version = F.lpad(F.hex((F.col("user_id") % 5 + 250).cast("long")), 8, "0")
    keys = users.select(F.unhex(F.concat(F.lit("57464C31"), version, F.lit("00" * 60))).alias("encrypted_key"))
    return keys.groupBy(codecs.read_uint32(F.col("encrypted_key"), 5).alias("secret_version")).agg(F.count("*").alias("keys"))


# Workloads and metrics.

_DIRECT = """WITH P AS (SELECT i // 500 AS worker_id, i % 500 AS operation_index, abs(42 * 31 + (i // 500) * 17 + (i % 500) * 13) AS v FROM range(2000) t(i))
SELECT worker_id, operation_index, v % 100 < 30 AS append, CASE WHEN v % 100 < 75 THEN v % 5 ELSE 5 + v % 95 END AS stream_index,
'load-test-stream-' || CASE WHEN v % 100 < 75 THEN v % 5 ELSE 5 + v % 95 END AS stream_id, 'live:42:' || worker_id || ':' || operation_index AS token FROM P"""


@query(_DIRECT)
def workload_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.direct_plan(spark, 42, 4, 500, 30, 5, 100)


@query(f"SELECT stream_id, worker_id, operation_index, event_index, token || ':' || event_index AS token FROM ({_DIRECT}), range(3) e(event_index) WHERE append")
def workload_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = generators.live_events(spark, generators.direct_plan(spark, 42, 4, 500, 30, 5, 100), 3)
    return out.withColumn("event_index", F.col("event_index").cast("long"))


_HTTP = """WITH P AS (SELECT i AS operation_index, abs(42 * 31 + i * 17) AS v, i // 100000 AS turn, (i % 100000 + 42) % 100000 AS user_index FROM range(1000000) t(i)),
K AS (SELECT *, CASE WHEN (turn + user_index) % 10 < 7 THEN 'read' ELSE 'deposit' END AS kind, 1 + v % 10 AS amount FROM P) """


@query(_HTTP + "SELECT kind, count(*) AS operations, CAST(sum(amount) AS BIGINT) AS amount, count(DISTINCT user_index) AS users FROM K GROUP BY kind")
def http_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily plan's totals: 300 000 deposits of 1 650 000 in all."""
    plan = generators.http_plan(spark, 42, 1_000_000, 100_000, 10, 70)
    return plan.groupBy("kind").agg(F.count("*").alias("operations"), F.sum("amount").alias("amount"), F.count_distinct("user_index").alias("users"))


@query(
    _HTTP + """SELECT count(*) AS accounts, CAST(sum(59 + coalesce(amount, 0)) AS BIGINT) AS final_balance, CAST(sum(60 // 50) AS BIGINT) AS snapshots, CAST(sum(60 + 60 // 50 + coalesce(n, 0)) AS BIGINT) AS stored_events
    FROM range(100000) a(u) LEFT JOIN (SELECT user_index, sum(amount) AS amount, count(*) AS n FROM K WHERE kind = 'deposit' GROUP BY user_index) d ON a.u = d.user_index"""
)
def seeded_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed history and the daily plan's deposits together: final balance 7 550 000, 100 000 snapshots, 6 400 000 stored events."""
    seeded = generators.seed_history(spark, 42, 100_000, 60).groupBy("account_index").agg(F.count("*").alias("events"), F.sum("amount").alias("seeded"))
    deposits = generators.http_plan(spark, 42, 1_000_000, 100_000, 10, 70).where("kind = 'deposit'")
    more = deposits.groupBy(F.col("user_index").alias("account_index")).agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
    both = seeded.join(more, "account_index", "left").fillna(0, ["amount", "n"])
    snaps = F.floor(F.col("events") / 50)
    return both.agg(
        F.count("*").alias("accounts"), F.sum(F.col("seeded") + F.col("amount")).alias("final_balance"), F.sum(snaps).alias("snapshots"),
        F.sum(F.col("events") + snaps + F.col("n")).alias("stored_events"),
    )


@query("SELECT name, CAST(request_offset AS BIGINT) AS request_offset, CAST(request_count AS BIGINT) AS request_count, CAST(duration_ms AS BIGINT) AS duration_ms, target FROM (VALUES ('off-peak', 0, 100000, 720000, 100000 / 720.0), ('peak', 100000, 800000, 2160000, 800000 / 2160.0), ('cool-down', 900000, 100000, 720000, 100000 / 720.0)) t(name, request_offset, request_count, duration_ms, target)")
def traffic_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.daily_phases(spark, 1_000_000, 3600)


@query("SELECT 'capacity-' || t || '-rps' AS name, (t // 100 - 1) * (t // 100) // 2 * 100 * 30 AS request_offset, t * 30 AS request_count, CAST(30000 AS BIGINT) AS duration_ms, CAST(t AS DOUBLE) AS target FROM range(100, 501, 100) r(t)")
def capacity_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.capacity_phases(spark, 100, 500, 100, 30)


@query("SELECT i AS operation_index, n AS retry, CAST(least(50, 5 * pow(2, n)) AS BIGINT) + (i * 17 + n * 13) % 10 AS delay_ms, (i + n) % 3 AS worker FROM range(200) a(i), range(6) b(n)")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.range(200).select(F.col("id").alias("operation_index"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("retry"))
    delay = generators.retry_delay_ms(F.col("operation_index"), F.col("retry"))
    return n.select("operation_index", "retry", delay.alias("delay_ms"), ((F.col("operation_index") + F.col("retry")) % 3).alias("worker"))


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def latency_percentiles_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    return metrics.nearest_rank(log, ["event_type"], "value", [50, 95, 99])


_FLOOR = """SELECT event_type, max(n) AS n, max(v) FILTER (i = floor((n - 1) * 0.5)) AS p50, max(v) FILTER (i = floor((n - 1) * 0.95)) AS p95, max(v) FILTER (i = floor((n - 1) * 0.99)) AS p99
FROM (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type"""


@query(_FLOOR)
def latency_percentiles_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    return metrics.floor_index(log, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 2000")
def ring_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ring_sample(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value"), "event_id")


_HASH = "((CAST({x} AS HUGEINT) * {m}) % 4294967296)::BIGINT"
_H1 = _HASH.format(x="(event_id + 1)", m=0x9E3779B1)
_RESERVOIR = f"""WITH A AS (SELECT event_id, value, {_H1} AS a FROM events), B AS (SELECT *, {_HASH.format(x="xor(a, a >> 16)", m=0x85EBCA6B)} AS b FROM A),
C AS (SELECT *, xor(b, b >> 13) AS c FROM B), D AS (SELECT *, CASE WHEN event_id < 500 THEN event_id ELSE (CASE WHEN c >= 2147483648 THEN c - 4294967296 ELSE c END) % (event_id + 1) END AS slot FROM C)
SELECT slot, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM D WHERE slot >= 0 AND slot < 500 GROUP BY slot"""


@query(_RESERVOIR)
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reservoir_sample(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value"), "event_id", 500)


_WORKERS = "SELECT user_id % 4 AS worker, count(*) AS attempted, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1"


@query(f"SELECT worker, attempted, succeeded, failed, succeeded / 3600.0 AS per_second, (attempted - succeeded) * 100.0 / attempted AS improvement FROM ({_WORKERS})")
def worker_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, failed = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_type") == "error"
    c = log.groupBy((F.col("user_id") % 4).alias("worker")).agg(F.count("*").alias("attempted"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"))
    return c.select(
        "*", metrics.rate(F.col("succeeded"), F.lit(3_600_000)).alias("per_second"), metrics.improvement(F.col("attempted"), F.col("succeeded")).alias("improvement")
    )


_SLO = f"""WITH P AS ({_FLOOR}), R AS (SELECT (SELECT p95 FROM P WHERE event_type = 'view') AS read_p95, (SELECT p95 FROM P WHERE event_type = 'purchase') AS write_p95,
(SELECT count(*) FROM events) AS attempted, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed) """


@query(_SLO + "SELECT read_p95, write_p95, failed * 100.0 / attempted AS error_percent, read_p95 <= 250 AS read_ok, write_p95 <= 500 AS write_ok, failed * 100.0 / attempted <= 0.1 AS errors_ok, read_p95 <= 250 AND write_p95 <= 500 AND failed * 100.0 / attempted <= 0.1 AS passed FROM R")
def slo_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = latency_percentiles_floor(spark, sf_dir)
    kind = lambda k, v: F.max(F.when(F.col("event_type") == k, F.col(v)))
    report = p.agg(kind("view", "p95").alias("read_p95"), kind("purchase", "p95").alias("write_p95"), F.sum("n").alias("attempted"), kind("error", "n").alias("failed"))
    return metrics.objectives(report, 250, 500, 0.1).drop("attempted", "failed")


@query("SELECT CAST(300.0 AS DOUBLE) AS sustained, CAST(400.0 AS DOUBLE) AS first_unsustained")
def capacity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = generators.capacity_phases(spark, 100, 500, 100, 30).selectExpr(
        "request_offset AS stage", "target", "IF(target < 350, target * 0.97, target * 0.9) AS achieved", "target < 450 AS passed"
    )
    return metrics.capacity(stages)
