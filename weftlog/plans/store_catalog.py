"""Registered queries that go through the event store: commands, consumers, keys and snapshots, each beside its SQL twin.

Commands that a caller gives one by one act on ``nation`` (a stream for each region) and ``region``; bulk ones on ``events``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.functions import codecs, errors, validation
from weftlog.operators import crypto, folds, reads, snapshots
from weftlog.operators.keyring import Secrets
from weftlog.operators.upcasts import Upcaster, Upcasters
from weftlog.plans.catalog import _STORED, LOG, _money, _with_snapshots
from weftlog.plans.registry import query
from weftlog.sources import fixtures, generators
from weftlog.sources.commitlog import scratch_folder
from weftlog.store import Encryption, EventStore, SnapshotHandle, define_aggregate, define_projection, define_snapshot

_ONE = Secrets.of(1, [(1, "one")])
_N = """WITH N AS (SELECT n_name, n_regionkey AS r, n_nationkey AS k, CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS BIGINT) AS p,
CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS v, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation) """


def _opened(spark: SparkSession, secrets: Secrets | None = None, snapshots: Sequence[SnapshotHandle] = (), root: str | None = None) -> EventStore:
    store = EventStore(spark, root or f"{scratch_folder(spark)}/store-{uuid.uuid4().hex}", secrets=secrets, snapshots=snapshots)
    store.setup()
    return store


def _nations(spark: SparkSession, sf_dir: str) -> dict[int, list[Any]]:
    """The nations of each region, in order: a table of fixed size."""
    out: dict[int, list[Any]] = {}
    for n in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_regionkey", "n_nationkey").collect():
        out.setdefault(n.n_regionkey, []).append(n)
    return out


def _joined(spark: SparkSession, sf_dir: str, topics: Sequence[str] | None = None) -> tuple[EventStore, dict[int, list[Any]]]:
    """A store to which each region's nations were appended, all in one transaction."""
    store, nations = _opened(spark), _nations(spark, sf_dir)

    def work(tx):
        for r, own in nations.items():
            tx.append(f"Region-{r}", -1, [{"type": "NationJoined", "data": {"name": n.n_name}, "extensions": {"key": n.n_nationkey}} for n in own], topics)

    store.with_transaction(work)
    return store, nations


def _name() -> Any:
    return F.get_json_object("data", "$.name")


@query(
    _N + """SELECT p AS global_position, 'Region-' || r AS stream_id, v AS stream_version, 'Region-' || r || '/' || v AS id, 'event-store' AS source, 'NationJoined' AS event_type,
    1 AS schema_version, CAST(1 AS BIGINT) AS txid, n_name AS name, CAST(k AS VARCHAR) AS key FROM N UNION ALL
    SELECT (SELECT count(*) FROM nation) + row_number() OVER (ORDER BY r), 'Region-' || r, CAST(c + 1 AS INT), 'Region-' || r || '/' || (c + 1), 'census', 'RegionClosed', 2,
    1 + row_number() OVER (ORDER BY r), NULL, NULL FROM (SELECT DISTINCT r, c FROM N)"""
)
def store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends to new streams in one transaction, then one at each stream's exact version."""
    store, nations = _joined(spark, sf_dir)
    for r, own in nations.items():
        store.append(f"Region-{r}", len(own), [{"type": "RegionClosed", "data": None, "source": "census", "schema_version": 2}])
    columns = ["global_position", "stream_id", "stream_version", "id", "source", "event_type", "schema_version", "txid"]
    return store.events().select(*columns, _name().alias("name"), F.get_json_object("extensions", "$.key").alias("key"))


def _outcome(attempt: Callable[[], Any]) -> tuple[str, int | None]:
    try:
        result = attempt()
    except errors.OptimisticConcurrencyError as e:
        return "conflict", e.actual_version
    except (errors.WeftlogError, ValueError) as e:
        return type(e).__name__, None
    return "done", result.to_version if hasattr(result, "to_version") else result


@query(
    _N + """, R AS (SELECT DISTINCT r, CAST(c AS INT) AS c FROM N) SELECT 'Region-' || r AS stream_id, attempt, outcome, CASE WHEN base THEN c ELSE 0 END + more AS version FROM R, (VALUES
    ('as a new stream', 'conflict', true, 0), ('at its version', 'done', true, 1), ('at its old version', 'conflict', true, 1), ('at any version', 'done', true, 2),
    ('no events', 'ValueError', true, NULL), ('a reserved type', 'ReservedSnapshotEventTypeError', true, NULL), ('before set-up', 'EventStoreNotInitializedError', true, NULL),
    ('three times', 'conflict', true, 2), ('no conflict', 'ValueError', true, NULL), ('runs', 'done', false, 4), ('without a secret', 'CryptoSecretsRequiredError', true, NULL)
    ) t(attempt, outcome, base, more)"""
)
def command_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of appends that expect this or that, of refused ones, and of retries."""
    store, nations = _joined(spark, sf_dir)
    unready, out = EventStore(spark, store.log.files.root), []
    for r, own in nations.items():
        stream, event, n, runs = f"Region-{r}", [{"type": "E", "data": 1}], len(own), []

        def again(expected: int, event=event, stream=stream, runs=runs):
            runs.append(expected)
            return store.append(stream, expected, event)

        def refused(runs=runs):
            runs.append(0)
            raise ValueError

        attempts = {
            "as a new stream": lambda: store.append(stream, -1, event), "at its version": lambda: store.append(stream, n, event), "at its old version": lambda: store.append(stream, n, event),
            "at any version": lambda: store.append(stream, 0, event), "no events": lambda: store.append(stream, 0, []), "a reserved type": lambda: store.append(stream, 0, [{"type": "ASnapshot", "data": 1}]),
            "before set-up": lambda: unready.load(stream), "three times": lambda: store.with_retry(lambda: again(1), 2), "no conflict": lambda: store.with_retry(refused, 2),
            "runs": lambda: len(runs), "without a secret": lambda: store.create_crypto_key("k"),
        }
        out += [(stream, name, *_outcome(f)) for name, f in attempts.items()]
    return spark.createDataFrame(out, "stream_id string, attempt string, outcome string, version int")


_BAD = {
    "schema_name": ["Upper", "1a", "a-b", "", "a" * 64, 'x"; drop'], "good_schema_name": ["a", "_x9", "a" * 63],
    "cursor": ["bm90IGEgY3Vyc29y", "e30", "!"], "limit": [0, -1, 1001, True, 1.5], "good_limit": [1, 1000],
    "expected_version": [-2, 1.5, 2**53, None], "good_expected_version": [-1, 0, 7], "lower_bound": ["-1", "01", "x", ""], "good_lower_bound": ["0", "9007199254740993"],
    "encrypted_fields": ["__proto__", "a..b", "a.constructor", "a,a.b"], "good_encrypted_fields": ["a", "a.b,a.c"],
}


def _check(spark: SparkSession, argument: str, value: Any) -> None:
    if argument == "schema_name":
        EventStore(spark, scratch_folder(spark), value)
    elif argument == "cursor":
        codecs.decode_cursor(value, "asc", ["a"])
    elif argument == "limit":
        validation.page_options(["a"], value, None, "asc")
    elif argument == "expected_version":
        validation.append_input({"stream_id": "s", "expected_version": value, "events": []})
    elif argument == "lower_bound":
        validation.subscribe_options(lower_bound={"id": value})
    else:
        validation.encrypted_paths(value.split(","))


_CHECKED = ", ".join(f"('{a.removeprefix('good_')}', '{repr(v).replace(chr(39), chr(39) * 2)}', {str(not a.startswith('good_')).lower()})" for a, vs in _BAD.items() for v in vs)


@query(f"SELECT * FROM (VALUES {_CHECKED}) t(argument, value, refused)")
def argument_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of calls, and whether they are refused."""
    out = []
    for argument, values in _BAD.items():
        for v in values:
            try:
                _check(spark, argument.removeprefix("good_"), v)
                out.append((argument.removeprefix("good_"), repr(v), False))
            except (errors.InvalidArgumentError, errors.InvalidSchemaNameError):
                out.append((argument.removeprefix("good_"), repr(v), True))
    return spark.createDataFrame(out, "argument string, value string, refused boolean")


# Consumers.


def _relayed(spark: SparkSession, sf_dir: str) -> EventStore:
    """Three batches of ten entries handed over (each appends what it got), and one whose handler fails."""
    store, _ = _joined(spark, sf_dir, ["orders", "notifications"])

    def fails(entries, tx):
        tx.append("Relay", 0, [{"type": "Lost", "data": 1}])
        raise RuntimeError("broker")

    for _ in range(3):
        store.process_outbox(lambda entries, tx: tx.append("Relay", 0, [{"type": "Relayed", "data": {"name": e.payload["data"]["name"], "id": e.id}} for e in entries]), 10)
    try:
        store.process_outbox(fails, 10)
    except RuntimeError:
        pass
    return store


_ENTRIES = _N + ", E AS (SELECT (p - 1) * 2 + t.k + 1 AS id, p, topic, n_name, r, v FROM N, (VALUES ('orders', 0), ('notifications', 1)) t(topic, k)) "


@query(_ENTRIES + "SELECT id, p AS event_global_pos, topic, n_name AS name, 'Region-' || r || '/' || v AS event_id, id <= 30 AS acknowledged, CASE WHEN id <= 30 THEN n_name END AS relayed FROM E")
def outbox_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _relayed(spark, sf_dir)
    entries, acks = store.log.table("outbox"), store.log.table("acks").select("id", F.lit(True).alias("acknowledged"))
    relayed = store.events().where("stream_id = 'Relay'").select(F.get_json_object("data", "$.id").cast("long").alias("id"), _name().alias("relayed"))
    out = entries.join(acks, "id", "left").join(relayed, "id", "left")
    payload = lambda path: F.get_json_object("payload", path)
    return out.select("id", "event_global_pos", "topic", payload("$.data.name").alias("name"), payload("$.id").alias("event_id"), F.coalesce("acknowledged", F.lit(False)).alias("acknowledged"), "relayed")


@query(_ENTRIES + "SELECT id, topic, CAST(30 AS BIGINT) AS deleted FROM E WHERE id > 30")
def outbox_swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _relayed(spark, sf_dir)
    deleted = store.cleanup_outbox(0)
    return store.log.table("outbox").select("id", "topic", F.lit(deleted).cast("long").alias("deleted"))


@query(_N + "SELECT 'Copy-' || r AS stream_id, v AS stream_version, n_name AS name, 2 * (SELECT count(*) FROM nation) AS checkpoint, false AS failed_moved FROM N")
def projection_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection whose handler appends; it moves with what it writes, and one that fails does not move."""
    store, _ = _joined(spark, sf_dir)

    def copied(data, ctx):
        ctx.tx.append(f"Copy-{ctx.entity_id}", 0, [{"type": "Copied", "data": data}])

    def fails(data, ctx):
        ctx.tx.append("Copy-lost", 0, [{"type": "Copied", "data": data}])
        raise RuntimeError

    try:
        store.run_projection(define_projection("failing", "Region", {"NationJoined": fails}))
    except RuntimeError:
        pass
    p = define_projection("copies", "Region", {"NationJoined": copied})
    while store.run_projection(p, 10):
        pass
    at = store.log.refresh().checkpoints
    rows = store.events().where("stream_id LIKE 'Copy-%'")
    return rows.select("stream_id", "stream_version", _name().alias("name"), F.lit(at["copies"]).cast("long").alias("checkpoint"), F.lit("failing" in at).alias("failed_moved"))


def _rows(spark: SparkSession, events: Sequence[Any]) -> DataFrame:
    return spark.createDataFrame([(e.global_position, e.stream_id, e.stream_version, e.data and e.data.get("name")) for e in events], "global_position long, stream_id string, stream_version int, name string")


@query(_N + "SELECT p AS global_position, 'Region-' || r AS stream_id, v AS stream_version, n_name AS name FROM N WHERE p >= 4")
def subscription_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _joined(spark, sf_dir)
    found = store.subscribe("Reg", recursive=True, event_types=["NationJoined"], lower_bound={"id": "4", "type": "inclusive"}, batch_size=7, live=False)
    return _rows(spark, list(found))


@query(_N + "SELECT p AS global_position, 'Region-' || r AS stream_id, v AS stream_version, n_name AS name FROM N WHERE r = 3")
def aggregate_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _joined(spark, sf_dir)
    region = define_aggregate("Region", {"NationJoined": lambda s, e: e.data})
    return _rows(spark, list(region.subscribe(store, "3", live=False)))


@query(
    _N + """, P AS (SELECT p, (row_number() OVER (ORDER BY p DESC) - 1) // 4 + 1 AS page FROM N WHERE r IN (0, 2, 4))
    SELECT CAST(page AS INT) AS page, p AS global_position, CASE WHEN page < max(page) OVER () THEN min(p) OVER (PARTITION BY page) END AS cursor_position FROM P"""
)
def store_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of three streams, newest first; what is appended meanwhile stays out."""
    store, _ = _joined(spark, sf_dir)
    streams, cursor, out, n = ["Region-0", "Region-2", "Region-4"], None, [], 1
    while True:
        page = store.read_events_page(streams, 4, cursor, "desc")
        at = codecs.decode_cursor(page.next_cursor, "desc", streams)["globalPosition"] if page.next_cursor else None
        out += [(n, e.global_position, at) for e in page.events]
        if not page.has_next_page:
            return spark.createDataFrame(out, "page int, global_position long, cursor_position long")
        store.append("Region-2", 0, [{"type": "Late", "data": n}])
        cursor, n = page.next_cursor, n + 1


@query(_N + "SELECT 'Region-' || r AS stream_id, CAST(max(v) AS INT) AS version, max(v) AS members, arg_max(n_name, v) AS newest, max(v) AS domain_events FROM N GROUP BY r")
def aggregate_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, nations = _joined(spark, sf_dir)
    region = define_aggregate("Region", {"NationJoined": lambda s, e: {"members": (s or {"members": 0})["members"] + 1, "newest": e.data["name"]}})
    loads = {r: (region.load(store, str(r)), region.load_events(store, str(r))) for r in nations}
    rows = [(x.stream_id, x.version, x.state["members"], x.state["newest"], len(events)) for x, events in loads.values()]
    return spark.createDataFrame(rows, "stream_id string, version int, members int, newest string, domain_events int")


@query(
    _N + """SELECT 'Region-' || r AS stream_id, CAST(v + (v - 1) // 3 AS INT) AS stream_version, 'NationJoined' AS event_type, n_name AS name FROM N UNION ALL
    SELECT 'Region-' || r, CAST(v + (v - 1) // 3 + 1 AS INT), 'MembersSnapshot', NULL FROM N WHERE v % 3 = 0"""
)
def single_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends of one event with a snapshot every three, several of them in a transaction."""
    members = define_snapshot("Region", "Members", 3, {"n": 0}, {"NationJoined": lambda s, e: {"n": s["n"] + 1}})
    store = _opened(spark, snapshots=[members])
    for r, own in _nations(spark, sf_dir).items():
        store.with_transaction(lambda tx, r=r, own=own: [tx.append(f"Region-{r}", 0, [{"type": "NationJoined", "data": {"name": n.n_name}}]) for n in own])
    return store.events().select("stream_id", "stream_version", "event_type", _name().alias("name"))


@query(_N + "SELECT 'Region-' || r AS stream_id, v AS stream_version, CASE WHEN r <> 2 THEN n_name END AS name, r = 2 AS tombstoned, CAST(c AS INT) AS version, CASE WHEN r <> 2 THEN n_name END AS newest FROM (SELECT *, max(v) OVER (PARTITION BY r) AS m FROM N) WHERE v = m")
def encrypted_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate that declares encrypted fields and the key of an entity; loads hand tombstones to its functions."""
    sealed = Encryption(lambda entity: f"region:{entity}", {"NationJoined": ["name"]})
    region = define_aggregate("Region", {"NationJoined": lambda s, e: e.data and e.data["name"]}, sealed)
    store, out = _opened(spark, _ONE), []
    for r, own in _nations(spark, sf_dir).items():
        store.create_crypto_key(f"region:{r}")
        region.append(store, str(r), -1, [{"type": "NationJoined", "data": {"name": n.n_name, "key": n.n_nationkey}} for n in own])
    store.revoke_crypto_key("region:2")
    for r in _nations(spark, sf_dir):
        loaded, last = region.load(store, str(r)), store.load_latest_event_by_type(f"Region-{r}", "NationJoined")
        out.append((last.stream_id, last.stream_version, last.data and last.data["name"], last.tombstoned, loaded.version, loaded.state))
    return spark.createDataFrame(out, "stream_id string, stream_version int, name string, tombstoned boolean, version int, newest string")


@query("SELECT DISTINCT 'User-' || user_id AS stream_id FROM events ORDER BY stream_id DESC LIMIT 100")
def store_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of streams from the table of heads: the log is not read."""
    store = _opened(spark)
    store.append_frame(_user_batch(spark, sf_dir))
    return spark.createDataFrame([(s,) for s in store.list_streams()], "stream_id string")


# Bulk appends with keys and snapshots.


def _user_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.user_log(spark, sf_dir, versions=False)
    data = F.to_json(F.struct("value", F.struct(F.get_json_object("props", "$.k").cast("int").alias("k")).alias("props")))
    key = F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("crypto_key_id")
    return rows.select("stream_id", "event_type", data.alias("data"), F.col("global_position").alias("input_order"), key)


def _users(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/events.parquet").where(where).select("user_id").distinct()
    return users.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key_id"))


_FIELDS = {"signup": ["value", "props.k"]}


def _shredded(spark: SparkSession, sf_dir: str) -> EventStore:
    """The user log with the fields of signups (and one that views have not) encrypted under a key for each user; those of ids
    divisible by 7 revoked."""
    store = _opened(spark, _ONE)
    store.create_crypto_keys(_users(spark, sf_dir))
    store.append_frame(_user_batch(spark, sf_dir), encrypted_fields={**_FIELDS, "view": ["missing"]})
    store.revoke_crypto_keys(_users(spark, sf_dir, "user_id % 7 = 0"))
    return store


@query(
    LOG + """, D AS (SELECT *, event_type IN ('signup', 'view') AND user_id % 7 = 0 AS dead FROM L) SELECT global_position, stream_id, stream_version, event_type, dead AS tombstoned,
    CASE WHEN NOT dead THEN value END AS value, CASE WHEN NOT dead THEN CAST(json_extract(props, '$.k') AS INT) END AS k, event_type <> 'signup' AS readable_as_stored FROM D"""
)
def revoked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decrypted where the key lives, a tombstone where it is revoked, even if no field was there to encrypt; what is stored has
    no encrypted field in the clear."""
    store = _shredded(spark, sf_dir)
    value, k = F.get_json_object("data", "$.value"), F.get_json_object("data", "$.props.k")
    stored = store.events().select("global_position", (value.isNotNull() | k.isNotNull()).alias("readable_as_stored"))
    out = store.replayed().select("global_position", "stream_id", "stream_version", "event_type", "tombstoned", value.cast("double").alias("value"), k.cast("int").alias("k"))
    return out.join(stored, "global_position")


@query("SELECT DISTINCT 'user:' || user_id AS key_id, user_id % 7 = 0 AS revoked, user_id % 7 <> 0 AS has_material, CAST(0 AS BIGINT) AS stale_folders FROM events")
def revoked_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No wrapped key of a revoked id is left, nor a file of keys that no manifest names."""
    log = _shredded(spark, sf_dir).log
    stale = len(set(log.key_folders()) - set(log.refresh().folders["keys"]))
    return log.table("keys", log.as_of(1)).select("key_id", F.col("revoked_at").isNotNull().alias("revoked"), F.col("encrypted_key").isNotNull().alias("has_material"), F.lit(stale).cast("long").alias("stale_folders"))


@query("SELECT user_id, CAST(CASE WHEN user_id % 2 = 0 AND count(*) FILTER (event_type = 'signup') > 0 THEN 2 ELSE 1 END AS BIGINT) AS secret_version, 68 AS envelope_bytes, count(*) FILTER (event_type = 'signup' AND user_id % 2 = 0) AS readable FROM events GROUP BY user_id")
def rotated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys wrapped under one secret; those that a store with a newer one writes with are wrapped anew, all stay readable."""
    old = _opened(spark, _ONE)
    old.create_crypto_keys(_users(spark, sf_dir))
    env = {"GDPR_CRYPTO_SECRETS": "2:two,1:one", "GDPR_CRYPTO_CURRENT_VERSION": "2"}
    store = _opened(spark, Secrets.from_environment(env), root=old.log.files.root.rpartition("/")[0])
    user = F.expr("substring(stream_id, 6)").cast("long").alias("user_id")
    store.append_frame(_user_batch(spark, sf_dir).where(user % 2 == 0), encrypted_fields=_FIELDS)
    readable = store.replayed().where("event_type = 'signup' AND NOT tombstoned AND data LIKE '%value%'").groupBy(user).agg(F.count("*").alias("readable"))
    keys = store.log.table("keys").select(
        F.expr("substring(key_id, 6)").cast("long").alias("user_id"), codecs.read_uint32(F.col("encrypted_key"), 5).alias("secret_version"), F.octet_length("encrypted_key").alias("envelope_bytes")
    )
    return keys.join(readable, "user_id", "left").fillna(0, ["readable"])


@query(LOG + "SELECT global_position, stream_id || '/' || global_position AS event_id, 'name-' || user_id AS name, true AS gone_from_data, true AS fails_elsewhere FROM L WHERE event_type = 'signup'")
def crypto_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypted and decrypted by the package's plans; under another event's context the ciphertext does not open."""
    log = fixtures.user_log(spark, sf_dir, versions=False).where("event_type = 'signup'")
    event = F.concat("stream_id", F.lit("/"), F.col("global_position").cast("string"))
    data = F.to_json(F.struct(F.struct(F.concat(F.lit("name-"), F.col("user_id").cast("string")).alias("name")).alias("of")))
    rows = log.select("global_position", event.alias("id"), "event_type", "crypto_key_id", data.alias("data"))
    keys = _users(spark, sf_dir).select("key_id", F.unhex(F.sha2("key_id", 256)).alias("key"), F.lit(False).alias("revoked"))
    sealed = crypto.encrypt(rows, {"signup": ["of.name"]}, keys, 1)
    whole = crypto.decrypt(sealed, keys).select("global_position", F.get_json_object("data", "$.of.name").alias("name"))
    box = F.element_at("encrypted_data", "of.name")
    raw = F.concat(*(F.unbase64(box[k]) for k in ("iv", "ciphertext", "auth_tag")))
    moved = crypto.field_aad(F.lit("other/1"), F.col("crypto_key_id"), F.lit("of.name"), box["version"])
    wrong = F.try_aes_decrypt(raw, F.unhex(F.sha2("crypto_key_id", 256)), F.lit("GCM"), F.lit("DEFAULT"), moved).isNull()
    gone = F.get_json_object("data", "$.of.name").isNull() & F.col("data").contains("of")
    stored = sealed.select("global_position", F.col("id").alias("event_id"), gone.alias("gone_from_data"), wrong.alias("fails_elsewhere"))
    return stored.join(whole, "global_position")


def _purchases(every: int = 5, **how: Any) -> SnapshotHandle:
    return define_snapshot("User", "Purchases", every, {"total": 0.0, "n": 0}, {"purchase": lambda s, e: {"total": s["total"] + e.data["value"], "n": s["n"] + 1}}, **how)


_TOTALS = LOG + """, T AS (SELECT stream_id, user_id, max(stream_version) AS v, count(*) FILTER (event_type = 'purchase') AS n, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 2) AS total,
count(*) FILTER (event_type = 'error') AS e FROM L GROUP BY stream_id, user_id) """


@query(
    _TOTALS + """SELECT stream_id, CAST(v + 1 AS INT) AS stream_version, 'PurchasesSnapshot' AS event_type, n, total FROM T WHERE n >= 5
    UNION ALL SELECT stream_id, CAST(v + CAST(n >= 5 AS INT) + 1 AS INT), 'ErrorsSnapshot', e, NULL FROM T WHERE e >= 3"""
)
def bulk_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of one prefix, as one append to each stream leaves them."""
    errors_ = define_snapshot("User", "Errors", 3, {"n": 0}, {"error": lambda s, e: {"n": s["n"] + 1}})
    store = _opened(spark, snapshots=[_purchases(), errors_])
    store.append_frame(_user_batch(spark, sf_dir))
    rows = store.events().where("event_type LIKE '%Snapshot'")
    total = _money(F.get_json_object("data", "$.total").cast("double"))
    return rows.select("stream_id", "stream_version", "event_type", F.get_json_object("data", "$.n").cast("long").alias("n"), total.alias("total"))


@query(
    _TOTALS + """SELECT stream_id, CAST(v + CAST(n >= 5 AS INT) AS INT) AS version, CASE WHEN n >= 5 AND user_id % 3 <> 0 THEN CAST(v + 1 AS INT) END AS snapshot_version,
    CASE WHEN n >= 5 AND user_id % 3 <> 0 THEN 0 ELSE n END AS replayed_events, n FROM T"""
)
def snapshot_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads from encrypted snapshots; where the key of one is revoked the stream is folded from its start."""
    store = _opened(spark, _ONE, [_purchases(crypto_key_id=lambda user: f"user:{user}", encrypted_fields=["total", "n"])])
    store.create_crypto_keys(_users(spark, sf_dir))
    store.append_frame(_user_batch(spark, sf_dir))
    store.revoke_crypto_keys(_users(spark, sf_dir, "user_id % 3 = 0"))
    log = store.replayed()
    found = snapshots.bases(log, "Purchases", F.get_json_object("data", "$.n").cast("long"), F.col("tombstoned"))
    later = F.col("base_version").isNull() | (F.col("stream_version") > F.col("base_version"))
    n = F.coalesce(F.max("base"), F.lit(0)) + F.count_if(later & (F.col("event_type") == "purchase"))
    return snapshots.load(log, found, {"n": n}, ["purchase"])


@query(LOG + "SELECT stream_id, stream_version FROM (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY stream_id ORDER BY stream_version) AS n FROM L) WHERE event_type = 'purchase' AND n % 4 = 0")
def tracked_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due snapshots as a stateful stream over the log finds them."""
    from weftlog.sources import positions
    from weftlog.streaming import trackers

    store = _opened(spark)
    store.append_frame(_user_batch(spark, sf_dir))
    files = store.log.files
    due = trackers.due_snapshots(positions.stream(spark, files.root), ["purchase"], 4)
    q = due.writeStream.format("parquet").option("path", files.at("due")).option("checkpointLocation", files.at("due-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(due.schema).parquet(files.at("due")).select("stream_id", "stream_version")


# Reads of the log that stand beside pages and snapshots.


@query(LOG + "SELECT stream_id, stream_version, event_type FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY stream_version DESC) AS r FROM L) WHERE r <= 3")
def newest_of_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.top_of_streams(fixtures.user_log(spark, sf_dir), 3).select("stream_id", "stream_version", "event_type")


@query(_STORED + "SELECT stream_id, stored_version AS stream_version, max(CASE WHEN snapshot_after THEN stored_version + 1 END) OVER (PARTITION BY stream_id ORDER BY stream_version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS snapshot_version FROM S")
def snapshots_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = snapshots.carried(_with_snapshots(spark, sf_dir), "Purchases", F.col("state"))
    return log.where("event_type <> 'PurchasesSnapshot'").select("stream_id", "stream_version", "snapshot_version")


@query(
    "SELECT event_id, '\"' || event_type || '\"' AS type_json, CAST(event_id AS VARCHAR) AS second, CAST(NULL AS VARCHAR) AS deleted, 'null' AS unlisted, CAST(event_id * 2 AS VARCHAR) AS replaced, "
    "'\"' || event_type || '\"' AS created, false AS other_lost, length(event_type) AS decoded FROM events"
)
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Get, set and delete by dot path in JSON text, and canonical base64."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    j = F.to_json(F.struct(F.struct(F.col("event_type").alias("t"), "value").alias("a"), F.array(F.lit(0), "event_id").alias("l")))
    rows = e.select("event_id", "event_type", j.alias("j"))
    cut, unlisted = codecs.json_delete(F.col("j"), "a.t"), codecs.json_delete(F.col("j"), "l.1")
    double = codecs.json_set(F.col("j"), "l.1", (F.col("event_id") * 2).cast("string"))
    deep = codecs.json_set(F.col("j"), F.lit("x.y.z"), F.concat(F.lit('"'), "event_type", F.lit('"')))
    return rows.select(
        "event_id", codecs.json_get(F.col("j"), "a.t").alias("type_json"), codecs.json_get(F.col("j"), "l.1").alias("second"), codecs.json_get(cut, "a.t").alias("deleted"),
        codecs.json_get(unlisted, "l.1").alias("unlisted"), codecs.json_get(double, "l.1").alias("replaced"), codecs.json_get(deep, "x.y.z").alias("created"),
        codecs.json_get(cut, "a.value").isNull().alias("other_lost"), F.octet_length(codecs.unbase64_strict(F.base64(F.col("event_type").cast("binary")))).cast("long").alias("decoded"),
    )


@query("SELECT DISTINCT event_type, CAST(event_id % 3 + 1 AS INT) AS schema_version, CAST(CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 1 ELSE 3 END ELSE event_id % 3 + 1 END AS INT) AS latest FROM events")
def upcast_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that each type's chain arrives at, from upcasters that an aggregate declares."""
    same = lambda d: d
    user = define_aggregate("User", {"view": lambda s, e: s}, upcasters=[Upcaster("view", 2, 3, same), Upcaster("view", 1, 2, same), Upcaster("click", 2, 3, same)])
    chain = Upcasters()
    chain.register(*user.get_upcasters())
    pairs = fixtures.user_log(spark, sf_dir, versions=False).select("event_type", "schema_version").distinct().collect()
    return spark.createDataFrame([(r.event_type, r.schema_version, chain.latest(r.event_type, r.schema_version)) for r in pairs], "event_type string, schema_version int, latest int")


@query(
    """WITH P AS (SELECT * FROM (VALUES ('off-peak', 0, 100, 0.0, 7200), ('peak', 100, 800, 7200.0, 21600), ('cool-down', 900, 100, 28800.0, 7200)) t(name, o, n, b, d))
    SELECT name, o + k AS operation_index, round(CAST(b AS DOUBLE) + k * 1000 / (n / (d / 1000)), 6) AS due_ms FROM P, range(800) r(k) WHERE k < n"""
)
def request_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = generators.paced(generators.daily_phases(spark, 1000, 36))
    return out.withColumn("due_ms", F.round("due_ms", 6))


# The example application's queries: accounts of customers, whose orders are transactions.


def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction-<order>: a deposit (urgent or high: a withdrawal), reverted where the order is pending."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Withdrawal").otherwise("Deposit")
    kinds = F.filter(F.array(kind, F.when(F.col("o_orderstatus") == "P", "TransactionReverted")), lambda x: x.isNotNull())
    rows = o.select("o_orderkey", "o_custkey", "o_totalprice", F.posexplode(kinds).alias("k", "event_type"))
    return rows.select(
        F.concat(F.lit("Transaction-"), F.col("o_orderkey").cast("string")).alias("stream_id"), (F.col("k") + 1).cast("int").alias("stream_version"), "event_type",
        F.when(F.col("k") == 0, F.col("o_custkey")).alias("account"), F.when(F.col("k") == 0, F.col("o_totalprice")).alias("amount"),
    )


_APP = "SELECT o_orderkey, o_custkey AS account, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Withdrawal' ELSE 'Deposit' END AS kind, o_totalprice AS amount, o_orderstatus = 'P' AS reverted FROM orders"


@query(f"SELECT 'Transaction-' || o_orderkey AS stream_id, CAST(1 + CAST(reverted AS INT) AS INT) AS version, kind, account, amount, reverted FROM ({_APP})")
def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ["Deposit", "Withdrawal"]
    state = {
        "kind": folds.last(F.col("event_type"), made), "account": folds.last(F.col("account"), made), "amount": folds.last(F.col("amount"), made),
        "reverted": folds.handled(["TransactionReverted"]) > 0,
    }
    return folds.algebraic(_transactions(spark, sf_dir), state)


@query(
    f"""WITH T AS ({_APP}) SELECT c_custkey AS account, c_name AS owner, CASE WHEN coalesce(b, 0) < 0 THEN 'blocked' ELSE 'open' END AS status, round(coalesce(b, 0), 2) AS balance, coalesce(n, 0) AS transactions
    FROM customer LEFT JOIN (SELECT account, round(sum(CASE WHEN reverted THEN 0 WHEN kind = 'Deposit' THEN amount ELSE -amount END), 2) AS b, count(*) AS n FROM T GROUP BY account) ON account = c_custkey"""
)
def bank_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with the balance of what was not reverted; one that is overdrawn is blocked."""
    signed = F.when(F.col("reverted"), 0.0).when(F.col("kind") == "Deposit", F.col("amount")).otherwise(-F.col("amount"))
    sums = transactions(spark, sf_dir).groupBy("account").agg(_money(F.sum(signed)).alias("balance"), F.count("*").alias("transactions"))
    owners = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("account"), F.col("c_name").alias("owner"))
    out = owners.join(sums, "account", "left").fillna(0.0, ["balance"]).fillna(0, ["transactions"])
    return out.withColumn("status", F.when(F.col("balance") < 0, "blocked").otherwise("open"))
