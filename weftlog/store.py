"""The event store: commands and reads over a commit log, and builders of aggregates, snapshots and projections.

Everything that a caller changes goes through a transaction on one commit: appends, outbox entries, key changes and
checkpoints are published together by one manifest. A transaction that loses the race for its commit is run again on the new
state, so its function must have no effects of its own.
"""

from __future__ import annotations

import copy
import json
import re
import secrets
import threading
import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any, Protocol
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from weftlog.functions import errors, filters, validation
from weftlog.operators import appends, crypto, outbox, paging, reads, snapshots
from weftlog.operators.keyring import KeyRing, Sealer, Secrets
from weftlog.operators.upcasts import Upcaster, Upcasters
from weftlog.sources import schema
from weftlog.sources.commitlog import TABLES, CommitConflict, CommitLog, Snapshot

BATCH = 500
OUTBOX_BATCH = 100
WEEK_MS = 7 * 24 * 3600 * 1000
LEASE_S = 60.0
#: Rows of a bulk append that a task numbers by stream, about, and the most tasks for that.
TASK_ROWS, MOST_TASKS = 250_000, 10_000
#: Entries of the outbox that one claim covers.
CLAIM = 20
_FOLDER = re.compile(r"(?:keys|outbox|acks)/[0-9a-f]{32}(?:/part_of=\d+)?(?=/[^/]+$)")
_OWN = ("id", "source", "specversion", "subject", "datacontenttype", "global_position", "stream_id", "stream_version", "created_at")


@dataclass(frozen=True)
class Event:
    """A stored event; a tombstone has no data and ``tombstoned`` set."""

    id: str
    source: str
    specversion: str
    type: str
    subject: str
    time: str
    datacontenttype: str
    data: Any
    extensions: dict[str, Any]
    global_position: int
    stream_id: str
    stream_version: int
    created_at: datetime
    tombstoned: bool = False


@dataclass(frozen=True)
class AppendResult:
    stream_id: str
    from_version: int
    to_version: int
    global_positions: list[int]


@dataclass(frozen=True)
class OutboxEntry:
    id: int
    event_global_position: int
    topic: str
    payload: Any
    created_at: datetime


@dataclass(frozen=True)
class EventsPage:
    events: list[Event]
    has_next_page: bool
    next_cursor: str | None


class Projection(Protocol):
    projection_name: str

    def handle(self, event: Event, tx: Transaction) -> None: ...


def _iso(t: datetime) -> str:
    return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass
class Transaction:
    """What one commit will hold. Reads see the commit before it and the transaction's own appends."""

    store: EventStore
    state: Snapshot
    rows: list[dict[str, Any]] = field(default_factory=list)
    entries: list[tuple[int, str, str, datetime]] = field(default_factory=list)
    keys: dict[str, dict[str, Any]] = field(default_factory=dict)
    checkpoints: dict[str, int] = field(default_factory=dict)
    folders: dict[str, list[str]] = field(default_factory=dict)
    _heads: dict[str, int] = field(default_factory=dict)
    _stored_keys: dict[str, dict[str, Any] | None] = field(default_factory=dict)

    def head(self, stream_id: str) -> int:
        if stream_id not in self._heads:
            self._heads[stream_id] = self.store._head(stream_id, self.state)
        return self._heads[stream_id]

    def key_rows(self, key_ids: Iterable[str]) -> dict[str, dict[str, Any] | None]:
        """The row of each key, None if there is none: as changed here, else as stored now, whatever the commit read."""
        ids = list(dict.fromkeys(key_ids))
        if new := [k for k in ids if k not in self.keys and k not in self._stored_keys]:
            self._stored_keys |= self.store._key_rows(new)
        return {k: self.keys.get(k, self._stored_keys.get(k)) for k in ids}

    def append(self, stream_id: str, expected_version: int, events: Sequence[Mapping[str, Any]], outbox_topics: Sequence[str] | None = None) -> AppendResult:
        """Append to a stream at its expected version (-1: it must be new, 0: at any), then update registered snapshots."""
        result = self._append(stream_id, expected_version, events, outbox_topics, snapshots=False)
        for s in self.store.snapshots:
            if stream_id.startswith(f"{s.stream_prefix}-") and any(e["type"] in s.evolve for e in events):
                s.update_after_append(self, stream_id)
        return result

    def append_snapshot(self, stream_id: str, expected_version: int, event: Mapping[str, Any]) -> AppendResult:
        return self._append(stream_id, expected_version, [event], None, snapshots=True)

    def _append(self, stream_id: str, expected: int, events: Sequence[Mapping[str, Any]], topics: Sequence[str] | None, snapshots: bool) -> AppendResult:
        validation.append_input({"stream_id": stream_id, "expected_version": expected, "events": events, "outbox_topics": topics})
        if not events:
            raise ValueError("Cannot append zero events")
        validation.reserved_types([e["type"] for e in events], snapshots)
        head = self.head(stream_id)
        if expected == -1 and head or expected > 0 and expected != head:
            raise errors.OptimisticConcurrencyError(stream_id, expected, head)
        positions = []
        for row in self._prepared(stream_id, head + 1, events):
            self.rows.append(row)
            positions.append(row["global_position"])
            for topic in topics or ():
                self.entries.append((row["global_position"], topic, self._payload(row), row["created_at"]))
        self._heads[stream_id] = head + len(events)
        return AppendResult(stream_id, head + 1, head + len(events), positions)

    def _sealed(self, stream_id: str, first: int, events: Sequence[Mapping[str, Any]]) -> dict[int, tuple[Any, dict[str, Any], str]]:
        """(clean data, entries, key id) of the events with encrypted fields, by place: one plan for all keys, one for all fields."""
        asked = {n: e for n, e in enumerate(events) if e.get("encrypted_fields")}
        if not asked:
            return {}
        if not all(e.get("crypto_key_id") for e in asked.values()):
            raise errors.CryptoKeyIdRequiredError
        ring = self.store._ring_or_refuse()
        keys, renewed = ring.for_writing(self.key_rows(e["crypto_key_id"] for e in asked.values()))
        self.keys |= renewed
        todo = [(e.get("data"), e["encrypted_fields"], keys[e["crypto_key_id"]], f"{stream_id}/{first + n}", e["crypto_key_id"]) for n, e in asked.items()]
        return {n: (*box, e["crypto_key_id"]) for (n, e), box in zip(asked.items(), ring.encrypt_fields(todo))}

    def _prepared(self, stream_id: str, first: int, events: Sequence[Mapping[str, Any]]) -> Iterator[dict[str, Any]]:
        sealed, at = self._sealed(stream_id, first, events), self.state.last_position + len(self.rows) + 1
        for n, e in enumerate(events):
            data, boxes, key_id = sealed.get(n, (e.get("data"), None, None))
            now, schema_version = _now(), e.get("schema_version") or 1
            yield {
                "global_position": at + n,
                "stream_id": stream_id,
                "stream_version": first + n,
                "id": f"{stream_id}/{first + n}",
                "source": e.get("source") or self.store.default_source,
                "specversion": schema.SPECVERSION,
                "event_type": e["type"],
                "subject": stream_id,
                "time": now,
                "datacontenttype": schema.CONTENT_TYPE,
                "data": json.dumps(data, separators=(",", ":")),
                "extensions": json.dumps({**(e.get("extensions") or {}), "schemaversion": schema_version}, separators=(",", ":")),
                "encrypted_data": boxes,
                "crypto_key_id": key_id,
                "schema_version": schema_version,
                "created_at": now,
                "txid": self.state.commit_id + 1,
            }

    @staticmethod
    def _payload(row: Mapping[str, Any]) -> str:
        extra = {k: v for k, v in json.loads(row["extensions"]).items() if k not in outbox.RESERVED}
        base = {k: row[k] for k in ("specversion", "id", "source", "subject", "datacontenttype")}
        return json.dumps({**extra, **base, "type": row["event_type"], "time": _iso(row["time"]), "data": json.loads(row["data"])})

    def load(self, stream_id: str, from_version: int = 1, max_events: int | None = None) -> list[Event]:
        stored = reads.stream(self.store._log(self.state), stream_id, from_version, max_events).select(*schema.REPLAY_COLUMNS).collect()
        own = [Row(**r) for r in self.rows if r["stream_id"] == stream_id and r["stream_version"] >= from_version]
        return self.store._replayed([*stored, *own][:max_events], self.key_rows)

    def latest(self, stream_id: str, event_type: str) -> Event | None:
        own = [Row(**r) for r in self.rows if r["stream_id"] == stream_id and r["event_type"] == event_type]
        if not own:
            rows = self.store._log(self.state).where((F.col("stream_id") == stream_id) & (F.col("event_type") == event_type))
            own = rows.orderBy(F.desc("stream_version")).limit(1).select(*schema.REPLAY_COLUMNS).collect()
        found = self.store._replayed(own[-1:], self.key_rows)
        return found[0] if found else None

    def body(self) -> dict[str, Any]:
        """The manifest of what has been done."""
        log, spark = self.store.log, self.store.spark
        folders = {k: list(v) for k, v in self.folders.items()}
        if self.rows:
            names = schema.LOG.names
            rows = spark.createDataFrame([tuple(r[n] for n in names) for r in self.rows], schema.LOG)
            folders.setdefault("events", []).append(log.stage("events", rows.coalesce(1)))
        replaced: dict[str, list[str]] = {}
        if self.keys:
            new, old = self.store._staged_keys(self.keys, self._stored_keys, self.state)
            folders.setdefault("keys", []).append(new)
            replaced["keys"] = old
        first = self.state.last_outbox
        if self.entries:
            rows = [(first + k, *e) for k, e in enumerate(self.entries, 1)]
            folders.setdefault("outbox", []).append(log.stage("outbox", spark.createDataFrame(rows, schema.OUTBOX).coalesce(1)))
        return {
            "folders": folders, "replaced": replaced, "checkpoints": self.checkpoints, "streams": sorted({r["stream_id"] for r in self.rows}),
            "heads": {s: self._heads[s] for s in {r["stream_id"] for r in self.rows}},
            "ranges": {f: [self.state.last_position + 1, self.state.last_position + len(self.rows)] for f in folders.get("events", ())},
            "last_position": self.state.last_position + len(self.rows), "last_outbox": first + len(self.entries),
        }

    @property
    def changed(self) -> bool:
        return bool(self.rows or self.entries or self.keys or self.checkpoints or self.folders)


class EventStore:
    """See the module; every method but ``register_upcaster`` needs :meth:`setup` first."""

    def __init__(self, spark: SparkSession, root: str, schema_name: str = "eventstore", secrets: Secrets | None = None, default_source: str = schema.DEFAULT_SOURCE, snapshots: Sequence[SnapshotHandle] = ()) -> None:
        validation.require(isinstance(default_source, str) and default_source != "", "default_source", "must be a non-empty string")
        self.spark, self.default_source, self.snapshots = spark, default_source, list(snapshots)
        self._commit_log = CommitLog(spark, root, schema_name)
        given = secrets or Secrets.from_environment()
        self._ring = KeyRing(Sealer(spark), given) if given else None
        self._upcasters, self._ready = Upcasters(), False
        self._known_heads: dict[str, tuple[int, int]] = {}

    # Set-up and plumbing.

    def setup(self) -> None:
        self._commit_log.setup()
        self._ready = True

    @property
    def log(self) -> CommitLog:
        if not self._ready:
            raise errors.EventStoreNotInitializedError
        return self._commit_log

    def _log(self, state: Snapshot | None = None, after: int | None = None) -> DataFrame:
        return self.log.table("events", state, after)

    def events(self) -> DataFrame:
        """The whole log as a DataFrame, as of now: for analytics with the operators of this package."""
        return self._log()

    def replayed(self, upcasters: Upcasters | None = None) -> DataFrame:
        """The whole log as readers of streams get it, as one plan: decrypted, with ``tombstoned``, and upcast by functions of
        JSON columns."""
        return crypto.replayed(self._log(), self.keys(), upcasters)

    def _ring_or_refuse(self) -> KeyRing:
        if self._ring is None:
            raise errors.CryptoSecretsRequiredError
        return self._ring

    def _key_rows(self, key_ids: Sequence[str]) -> dict[str, dict[str, Any] | None]:
        """Rows of the table of keys with the file they are in, as stored now; read anew if it is replaced meanwhile."""
        found: dict[str, dict[str, Any]] = {}
        for attempt in range(3):
            state = self.log.refresh().pinned()
            if not state.folders["keys"]:
                break
            try:
                rows = self.log.table("keys", state).where(F.col("key_id").isin(list(key_ids)))
                found = {r.key_id: r.asDict() for r in rows.select("*", F.col("_metadata.file_path").alias("_file")).collect()}
                break
            except Exception:
                if attempt == 2 or self.log.refresh().folders["keys"] == state.folders["keys"]:
                    raise
        return {k: found.get(k) for k in key_ids}

    def _key_rows_of(self, key_ids: Iterable[str]) -> dict[str, dict[str, Any] | None]:
        return self._key_rows(list(dict.fromkeys(key_ids)))

    def keys(self) -> DataFrame | None:
        """All entity keys, unwrapped, for the plans of :mod:`weftlog.operators.crypto`; None without secrets."""
        return self._ring.opened(self.log.table("keys")) if self._ring else None

    def _staged_keys(self, changed: Mapping[str, Mapping[str, Any]], stored: Mapping[str, Mapping[str, Any] | None], state: Snapshot) -> tuple[str, list[str]]:
        """The new folder of changed keys, and the folders that it replaces: those that held one of them before."""
        old = sorted({_FOLDER.search(unquote(r["_file"]))[0] for k in changed if (r := stored.get(k))})
        if not set(old) <= set(state.folders["keys"]):  # another commit rewrote them: this one cannot be published
            old = []
        names = [f.name for f in schema.CRYPTO_KEYS.fields]
        new = self.spark.createDataFrame([tuple({"key_id": k, **r}[n] for n in names) for k, r in changed.items()], schema.CRYPTO_KEYS)
        if old:
            kept = self.spark.read.schema(schema.CRYPTO_KEYS).parquet(*map(self.log.files.at, old))
            new = new.unionByName(kept.where(~F.col("key_id").isin(list(changed))))
        return self.log.stage("keys", new.coalesce(1)), old

    def _head(self, stream_id: str, state: Snapshot) -> int:
        """A head that was read before holds while no later commit touched its stream."""
        if known := self._known_heads.get(stream_id):
            at, version = known
            touched = self.log.touched_since(at) if at <= state.commit_id else None
            if touched is not None and stream_id not in touched:
                return version
        version = state.heads.get(stream_id, 0)
        if state.folders["heads"]:
            stored = self.log.table("heads", state).where(F.col("stream_id") == stream_id).agg(F.max("version").alias("v")).first().v
            version = max(version, stored or 0)
        self._known_heads[stream_id] = (state.commit_id, version)
        return version

    def _heads_of(self, streams: DataFrame, state: Snapshot) -> DataFrame:
        """(stream_id, version) of those of ``streams`` that exist: from the table of heads, not the log."""
        known = self._heads_table(state).join(streams.distinct(), "stream_id", "left_semi")
        return known.groupBy("stream_id").agg(F.max("version").alias("version"))

    def _heads_table(self, state: Snapshot) -> DataFrame:
        return self.log.table("heads", state).unionByName(self.spark.createDataFrame(list(state.heads.items()), schema.HEADS))

    def with_transaction(self, work: Callable[[Transaction], Any]) -> Any:
        """Run ``work`` on a transaction and publish it; nothing is published if it raises."""

        held: list[Any] = []

        def build(state: Snapshot) -> tuple[Mapping[str, Any], Any] | None:
            tx = Transaction(self, state.pinned())
            result = work(tx)
            held[:] = [result, tx]
            return (tx.body(), None) if tx.changed else None

        self.log.commit(build)
        result, tx = held
        if len(self._known_heads) > 10_000:
            self._known_heads.clear()
        for s in {r["stream_id"] for r in tx.rows}:
            self._known_heads[s] = (tx.state.commit_id + 1, tx._heads[s])
        return result

    def with_retry(self, work: Callable[[], Any], max_retries: int = 3) -> Any:
        """Run again on a concurrency conflict, at once, so often at most; other errors go through."""
        for attempt in range(max_retries + 1):
            try:
                return work()
            except errors.OptimisticConcurrencyError:
                if attempt == max_retries:
                    raise
        return None

    # Commands.

    def append(self, stream_id: str, expected_version: int, events: Sequence[Mapping[str, Any]], outbox_topics: Sequence[str] | None = None, tx: Transaction | None = None) -> AppendResult:
        self.log  # noqa: B018
        if tx is not None:
            return tx.append(stream_id, expected_version, events, outbox_topics)
        return self.with_transaction(lambda t: t.append(stream_id, expected_version, events, outbox_topics))

    def append_frame(
        self, batch: DataFrame, expected: DataFrame | None = None, outbox_topics: Sequence[str] | None = None, encrypted_fields: Mapping[str, Sequence[str]] | None = None
    ) -> int:
        """Append many events to many streams in one commit, as plans; returns how many, snapshots not counted.

        ``batch``: stream_id, event_type, data (JSON), input_order, and at will source, extensions (JSON), schema_version,
        crypto_key_id. ``expected``: (stream_id, expected_version) of streams that must be at a version; the first that is not
        raises. ``outbox_topics`` and ``encrypted_fields`` (paths by type) hold for all rows. A stream's rows are one append:
        registered snapshots are stored after its last one as :meth:`append` would store them (their handlers see no position).

        Positions follow input_order without a global sort in one task: rows are range-partitioned, and each partition's
        numbers begin after those before it.
        """
        log, fields = self.log, {k: list(v) for k, v in (encrypted_fields or {}).items() if v}
        if outbox_topics is not None:
            validation.texts(outbox_topics, "outbox_topics", distinct=True)
        if fields:
            self._ring_or_refuse()
        given = set(batch.columns)
        extra = lambda name, default: F.col(name) if name in given else F.lit(default)
        key_id = F.when(F.col("event_type").isin(list(fields)), extra("crypto_key_id", None).cast("string")) if fields else F.lit(None).cast("string")
        rows = batch.select(
            "stream_id", "event_type", F.coalesce("data", F.lit("null")).alias("data"), F.col("input_order").cast("long").alias("input_order"),
            F.coalesce(extra("source", None).cast("string"), F.lit(self.default_source)).alias("source"), extra("extensions", None).cast("string").alias("extensions"),
            F.coalesce(extra("schema_version", 1).cast("int"), F.lit(1)).alias("schema_version"), key_id.alias("crypto_key_id"),
        )
        keyless = F.col("event_type").isin(list(fields)) & (F.coalesce("crypto_key_id", F.lit("")) == "") if fields else F.lit(False)
        unnamed = F.col("event_type").isNull() | (F.col("event_type") == "") | F.col("stream_id").isNull() | (F.col("stream_id") == "")
        bad = unnamed | F.col("event_type").endswith(validation.SNAPSHOT_SUFFIX) | keyless
        seen = rows.agg(F.count("*").alias("n"), F.first(F.when(bad, F.struct("event_type", keyless.alias("keyless"))), ignorenulls=True).alias("bad")).first()
        if hit := seen.bad:
            if hit.event_type and validation.is_snapshot_type(hit.event_type):
                raise errors.ReservedSnapshotEventTypeError(hit.event_type)
            raise errors.CryptoKeyIdRequiredError if hit.keyless else errors.InvalidArgumentError("batch", "needs stream_id and event_type in each row")
        tasks = max(self.spark.sparkContext.defaultParallelism, min(-(-seen.n // TASK_ROWS), MOST_TASKS))

        def build(state: Snapshot) -> tuple[Mapping[str, Any], int]:
            heads = self._heads_of(rows.select("stream_id"), state)
            if expected is not None:
                asked = self._heads_of(expected.select("stream_id"), state)
                lost = appends.checked(expected, asked).where("conflict").orderBy("stream_id").first()
                if lost:
                    raise errors.OptimisticConcurrencyError(lost.stream_id, lost.expected_version, lost.actual_version)
            # By number: sizes of shuffle blocks, by which adaptive plans join partitions, tell little of rows that compress well.
            numbered = appends.numbered(rows.repartition(tasks, "stream_id"), heads).drop("from_version").withColumns({"id": F.concat("stream_id", F.lit("/"), "stream_version"), "snapshot": F.lit(0)})
            if fields:
                self._used_keys(numbered, fields)
            numbered, snapshot_fields = self._with_snapshots(numbered, state)
            whole, key_folders = self._encrypted(numbered, fields | snapshot_fields, state)
            whole = whole.repartitionByRange("input_order").sortWithinPartitions("input_order", "stream_id", "stream_version")
            path = log.files.at(f"events/draft-{threading.get_ident()}-{time.time_ns()}")
            whole.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("k")).write.parquet(path)
            draft = self.spark.read.parquet(path)
            sizes = draft.groupBy("p").agg(F.count("*").alias("n"), F.count_if(F.col("snapshot") == 0).alias("m"))
            starts = sizes.selectExpr("p", f"sum(n) OVER (ORDER BY p) - n + {state.last_position} AS begin", "sum(m) OVER (ORDER BY p) - m AS before")
            placed = draft.join(F.broadcast(starts), "p").withColumn("global_position", F.col("begin") + F.col("k") + 1)
            now = F.lit(_now())
            version = F.parse_json(F.col("schema_version").cast("string"))
            kept = F.coalesce(F.from_json("extensions", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
            merged = F.map_concat(F.map_filter(kept, lambda k, v: k != "schemaversion"), F.create_map(F.lit("schemaversion"), version))
            whole = placed.withColumns(
                {
                    "specversion": F.lit(schema.SPECVERSION), "subject": F.col("stream_id"), "time": now, "datacontenttype": F.lit(schema.CONTENT_TYPE),
                    "extensions": F.to_json(merged), "created_at": now, "txid": F.lit(state.commit_id + 1),
                }
            )
            total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()
            folder = log.stage("events", whole)
            folders = {"events": [folder], "heads": [log.stage("heads", draft.groupBy("stream_id").agg(F.max("stream_version").alias("version")))]}
            if outbox_topics and total.m:
                order = F.expr("row_number() OVER (PARTITION BY p ORDER BY k)") + F.col("before") - 1
                mine = whole.where("snapshot = 0").select("global_position", "created_at", order.alias("nth"), outbox.payload().alias("payload"))
                sent = outbox.fan_out(mine, list(outbox_topics))
                entry = F.col("nth") * len(outbox_topics) + F.col("k") + state.last_outbox + 1
                folders["outbox"] = [log.stage("outbox", sent.select(entry.alias("id"), "event_global_pos", "topic", "payload", "created_at"))]
            log.files.delete(path.removeprefix(f"{log.files.root}/"))
            body = {"folders": folders, "ranges": {folder: [state.last_position + 1, state.last_position + total.n]}, "streams": None, "last_position": state.last_position + total.n}
            if key_folders:
                folders["keys"], body["replaced"] = key_folders[0], {"keys": key_folders[1]}
            return body | {"last_outbox": state.last_outbox + total.m * len(outbox_topics or ())}, total.m

        return log.commit(build)

    def _with_snapshots(self, numbered: DataFrame, state: Snapshot) -> tuple[DataFrame, dict[str, list[str]]]:
        """``numbered`` with the snapshots that fall due after each stream's last row, and what of them is encrypted."""
        found, fields = None, {}
        for n, handle in enumerate(self.snapshots, 1):
            if handle.every > 0:
                due = handle.due(self, numbered, state).withColumn("snapshot", F.lit(n))
                found = due if found is None else found.unionByName(due)
                if handle.crypto_key_id and handle.encrypted_fields:
                    fields[handle.snapshot_event_type] = list(handle.encrypted_fields)
        if found is None:
            return numbered, {}
        later = F.expr("CAST(stream_version + row_number() OVER (PARTITION BY stream_id ORDER BY snapshot) AS int)")
        stored = found.withColumn("stream_version", later).withColumns(
            {"source": F.lit(self.default_source), "extensions": F.lit(None).cast("string"), "schema_version": F.lit(1), "id": F.concat("stream_id", F.lit("/"), "stream_version")}
        )
        return numbered.unionByName(stored.select(*numbered.columns)), fields

    @staticmethod
    def _folders_with(stored: DataFrame, some: DataFrame, key: str) -> list[str]:
        """The folders of a table that hold one of ``some`` rows, by key: as many as there are folders at most."""
        at = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), _FOLDER.pattern, 0)
        return sorted(r.f for r in stored.select(key, at.alias("f")).join(some, key, "left_semi").select("f").distinct().collect())

    def _used_keys(self, rows: DataFrame, fields: Mapping[str, Sequence[str]]) -> DataFrame:
        """(key_id) of all keys that encrypting ``rows`` uses; the first that is missing or revoked raises."""
        used = rows.where(F.col("event_type").isin(list(fields))).select(F.col("crypto_key_id").alias("key_id")).distinct()
        dead = self.log.table("keys").select("key_id", F.col("revoked_at").isNotNull().alias("dead"))
        if lost := used.join(dead, "key_id", "left").where("dead IS NULL OR dead").orderBy("key_id").first():
            raise (errors.CryptoKeyRevokedError if lost.dead else errors.CryptoKeyNotFoundError)(lost.key_id)
        return used

    def _encrypted(self, rows: DataFrame, fields: Mapping[str, Sequence[str]], state: Snapshot) -> tuple[DataFrame, tuple[list[str], list[str]] | None]:
        """``rows`` with their fields encrypted, and (new, replaced) folders of keys if some had to be wrapped anew."""
        if not fields:
            return rows.withColumn("encrypted_data", F.lit(None).cast(schema.ENCRYPTED)), None
        ring, log, stored, used = self._ring_or_refuse(), self.log, self.log.table("keys"), self._used_keys(rows, fields)
        keys = ring.opened(stored.join(used, "key_id", "left_semi"))
        stale = keys.where(F.col("version") < ring.given.current)
        folders = None
        if state.folders["keys"] and stale.first():
            old = self._folders_with(stored, stale, "key_id")
            held = self.spark.read.schema(schema.CRYPTO_KEYS).parquet(*map(log.files.at, old))
            created = held.select("key_id", "created_at")
            anew = ring.wrapped(stale.join(created, "key_id"))
            folders = [log.stage("keys", held.join(stale, "key_id", "left_anti").unionByName(anew.select(*held.columns)))], old
        return crypto.encrypt(rows, fields, keys, ring.given.current), folders

    def create_crypto_key(self, key_id: str) -> None:
        """A new entity key; nothing if the id exists, revoked or not."""
        self.log  # noqa: B018
        validation.require(isinstance(key_id, str) and key_id != "", "key_id", "must be a non-empty string")
        ring = self._ring_or_refuse()

        def work(tx: Transaction) -> None:
            if tx.key_rows([key_id])[key_id] is None:
                tx.keys |= ring.new_rows([key_id])

        self.with_transaction(work)

    def create_crypto_keys(self, key_ids: DataFrame) -> int:
        """New entity keys for those of ``key_ids`` (key_id) that have none, in one commit, as plans; returns how many."""
        ring, log = self._ring_or_refuse(), self.log

        def build(state: Snapshot) -> tuple[Mapping[str, Any], int] | None:
            new = key_ids.select("key_id").where("key_id <> ''").distinct().join(log.table("keys", state), "key_id", "left_anti")
            # Random numbers of a plan are drawn with a seed; keys come from the system's own source, batch by batch.
            drawn = new.mapInArrow(_drawn_keys, "key_id string, key binary")
            folder = log.stage("keys", ring.wrapped(drawn.withColumn("created_at", F.current_timestamp())))
            n = self.spark.read.parquet(log.files.at(folder)).count()
            if not n:
                log.files.delete(folder)
                return None
            return {"folders": {"keys": [folder]}}, n

        return log.commit(build) or 0

    def revoke_crypto_key(self, key_id: str) -> None:
        """Forget the key: what it encrypted can be read no more. Again is the same; an unknown id is an error.

        The files that held its wrapped material are deleted, those that no manifest names too.
        """
        ring, log = self._ring_or_refuse(), self.log

        def work(tx: Transaction) -> None:
            row = tx.key_rows([key_id])[key_id]
            if row is None:
                raise errors.CryptoKeyNotFoundError(key_id)
            if row["revoked_at"] is None or row["encrypted_key"] is not None:
                tx.keys[key_id] = ring.revoked_row(row)

        self.with_transaction(work)
        log.shred()

    def revoke_crypto_keys(self, key_ids: DataFrame) -> int:
        """Forget all keys of ``key_ids`` (key_id) in one commit, as plans; returns how many were not revoked yet."""
        self._ring_or_refuse()
        log, wanted = self.log, key_ids.select("key_id").distinct()

        def build(state: Snapshot) -> tuple[Mapping[str, Any], int] | None:
            stored = log.table("keys")
            if lost := wanted.join(stored, "key_id", "left_anti").orderBy("key_id").first():
                raise errors.CryptoKeyNotFoundError(lost.key_id)
            live = stored.where("revoked_at IS NULL OR encrypted_key IS NOT NULL").join(wanted, "key_id", "left_semi").select("key_id")
            n = live.count() if state.folders["keys"] else 0
            if not n:
                return None
            old = self._folders_with(stored, live, "key_id")
            held = self.spark.read.schema(schema.CRYPTO_KEYS).parquet(*map(log.files.at, old))
            gone = held.join(live, "key_id", "left_semi").withColumns({"encrypted_key": F.lit(None).cast("binary"), "revoked_at": F.coalesce("revoked_at", F.lit(_now()))})
            folder = log.stage("keys", held.join(live, "key_id", "left_anti").unionByName(gone))
            return {"folders": {"keys": [folder]}, "replaced": {"keys": old}}, n

        done = log.commit(build) or 0
        log.shred()
        return done

    def register_upcaster(self, *upcasters: Upcaster) -> None:
        self._upcasters.register(*upcasters)

    # Reads.

    def _replayed(self, rows: Sequence[Row], keys: Callable[[Iterable[str]], Mapping[str, Any]]) -> list[Event]:
        """Decrypt, leave tombstones, upcast: one plan for all keys, one for all fields."""
        data = [json.loads(r.data) if r.data is not None else None for r in rows]
        sealed = [k for k, r in enumerate(rows) if r.encrypted_data is not None and r.crypto_key_id]
        opened = self._ring.for_reading(keys(rows[k].crypto_key_id for k in sealed)) if self._ring and sealed else {}
        dead = {k for k in sealed if opened.get(rows[k].crypto_key_id) is None}
        live = [k for k in sealed if k not in dead]
        if live:
            boxes = lambda r: {p: v if isinstance(v, Mapping) else v.asDict() for p, v in r.encrypted_data.items()}
            whole = self._ring.decrypt_fields([(data[k], boxes(rows[k]), opened[rows[k].crypto_key_id], rows[k].id, rows[k].crypto_key_id) for k in live])
            for k, d in zip(live, whole):
                data[k] = d
        return [_event(r, None if k in dead else self._upcasters.value(r.event_type, r.schema_version, data[k]), k in dead) for k, r in enumerate(rows)]

    def load(self, stream_id: str, max_events: int | None = None) -> list[Event]:
        return self.load_from(stream_id, 1, max_events)

    def load_from(self, stream_id: str, from_version: int, max_events: int | None = None, tx: Transaction | None = None) -> list[Event]:
        validation.positive(from_version, "from_version")
        if max_events is not None:
            validation.positive(max_events, "max_events")
        return (tx or Transaction(self, self.log.refresh().pinned())).load(stream_id, from_version, max_events)

    def load_latest_event_by_type(self, stream_id: str, event_type: str, tx: Transaction | None = None) -> Event | None:
        return (tx or Transaction(self, self.log.refresh().pinned())).latest(stream_id, event_type)

    def get_stream_version(self, stream_id: str) -> int:
        return self._head(stream_id, self.log.refresh())

    def list_streams(self, prefix: str = "", limit: int = 100) -> list[str]:
        validation.positive(limit, "limit")
        state = self.log.refresh()
        return [r.stream_id for r in reads.streams(self._heads_table(state), prefix, limit).collect()]

    def read_events_page(self, stream_ids: Sequence[str], limit: int, cursor: str | None = None, order: str = "asc") -> EventsPage:
        state = self.log.refresh()
        page = paging.read_page(self._log(state).select(*schema.REPLAY_COLUMNS, "txid"), stream_ids, limit, cursor, order, state.commit_id)
        return EventsPage(self._replayed(page.events, self._key_rows_of), page.has_next_page, page.next_cursor)

    # Consumers.

    def run_projection(self, projection: Projection, batch_size: int = BATCH) -> int:
        """Handle the next batch after the projection's checkpoint and move it, in one commit; returns the events read.

        An error of the handler publishes nothing, so that what a handler appends and the checkpoint agree exactly.
        """
        validation.positive(batch_size, "batch_size")

        def work(tx: Transaction) -> int:
            at = tx.state.checkpoints.get(projection.projection_name, 0)
            if tx.state.last_position <= at:
                return 0
            rows = reads.after_position(self._log(tx.state, at), at, tx.state.last_position, limit=batch_size).select(*schema.EVENT_COLUMNS).collect()
            for r in rows:
                projection.handle(_event(r, json.loads(r.data), False), tx)
            if rows:
                tx.checkpoints[projection.projection_name] = rows[-1].global_position
            return len(rows)

        return self.with_transaction(work)

    def subscribe(self, subject: str | None = None, recursive: bool = False, event_types: Sequence[str] | None = None, lower_bound: Mapping[str, str] | None = None, batch_size: int = BATCH, poll_interval_ms: int = 1000, signal: threading.Event | None = None, live: bool = True) -> Iterator[Event]:
        """Events that match, in position order: first what is there, then (if ``live``) what comes, until ``signal`` is set.

        Data is as stored: neither decrypted nor upcast. Arguments are checked when the first event is asked for.
        """
        log = self.log

        def stream() -> Iterator[Event]:
            validation.subscribe_options(subject, recursive, event_types, lower_bound, batch_size, poll_interval_ms)
            wanted, at, stop = filters.subscription(subject, recursive, event_types), filters.start_position(lower_bound), signal or threading.Event()
            while not stop.is_set():
                state = log.refresh()
                state_id, end, rows = state.commit_id, state.last_position, []
                if end > at:
                    rows = reads.after_position(self._log(state, at), at, end, wanted, batch_size).select(*schema.EVENT_COLUMNS).collect()
                    for r in rows:
                        if stop.is_set():
                            return
                        yield _event(r, json.loads(r.data), False)
                        at = r.global_position
                if len(rows) < batch_size:
                    at = max(at, end)
                    if not live:
                        return
                    log.wait(state_id, poll_interval_ms / 1000, stop)

        return stream()

    def process_outbox(self, handler: Callable[[list[OutboxEntry], Transaction], None], limit: int = OUTBOX_BATCH) -> int:
        """Claim pending entries, hand them over, acknowledge them; returns how many.

        A claim is an exclusive file for a block of entries by id, which other workers respect for a minute, so that batches are
        disjoint. An error of the handler gives the claims back; entries come at least once.
        """
        validation.positive(limit, "limit")
        log = self.log
        state = log.refresh()
        taken = CLAIM * len(log.files.names("claims"))
        rows = outbox.pending(log.table("outbox", state), log.table("acks", state)).orderBy("id").limit(limit + taken).collect()
        mine, blocks = [], {}
        for r in rows:
            block = r.id // CLAIM
            if len(mine) < limit and (blocks[block] if block in blocks else blocks.setdefault(block, self._claim(block))):
                mine.append(r)
        try:
            # What another worker acknowledged between the read and the claim is not pending any more.
            if mine:
                done = {r.id for r in log.table("acks").where(F.col("id").isin([r.id for r in mine])).collect()}
                mine_now = [r for r in mine if r.id not in done]
            else:
                mine_now = []
            if not mine_now:
                return 0
            entries = [OutboxEntry(r.id, r.event_global_pos, r.topic, json.loads(r.payload), r.created_at) for r in mine_now]

            def work(tx: Transaction) -> int:
                handler(entries, tx)
                acks = self.spark.createDataFrame([(e.id, _now()) for e in entries], schema.ACKS)
                tx.folders["acks"] = [log.stage("acks", acks.coalesce(1))]
                return len(entries)

            return self.with_transaction(work)
        finally:
            for block, held in blocks.items():
                if held:
                    log.files.delete(f"claims/{block}")

    def _claim(self, block: int) -> bool:
        name = f"claims/{block}"
        for _ in range(2):
            try:
                self.log.files.create(name, str(time.time()))
                return True
            except CommitConflict:
                since = self.log.files.read(name)
                if since is None or time.time() - float(since or 0) <= LEASE_S:
                    return False
                self.log.files.delete(name)
        return False

    def cleanup_outbox(self, older_than_ms: int = WEEK_MS, batch_size: int = 1000) -> int:
        """Delete entries acknowledged longer ago than an age; returns how many. Folders that hold such entries are rewritten, in
        one commit whatever the batch size; all others stay."""
        validation.not_negative(older_than_ms, "older_than_ms")
        validation.positive(batch_size, "batch_size")
        log = self.log

        def build(state: Snapshot) -> tuple[Mapping[str, Any], int] | None:
            acks = log.table("acks", state)
            gone = outbox.expired(acks, F.lit(_now()), older_than_ms).select("id")
            n = log.table("outbox", state).join(gone, "id", "left_semi").count() if state.folders["acks"] and state.folders["outbox"] else 0
            if not n:
                return None
            body: dict[str, dict[str, list[str]]] = {"folders": {}, "replaced": {}}
            for t in ("outbox", "acks"):
                old = self._folders_with(log.table(t, state), gone, "id")
                kept = self.spark.read.schema(TABLES[t]).parquet(*map(log.files.at, old)).join(gone, "id", "left_anti")
                body["folders"][t], body["replaced"][t] = [log.stage(t, kept)], old
            return body, n

        return log.commit(build) or 0


def _drawn_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([secrets.token_bytes(schema.KEY) for _ in range(b.num_rows)], pa.binary())], ["key_id", "key"])


def _event(r: Row, data: Any, dead: bool) -> Event:
    own = {n: getattr(r, n) for n in _OWN}
    return Event(**own, type=r.event_type, time=_iso(r.time), data=data, extensions=json.loads(r.extensions or "{}"), tombstoned=dead)


# Builders.


@dataclass(frozen=True)
class Encryption:
    """Which fields of which types are encrypted, and an entity's key id."""

    crypto_key_id: Callable[[str], str]
    encrypted_fields: Mapping[str, Sequence[str]]


@dataclass(frozen=True)
class AggregateInstance:
    state: Any
    version: int
    stream_id: str


@dataclass(frozen=True)
class AggregateHandle:
    """State of one entity by folding its stream; see :func:`define_aggregate`."""

    stream_prefix: str
    evolve: Mapping[str, Callable[[Any, Event], Any]]
    encryption: Encryption | None = None
    upcasters: Sequence[Upcaster] = ()

    def stream_id(self, entity_id: str) -> str:
        return filters.stream_id(self.stream_prefix, entity_id)

    def load(self, store: EventStore, entity_id: str) -> AggregateInstance:
        """Types without a function count for the version only; no events give (None, 0). Tombstones are handed over."""
        state, version = None, 0
        for e in store.load(self.stream_id(entity_id)):
            version = e.stream_version
            if change := self.evolve.get(e.type):
                state = change(state, e)
        return AggregateInstance(state, version, self.stream_id(entity_id))

    def load_events(self, store: EventStore, entity_id: str, max_events: int | None = None) -> list[Event]:
        """Domain events; the limit holds before snapshots are left out."""
        return [e for e in store.load(self.stream_id(entity_id), max_events) if not validation.is_snapshot_type(e.type)]

    def append(self, store: EventStore, entity_id: str, expected_version: int, events: Sequence[Mapping[str, Any]], outbox_topics: Sequence[str] | None = None, tx: Transaction | None = None) -> AppendResult:
        sealed = []
        for e in events:
            fields = list(self.encryption.encrypted_fields.get(e["type"], ())) if self.encryption else []
            sealed.append({**e, "encrypted_fields": fields, "crypto_key_id": self.encryption.crypto_key_id(entity_id)} if fields else e)
        return store.append(self.stream_id(entity_id), expected_version, sealed, outbox_topics, tx)

    def subscribe(self, store: EventStore, entity_id: str, **options: Any) -> Iterator[Event]:
        events = store.subscribe(**{**options, "subject": self.stream_id(entity_id)})
        return (e for e in events if not validation.is_snapshot_type(e.type))

    def get_upcasters(self) -> list[Upcaster]:
        """They act once the caller registers them with a store."""
        return list(self.upcasters)


def define_aggregate(stream_prefix: str, evolve: Mapping[str, Callable[[Any, Event], Any]], encryption: Encryption | None = None, upcasters: Sequence[Upcaster] = ()) -> AggregateHandle:
    """``evolve`` maps an event type to (state, event) -> state; the first state is None."""
    validation.event_map(evolve)
    return AggregateHandle(stream_prefix, dict(evolve), encryption, tuple(upcasters))


@dataclass(frozen=True)
class SnapshotLoad:
    state: Any
    stream_id: str
    version: int
    snapshot_version: int | None
    replayed_events: int


@dataclass(frozen=True)
class SnapshotHandle:
    """A fold that starts from its newest stored state; see :func:`define_snapshot`."""

    stream_prefix: str
    snapshot_name: str
    every: int
    initial_state: Any
    evolve: Mapping[str, Callable[[Any, Event], Any]]
    crypto_key_id: Callable[[str], str] | None = None
    encrypted_fields: Sequence[str] = ()

    @property
    def snapshot_event_type(self) -> str:
        return f"{self.snapshot_name}{validation.SNAPSHOT_SUFFIX}"

    @property
    def source_event_types(self) -> list[str]:
        return list(self.evolve)

    def load(self, store: EventStore, entity_id: str, tx: Transaction | None = None) -> SnapshotLoad:
        """Only the newest snapshot is looked at: where its key is gone, all events are replayed."""
        stream = filters.stream_id(self.stream_prefix, entity_id)
        tx = tx or Transaction(store, store.log.refresh().pinned())
        newest = tx.latest(stream, self.snapshot_event_type)
        based = newest is not None and not newest.tombstoned
        state, base = (newest.data, newest.stream_version) if based else (copy.deepcopy(self.initial_state), None)
        version, replayed = base or 0, 0
        for e in tx.load(stream, (base or 0) + 1):
            version = e.stream_version
            if change := self.evolve.get(e.type):
                state, replayed = change(state, e), replayed + 1
        return SnapshotLoad(state, stream, version, base, replayed)

    def due(self, store: EventStore, rows: DataFrame, state: Snapshot) -> DataFrame:
        """What falls due in a bulk append: (stream_id, event_type, data, crypto_key_id, stream_version and input_order of the
        stream's last row). ``rows``: the append's, with versions. One stream's events since its last snapshot are folded at a time.
        """
        handled = F.col("event_type").isin(list(self.evolve))
        mine = rows.where(filters.in_prefix(self.stream_prefix))
        touched = mine.where(handled).select("stream_id").distinct()
        log = crypto.replayed(store._log(state).join(touched, "stream_id", "left_semi"), store.keys())
        found = snapshots.bases(log, self.snapshot_name, F.col("data"), F.col("tombstoned"))
        names = ["stream_id", "stream_version", "event_type", "data", "schema_version", "id", "source", "extensions", "tombstoned", "global_position", "time", "created_at"]
        stored = log.join(found, "stream_id", "left").where("base_version IS NULL OR stream_version > base_version").select(*names)
        none = {"global_position": F.lit(None).cast("long"), "tombstoned": F.lit(False), "time": F.current_timestamp(), "created_at": F.current_timestamp()}
        both = stored.unionByName(mine.withColumns(none).join(touched, "stream_id", "left_semi").select(*names)).where(handled)
        both = both.join(found.select("stream_id", "base"), "stream_id", "left")
        evolve, every, initial, upcasters, key_id, prefix = self.evolve, self.every, self.initial_state, store._upcasters, self.crypto_key_id, len(self.stream_prefix) + 1

        def fold(table: pa.Table) -> pa.Table:
            events = sorted(table.to_pylist(), key=lambda r: r["stream_version"])
            stream = events[0]["stream_id"]
            value, base = copy.deepcopy(initial), events[0]["base"]
            if base is not None:
                value = json.loads(base)
            for r in events:
                data = None if r["tombstoned"] else upcasters.value(r["event_type"], r["schema_version"], json.loads(r["data"]))
                own = {k: r[k] for k in ("id", "source", "global_position", "stream_id", "stream_version", "created_at")}
                envelope = {"specversion": schema.SPECVERSION, "subject": stream, "datacontenttype": schema.CONTENT_TYPE, "time": _iso(r["time"])}
                value = evolve[r["event_type"]](value, Event(**own, **envelope, type=r["event_type"], data=data, extensions=json.loads(r["extensions"] or "{}"), tombstoned=r["tombstoned"]))
            n = int(len(events) >= every)
            key = key_id(stream[prefix:]) if key_id else None
            cols = [pa.array([stream] * n, pa.string()), pa.array([json.dumps(value, separators=(",", ":"))] * n, pa.string()), pa.array([key] * n, pa.string())]
            return pa.Table.from_arrays(cols, ["stream_id", "data", "crypto_key_id"])

        made = both.groupBy("stream_id").applyInArrow(fold, "stream_id string, data string, crypto_key_id string")
        last = mine.groupBy("stream_id").agg(F.max("stream_version").alias("stream_version"), F.max_by("input_order", "stream_version").alias("input_order"))
        return made.join(last, "stream_id").withColumn("event_type", F.lit(self.snapshot_event_type))

    def update_after_append(self, tx: Transaction, stream_id: str) -> None:
        if self.every <= 0:
            return
        entity = stream_id[len(self.stream_prefix) + 1 :]
        found = self.load(tx.store, entity, tx)
        if found.replayed_events >= self.every:
            event = {"type": self.snapshot_event_type, "data": found.state}
            if self.crypto_key_id and self.encrypted_fields:
                event |= {"encrypted_fields": list(self.encrypted_fields), "crypto_key_id": self.crypto_key_id(entity)}
            tx.append_snapshot(stream_id, found.version, event)


def define_snapshot(stream_prefix: str, snapshot_name: str, every: int, initial_state: Any, evolve: Mapping[str, Callable[[Any, Event], Any]], crypto_key_id: Callable[[str], str] | None = None, encrypted_fields: Sequence[str] = ()) -> SnapshotHandle:
    """State stored as an event once ``every`` handled events were replayed on top of the last one (0: never)."""
    validation.event_map(evolve)
    return SnapshotHandle(stream_prefix, snapshot_name, every, initial_state, dict(evolve), crypto_key_id, tuple(encrypted_fields))


@dataclass(frozen=True)
class ProjectionContext:
    entity_id: str
    stream_id: str
    global_position: int
    stream_version: int
    created_at: datetime
    tx: Transaction


@dataclass(frozen=True)
class ProjectionHandle:
    """Dispatches events of one prefix to handlers by type; all others are passed over."""

    projection_name: str
    stream_prefix: str
    handlers: Mapping[str, Callable[[Any, ProjectionContext], None]]

    def handle(self, event: Event, tx: Transaction) -> None:
        prefix, handler = f"{self.stream_prefix}-", self.handlers.get(event.type)
        if handler and event.stream_id.startswith(prefix):
            where = ProjectionContext(event.stream_id[len(prefix) :], event.stream_id, event.global_position, event.stream_version, event.created_at, tx)
            handler(event.data, where)


def define_projection(projection_name: str, stream_prefix: str, handlers: Mapping[str, Callable[[Any, ProjectionContext], None]]) -> ProjectionHandle:
    validation.event_map(handlers)
    return ProjectionHandle(projection_name, stream_prefix, dict(handlers))
