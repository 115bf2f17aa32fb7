"""The store end to end: appends, conflicts, pages, snapshots, projections, subscriptions, outbox and crypto-shredding."""

from __future__ import annotations

import json
import threading
from base64 import b64encode

import pytest
from pyspark.sql import functions as F

from weftlog.functions import errors
from weftlog.operators.keyring import Secrets
from weftlog.operators.upcasts import Upcaster
from weftlog.store import Encryption, EventStore, Transaction, define_aggregate, define_projection, define_snapshot


def opened(spark, path, **how) -> EventStore:
    store = EventStore(spark, str(path), **how)
    store.setup()
    return store


def test_needs_setup_and_a_plain_schema_name(spark, tmp_path):
    store = EventStore(spark, str(tmp_path))
    for call in (lambda: store.load("a"), lambda: store.list_streams(), lambda: store.append("a", 0, [{"type": "T", "data": 1}])):
        with pytest.raises(errors.EventStoreNotInitializedError):
            call()
    store.register_upcaster(Upcaster("T", 1, 2, lambda d: d))
    for bad in ("Upper", "1a", "a-b", "", "a" * 64, 'x"; drop'):
        with pytest.raises(errors.InvalidSchemaNameError):
            EventStore(spark, str(tmp_path), bad)


def test_append_versions_conflicts_and_reads(spark, tmp_path):
    store = opened(spark, tmp_path)
    assert (store.load("Order-1"), store.get_stream_version("Order-1")) == ([], 0)
    first = store.append("Order-1", -1, [{"type": "A", "data": {"n": 1}}, {"type": "B", "data": {"n": 2}, "source": "me"}])
    assert (first.from_version, first.to_version, first.global_positions) == (1, 2, [1, 2])
    with pytest.raises(errors.OptimisticConcurrencyError) as e:
        store.append("Order-1", -1, [{"type": "A", "data": 1}])
    assert (e.value.expected_version, e.value.actual_version) == (-1, 2)
    with pytest.raises(errors.OptimisticConcurrencyError):
        store.append("Order-1", 1, [{"type": "A", "data": 1}])
    store.append("Order-1", 2, [{"type": "C", "data": None, "extensions": {"k": "v", "schemaversion": 9}, "schema_version": 3}])
    store.append("Order-2", 0, [{"type": "A", "data": [1]}])
    events = store.load("Order-1")
    assert [(x.stream_version, x.type, x.data) for x in events] == [(1, "A", {"n": 1}), (2, "B", {"n": 2}), (3, "C", None)]
    assert (events[1].source, events[0].source, events[2].extensions) == ("me", "event-store", {"k": "v", "schemaversion": 3})
    assert (events[0].id, events[0].subject, events[0].specversion) == ("Order-1/1", "Order-1", "1.0")
    assert [x.stream_version for x in store.load_from("Order-1", 2, 1)] == [2]
    assert store.load_latest_event_by_type("Order-1", "A").stream_version == 1
    assert store.load_latest_event_by_type("Order-1", "Z") is None
    assert store.list_streams() == ["Order-2", "Order-1"]
    assert store.list_streams("Ord_r", 1) == ["Order-2"]
    with pytest.raises(ValueError, match="zero events"):
        store.append("Order-1", 0, [])
    with pytest.raises(errors.ReservedSnapshotEventTypeError):
        store.append("Order-1", 0, [{"type": "XSnapshot", "data": 1}])
    hostile = "x'; DROP TABLE events; --%_\\"
    store.append(hostile, 0, [{"type": hostile, "data": hostile}], [hostile])
    assert store.load(hostile)[0].data == hostile


def test_transactions_publish_all_or_nothing(spark, tmp_path):
    store = opened(spark, tmp_path)

    def fails(tx):
        tx.append("S-1", 0, [{"type": "A", "data": 1}])
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        store.with_transaction(fails)
    assert store.load("S-1") == []

    def works(tx):
        tx.append("S-1", -1, [{"type": "A", "data": 1}])
        assert [e.data for e in tx.load("S-1")] == [1]
        return tx.append("S-2", -1, [{"type": "A", "data": 2}]).global_positions

    assert store.with_transaction(works) == [2]
    assert [e.data for e in store.load("S-2")] == [2]


def test_a_lost_race_is_built_again(spark, tmp_path):
    one, two = opened(spark, tmp_path), opened(spark, tmp_path)
    runs = []

    def work(tx):
        runs.append(tx.state.commit_id)
        if len(runs) == 1:
            two.append("S-1", 0, [{"type": "A", "data": "two"}])
        return tx.append("S-1", 0, [{"type": "A", "data": "one"}])

    assert one.with_transaction(work).from_version == 2
    assert runs == [0, 1]
    assert [(e.data, e.global_position) for e in one.load("S-1")] == [("two", 1), ("one", 2)]
    stale = [0]

    def strict(tx):
        stale[0] += 1
        if stale[0] == 1:
            two.append("S-1", 0, [{"type": "A", "data": "again"}])
        return tx.append("S-1", 2, [{"type": "A", "data": "never"}])

    with pytest.raises(errors.OptimisticConcurrencyError):
        one.with_transaction(strict)


def test_retry_only_on_conflicts(spark, tmp_path):
    store, calls = opened(spark, tmp_path), []

    def conflict():
        calls.append(1)
        raise errors.OptimisticConcurrencyError("s", 1, 2)

    with pytest.raises(errors.OptimisticConcurrencyError):
        store.with_retry(conflict, 2)
    assert len(calls) == 3
    with pytest.raises(KeyError):
        store.with_retry(lambda: {}["x"])


def test_pages_are_bound_to_their_first_read(spark, tmp_path):
    store = opened(spark, tmp_path)
    for k in range(3):
        store.append("A", 0, [{"type": "T", "data": f"a{k}"}])
        store.append("B", 0, [{"type": "T", "data": f"b{k}"}])
    page = store.read_events_page(["A", "B"], 4)
    assert ([e.data for e in page.events], page.has_next_page) == (["a0", "b0", "a1", "b1"], True)
    store.append("A", 0, [{"type": "T", "data": "late"}])
    rest = store.read_events_page(["B", "A"], 4, page.next_cursor)
    assert ([e.data for e in rest.events], rest.has_next_page, rest.next_cursor) == (["a2", "b2"], False, None)
    down = store.read_events_page(["A"], 2, order="desc")
    assert [e.data for e in down.events] == ["late", "a2"]
    assert [e.data for e in store.read_events_page(["A"], 9, down.next_cursor, "desc").events] == ["a1", "a0"]
    for bad in ({"stream_ids": ["A"]}, {"order": "desc"}):
        with pytest.raises(errors.InvalidArgumentError):
            store.read_events_page(**{"stream_ids": ["A", "B"], "limit": 1, "cursor": page.next_cursor, **bad})
    with pytest.raises(errors.InvalidArgumentError):
        store.read_events_page([], 1, "bm90IGEgY3Vyc29y")
    assert store.read_events_page([], 1).events == []
    for wrong in (0, 1001, True):
        with pytest.raises(errors.InvalidArgumentError):
            store.read_events_page(["A"], wrong)


ORDER = define_aggregate(
    "Order",
    {
        "OrderPlaced": lambda s, e: {"status": "placed", "total": e.data["total"] if e.data else None},
        "OrderShipped": lambda s, e: {**s, "status": "shipped"},
    },
)


def balance(every: int, **how):
    return define_snapshot(
        "Transaction", "Balance", every, {"balance": 0},
        {"Deposit": lambda s, e: {"balance": s["balance"] + e.data["amount"]}, "Withdrawal": lambda s, e: {"balance": s["balance"] - e.data["amount"]}}, **how,
    )


def test_aggregates_and_snapshots(spark, tmp_path):
    snap = balance(2)
    store = opened(spark, tmp_path, snapshots=[snap])
    assert ORDER.load(store, "1") == ORDER.load(store, "1").__class__(None, 0, "Order-1")
    ORDER.append(store, "1", -1, [{"type": "OrderPlaced", "data": {"total": 75}}, {"type": "Other", "data": {}}])
    assert (ORDER.load(store, "1").state, ORDER.load(store, "1").version) == ({"status": "placed", "total": 75}, 2)
    result = store.append("Transaction-1", -1, [{"type": "Deposit", "data": {"amount": 100}}, {"type": "Withdrawal", "data": {"amount": 20}}])
    assert (result.from_version, result.to_version) == (1, 2)
    loaded = snap.load(store, "1")
    assert (loaded.state, loaded.version, loaded.snapshot_version, loaded.replayed_events) == ({"balance": 80}, 3, 3, 0)
    store.append("Transaction-1", 3, [{"type": "NoteAdded", "data": {}}])
    store.append("Transaction-1", 4, [{"type": "Deposit", "data": {"amount": 5}}])
    loaded = snap.load(store, "1")
    assert (loaded.state, loaded.version, loaded.snapshot_version, loaded.replayed_events) == ({"balance": 85}, 5, 3, 1)
    handle = define_aggregate("Transaction", {"Deposit": lambda s, e: s})
    assert [e.type for e in handle.load_events(store, "1", 3)] == ["Deposit", "Withdrawal"]
    with pytest.raises(errors.InvalidArgumentError):
        define_aggregate("X", {})


def test_upcasters_run_on_replay_only(spark, tmp_path):
    store = opened(spark, tmp_path)
    store.register_upcaster(Upcaster("U", 2, 3, lambda d: {**d, "active": True}), Upcaster("U", 1, 2, lambda d: {**d, "role": "user"}))
    store.append("U-1", 0, [{"type": "U", "data": {"name": "a"}}, {"type": "U", "data": {"name": "b"}, "schema_version": 2}])
    assert [e.data for e in store.load("U-1")] == [{"name": "a", "role": "user", "active": True}, {"name": "b", "active": True}]
    assert [e.data for e in store.subscribe(live=False)] == [{"name": "a"}, {"name": "b"}]


def test_projection_checkpoints_with_what_it_writes(spark, tmp_path):
    store, seen = opened(spark, tmp_path), []
    for k in range(3):
        ORDER.append(store, f"abc-{k}", 0, [{"type": "OrderPlaced", "data": {"total": k}}])

    def placed(data, ctx):
        seen.append((ctx.entity_id, data["total"]))
        ctx.tx.append(f"Copy-{ctx.entity_id}", 0, [{"type": "Copied", "data": data}])

    p = define_projection("copies", "Order", {"OrderPlaced": placed})
    assert (store.run_projection(p, 2), seen) == (2, [("abc-0", 0), ("abc-1", 1)])
    assert store.run_projection(p, 2) == 2  # the third order, and the first copy is read past
    assert seen[-1] == ("abc-2", 2)

    def boom(data, ctx):
        raise RuntimeError("handler")

    failing = define_projection("failing", "Order", {"OrderPlaced": boom})
    with pytest.raises(RuntimeError):
        store.run_projection(failing)
    assert store.log.refresh().checkpoints.get("failing") is None
    while store.run_projection(p):
        pass
    assert store.run_projection(p) == 0


def test_subscriptions_filter_catch_up_and_tail(spark, tmp_path):
    store = opened(spark, tmp_path)
    for s in ("Order_1", "OrderA1", "Order_1-child"):
        store.append(s, 0, [{"type": "A", "data": s}, {"type": "B", "data": s}])
    got = lambda **how: [(e.stream_id, e.type) for e in store.subscribe(live=False, **how)]
    assert got(subject="Order_1") == [("Order_1", "A"), ("Order_1", "B")]
    assert got(subject="Order_1", recursive=True, event_types=["A"]) == [("Order_1", "A"), ("Order_1-child", "A")]
    assert got(lower_bound={"id": "5"}) == [("Order_1-child", "B")]
    assert len(got(lower_bound={"id": "5", "type": "inclusive"}, batch_size=1)) == 2
    with pytest.raises(errors.InvalidArgumentError):
        got(lower_bound={"id": "01"})
    stop, out = threading.Event(), []
    tail = store.subscribe(lower_bound={"id": "6"}, poll_interval_ms=20, signal=stop)
    store.append("Order_1", 0, [{"type": "C", "data": 1}])
    out.append(next(tail).type)
    stop.set()
    assert out == ["C"] and list(tail) == []


def test_outbox_is_handed_over_and_cleaned_up(spark, tmp_path):
    store, seen = opened(spark, tmp_path), []
    store.append("O-1", 0, [{"type": "P", "data": {"total": 1}, "extensions": {"traceid": "t", "id": "no"}}], ["orders", "notifications"])
    store.append("O-1", 0, [{"type": "P", "data": {"total": 2}}], ["orders"])

    def boom(entries, tx):
        raise RuntimeError("broker")

    with pytest.raises(RuntimeError):
        store.process_outbox(boom)
    assert store.process_outbox(lambda entries, tx: seen.extend(entries), 2) == 2
    assert [(e.id, e.topic, e.event_global_position) for e in seen] == [(1, "orders", 1), (2, "notifications", 1)]
    assert seen[0].payload["data"] == {"total": 1} and seen[0].payload["traceid"] == "t" and seen[0].payload["id"] == "O-1/1"
    nested = []
    assert store.process_outbox(lambda entries, tx: nested.append(store.process_outbox(lambda e, t: None)), 5) == 1
    assert nested == [0]  # another worker meets no entry that is claimed
    assert store.process_outbox(boom) == 0
    assert store.cleanup_outbox() == 0
    assert store.cleanup_outbox(0) == 3
    assert store.log.table("outbox").count() == 0


def holds(path, envelope: bytes) -> bool:
    """Whether wrapped key material is in any file under a folder: as bytes or text in it, or in a Parquet file's columns."""
    import pyarrow.parquet as pq

    shapes = (envelope, envelope[8:], envelope[36:], envelope.hex().encode(), envelope[36:].hex().encode(), b64encode(envelope[36:])[:40])
    for file in path.rglob("*"):
        if file.is_file():
            raw = file.read_bytes()
            if file.suffix == ".parquet":
                raw += repr(pq.read_table(file, partitioning=None).to_pylist()).encode()
            if any(x in raw for x in shapes) or repr(envelope)[2:-1].encode() in raw:
                return True
    return False


SECRETS = Secrets.of(1, [(1, "one")])
USER = define_aggregate(
    "User", {"Registered": lambda s, e: {"name": e.data["name"] if e.data else None}}, Encryption(lambda i: f"user:{i}", {"Registered": ["name", "address.street"]})
)


def test_crypto_shredding(spark, tmp_path):
    store = opened(spark, tmp_path, secrets=SECRETS)
    plain = opened(spark, tmp_path)
    data = {"name": "Ann", "address": {"street": "S", "city": "C"}, "n": 1}
    with pytest.raises(errors.CryptoKeyNotFoundError):
        USER.append(store, "1", 0, [{"type": "Registered", "data": data}])
    store.create_crypto_key("user:1")
    USER.append(store, "1", 0, [{"type": "Registered", "data": data}, {"type": "Plain", "data": {"x": 1}}])
    assert store.load("User-1")[0].data == data
    assert next(store.subscribe(live=False)).data == {"address": {"city": "C"}, "n": 1}
    assert (plain.load("User-1")[0].tombstoned, plain.load("User-1")[1].tombstoned) == (True, False)
    with pytest.raises(errors.CryptoSecretsRequiredError):
        plain.create_crypto_key("x")
    rotated = opened(spark, tmp_path, secrets=Secrets.of(2, [(2, "two"), (1, "one")]))
    wrapped = lambda: bytes(rotated.log.table("keys").where("key_id = 'user:1'").first().encrypted_key)
    before = wrapped()
    USER.append(rotated, "1", 0, [{"type": "Registered", "data": {"name": "B"}}])
    after = wrapped()
    assert before[4:8] == b"\0\0\0\1" and after[4:8] == b"\0\0\0\2" and len(after) == 68
    assert not holds(tmp_path, before) and holds(tmp_path, after)
    assert [e.data["name"] for e in rotated.load("User-1") if e.type == "Registered"] == ["Ann", "B"]
    with pytest.raises(errors.CryptoSecretVersionNotFoundError):
        store.load("User-1")
    commits = rotated.log.refresh().commit_id
    rotated.revoke_crypto_key("user:1")
    assert not holds(tmp_path, after)
    old = rotated.log.as_of(commits)
    assert old.commit_id == commits and [r.encrypted_key for r in rotated.log.table("keys", old).collect()] == [None]
    gone = rotated.load_from("User-1", 1, tx=Transaction(rotated, old))
    assert gone[0].tombstoned
    rotated.revoke_crypto_key("user:1")
    rotated.create_crypto_key("user:1")
    events = rotated.load("User-1")
    assert [(e.type, e.tombstoned, e.data) for e in events] == [("Registered", True, None), ("Plain", False, {"x": 1}), ("Registered", True, None)]
    assert USER.load(rotated, "1").version == 3
    with pytest.raises(errors.CryptoKeyRevokedError):
        USER.append(rotated, "1", 0, [{"type": "Registered", "data": {"name": "C"}}])
    with pytest.raises(errors.CryptoKeyNotFoundError):
        rotated.revoke_crypto_key("user:9")
    with pytest.raises(errors.CryptoKeyIdRequiredError):
        rotated.append("X", 0, [{"type": "T", "data": {"a": 1}, "encrypted_fields": ["a"]}])


def test_encrypted_event_without_matching_fields_is_still_a_tombstone(spark, tmp_path):
    store = opened(spark, tmp_path, secrets=SECRETS)
    store.create_crypto_key("k")
    store.append("X", 0, [{"type": "T", "data": {"b": 1}, "encrypted_fields": ["a"], "crypto_key_id": "k"}])
    assert store.load("X")[0].data == {"b": 1}
    store.revoke_crypto_key("k")
    assert store.load("X")[0].tombstoned


def test_encrypted_snapshot_falls_back_to_a_full_replay(spark, tmp_path):
    snap = balance(1, crypto_key_id=lambda i: f"t:{i}", encrypted_fields=["balance"])
    store = opened(spark, tmp_path, secrets=SECRETS, snapshots=[snap])
    store.create_crypto_key("t:1")
    store.append("Transaction-1", 0, [{"type": "Deposit", "data": {"amount": 7}}])
    assert snap.load(store, "1").snapshot_version == 2
    store.revoke_crypto_key("t:1")
    loaded = snap.load(store, "1")
    assert (loaded.state, loaded.version, loaded.snapshot_version, loaded.replayed_events) == ({"balance": 7}, 2, None, 1)


def test_secrets_from_the_environment():
    env = {"GDPR_CRYPTO_SECRETS": "1:a,7:b:c", "GDPR_CRYPTO_CURRENT_VERSION": "7"}
    assert Secrets.from_environment(env) == Secrets.of(7, [(1, "a"), (7, "b:c")])
    assert Secrets.from_environment({}) is None
    for bad in ({**env, "GDPR_CRYPTO_CURRENT_VERSION": "2"}, {"GDPR_CRYPTO_SECRETS": "1:a"}, {**env, "GDPR_CRYPTO_SECRETS": "x:a"}, {**env, "GDPR_CRYPTO_SECRETS": "7:"}, {**env, "GDPR_CRYPTO_SECRETS": "7:a,7:b"}):
        with pytest.raises(errors.InvalidCryptoSecretsError):
            Secrets.from_environment(bad)


def test_bulk_append_and_compaction(spark, tmp_path):
    store = opened(spark, tmp_path)
    store.append("S-0", 0, [{"type": "A", "data": 0}])
    batch = spark.range(1000).selectExpr("concat('S-', id % 10) AS stream_id", "'A' AS event_type", "to_json(named_struct('n', id)) AS data", "id AS input_order")
    assert store.append_frame(batch, spark.createDataFrame([("S-0", 1), ("S-1", -1)], "stream_id string, expected_version int")) == 1000
    with pytest.raises(errors.OptimisticConcurrencyError):
        store.append_frame(batch, spark.createDataFrame([("S-0", 1)], "stream_id string, expected_version int"))
    log = store.events()
    assert log.count() == log.select("global_position").distinct().count() == 1001
    assert log.agg({"global_position": "max"}).first()[0] == 1001
    events = store.load("S-3")
    assert [e.stream_version for e in events] == list(range(1, 101))
    assert [e.data["n"] for e in events] == list(range(3, 1000, 10))
    assert [e.global_position for e in events] == sorted(e.global_position for e in events)
    assert store.append("S-3", 100, [{"type": "A", "data": 1}]).global_positions == [1002]
    assert store.log.compact() == 3
    assert [e.stream_version for e in store.load("S-3")] == list(range(1, 102))


def test_keys_that_no_manifest_names_are_deleted(spark, tmp_path):
    """Files of keys that a crash left behind go with the next revocation; those in use stay, compacted ones too."""
    store = opened(spark, tmp_path, secrets=SECRETS)
    assert store.create_crypto_keys(spark.createDataFrame([("k1",), ("k2",), ("k2",), ("k3",)], "key_id string")) == 3
    assert store.create_crypto_keys(spark.createDataFrame([("k1",)], "key_id string")) == 0
    store.create_crypto_key("k4")
    envelope = {r.key_id: bytes(r.encrypted_key) for r in store.log.table("keys").collect()}
    left = store.log.stage("keys", store.log.table("keys"))
    assert store.log.compact_keys(2) == 2 and len(store.log.refresh().folders["keys"]) == 2
    assert left in store.log.key_folders() or not store.log.files.names(left)
    store.revoke_crypto_key("k2")
    assert sorted(store.log.key_folders()) == sorted(store.log.refresh().folders["keys"])
    assert not holds(tmp_path, envelope["k2"]) and all(holds(tmp_path, envelope[k]) for k in ("k1", "k3", "k4"))
    kept = {r.key_id: r.encrypted_key for r in store.log.table("keys").collect()}
    assert set(kept) == set(envelope) and kept["k2"] is None and bytes(kept["k1"]) == envelope["k1"]
    store.append("S", 0, [{"type": "T", "data": {"a": k}, "encrypted_fields": ["a"], "crypto_key_id": k} for k in ("k1", "k3", "k4")])
    assert [e.data["a"] for e in store.load("S")] == ["k1", "k3", "k4"]


def test_bulk_appends_equal_single_ones(spark, tmp_path):
    """Outbox entries, encrypted fields and snapshots of a bulk append, against the same appends one stream after the other."""
    snaps = [balance(2, crypto_key_id=lambda i: f"t:{i}", encrypted_fields=["balance"]), define_snapshot("Transaction", "Count", 3, 0, {"Deposit": lambda s, e: s + 1})]
    stores = [opened(spark, tmp_path / n, secrets=SECRETS, snapshots=snaps) for n in ("bulk", "single")]
    fields = {"Deposit": ["by.name", "tags"]}
    rows = [
        (f"Transaction-{s}", t, {"amount": n + 1, "by": {"name": f"N{n}", "x": None}, "tags": [1, "é"]} if t == "Deposit" else {"amount": 1} if t == "Withdrawal" else {"n": 1.5})
        for s in (1, 2, 3) for n, t in enumerate(["Deposit", "Note", "Withdrawal", "Deposit", "Deposit"][: s + 2])
    ]
    for store in stores:
        store.create_crypto_keys(spark.createDataFrame([(f"t:{s}",) for s in (1, 2, 3)], "key_id string"))
        store.append("Transaction-2", 0, [{"type": "Deposit", "data": {"amount": 7}}])
    bulk, single = stores
    batch = spark.createDataFrame(
        [(s, t, json.dumps(d), n, json.dumps({"traceid": n, "id": "no"}), f"t:{s[-1]}") for n, (s, t, d) in enumerate(rows)],
        "stream_id string, event_type string, data string, input_order long, extensions string, crypto_key_id string",
    )
    assert bulk.append_frame(batch, outbox_topics=["a", "b"], encrypted_fields=fields) == len(rows)
    for s in (1, 2, 3):
        name = f"Transaction-{s}"
        events = [
            {"type": t, "data": d, "extensions": {"traceid": n, "id": "no"}, **({"encrypted_fields": fields[t], "crypto_key_id": f"t:{s}"} if t in fields else {})}
            for n, (x, t, d) in enumerate(rows) if x == name
        ]
        single.append(name, 0, events, ["a", "b"])

    def shape(store):
        own = lambda e: (e.global_position, e.stream_id, e.stream_version, e.id, e.source, e.type, e.data, e.extensions, e.tombstoned)
        raw = store.events().orderBy("global_position").collect()
        return (
            [own(e) for s in (1, 2, 3) for e in store.load(f"Transaction-{s}")], [json.loads(r.data) for r in raw], [r.encrypted_data and sorted(r.encrypted_data) for r in raw],
            [(r.id, r.event_global_pos, r.topic, {**json.loads(r.payload), "time": 0}) for r in store.log.table("outbox").orderBy("id").collect()],
            {s: store.get_stream_version(s) for s in store.list_streams()}, [snaps[0].load(store, str(s)) for s in (1, 2, 3)],
        )

    assert shape(bulk) == shape(single)
    assert any(e.type == "BalanceSnapshot" for e in bulk.load("Transaction-2")) and any(e.type == "CountSnapshot" for e in bulk.load("Transaction-3"))
    plan = {(r.stream_id, r.stream_version): (r.data and json.loads(r.data), r.tombstoned) for r in bulk.replayed().collect()}
    assert plan == {(e.stream_id, e.stream_version): (e.data, e.tombstoned) for s in (1, 2, 3) for e in bulk.load(f"Transaction-{s}")}
    bulk.revoke_crypto_key("t:1")
    assert all(r.tombstoned == (r.stream_id == "Transaction-1" and r.event_type in ("Deposit", "BalanceSnapshot")) for r in bulk.replayed().collect())
    assert all(r.data is None for r in opened(spark, tmp_path / "bulk").replayed().where("tombstoned").collect())
    for bad, error in (("t:1", errors.CryptoKeyRevokedError), ("t:9", errors.CryptoKeyNotFoundError), (None, errors.CryptoKeyIdRequiredError)):
        with pytest.raises(error):
            bulk.append_frame(batch.withColumn("crypto_key_id", F.lit(bad).cast("string")), encrypted_fields=fields)


def test_empty_bulk_appends(spark, tmp_path):
    store = opened(spark, tmp_path, secrets=SECRETS, snapshots=[balance(1)])
    none = spark.createDataFrame([], "stream_id string, event_type string, data string, input_order long, crypto_key_id string")
    assert store.append_frame(none, outbox_topics=["a"], encrypted_fields={"Deposit": ["amount"]}) == 0
    assert store.events().count() == 0 and store.create_crypto_keys(none.selectExpr("crypto_key_id AS key_id")) == 0
    assert store.revoke_crypto_keys(none.selectExpr("crypto_key_id AS key_id")) == 0
    assert store.append("Transaction-1", -1, [{"type": "Deposit", "data": {"amount": 2}}]).global_positions == [1]
    assert store.replayed().count() == 2


def test_bulk_appends_wrap_old_keys_anew(spark, tmp_path):
    old = opened(spark, tmp_path, secrets=SECRETS)
    old.create_crypto_keys(spark.createDataFrame([("a",), ("b",)], "key_id string"))
    before = {r.key_id: bytes(r.encrypted_key) for r in old.log.table("keys").collect()}
    store = opened(spark, tmp_path, secrets=Secrets.of(2, [(2, "two"), (1, "one")]))
    batch = spark.createDataFrame([("S", "T", '{"x":1}', 1, "a")], "stream_id string, event_type string, data string, input_order long, crypto_key_id string")
    store.append_frame(batch, encrypted_fields={"T": ["x"]})
    after = {r.key_id: bytes(r.encrypted_key) for r in store.log.table("keys").collect()}
    assert after["a"][4:8] == b"\0\0\0\2" and after["b"] == before["b"] and not holds(tmp_path, before["a"])
    assert store.load("S")[0].data == {"x": 1} and store.replayed().first().data == '{"x":1}'


def test_appends_survive_a_revocation_of_other_keys(spark, tmp_path, monkeypatch):
    """The files that a bulk append reads keys from are replaced while it runs: it is built again."""
    store, other = opened(spark, tmp_path, secrets=SECRETS), opened(spark, tmp_path, secrets=SECRETS)
    store.create_crypto_keys(spark.createDataFrame([("a",), ("b",)], "key_id string"))
    plain, calls = store._with_snapshots, []

    def meanwhile(numbered, state):
        calls.append(1)
        if len(calls) == 1:
            other.revoke_crypto_key("b")
        return plain(numbered, state)

    monkeypatch.setattr(store, "_with_snapshots", meanwhile)
    batch = spark.createDataFrame([("S", "T", '{"x":1}', 1, "a")], "stream_id string, event_type string, data string, input_order long, crypto_key_id string")
    assert store.append_frame(batch, encrypted_fields={"T": ["x"]}) == 1 and len(calls) == 2
    assert [e.data for e in store.load("S")] == [{"x": 1}] and store.events().count() == 1


def test_bound_fields_do_not_move(spark, tmp_path):
    """A field's ciphertext opens under its own event, key, path and version only, in plans as in reads of streams."""
    from weftlog.operators import crypto

    store = opened(spark, tmp_path, secrets=SECRETS)
    store.create_crypto_key("k")
    store.append("é-1", 0, [{"type": "T", "data": {"ü": "ä", "n": 1}, "encrypted_fields": ["ü"], "crypto_key_id": "k"}])
    log = store.events()
    assert json.loads(crypto.decrypt(log, store.keys()).first().data) == {"ü": "ä", "n": 1} == store.load("é-1")[0].data
    moved = log.withColumn("id", F.lit("other/1"))
    broken = log.withColumn("encrypted_data", F.transform_values("encrypted_data", lambda k, v: v.withField("iv", F.lit("AAAA"))))
    for wrong in (moved, broken):
        with pytest.raises(Exception, match="(?i)aes|canonical"):
            crypto.decrypt(wrong, store.keys()).collect()


def test_waiting_readers_are_woken(spark, tmp_path):
    import time

    store = opened(spark, tmp_path)
    at = store.log.refresh().commit_id
    took = []

    def wait():
        started = time.monotonic()
        store.log.wait(at, 30)
        took.append(time.monotonic() - started)

    reader = threading.Thread(target=wait)
    reader.start()
    store.append("S", 0, [{"type": "T", "data": 1}])
    reader.join(20)
    assert took and took[0] < 20
    other = opened(spark, tmp_path)
    started = time.monotonic()
    other.log.wait(other.log.refresh().commit_id, 0.3)
    assert 0.2 < time.monotonic() - started < 5


def test_bulk_appends_are_numbered_in_tasks_of_few_rows(spark, tmp_path, monkeypatch):
    seen, whole = [], EventStore._with_snapshots
    monkeypatch.setattr("weftlog.store.TASK_ROWS", 100, raising=False)
    monkeypatch.setattr(EventStore, "_with_snapshots", lambda self, rows, state: seen.append(rows) or whole(self, rows, state))
    store = EventStore(spark, str(tmp_path))
    store.setup()
    batch = spark.range(2000).select(F.concat(F.lit("S-"), F.col("id") % 500).alias("stream_id"), F.lit("E").alias("event_type"), F.lit("1").alias("data"), F.col("id").alias("input_order"))
    assert store.append_frame(batch) == 2000
    tasks = [r["count"] for r in seen[0].groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(tasks) == 2000 and max(tasks) < 400
    assert store.events().groupBy("stream_version").count().orderBy("stream_version").collect() == [(v, 500) for v in range(1, 5)]
