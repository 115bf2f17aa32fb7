"""Operators on small hand-made logs: rules, edge cases and plans."""

from __future__ import annotations

import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftlog.functions import codecs, errors, filters, validation
from weftlog.operators import appends, crypto, folds, metrics, paging, reads, snapshots, upcasts, verify, watermarks
from weftlog.sources import schema

JSON = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab", max_size=3), lambda x: st.dictionaries(st.sampled_from("abc"), x, max_size=3) | st.lists(x, max_size=3), max_leaves=8)
COLUMNS = "global_position long, stream_id string, stream_version int, id string, event_type string, value double, txid long"


def log_of(spark, rows):
    full = [(p, s, v, f"{s}/{v}", t, x, tx) for p, s, v, t, x, tx in rows]
    return spark.createDataFrame(full, COLUMNS)


ROWS = [(1, "A", 1, "d", 100.0, 1), (2, "B", 1, "d", 5.0, 1), (3, "A", 2, "n", None, 2), (4, "A", 3, "w", 25.0, 2), (6, "B", 2, "x", 1.0, 3)]


def test_reads(spark):
    log = log_of(spark, ROWS)
    assert [r.stream_version for r in reads.stream(log, "A", 2).collect()] == [2, 3]
    assert reads.stream(log, "none").collect() == []
    assert {(r.stream_id, r.event_type): r.stream_version for r in reads.latest_of_type(log).collect()}["A", "w"] == 3
    assert {r.stream_id: (r.version, r.events) for r in reads.heads(log).collect()} == {"A": (3, 3), "B": (2, 2)}
    assert reads.head(log, "none").first().version == 0
    assert [r.global_position for r in reads.after_position(log, 2, 4).collect()] == [3, 4]


def test_list_prefix_keeps_wildcards(spark):
    log = spark.createDataFrame([("Ord_r-1",), ("Order-2",), ("OrderX-3",)], "stream_id string")
    assert [r.stream_id for r in reads.streams(log, "Ord_r").collect()] == ["Order-2", "Ord_r-1"]
    assert len(reads.streams(log, "").collect()) == 3


def test_watermark(spark):
    log = log_of(spark, ROWS)
    at = lambda df, x: watermarks.safe_watermark(df, x).first().watermark
    assert (at(log, 9), at(log, 3), at(log, 2), at(log, 1)) == (6, 5, 2, 0)
    assert at(log.where("false"), 1) == 0


def test_pages_concatenate_to_the_scan(spark):
    rng = random.Random(3)
    rows = [(k + 1, f"S{rng.randrange(4)}", k + 1, "t", 0.0, 1 + k // 5) for k in range(60)]
    log = log_of(spark, rows).cache()
    for order in ("asc", "desc"):
        seen, cursor, n = [], None, 0
        while True:
            page = paging.read_page(log, ["S0", "S2"], 7, cursor, order, commit_id=9)
            seen += [e.global_position for e in page.events]
            n += 1
            if not page.has_next_page:
                break
            cursor = page.next_cursor
        want = sorted((r[0] for r in rows if r[1] in ("S0", "S2") and r[5] <= 9), reverse=order == "desc")
        assert seen == want and n == max(1, math.ceil(len(want) / 7))


def test_cursor_is_exact_and_bound():
    big = 9007199254740993
    c = codecs.encode_cursor("asc", ["b", "a"], 3, big, big, "a", "a/1")
    assert codecs.decode_cursor(c, "asc", ["a", "b"])["globalPosition"] == big
    for args in ((c, "desc", ["a", "b"]), (c, "asc", ["a"]), (c[:-3], "asc", ["a", "b"]), ("e30", "asc", ["a"]), ("!", "asc", ["a"])):
        with pytest.raises(errors.InvalidArgumentError):
            codecs.decode_cursor(*args)


def test_three_folds_agree(spark):
    log = log_of(spark, ROWS)
    value = F.col("value")
    fast = folds.algebraic(log, {"balance": folds.total(value, ["d"]) + folds.total(value, ["w"], -1)})
    start = F.struct(F.lit(0.0).alias("balance"))
    change = lambda sign: lambda s, e: F.struct((s["balance"] + e["value"] * sign).alias("balance"))
    middle = folds.by_expression(log, start, {"d": change(1), "w": change(-1)}, ["value"]).select("stream_id", "version", "state.balance")
    python = {"d": lambda s, e: {"balance": s["balance"] + e["value"]}, "w": lambda s, e: {"balance": s["balance"] - e["value"]}}
    slow = folds.by_function(log, {"balance": 0.0}, python, "balance double", ["value"])
    want = {"A": (3, 75.0), "B": (2, 5.0)}
    for df in (fast, middle, slow):
        assert {r.stream_id: (r.version, r.balance) for r in df.collect()} == want


def simulate(events: list[tuple[int, int]], every: int) -> list[tuple[int, int | None]]:
    """One stream's appends of (events, handled): first version of each, and where a snapshot is stored."""
    head, seen, out = 0, 0, []
    for n, handled in events:
        first, head, seen, at = head + 1, head + n, seen + handled, None
        if handled and every > 0 and seen >= every:
            head, at, seen = head + 1, head + 1, 0
        out.append((first, at))
    return out


@pytest.mark.parametrize("every", [0, 1, 3, 7])
def test_snapshot_closed_form_and_fold_equal_a_simulation(spark, every):
    rng = random.Random(every)
    handled = [rng.random() < 0.5 for _ in range(120)]
    log = spark.createDataFrame([("S", k + 1, "d" if h else "n") for k, h in enumerate(handled)], "stream_id string, stream_version int, event_type string")
    want = simulate([(1, int(h)) for h in handled], every)
    out = snapshots.stored_versions(log, ["d"], every).orderBy("stream_version").collect()
    assert [(r.stored_version, r.stored_version + 1 if r.snapshot_after else None) for r in out] == want
    batches = [(rng.randint(1, 4),) for _ in range(40)]
    batches = [(n, rng.randint(0, n)) for (n,) in batches]
    df = spark.createDataFrame([("S", k + 1, n, h) for k, (n, h) in enumerate(batches)], "stream_id string, n long, events long, handled long")
    out = snapshots.batched_appends(df, every).orderBy("n").collect()
    assert [(r.first_version, r.snapshot_at) for r in out] == simulate(batches, every)


def test_upcasters():
    u = upcasts.Upcasters()
    u.register(upcasts.Upcaster("T", 2, 3, lambda d: d + "c"), upcasts.Upcaster("T", 1, 2, lambda d: d + "b"), upcasts.Upcaster("G", 2, 3, lambda d: d))
    assert (u.value("T", 1, "a"), u.value("T", 2, "a"), u.value("T", 3, "a"), u.value("G", 1, "a"), u.value("Z", 1, "a")) == ("abc", "ac", "a", "a", "a")
    assert (u.latest("T", 1), u.latest("G", 1), u.latest("Z", 4)) == (3, 1, 4)
    u.register(upcasts.Upcaster("S", 1, 3, lambda d: d + "!"), upcasts.Upcaster("S", 2, 3, lambda d: d + "?"))
    assert u.value("S", 1, "a") == "a!"


def test_upcast_column_keeps_null_data(spark):
    u = upcasts.Upcasters()
    u.register(upcasts.Upcaster("T", 1, 2, lambda d: F.concat(d, F.lit("b"))))
    df = spark.createDataFrame([("T", 1, "a"), ("T", 2, "a"), ("T", 1, None)], "event_type string, schema_version int, data string")
    assert [r[0] for r in df.select(u.column(F.col("data"))).collect()] == ["ab", "a", None]


def test_appends(spark):
    heads = spark.createDataFrame([("A", 3)], "stream_id string, version int")
    wanted = [("A", -1, True), ("A", 0, False), ("A", 3, False), ("A", 2, True), ("N", -1, False), ("N", 0, False), ("N", 1, True)]
    df = spark.createDataFrame([(s, e) for s, e, _ in wanted], "stream_id string, expected_version int")
    got = {(r.stream_id, r.expected_version): r.conflict for r in appends.checked(df, heads).collect()}
    assert got == {(s, e): c for s, e, c in wanted}


def test_verification(spark):
    log = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1), ("B", 3), ("C", 1), ("C", 1), ("D", 2)], "stream_id string, stream_version int")
    assert {r.stream_id: r.contiguous for r in verify.contiguity(log).collect()} == {"A": True, "B": False, "C": False, "D": False}
    expected, seen = (spark.createDataFrame([(t,) for t in x], "token string") for x in ("ab", "bbc"))
    assert {r.token: r.problem for r in verify.token_errors(expected, seen).collect()} == {"a": "missing", "b": "duplicate", "c": "unexpected"}


def test_percentile_rules_differ(spark):
    df = spark.createDataFrame([(float(k),) for k in range(1, 11)], "v double")
    assert metrics.nearest_rank(df, [], "v", [50, 95]).first().asDict() == {"n": 10, "p50": 5.0, "p95": 10.0}
    assert metrics.floor_index(df, [], "v", {"p50": 0.5, "p95": 0.95}).first().asDict() == {"n": 10, "p50": 5.0, "p95": 9.0}


@pytest.mark.parametrize("sketch", [20, 10_000])
def test_percentiles_by_brackets_are_exact(spark, monkeypatch, sketch):
    """Skewed, tied, negative and null values, in keys of a few and of many, null among them."""
    monkeypatch.setattr(metrics, "SKETCH", sketch)
    rng = random.Random(sketch)
    rows = [(k, rng.choice([rng.randint(-3, 3), rng.expovariate(0.1), None, 7.0])) for k in ("a", "b", None) for _ in range({"a": 1500, "b": 17, None: 300}[k])] + [("c", 1.0), ("d", None)]
    rows = [(k, None if v is None else float(v)) for k, v in rows]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    fractions = {"f0": 0.0, "f1": 0.1, "f5": 0.5, "f95": 0.95, "f99": 0.99, "f100": 1.0}
    got = {r.k: r for r in metrics.floor_index(df, ["k"], "v", fractions).collect()}
    near = {r.k: r for r in metrics.nearest_rank(df, ["k"], "v", [1, 50, 99, 100]).collect()}
    assert set(got) == set(near) == {"a", "b", "c", None}
    for k in got:
        v = sorted(x for kk, x in rows if kk == k and x is not None)
        assert got[k].n == len(v) and [got[k][f] for f in fractions] == [v[math.floor((len(v) - 1) * f)] for f in fractions.values()]
        assert [near[k][f"p{p}"] for p in (1, 50, 99, 100)] == [v[max(0, math.ceil(p * len(v) / 100) - 1)] for p in (1, 50, 99, 100)]


def test_tops_and_carried_snapshots(spark):
    log = spark.createDataFrame([("A", v, "XSnapshot" if v % 3 == 0 else "n", float(v)) for v in range(1, 9)] + [("B", 1, "n", 1.0)], "stream_id string, stream_version int, event_type string, value double")
    top = lambda **how: sorted((r.stream_id, r.stream_version) for r in reads.top_of_streams(log, 2, **how).collect())
    assert top() == [("A", 7), ("A", 8), ("B", 1)] and top(descending=False, after=3) == [("A", 4), ("A", 5)]
    assert "WindowGroupLimit" in reads.top_of_streams(log, 2)._jdf.queryExecution().executedPlan().toString()
    got = {(r.stream_id, r.stream_version): (r.snapshot_version, r.snapshot) for r in snapshots.carried(log, "X", F.col("value")).collect()}
    assert got == {("A", v): (v // 3 * 3, float(v // 3 * 3)) if v >= 3 else (None, None) for v in range(1, 9)} | {("B", 1): (None, None)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(JSON, st.lists(st.sampled_from(["a", "b", "0", "1"]), min_size=1, max_size=3), JSON), min_size=1, max_size=20))
def test_json_columns_equal_values(spark, cases):
    """Paths of JSON text by columns against the same by values."""
    rows = [(k, json.dumps(d), ".".join(p), json.dumps(v)) for k, (d, p, v) in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, j string, p string, v string")
    for r in df.withColumn("g", codecs.json_get(F.col("j"), F.col("p"))).collect():
        there, value = codecs.get_path(json.loads(r.j), r.p)
        assert (r.g is not None) == there and (not there or json.loads(r.g) == value)
    k, j, p, v = rows[0]
    one = df.where(F.col("k") == 0)
    assert json.loads(one.select(codecs.json_delete(F.col("j"), p)).first()[0]) == codecs.delete_path(json.loads(j), p)
    try:
        want = codecs.set_path(json.loads(j), p, json.loads(v))
    except ValueError:
        return
    assert all(json.loads(one.select(codecs.json_set(F.col("j"), path, F.col("v"))).first()[0]) == want for path in (p, F.col("p")))


def test_ring_and_reservoir(spark):
    df = spark.range(50).selectExpr("id AS seq", "id * 2 AS v")
    assert sorted(r.seq for r in metrics.ring_sample(df, "seq", 7).collect()) == list(range(43, 50))
    slots: list[int | None] = list(range(10))
    for n in range(10, 50):
        h = n + 1
        for factor, shift in metrics.ROUNDS:
            h = h * factor % 2**32
            h ^= h >> shift
        signed = h - 2**32 if h >= 2**31 else h
        slot = int(math.fmod(signed, n + 1))
        if 0 <= slot < 10:
            slots[slot] = n
    got = {r.slot: r.seq for r in metrics.reservoir_sample(df, "seq", 10).collect()}
    assert got == dict(enumerate(slots))


def test_argument_checks():
    good = {"stream_id": "s", "expected_version": 0, "events": [{"type": "T", "data": {}}]}
    validation.append_input(good)
    for bad in (
        {"stream_id": ""}, {"expected_version": -2}, {"expected_version": 1.5}, {"expected_version": 2**53}, {"expected_version": True}, {"events": "x"},
        {"events": [{"type": ""}]}, {"events": [{"type": "T", "schema_version": 0}]}, {"events": [{"type": "T", "source": ""}]}, {"outbox_topics": ["a", "a"]},
        {"events": [{"type": "T", "data": [1], "encrypted_fields": ["a"]}]}, {"events": [{"type": "T", "data": {}, "encrypted_fields": [""]}]}, {"outbox_topics": [""]},
    ):
        with pytest.raises(errors.InvalidArgumentError):
            validation.append_input({**good, **bad})
    for bad in ({"lower_bound": {"id": "-1"}}, {"lower_bound": {"id": "1", "type": "x"}}, {"batch_size": 0}, {"poll_interval_ms": -1}, {"recursive": 1}, {"event_types": "a"}, {"subject": ""}):
        with pytest.raises(errors.InvalidArgumentError):
            validation.subscribe_options(**bad)


def test_encrypted_paths():
    validation.encrypted_paths(["a", "b.c", "b.d"])
    for bad in (["a", "a"], ["a", "a.b"], ["a.b", "a"], ["__proto__"], ["a..b"], ["a.constructor"]):
        with pytest.raises(errors.InvalidArgumentError):
            validation.encrypted_paths(bad)




@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from("abc"), JSON, max_size=3), st.lists(st.sampled_from("abc"), min_size=1, max_size=3), JSON)
def test_paths_set_what_they_get(data, steps, value):
    path = ".".join(steps)
    there, old = codecs.get_path(data, path)
    if there:
        assert codecs.set_path(codecs.delete_path(data, path), path, old) == data
    try:
        new = codecs.set_path(data, path, value)
    except ValueError:
        return
    assert codecs.get_path(new, path) == (True, value)


def test_strict_base64():
    assert codecs.strict_base64("YWI=", 2) == b"ab"
    for bad in ("YWI", "YWJ=", "YWI=\n", "YW!="):
        with pytest.raises(ValueError):
            codecs.strict_base64(bad)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([], schema.LOG).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    one = plan(reads.stream(log, "A", 2))
    assert "EqualTo(stream_id,A)" in one and "GreaterThanOrEqual(stream_version,2)" in one
    sub = plan(reads.after_position(log, 5, 9, filters.subscription("O", True, ["a"]), 10))
    assert all(x in sub for x in ("StringStartsWith(subject,O)", "In(event_type", "GreaterThan(global_position,5)")) or "EqualTo(event_type,a)" in sub
    assert "TakeOrderedAndProject" in sub
    page = plan(paging.page_rows(log, ["A", "B"], 5, after=(3, "A", "A/1")))
    assert "TakeOrderedAndProject" in page and "GreaterThanOrEqual(global_position,3)" in page
    fold = plan(folds.algebraic(log.withColumn("value", F.lit(1.0)), {"x": folds.total(F.col("value"), ["d"])}))
    assert fold.count("Exchange") == 1 and "partial_sum" in fold


def test_rows_without_a_key_are_spread_over_tasks(spark):
    n, held = 4000, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    rows = spark.range(n).select(
        F.concat(F.lit("s/"), "id").alias("id"), F.when(F.col("id") < 10, "sealed").otherwise("open").alias("event_type"), F.lit('{"a":1}').alias("data"),
        F.when(F.col("id") < 10, "k").when(F.col("id") < 20, "unused").alias("crypto_key_id"),
    )
    keys = spark.createDataFrame([(k, bytearray(32), k != "k") for k in ("k", "s/100")], "key_id string, key binary, revoked boolean")  # one has an event's name
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sealed = crypto.encrypt(rows, {"sealed": ["a"]}, keys, 1)
        for out in (sealed, crypto.decrypt(sealed, keys)):
            tasks = {r.p: r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()}
            assert sum(tasks.values()) == n and max(tasks.values()) < n / 2
        assert {(r.data, r.tombstoned) for r in crypto.decrypt(sealed, keys).collect()} == {('{"a":1}', False)}
        assert sealed.where("data = '{}' AND crypto_key_id = 'k'").count() == 10 and sealed.where("crypto_key_id IS NULL").count() == n - 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
