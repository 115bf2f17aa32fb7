"""Streams over the commit log: catch-up, restarts without double counting, stateful trackers."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from weftlog.sources import positions, schema
from weftlog.store import EventStore
from weftlog.streaming import projections, trackers


def filled(spark, path) -> EventStore:
    store = EventStore(spark, str(path))
    store.setup()
    for k in range(4):
        store.append(f"Account-{k % 2}", 0, [{"type": "Deposit", "data": {"amount": k}}, {"type": "Note", "data": {}}])
    return store


def test_read_model_counts_every_event_once_across_restarts_and_compaction(spark, tmp_path):
    store = filled(spark, tmp_path / "s")
    root = str(tmp_path / "s" / "eventstore")

    def part(batch):
        rows = projections.dispatched(batch, "Account", {"Deposit": lambda d: d.select("entity_id", "global_position", F.get_json_object("data", "$.amount").cast("long").alias("amount"))})
        return rows.groupBy("entity_id").agg(F.sum("amount").alias("amount"), F.max("global_position").alias("upto"))

    def run():
        projections.materialise(positions.stream(spark, root), part, str(tmp_path / "model"), str(tmp_path / "ck")).awaitTermination(120)
        model = projections.read_model(spark, str(tmp_path / "model"), ["entity_id"], [F.sum("amount").alias("amount"), F.max("upto").alias("upto")])
        return {r.entity_id: (r.amount, r.upto) for r in model.collect()}

    assert run() == {"0": (2, 5), "1": (4, 7)}
    assert run() == {"0": (2, 5), "1": (4, 7)}
    store.log.compact()
    store.append("Account-1", 0, [{"type": "Deposit", "data": {"amount": 10}}])
    assert run() == {"0": (2, 5), "1": (14, 9)}


def test_parts_of_a_read_model_are_merged(spark, tmp_path):
    path, merge = str(tmp_path / "m"), [F.sum("n").alias("n"), F.max("top").alias("top")]
    part = lambda k: spark.createDataFrame([("a", k, k), (f"b{k % 2}", 1, k)], "key string, n long, top long")
    model = lambda: {r.key: (r.n, r.top) for r in projections.read_model(spark, path, ["key"], merge).collect()}
    for k in range(6):
        part(k).write.parquet(f"{path}/batch={k}")
    want = model()
    assert want == {"a": (15, 5), "b0": (3, 4), "b1": (3, 5)}
    projections.merge_parts(spark, path, ["key"], merge, 3)
    projections.merge_parts(spark, path, ["key"], merge, 3)
    assert model() == want and sorted(p.name for p in (tmp_path / "m").iterdir()) == ["batch=4", "batch=5", "merged=3"]
    part(2).write.parquet(f"{path}/batch=2")  # a leftover of a batch that is merged already
    assert model() == want
    projections.merge_parts(spark, path, ["key"], merge, 5)
    assert model() == want and [p.name for p in (tmp_path / "m").iterdir()] == ["merged=5"]


def test_snapshots_fall_due_by_counter(spark, tmp_path):
    store = filled(spark, tmp_path / "s")
    root = str(tmp_path / "s" / "eventstore")

    def run():
        due = trackers.due_snapshots(positions.stream(spark, root), ["Deposit"], 2)
        q = due.writeStream.format("parquet").option("path", str(tmp_path / "due")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r.stream_id, r.stream_version) for r in spark.read.parquet(str(tmp_path / "due")).collect())

    assert run() == [("Account-0", 3), ("Account-1", 3)]
    store.append("Account-0", 0, [{"type": "Deposit", "data": {"amount": 1}}, {"type": "Deposit", "data": {"amount": 1}}, {"type": "Deposit", "data": {"amount": 1}}])
    assert run() == [("Account-0", 3), ("Account-0", 6), ("Account-1", 3)]


def test_a_large_file_is_read_in_small_batches(tmp_path):
    n, path = 200_000, str(tmp_path / "part.parquet")
    kinds = {"stream_version": pa.int32(), "time": pa.timestamp("us"), "created_at": pa.timestamp("us")}
    row = {"stream_version": 1, "time": datetime(2024, 1, 1), "created_at": datetime(2024, 1, 1)}
    columns = {c: pa.array([row.get(c, "x" * 40)] * n, kinds.get(c, pa.string())) for c in schema.EVENT_COLUMNS} | {"global_position": pa.array(range(1, n + 1))}
    pq.write_table(pa.table(columns).select(schema.EVENT_COLUMNS[::-1]), path, row_group_size=n // 2)  # any order of columns
    whole = pa.table(columns).nbytes
    del columns
    reader, before, held, found = positions._Reader({"path": str(tmp_path)}), pa.total_allocated_bytes(), [], []
    for batch in reader.read(positions._Slice(str(tmp_path), path, 10, n - 10)):
        held.append(pa.total_allocated_bytes() - before)
        found += batch.column("global_position").to_pylist()
        assert batch.schema.names == schema.EVENT_COLUMNS
    assert found == list(range(11, n - 9)) and max(held) < whole / 5
    assert positions._groups(pq.read_metadata(path), n // 2, n) == [1] and positions._groups(pq.read_metadata(path), 0, n // 2) == [0]
    assert list(reader.read(positions._Slice(str(tmp_path), path, n, n + 5))) == []
