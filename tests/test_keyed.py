"""Upserts by hash partitions: what a batch touches, replays, cut-short batches, rejected rows."""

import pathlib

import pytest
from pyspark.sql import functions as F

from paperloom.sinks import keyed as K

SCHEMA = "id string, v int, at int"


def files(path):
    return {str(p.relative_to(path)) for p in pathlib.Path(path, "rows").rglob("*.parquet")}


def held(table):
    return {r["id"]: r["v"] for r in table.rows().collect()}


def test_only_touched_partitions_change(spark, tmp_path):
    table = K.KeyedTable(spark, str(tmp_path), "id", 8)
    assert table.upsert(spark.createDataFrame([(f"k{i}", i, 0) for i in range(64)], SCHEMA), 0, "at")
    before = files(tmp_path)
    batch = spark.createDataFrame([("k3", 100, 2), ("k3", 101, 1), ("new", 5, 0), (None, 1, 0), ("bad", -1, 0)], SCHEMA)
    assert table.upsert(batch, 1, "at", F.col("v") >= 0)
    want = {f"k{i}": i for i in range(64)} | {"k3": 101, "new": 5}
    assert held(table) == want
    after, touched = files(tmp_path), {r[0] for r in batch.where("id in ('k3', 'new')").select(F.pmod(F.xxhash64("id"), F.lit(8))).collect()}
    assert {f.split("key_bucket=")[1].split("/")[0] for f in before ^ after} == {str(b) for b in touched}
    assert {(r["id"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/rejected/1").collect()} == {(None, 1), ("bad", -1)}
    # The same batch again, with other rows even, changes nothing.
    assert not table.upsert(spark.createDataFrame([("k3", 7, 0)], SCHEMA), 1, "at")
    assert files(tmp_path) == after
    assert table.upsert(batch.limit(0), 2, "at") and held(table) == want
    assert K.KeyedTable(spark, str(tmp_path), "id", 99).buckets == 8
    with pytest.raises(ValueError):
        K.KeyedTable(spark, str(tmp_path), "v")


def test_a_batch_cut_short_goes_on_from_its_copy(spark, tmp_path, monkeypatch):
    table = K.KeyedTable(spark, str(tmp_path), "id", 4)
    table.upsert(spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], SCHEMA), "x", "at")
    rows = spark.createDataFrame([("a", 9, 0)], SCHEMA)
    with monkeypatch.context() as m:
        real, calls = spark.read.parquet, []
        m.setattr(K, "_done", lambda s, p: False)
        m.setattr(K.KeyedTable, "_drop", lambda self, p: calls.append(p) or (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.upsert(rows, "y", "at")
    assert real(f"{tmp_path}/staged/y").count() >= 1
    # The note is lost too: the copy is what counts, not what comes with the replay.
    table._drop(f"{tmp_path}/ledger/y")
    assert table.upsert(spark.createDataFrame([("a", 77, 0)], SCHEMA), "y", "at")
    assert held(table) == {"a": 9, "b": 2}
    assert not pathlib.Path(tmp_path, "staged/y").exists()


def test_stream_restarts(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/table"
    for i in range(2):
        spark.createDataFrame([("a", i, 0), (f"b{i}", i, 0)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        K.upserts(stream, path, "id", "at", f"{tmp_path}/check", 4).trigger(availableNow=True).start().awaitTermination(120)
    assert held(K.KeyedTable(spark, path, "id")) == {"a": 1, "b0": 0, "b1": 1}
