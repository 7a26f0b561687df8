"""The stream of a user's actions against a plain list, with failed writes and a restart in between."""

import pytest
from pyspark.sql import functions as F

from paperloom.streaming import library as L

SCHEMA = "user_id string, paper_id string, action string, at long, fails boolean"
BATCHES = [
    [("u", "a", "add", 1, False), ("u", "b", "add", 2, None), ("u", "a", "add", 3, False), ("v", "a", "toggle", 1, False), ("u", " ", "add", 4, False), (None, "a", "add", 4, False), ("u", "c", "open", 4, False)],
    [("u", "a", "toggle", 5, False), ("u", "c", "add", 6, True), ("u", " b ", "remove", 7, True), ("v", "a", "toggle", 2, False), ("v", "x", "remove", 3, False)],
    [("u", "a", "add", 8, False), ("u", "c", "toggle", 9, False), ("w", None, "add", 1, False), ("w", "z", "add", 2, False)],
]


def plain(batches):
    kept, answers = {}, []
    for user, paper, action, at, fails in (r for b in batches for r in b):
        paper = (paper or "").strip()
        if not paper or user is None or action not in ("add", "remove", "toggle"):
            continue
        mine = kept.setdefault(user, [])
        on = paper in mine
        want = {"add": True, "remove": False}.get(action, not on)
        if not fails and want != on:
            mine.append(paper) if want else mine.remove(paper)
        answers.append((user, paper, at, on if fails else want, want != on and not fails, not fails))
    return kept, sorted(answers)


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stream_with_restart(rocks, tmp_path):
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    for i, batch in enumerate(BATCHES):
        rocks.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        # Each batch is a run of its own, from the checkpoint of the one before.
        stream = rocks.readStream.schema(SCHEMA).parquet(source)
        L.answered(stream).writeStream.option("checkpointLocation", state).outputMode("update").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).start().awaitTermination(120)
        kept, answers = plain(BATCHES[: i + 1])
        rows = rocks.read.parquet(out)
        assert sorted((r["user_id"], r["paper_id"], r["at"], r["in_library"], r["changed"], r["persisted"]) for r in rows.collect()) == answers
        got = {}
        for r in L.lists(rows).orderBy("user_id", "seq").collect():
            got.setdefault(r["user_id"], []).append(r["paper_id"])
        assert got == {u: papers for u, papers in kept.items() if papers}


def test_batch_equals_replay(rocks):
    from paperloom.operators.library import replay

    actions = rocks.createDataFrame([r[:4] for b in BATCHES for r in b], "user_id string, paper_id string, action string, at long")
    stream = L.lists(L.answered(actions)).select("user_id", "paper_id").collect()
    whole = replay(actions.where(F.col("user_id").isNotNull())).select("user_id", "paper_id").collect()
    assert sorted(stream) == sorted(whole)
