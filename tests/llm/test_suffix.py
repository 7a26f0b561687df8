from collections import Counter

import numpy as np
import pytest

from paperloom.llm import suffix

from .cases import awkward, repeated


def brute(rows, size):
    seen = Counter()
    raws = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raws:
        seen.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = []
    for d, b in raws:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [400, 60, 17])
def test_equals_brute_force(spark, size):
    docs = repeated(awkward(spark, 60))
    long = "".join(chr(97 + (i * i * 7 + i // 13) % 26) for i in range(3000))
    more = [(7000, long), (7001, long[100:900] + "X" + long[900:1700]), (7002, "pre" + long[500:1300]), (None, long[2000:2500]), (7004, "ab" * 900), (7005, long[:400]), (7006, long[300:700] + long[300:700])]
    docs = docs.union(spark.createDataFrame([(d, t, None, None, None, None, None, None) for d, t in more], docs.schema))
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix.dedup(docs, size).collect()), key=repr)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], size)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert got == want


def test_ranges_cover_every_window_once():
    from paperloom.llm.blocks import Slice

    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in (10, 20, 21, 300, 20)]
    able = [t for t in texts if len(t) >= 20]
    part = Slice(able)
    r = suffix.Ranges(part, 20, 10)
    at, _ = r.windows(np.arange(len(r.first)))
    want = [s + i for s, t in zip(part.starts.tolist(), able) for i in range(len(t) - 19)]
    assert at.tolist() == want


def test_empty_table(spark):
    assert suffix.dedup(awkward(spark).limit(0)).count() == 0


def test_hash_collisions_remove_nothing(spark):
    """Texts whose polynomial hashes modulo 2^64 agree: the first 400 bytes of one repeat nowhere."""
    order = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ k] for x in order) for k in (0, 1))
    tail = "".join(chr(97 + (i * i * 11 + i // 7) % 26) for i in range(1400))
    rows = [(1, a + tail[:100]), (2, b + tail[100:200]), (3, "x" + a[:1000]), (None, None), (None, ""), (None, tail), (None, tail)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (400, 1024):
        got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix.dedup(docs, size).collect()), key=repr)
        assert got == brute(rows, size)


def test_rows_without_an_id_are_dealt_over_blocks(spark):
    from pyspark.sql import functions as F

    from paperloom.llm.blocks import block_of

    rows = spark.range(200).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("_text"))
    assert rows.select(block_of(F.xxhash64("doc_id", "_text"), 8)).distinct().count() == 8
