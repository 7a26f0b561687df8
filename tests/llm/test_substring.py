import re

import pytest

from paperloom.llm import substring

from .cases import awkward, repeated

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=13):
    first = {}
    docs = [(i, d, WORD.findall(t or "")) for i, (d, t) in enumerate(rows)]
    rank = lambda d: 1 << 63 if d is None else d
    for _, d, w in docs:
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            first[g] = min(first.get(g, 1 << 64), rank(d))
    out = []
    for _, d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < rank(d):
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_equals_brute_force(spark, batches):
    docs = repeated(awkward(spark, 100))
    extra = spark.createDataFrame([(None, " ".join(f"w{i}" for i in range(40)), None, None, None, None, None, None), (None, " ".join(f"w{i}" for i in range(5, 60)), None, None, None, None, None, None), (5000, " ".join(f"w{i}" for i in range(20, 50)), None, None, None, None, None, None)], docs.schema)
    docs = docs.union(extra)
    got = substring.dedup(docs, batches=batches)
    got = sorted((tuple(r) for r in got.select("doc_id", "_n_words", "_n_removed", "_kept").collect()), key=repr)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got == want
    assert sum(r[2] for r in want) > 0


def test_index_keeps_history_between_batches(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"a{i}" for i in range(30))
    index = substring.FingerprintIndex(spark, 4)
    try:
        for turn in range(4):
            index.add(spark.createDataFrame([(turn, 100 - turn, text)], "_block long, _id long, _text string"))
            assert [level for level, _, _ in index.runs] == [[0], [1], [1, 0], [2]][turn]
        asked = index.answers().groupBy("_block").agg(F.count(F.lit(1)).alias("n"))
        assert {r["_block"] for r in asked.collect()} == {1, 2, 3}
    finally:
        index.drop_runs()


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_doc_ids_of_any_sign_and_size(spark, batches):
    text = " ".join(f"n{i}" for i in range(20))
    ids = [*range(-9, 0), -(2**63), 2**63 - 1, -5, 7, None, None]
    rows = [(i, text) for i in ids] + [(2**63 - 1, "x " + text), (-3, text + " " + text)]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches)
    got = sorted((tuple(r) for r in got.select("doc_id", "_n_words", "_n_removed", "_kept").collect()), key=repr)
    assert got == brute(rows)
    # None is not the largest number.
    rows = [(2**63 - 1, text), (None, text)]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches)
    assert sorted(((r["doc_id"], r["_n_removed"]) for r in got.collect()), key=repr) == sorted([(2**63 - 1, 0), (None, 20)], key=repr)


def test_empty_table(spark):
    assert substring.dedup(awkward(spark).limit(0)).count() == 0


def test_hash_collisions_remove_nothing(spark):
    """Two words whose polynomial hashes modulo 2^64 agree for any base."""
    order = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[x ^ k] for x in order) for k in (0, 1))
    rows = [(i, " ".join(["w%d" % k for k in range(6)] + [word] + ["v%d" % k for k in range(6)])) for i, word in ((1, one), (2, other), (3, one))]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["_n_removed"]) for r in got.collect()) == [(1, 0), (2, 0), (3, 13)]


def test_buckets_stay_below_what_spark_takes(spark):
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    assert substring.n_buckets(10) == 10 and substring.n_buckets(100_001) < most and substring.n_buckets(10**9) < most


def test_carried_columns_may_have_any_name(spark):
    text = " ".join(f"c{i}" for i in range(20))
    names = ["_id", "_text", "_block", "_turn", "_kept", "_n_removed", "_row"]
    docs = spark.createDataFrame([(1, text, *[f"{n}1" for n in names]), (2, text, *[f"{n}2" for n in names]), (None, None, *[None] * 7)], f"doc_id long, text string, {', '.join(n + ' string' for n in names)}")
    got = substring.dedup(docs, carry=docs.columns)
    assert got.columns == [*docs.columns, "_n_words", "_n_removed", "_kept"]
    rows = {r[0]: r for r in got.collect()}
    assert rows[2][2:9] == tuple(f"{n}2" for n in names) and rows[2][10] == 20 and rows[1][10] == 0


def test_a_later_job_goes_on_from_a_saved_index(spark, tmp_path):
    text = " ".join(f"s{i}" for i in range(30))
    folder = f"file://{tmp_path}/index"
    schema = "doc_id long, text string"
    first = substring.dedup(spark.createDataFrame([(1, text), (2, "short")], schema), index_dir=folder)
    assert {r["doc_id"]: r["_n_removed"] for r in first.collect()} == {1: 0, 2: 0}
    for job in (3, 4):
        later = substring.dedup(spark.createDataFrame([(job, f"new{job} {text}")], schema), index_dir=folder)
        assert {r["doc_id"]: (r["_n_words"], r["_n_removed"]) for r in later.collect()} == {job: (31, 30)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("paperloom_")]
