import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from paperloom.llm import common, decontam, langid, quality, sharding, simhash
from paperloom.llm.graph import components

from . import brute
from .cases import awkward, repeated


def plain(rows):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rows), key=repr)


def test_quality(spark):
    text = "this line repeats itself for all of its words again and again"
    docs = repeated(awkward(spark))
    more = [(2000 + i, "\n".join([text] * (i + 1)), None, "bad", 1) for i in range(30)] + [(None, text * 3, None, "bad", 1)]
    docs = docs.union(spark.createDataFrame([(*r, 1, "x", "y") for r in more], docs.schema))
    want = plain(brute.quality([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]))
    assert plain(quality.judge(docs).collect()) == want
    assert sum(r[-1] for r in want) and sum(not r[-1] and not r[-2] for r in want)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, [r["doc_id"] for r in kept.collect()])) == sorted(repr(r[0]) for r in want if r[-1])


def test_simhash(spark):
    docs = repeated(awkward(spark, 100)).union(spark.createDataFrame([(None, "only here and nowhere else at all", None, None, None, None, None, None)], awkward(spark, 1).schema))
    rows = [(r["doc_id"], brute.simhash(r["text"])) for r in docs.collect()]
    want = plain((d, fp - (1 << 64) if fp >> 63 else fp, c) for d, fp, c in brute.near(rows))
    assert plain(simhash.near_duplicates(docs).collect()) == want
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(docs).where("doc_id is not null").select("doc_id").distinct().collect())
    assert kept == sorted({c for d, _, c in want if d is not None and c is not None})


@pytest.mark.parametrize("dense", [0, 2, 10_000])
def test_links_connect_all_within_two_bits(spark, dense):
    import random

    rng = random.Random(5)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
            values.add(x - (1 << 64) if x >> 63 else x)
    values = sorted(values)
    got, _ = components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), dense))
    roots = {r["node"]: r["root"] for r in got.collect()}
    want = brute.near([(i, v & ((1 << 64) - 1)) for i, v in enumerate(values)])
    classes, found = defaultdict(set), defaultdict(set)
    for i, (_, _, c) in enumerate(want):
        classes[c].add(values[i])
        found[roots.get(values[i], values[i])].add(values[i])
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, found.values()))


def test_decontamination(spark):
    docs = repeated(awkward(spark, 100))
    text = docs.where("doc_id = 3").first()["text"]
    items = [(r["item_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/benchmark.parquet").to_pylist()]
    items += [(900, "two WORDS"), (901, None), (902, " -- "), (None, "One"), (903, "école straße 日本語"), (903, " ".join(text.split()[5:30])), (904, " ".join(text.split()[5:30])), (905, "12345 " * 14)]
    table = spark.createDataFrame([(*x, "w", "h") for x in items], "item_id long, text string, words string, hash string")
    want = plain(brute.decontaminate([(r["doc_id"], r["text"]) for r in docs.collect()], items))
    got = decontam.decontaminate(docs, table).select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated")
    assert plain(got.collect()) == want
    assert sum(r[-1] for r in want) > 3
    none = decontam.decontaminate(docs, table.limit(0))
    assert none.count() == docs.count() and none.where("n_hit > 0").count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    docs, table = awkward(spark, 40), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = plain(decontam.decontaminate(docs, table).collect())
    monkeypatch.setattr(decontam, "BLOCK", 100)
    assert plain(decontam.decontaminate(docs, table).collect()) == whole


def test_language(spark):
    docs = awkward(spark, 200)
    trees = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, trees).collect()}
    rows = docs.collect()
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    real = [r for r in rows if r["doc_id"] < 1000 and got[r["doc_id"]]["held_out"] and len((r["text"] or "").split()) > 5]
    right = sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in real)
    assert right / len(real) > 0.9
    assert {got[d]["lang_pred"] for d in (1000, 1001, 1002, 1010, 1012)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # The remembered sums are the exact code lengths.
    scorer = langid.Scorer(trees)
    word = "théorie"
    want = [sum(langid.bits(b[max(0, i - langid.ORDER) : i], b[i], t) for i in range(1, len(b))) for t in scorer.trees for b in [b" " + word.encode() + b" "]]
    assert scorer.lengths([word])[0].tolist() == pytest.approx(want)


def test_language_by_plain_code(spark):
    """Trees and predictions against counts of the same sample by other code."""
    docs = awkward(spark, 60)
    rows = [r for r in docs.collect() if r["lang"] is not None and r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    want = defaultdict(Counter)
    for r in rows:
        for word in r["text"].encode().split():
            coded = b" " + word + b" "
            want[r["lang"]].update(coded[i - k : i + 1] for i in range(1, len(coded)) for k in range(min(langid.ORDER, i) + 1))
    trees = langid.train(docs)
    got = {name: Counter({context + bytes([b]): n for context, seen in tree.items() for b, n in seen.items()}) for name, tree in trees.items()}
    assert got == {name: c for name, c in want.items() if c or name in got}

    def length(text, tree):
        out = 0.0
        for word in text.encode().split():
            coded = b" " + word + b" "
            out += sum(langid.bits(coded[max(0, i - langid.ORDER) : i], coded[i], tree) for i in range(1, len(coded)))
        return out

    able = [r for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"]) and len(r["text"]) < 5000]
    said = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, trees).collect()}
    for r in able[:40]:
        lengths = {name: length(r["text"], tree) for name, tree in trees.items()}
        assert lengths[said[r["doc_id"]]] == pytest.approx(min(lengths.values()))


def test_language_of_many_names(spark):
    """More languages than the bound holds at full samples: each is still learned, from fewer documents."""
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"), F.concat(F.lit("l"), F.pmod("id", F.lit(250)).cast("string")).alias("lang"))
    trees = langid.train(docs, sample_docs=5, total_docs=500)
    assert len(trees) > 240 and all(tree[b" "] in ({ord("w"): 1}, {ord("w"): 2}) for tree in trees.values())
    hot = docs.withColumn("lang", F.lit("one"))
    assert langid.train(hot, sample_docs=7)["one"][b" "] == {ord("w"): 7}


def test_hot_keys_join_whole(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, 0).when(F.col("id") < 990, F.col("id")).cast("long").alias("k"))
    known = rows.where("k is not null and k <> 905").groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("least"))
    for how, left in (("inner", 989), ("left", 1000)):
        got = common.join_by_key(rows, known, "k", 1000, how).collect()
        assert sorted(r["id"] for r in got) == [i for i in range(1000) if how == "left" or (i < 990 and i != 905)] and len(got) == left
        assert all(r["least"] == (None if r["k"] in (None, 905) else r["k"]) for r in got)


def test_language_without_training(spark):
    rows = langid.predict(awkward(spark, 5), {}).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}
    assert langid.predict(awkward(spark).limit(0), {}).count() == 0


def test_sharding(spark):
    docs = awkward(spark, 100)
    docs = repeated(docs.union(docs.where("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 3000)))
    docs = docs.union(spark.range(120).select((F.col("id") + 9000).alias("doc_id"), F.lit("the same text").alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes[2:]]))
    rows = sharding.shard_rows(docs, shards=7).collect()
    counts = Counter(r["shard"] for r in rows)
    n = docs.count()
    assert sum(counts.values()) == n and set(counts.values()) <= {n // 7, n // 7 + 1} and set(counts) == set(range(7))
    for s in range(7):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows)
    where = defaultdict(Counter)
    for r in rows:
        if texts[r["doc_id"]] is not None:
            where[texts[r["doc_id"]]][r["shard"]] += 1
    pairs = sum(sum(c.values()) * (sum(c.values()) - 1) // 2 for t, c in where.items() if t != "the same text")
    kept = sum(k * (k - 1) // 2 for t, c in where.items() if t != "the same text" for k in c.values())
    assert kept >= 0.8 * pairs
    assert len(where["the same text"]) <= 5


def test_empty_tables(spark):
    docs = awkward(spark).limit(0)
    assert quality.judge(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert sharding.shard_rows(docs).count() == 0
    assert decontam.decontaminate(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).count() == 0
