"""Near copies against all pairs compared in plain Python."""

import os
import random
from itertools import combinations

from paperloom.llm import neardup, simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for (a, x), (b, y) in combinations(sets, 2):
        if x == y or len(x & y) >= 0.8 * len(x | y):
            pairs += x != y
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: find(d) for d, _ in rows}, pairs


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, pairs = components(rows)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_copies(docs).collect()} == want
    assert {r["doc_id"] for r in neardup.one_of_each(docs).collect()} == set(want.values())
    return docs, want, pairs


def test_edited_copies_are_joined(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    rows = [(1, " ".join(base)), (2, None), (3, " \t"), (4, "one two"), (5, "ONE  two"), (6, "one two three")]
    for i, edits in enumerate([1, 3, 5, 6, 14, 40]):
        words = list(base)
        for at in range(7, 300, 300 // edits):
            words[at] = "edited"
        rows.append((10 + i, " ".join(words)))
    docs, want, pairs = check(spark, rows)
    assert pairs and want[10] == want[11] == 1 and want[15] == 15
    # What the two bits of op4 miss.
    assert len({r["component_id"] for r in simhash.near_duplicates(docs).where("doc_id IN (1, 10, 11, 12, 13)").collect()}) > 1


def test_crowded_buckets(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = []
    for i in range(80):
        words = list(base)
        words[rng.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(words)))
    assert set(check(spark, rows)[1].values()) == {0}


def test_crowded_buckets_lose_no_link(spark):
    """Bases with copies just above the threshold, in buckets crowded with relatives just below it."""
    rng = random.Random(8)
    rows = []
    for b in range(2):
        base = [f"b{b}w{rng.randrange(900)}" for _ in range(300)]

        def edited(n, base=base, b=b):
            words, step = list(base), 300 // n
            for k in range(n):
                words[k * step + rng.randrange(step // 2)] = f"e{b}x{rng.randrange(10**9)}"
            return " ".join(words)

        for i in range(1 + 8 + 60):
            doc_id = 1000 * b + i
            rows.append((doc_id, " ".join(base) if i == 0 else edited(6 if i <= 8 else 18)))
    docs, want, pairs = check(spark, rows)
    assert pairs >= 2 * 8
    # However few classes a bucket may hold before it counts as crowded.
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_copies(docs, dense=0).collect()} == want


def test_rows_of_one_doc_id_are_told_apart(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = spark.createDataFrame([(3, one, {"k": 1}), (5, one, {"k": 2}), (5, two, {"k": 3}), (8, three, {"k": 4}), (8, two + " more", {"k": 5}), (8, three, {"k": 4}), (None, one, None), (-7, three + " x", {})], "doc_id long, text string, extra map<string,int>")
    got = sorted(((r["doc_id"], r["text"]) for r in neardup.one_of_each(docs).collect()), key=repr)
    assert got == sorted([(3, one), (5, two), (-7, three + " x"), (None, one)], key=repr)
    docs = spark.createDataFrame([(8, three), (8, two)], "doc_id long, text string")
    assert neardup.one_of_each(docs).count() == 2
    docs = spark.createDataFrame([(8, three), (8, three), (-(2**63), two), (2**63 - 1, two)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardup.one_of_each(docs).collect()) == [-(2**63), 8]


def test_no_pair_is_left_to_chance(spark):
    """Eight of ten shingles in common; the MinHash bands that gave the candidates before share none for these words."""
    words = [f"m2838x{i}" for i in range(13)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:12], "tail"])), (3, "seven words that are in no other")]
    assert set(check(spark, rows)[1].values()) == {1, 3}


def test_fingerprints_meet_by_pigeonring(spark):
    """Chains for more bits than op4's two, against all pairs."""
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(30)}
    for v in list(values):
        for n in range(1, 6):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), n)))
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    for limit in (2, 3, 5):
        got = {tuple(sorted((r["u"], r["v"]))) for r in simhash.links(fps, limit=limit).collect()}
        assert got == {(a, b) for a, b in combinations(values, 2) if ((a ^ b) % (1 << 64)).bit_count() <= limit}


def test_wide_tables_of_one_round_at_a_time(spark, monkeypatch):
    """What a round has written is gone before the next one writes; a pair is judged once."""
    paths, judged = [], []

    def staged(df, name, real=neardup.staged):
        out, path = real(df, name)
        for wide in ("rooted", "marks", "links"):
            paths[:] = [p for p in paths if os.path.isdir(p.removeprefix("file://"))] + [path] * (path not in paths)
            assert sum(p.endswith(f"/{wide}") for p in paths) <= 1, paths
        if name == "candidates":
            judged.extend((r["u"], r["v"]) for r in out.collect())
        return out, path

    monkeypatch.setattr(neardup, "staged", staged)
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = [(1, " ".join(base))]
    for i in range(12):
        words = list(base)
        for at in rng.sample(range(200), 9 if i % 2 else 2):
            words[at] = f"edit{i}x{at}"
        rows.append((10 + i, " ".join(words)))
    check(spark, rows)
    assert judged and len(judged) == 2 * len(set(judged))  # check finds the components twice
