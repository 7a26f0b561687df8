"""Hard negatives against all inner products computed in plain Python."""

import math
import random

import numpy as np
import pytest

from paperloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long, v string"


def brute(rows):
    usable = []
    for vec_id, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        usable.append((vec_id, [math.floor(256 * float(np.float32(c))) for c in x], label))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, (a, x, label) in enumerate(usable):
        if a is None or a % 100:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), b, other) for j, (b, y, other) in enumerate(usable) if j != i]
        for score, b, _ in sorted((s for s in scored if s[2] == label), key=key)[:5]:
            fit = sorted((s for s in scored if s[2] != label and 30 * score <= 100 * s[0] <= 90 * score), key=key)
            out += [(a, b, r + 1, s[1], score, s[0]) for r, s in enumerate(fit[:10])]
    return sorted(out, key=repr)


def vectors(n, dims, seed, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(8)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        out.append((i, [scale * (x + rng.gauss(0, 0.3)) for x in c], rng.randrange(10)))
    return out


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in negatives.mine(df, **more).collect()), key=repr)
    assert got == brute(rows)
    return got


def test_equals_brute_force_in_one_round_and_in_several(spark):
    rows = vectors(1500, 6, 1)
    got = check(spark, rows)
    assert len(got) > 500
    assert check(spark, rows, round_bytes=4000) == got


def test_awkward_rows(spark):
    rows = vectors(300, 4, 2)
    nan, inf = float("nan"), float("inf")
    rows += [(400, None, 1), (500, [1.0, None, 0.0, 0.0], 1), (600, [nan, 1.0, 0.0, 0.0], 1), (700, [inf, 1.0, 0.0, 0.0], 1), (800, [1.0, 1.0, 0.0, 0.0], None)]
    rows += [(900, [], 3), (1000, [0.5], 4), (1100, [0.5, 0.5, 0.25, 1.0, 2.0, -1.0], 4), (-100, [1.0, 0.5, 0.0, 0.0], 5), (-(2**63), [1.0, 0.5, 0.0, 0.0], 5)]
    # One id several times, copies of a vector, ids that are null.
    rows += [(100, [1.0, 0.5, 0.0, 0.0], 5)] * 3 + [(2000 + i, [1.0, 0.5, 0.0, 0.0], i % 3) for i in range(400)] + [(None, [1.0, 0.5, 0.0, 0.0], i % 4) for i in range(30)]
    assert len(check(spark, rows)) > 50


def test_a_null_id_comes_last_among_ties(spark):
    rows = [(100, [2.0], 1), (1, [2.0], 1), (None, [1.0], 2), (3, [1.0], 2), (None, [1.1], 3)]
    assert [r[2:4] for r in check(spark, rows)] == [(1, None), (2, 3), (3, None)]


def test_large_components_keep_exact_scores(spark):
    rows = vectors(400, 3, 5, scale=2e4)
    assert max(abs(r[4]) for r in check(spark, rows)) * 100 > 2**40
    small = [(i, [c * 3e5 for c in x], label) for i, x, label in vectors(300, 3, 6, scale=1.0)]
    assert max(abs(r[4]) for r in check(spark, small)) > 2**49


def test_negative_and_zero_positives_have_no_negatives(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, -1.0], 2), (4, [-0.5, 0.0], 2)]
    assert [r[:4] for r in check(spark, rows)] == [(0, 3, 1, 2)]  # 0 is divisible by 7: its label is 2


def test_whole_groups_of_anchors_are_pruned():
    rng = np.random.default_rng(3)
    near, far = rng.normal(0, 1, (64, 8)) + 50, rng.normal(0, 1, (4096, 8)) - 50
    tree = negatives.Tree(np.floor(near), negatives.ANCHOR_LEAF)
    wanted = negatives.Wanted(np.full((64, 1), 0.0), np.full((64, 1), 1e6), 3)
    labels = np.zeros(64, np.int64)
    assert negatives.search(tree, labels, wanted, np.floor(far), np.arange(4096), 0, True) == 0
    some = negatives.search(tree, labels, wanted, np.floor(np.concatenate([far, near])), np.arange(4160), 0, True)
    assert 0 < some < 64 * 4160 / 4


@pytest.mark.parametrize("rows", [[], [(0, None, 1)], [(100, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 2)]])
def test_nothing_to_mine(spark, rows):
    assert check(spark, rows) == []
