"""Packing against the tokenizers library, brute-force optima and its own laws."""

import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from paperloom.llm import packing

from .cases import awkward, repeated


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path(packing.TOKENIZER))


def obey(rows, size):
    """Sequences are gapless from 0 and not too long."""
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(held)


@pytest.mark.parametrize("size", [packing.LENGTH, 100])
def test_pieces_equal_library_and_sequences_obey(spark, library, size):
    docs = repeated(awkward(spark))
    docs = docs.union(spark.createDataFrame([(None, "no id", None, None, None, 0, "x", "y"), (-(2**63), "Ünḯ\x0bx\x1cy\x85z  end", None, None, None, 0, "x", "y")], docs.schema))
    rows = packing.pack(docs, size=size).collect()
    want = []
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), size)):
            cut = np.array(ids[at : at + size], "<u4")
            want.append((r["doc_id"], k, at, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    counts = Counter(r["length"] for r in rows)
    assert packing.lower_bound(counts, size) <= obey(rows, size) <= packing.best_fit(counts, size)[1]


def test_white_space_and_words_agree_with_library(library):
    rng = random.Random(1)
    alphabet = [chr(c) for c in [*range(0, 0x180), *range(0x300, 0x310), *range(0x2000, 0x2030), 0x3000, 0xFEFF, 0x3A3, 0x130]] + ["'s", "'LL", " ", " ", "\n", "<|endoftext|>", "word"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(800)]
    letters = [chr(c) for c in range(0x41, 0x260) if chr(c).isalpha()] + list("abcdefgh")
    texts += ["".join(rng.choices(letters, k=rng.randrange(1, 12))) + rng.choice(["", ".", ",", "?!", "1"]) for _ in range(3000)] + letters
    rng.shuffle(texts)
    coder = packing.WordEncoder(P.path(packing.TOKENIZER))
    for few in (texts[:400], texts[400:]):
        ids, counts = coder.packed(few)
        want = [library.encode(t, add_special_tokens=False).ids for t in few]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def expanded(fills, size):
    """Bins as lists of lengths, with their places checked."""
    bins = {}
    for f in fills:
        for k in range(f.count):
            bins.setdefault(f.first + k // f.each, []).append((f.offset + k % f.each * f.length, f.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return bins


def optimum(lengths, size):
    @lru_cache(None)
    def least(left, room):
        if not left:
            return 0
        best = None
        for i, n in enumerate(left):
            if i and left[i - 1] == n:
                continue
            rest = left[:i] + left[i + 1 :]
            found = least(rest, room - n) if n <= room else (1 + least(rest, size - n) if i == 0 else None)
            if found is not None and (best is None or found < best):
                best = found
        return best

    return least(tuple(sorted(lengths, reverse=True)), 0)


@pytest.mark.parametrize("seed", range(40))
def test_small_plans_are_optimal(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 13, 20, 30])
    lengths = [rng.randint(1, size) if seed % 2 else rng.randint(size // 4, size // 2) for _ in range(rng.randint(1, 11))]
    counts = Counter(lengths)
    fills, n = packing.plan(counts, size)
    bins = expanded(fills, size)
    assert sorted(x for b in bins.values() for _, x in b) == sorted(lengths) and len(bins) == n
    assert packing.lower_bound(counts, size) <= optimum(lengths, size) <= n <= packing.best_fit(counts, size)[1]
    assert n == optimum(lengths, size)


def test_bin_completion_improves_on_best_fit():
    counts = {44: 200, 24: 200, 22: 200, 21: 100, 17: 100, 8: 200, 6: 200, 30: 37}
    size = 100
    _, n = packing.best_fit(counts, size)
    fills, better = packing.plan(counts, size)
    assert packing.lower_bound(counts, size) <= better < n
    bins = expanded(fills, size)
    assert Counter(x for b in bins.values() for _, x in b) == Counter(counts) and len(bins) == better


def test_plans_do_not_grow_with_the_number_of_pieces():
    rng = random.Random(2)
    counts = {n: rng.randrange(1, 1000) for n in rng.sample(range(1, 4097), 1500)}
    few, many = (packing.plan({n: c * k for n, c in counts.items()}) for k in (1, 10**6))
    assert len(many[0]) < 3 * len(few[0])
    for (_, n), k in ((few, 1), (many, 10**6)):
        bound = packing.lower_bound({x: c * k for x, c in counts.items()}, packing.LENGTH)
        assert bound <= n <= bound * 1.005 + 1


def test_fillings_are_undominated():
    def ways(left, most):
        return list(packing.fillings(left, packing.Sums(left, 100), 100, most, [1000]))

    left = {50: 2, 30: 2, 25: 2, 20: 2, 10: 3}
    # 30 + 20 and twice 25 give way to the second 50.
    assert ways(left, 10) == [(0, {50: 2})]
    left[50] = 1
    assert ways(left, 4) == [(0, {30: 1, 20: 1, 50: 1}), (0, {25: 2, 50: 1})]
    # 20 + 20 leaves 7 and could hold 25 instead of 20.
    assert ways({53: 1, 25: 1, 20: 2}, 47) == [(2, {25: 1, 20: 1, 53: 1})]


def test_empty_table(spark):
    assert packing.pack(awkward(spark).limit(0)).count() == 0
    assert packing.plan({}) == ([], 0)
