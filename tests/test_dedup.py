"""Title similarity and both passes of de-duplication against plain Python."""

import random
from itertools import combinations

import pytest

from paperloom.operators import dedup

from .test_operators import frame


def bag(title):
    return title.lower().split()


def grams(w):
    return set(zip(w, w[1:])) or {(x, "") for x in w}


def alike(a, b, least=0.85):
    a, b = bag(a), bag(b)
    return bool(grams(a) & grams(b)) and len(set(a) & set(b)) / len(set(a) | set(b)) >= least


def some_titles(seed, n, common):
    """Titles with frequent endings, edited copies and permuted words."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            w = bag(rng.choice(out))
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.2:
                w = w[:-1] or w
            if rng.random() < 0.1:
                rng.shuffle(w)
        else:
            w = rng.choices(words, k=rng.randrange(1, 14)) + common
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed, least", [(1, 0.85), (2, 0.85), (3, 0.6), (4, 1.0)])
def test_pairs_equal_all_pairs_compared(spark, seed, least):
    titles = some_titles(seed, 160, ["large", "language", "models"]) + ["", "one", "one", "One"]
    got = {(r["p"], r["q"]) for r in dedup.title_pairs(frame(spark, *[{"title": t} for t in titles]), least).collect()}
    want = {(i, j) for (i, a), (j, b) in combinations(enumerate(titles), 2) if a and b and alike(a, b, least)}
    assert got == want and len(want) > 20


def test_frequent_words_of_many_titles_make_few_candidates(spark):
    """The same six words in every title: no key but theirs is shared, and their titles aren't paired."""
    titles = [" ".join([f"a{i}", f"b{i}", "with", "large", "language", "models", "for", "all"]) for i in range(400)] + ["a0 b0 with large language models for all of"]
    rows = frame(spark, *[{"title": t} for t in titles])
    assert [(r["p"], r["q"]) for r in dedup.title_pairs(rows).collect()] == [(0, 400)]


def test_copies_of_a_title_follow_its_first(spark):
    titles = ["the very same title here"] * 50 + ["another one of these", "", ""]
    got = {r["pos"]: r["leader"] for r in dedup.leaders(frame(spark, *[{"title": t} for t in titles])).collect()}
    assert got == {i: 0 for i in range(50)} | {50: 50, 51: 51, 52: 52}


FILLED = ("abstract", "pdf_url", "citations", "affiliations_raw")


def completeness(r):
    venue = 5 if r["venue"] not in ("", "arXiv", "Unknown") else 0
    return bool(r["abstract"]) + bool(r["pdf_url"]) + len(r["authors"]) + len(r["tags"]) + (r["citations"] > 0) + venue + (3 if r["conference_rank"] else 0)


def merged(winner, loser):
    return winner | {c: winner[c] or loser[c] for c in FILLED}


@pytest.mark.parametrize("seed", [5, 6])
def test_both_passes_equal_one_row_after_the_other(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i, title in enumerate(some_titles(seed, 120, ["survey"])):
        rows.append({
            "pos": i, "id": rng.choice([f"acl:{i}", f"arxiv:2401.0000{rng.randrange(9)}v{i}"]), "title": title, "abstract": rng.choice(["", f"text {i}"]), "pdf_url": rng.choice(["", f"u{i}"]), "citations": rng.choice([0, i]),
            "affiliations_raw": rng.choice([[], [f"org{i}"]]), "venue": rng.choice(["arXiv", "ICML"]), "conference_rank": rng.choice(["", "A"]), "tags": ["t"] * rng.randrange(3), "authors": ["a"] * rng.randrange(3),
        })
    first, at = [], {}
    for r in rows:
        key = r["id"].rsplit("v", 1)[0] if r["id"].startswith("arxiv") else None
        if key in at:
            old = first[at[key]]
            first[at[key]] = (merged(r, old) if completeness(r) > completeness(old) else merged(old, r)) | {"pos": old["pos"]}
            continue
        if key:
            at[key] = len(first)
        first.append(r)
    kept, now = [], {i: r for i, r in enumerate(first)}
    for i, r in enumerate(first):
        led = next((j for j in kept if alike(first[j]["title"], r["title"])), None)
        if led is None:
            kept.append(i)
        elif completeness(r) > completeness(now[led]):
            now[led] = merged(r, now[led]) | {"pos": now[led]["pos"]}
    want = {now[i]["pos"]: now[i] for i in kept}
    got = {r["pos"]: r for r in dedup.deduplicate(frame(spark, *rows)).collect()}
    assert set(got) == set(want) and len(want) < len(first) < len(rows)
    for pos, r in want.items():
        assert {c: got[pos][c] for c in ("id", "title", *FILLED)} == {c: r[c] for c in ("id", "title", *FILLED)}
