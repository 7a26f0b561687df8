"""Keywords, phrases and fits of venues against plain Python; exact points of whole and partial matches."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperloom.operators import recommend as O
from paperloom.rules import tables as R

PAPERS = [
    ("A", 1, "Graph mining finds graph mining gems", ["Graph Mining", " NLP ", ""]),
    ("A", 2, "graph mining again; gems, gems and gems in large-scale causal graphs", None),
    ("A", 3, None, ["x", "Very " * 12 + "Long Tag"]),
    ("B", 1, "", []),
    (None, 1, "nobody reads this", ["Tag"]),
    ("C", 1, "Translation of dialogue by language agents " + "word" * 9, ["Dialogue"]),
]
SCHEMA = "venue string, rank int, text string, tags array<string>"


def words(text):
    return [w for w in re.findall(r"[a-z][a-z0-9+-]{2,}", (text or "").lower()) if len(w) <= 32 and w not in R.STOP_WORDS]


def plain_keywords(rows, field):
    phrases, terms = Counter(), Counter()
    for text, tags in rows:
        ws, tagged = words(text), []
        for t in tags or []:
            t = t.strip().lower()
            if t:
                phrases[t] += 3
                tagged += words(t)
        phrases.update(f"{a} {b}" for a, b in zip(ws, ws[1:]) if a != b)
        terms.update(ws + tagged)
    found = sorted(R.VENUE_HINTS[field]) + [p for p, _ in phrases.most_common(45) if 3 <= len(p) <= 56] + [t for t, _ in terms.most_common(55)]
    return list(dict.fromkeys(found))[:85]


def test_keywords_in_order(spark):
    papers = spark.createDataFrame(PAPERS, SCHEMA)
    fields = O.venue_fields(papers)
    assert {r["venue"]: r["field"] for r in fields.collect()} == {"A": "DM", "B": "ML", "C": "NLP"}
    got = {}
    for r in O.derived_keywords(papers, fields).orderBy("venue", "place").collect():
        got.setdefault(r["venue"], []).append(r["term"])
    for venue, field in (("A", "DM"), ("B", "ML"), ("C", "NLP")):
        assert got[venue] == plain_keywords([(t, g) for v, _, t, g in PAPERS if v == venue], field)
    assert set(got) == {"A", "B", "C"}
    assert O.derived_keywords(papers.limit(0), fields.limit(0)).count() == 0


def test_profiles_are_filled_up(spark):
    weights = spark.createDataFrame([("A", "graph", 1.0), ("A", "gems", 0.5)], "venue string, term string, weight double")
    keywords = spark.createDataFrame([("A", 1, "gems"), ("A", 2, "mining"), ("A", 3, "tree"), ("B", 1, "lone")], "venue string, place int, term string")
    rows = [tuple(r) for r in O.profiles(weights, keywords).orderBy("venue", "place").collect()]
    assert rows == [("A", 1, "graph", 1.0), ("A", 2, "gems", 0.5), ("A", 3, "mining", 0.2), ("A", 4, "tree", 0.2), ("B", 1, "lone", 0.35)]


def test_points_of_whole_and_partial_phrases(spark):
    profile = spark.createDataFrame([("A", 1, "graph mining", 1.0), ("A", 2, "gems", 0.5), ("A", 3, "very deep trees", 0.3), ("A", 4, "of", 1.0), ("B", 1, "graph theory", 0.5), ("C", 1, "none here", 1.0)], "venue string, place int, term string, weight double")
    drafts = spark.createDataFrame([(1, ["graph", "mining", "gems", "deep", "graph"]), (2, []), (3, None)], "draft int, words array<string>")
    got = {(r["draft"], r["venue"]): (r["overlap"], r["matched"]) for r in O.overlaps(drafts, profile).collect()}
    assert got == {(1, "A"): (round(18 + 6 + 0.3 * 4 / 3, 6), ["graph mining", "gems"]), (1, "B"): (1.0, [])}


@pytest.mark.parametrize("stage,rank,points", [("any", "A*", 0), ("early", "A*", -5), ("early", "A", 0), ("solid", None, 3), ("solid", "A*", 3), ("mature", "A*", 3), ("mature", "", 0), (None, "A*", 0)])
def test_maturity(spark, stage, rank, points):
    row = spark.createDataFrame([(stage, rank)], "stage string, rank string")
    assert row.select(O.maturity(F.col("stage"), F.col("rank"))).first()[0] == points


LONG = " ".join(f"{w}{i}x" for i, w in enumerate(["graph", "mining", "query", "gems"] * 10))


def test_verdicts(spark):
    texts = {"short": "too short", None: "too short", f"{LONG} Lorem  Ipsum": "placeholder", f"{LONG} " + "todo tbd dummy " * 10: "placeholder", "word here " * 40: "too few details", LONG: "ok"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", O.verdict(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == texts


def test_fits_are_ranked_with_their_parts(spark):
    profile = spark.createDataFrame([("A", 1, "graph0x mining1x", 1.0), ("B", 1, "graph0x other", 1.0), ("C", 1, "gems3x", 0.9)], "venue string, place int, term string, weight double")
    venues = spark.createDataFrame([("A", "ML", "A*"), ("B", "ML", None), ("C", "NLP", "A")], "venue string, field string, rank string")
    drafts = spark.createDataFrame([(1, LONG, "auto", "early"), (2, LONG, "any", "solid"), (3, "short", "any", "any"), (4, LONG, "NLP", None)], "draft int, text string, field string, stage string")
    got = [tuple(r)[:3] + (r["score"], r["fit"]) for r in O.recommend(drafts, venues, profile).orderBy("draft", "place").collect()]
    assert got == [
        (1, 1, "A", 23.0, "Moderate fit"), (1, 2, "C", 6.8, "Stretch fit"),
        (2, 1, "A", 23.0, "Moderate fit"), (2, 2, "C", 13.8, "Stretch fit"),
        (4, 1, "C", 18.8, "Moderate fit"), (4, 2, "A", 16.0, "Moderate fit"),
    ]


def test_bars(spark):
    row = spark.createDataFrame([(8.0, 16.0), (-4.0, 16.0), (20.0, 16.0), (0.5, 0.0)], "v double, top double")
    assert [r[0] for r in row.select(O.bars(F.col("v"), F.col("top"))).collect()] == [50, 0, 100, 50]
