"""The index of venues by exact rows; one that doesn't hold is refused with counts and leaves the old one."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from paperloom.operators import venueindex as V

PAPERS = "venue string, rank int, n int, id string, title string, abstract string, text string, tags array<string>, year int, paper_url string, paper_type string, conference_rank string"
DUE = "short string, name string, area string, rank string, paper_deadline string"


def paper(venue, rank, n, kind="methods", stars="A*"):
    return (venue, rank, n, f"{venue}{rank}", f"t{rank}", "x" * 300, "gems gems graph tree graph gems", ["a"] * 8, 2020, "u", kind, stars)


def built(spark):
    rows = [paper("Big Venue", i, 20, "new_kind" if i > 4 else "", "A*" if i < 9 else "") for i in range(1, 21)] + [paper("few", 1, 1)] + [paper("Due", 1, 1, "", "")]
    papers = spark.createDataFrame(rows, PAPERS)
    fields = spark.createDataFrame([("Big Venue", "CV"), ("Due", "ML")], "venue string, field string")
    profile = spark.createDataFrame([("Big Venue", 2, "b", 0.5), ("Big Venue", 1, "a", 1.0), ("Due", 1, "d", 0.35)], "venue string, place int, term string, weight double")
    due = spark.createDataFrame([("due", " Due Days 2026", "NLP", "A", "2026-01-01"), ("none", "n", "ML", "", None)], DUE)
    return V.build(papers, fields, profile, due)


def test_rows(spark):
    rows = {r["short"]: r.asDict(True) for r in built(spark).collect()}
    assert set(rows) == {"Big Venue", "Due"}
    big, due = rows["Big Venue"], rows["Due"]
    assert (big["id"], big["name"], big["field"], big["rank"], big["paper_count"], big["keywords"], big["deadline"]) == ("big-venue", "Big Venue", "CV", "A*", 20, ["a", "b"], None)
    assert big["weighted_keywords"] == [{"term": "a", "weight": 1.0}, {"term": "b", "weight": 0.5}]
    assert len(big["expectations"]) == 4 and big["expectations"][3] == "Recent accepted papers skew toward new kind; make that contribution type explicit."
    assert [p["title"] for p in big["accepted_papers"]] == [f"t{i}" for i in range(1, 19)]
    assert big["accepted_papers"][0] | {"abstract": ""} == {"id": "Big Venue1", "title": "t1", "year": 2020, "url": "u", "tags": ["a"] * 6, "abstract": "", "terms": ["gems", "graph", "tree"]}
    assert len(big["accepted_papers"][0]["abstract"]) == 260
    assert (due["name"], due["field"], due["rank"], due["deadline"]["paper_deadline"], len(due["expectations"])) == ("Due Days", "NLP", "A", "2026-01-01", 3)


def test_written_only_if_it_holds(spark, tmp_path):
    path = f"{tmp_path}/index"
    index = built(spark)
    assert V.write(index, path, least=2) == 2
    held = sorted(json.loads(line)["id"] for f in pathlib.Path(path).glob("*.json") for line in f.read_text().splitlines())
    assert held == ["big-venue", "due"]
    with pytest.raises(ValueError, match="'rows': 2"):
        V.write(index, path)
    broken = index.withColumn("weighted_keywords", F.transform("weighted_keywords", lambda k: k.withField("weight", k["weight"] * 2))).withColumn("keywords", F.array().cast("array<string>")).withColumn("type", F.lit("workshop"))
    with pytest.raises(ValueError) as e:
        V.write(broken, path, least=1)
    assert "'wrong type': 2" in str(e.value) and "'no keywords': 2" in str(e.value) and "'weight not in (0, 1]': 1" in str(e.value)
    assert sorted(json.loads(line)["id"] for f in pathlib.Path(path).glob("*.json") for line in f.read_text().splitlines()) == held
    assert not pathlib.Path(f"{path}.draft").exists()
