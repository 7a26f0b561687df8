import gzip
import json

import pytest

from paperloom.sinks import tables
from paperloom.sources import landing
from paperloom.streaming import events as streaming

BIB = """@inproceedings{2024.acl-long.1,
    title = "{G}raphs and \\'Etudes",
    author = "Doe, Jane  and
      Roe, Max",
    year = "2024",
    booktitle = {Proc. {ACL}},
    url = "https://aclanthology.org/2024.acl-long.1"
}
@article{J99-1001,
    title = {Old one},
    author = {A B},
    year = {1999}
}
@misc{2024.ws-1.1,
    title = {Workshop},
    year = {2024}
}
"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom">
<entry><id>http://arxiv.org/abs/2401.00001v1</id><title>A
 title</title><summary>Some text.</summary><published>2024-01-02T00:00:00Z</published><author><name>Jane Doe</name></author><author><name>Max Roe</name></author>
<category term="cs.CL"/><category term="cs.LG"/><link href="http://arxiv.org/abs/2401.00001v1" type="text/html"/><link href="http://arxiv.org/pdf/2401.00001v1" type="application/pdf"/></entry>
<entry><id>http://arxiv.org/abs/2401.00002v1</id><title>Physics</title><summary>x</summary><published>2024-01-02T00:00:00Z</published><author><name>A</name></author><category term="hep-th"/><link href="h" type="text/html"/></entry>
</feed>"""


def test_bibtex(spark, tmp_path):
    (tmp_path / "a.bib.gz").write_bytes(gzip.compress(BIB.encode()))
    records = landing.bibtex_records(landing.read_bibtex(spark, str(tmp_path / "a.bib.gz")))
    assert records.count() == 3
    rows = landing.anthology_papers(records).collect()
    assert len(rows) == 1
    assert rows[0]["id"] == "acl:2024.acl-long.1" and rows[0]["venue"] == "ACL" and rows[0]["conference_rank"] == "A*" and rows[0]["authors"] == ["Doe, Jane", "Roe, Max"] and rows[0]["title"].startswith("Graphs and")


def test_atom(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ATOM)
    rows = landing.read_atom(spark, str(tmp_path / "a.xml")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["id"], r["title"], r["year"], r["tags"]) == ("arxiv:2401.00001v1", "A title", 2024, ["NLP", "Machine Learning"])
    assert r["pdf_url"].endswith("/pdf/2401.00001v1") and r["authors"] == ["Jane Doe", "Max Roe"]


def test_records_and_notes(spark):
    recs = [{"paperId": "1", "title": "T", "year": 2023, "venue": "KDD", "citationCount": 3, "authors": [{"name": "A", "affiliations": ["X", "Y"]}, {"name": "B", "affiliations": ["X"]}], "externalIds": {"DOI": "10.1/2"}, "fieldsOfStudy": list("abcde")}, {"paperId": "2", "title": ""}]
    df = spark.createDataFrame([(json.dumps(r),) for r in recs], "value string").selectExpr(f"from_json(value, '{landing.RECORD}') as r").select("r.*")
    rows = landing.record_papers(df).collect()
    assert len(rows) == 1 and rows[0]["affiliations_raw"] == ["X", "Y"] and rows[0]["paper_url"] == "https://doi.org/10.1/2" and rows[0]["tags"] == list("abcd")
    notes = [{"id": "n1", "content": {"title": {"value": "New"}, "abstract": "plain", "authors": {"value": ["A"]}}}, {"id": "n2", "content": {"title": ""}}]
    got = landing.note_papers(spark.createDataFrame([(json.dumps(n),) for n in notes] + [("not json",)], "value string"), "ICLR", "A*", 2024).collect()
    assert [(r["id"], r["title"], r["abstract"], r["authors"]) for r in got] == [("openreview:n1", "New", "plain", ["A"])]


def test_listing(spark):
    html = '<div class="paper"><p class="title">One <b>two</b></p><p class="details"><span class="authors">A B, C D</span></p><a href="http://x/y.html">abs</a></div><div class="paper"><p class="title"></p></div>'
    rows = landing.listing_papers(spark.createDataFrame([(html,), (None,)], "html string")).collect()
    assert [(r["title"], r["authors"], r["href"]) for r in rows] == [("One two", ["A B", "C D"], "http://x/y.html")]


def test_rolling_store(spark):
    rows = spark.createDataFrame([("a", "arXiv", "2026-05-01"), ("b", "arXiv", "2020-01-01"), ("c", "ICML", "2026-05-01"), ("d", None, ""), ("e", "", None)], "id string, venue string, published_date string")
    assert sorted(r["id"] for r in landing.recent(rows, "2026-06-01").collect()) == ["a", "d", "e"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3), (None, "d", 4)], "k int, v string, o int")
    assert {r["v"] for r in tables.first_per_key(rows, "k", "o").collect()} == {"a", "c"}
    assert {r["v"] for r in tables.last_per_key(rows, "k", "o").collect()} == {"b", "c"}
    base = spark.createDataFrame([(1, "old", 0), (3, "stay", 0)], "k int, v string, o int")
    assert sorted(r["v"] for r in tables.upsert(base, rows, "k", "o").collect()) == ["a", "c", "stay"]
    assert tables.delete(base, rows, "k").count() == 1
    assert tables.write_json(base, f"{tmp_path}/out") == "ok"
    with pytest.raises(ValueError):
        tables.write_json(base, f"{tmp_path}/more", limit=10)


def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    want = sorted(map(tuple, streaming.windowed_counts(events).collect()))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    counts = streaming.windowed_counts(stream)
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == want
    held = {"df": events.limit(0).select("event_id", "event_type", "ts")}
    q = streaming.upsert_stream(stream.select("event_id", "event_type", "ts"), lambda: held["df"], lambda df: held.update(df=spark.createDataFrame(df.collect(), df.schema)), "event_id", "ts", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert held["df"].count() == events.select("event_id").distinct().count()
