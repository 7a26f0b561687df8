"""Landed harvests: chains of pages, streams that are stopped and go on, broken ones."""

import json
from urllib.parse import quote

import pytest

from paperloom.sources import paged

OAI = '<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/">{}</OAI-PMH>'


def oai_record(i, cats="cs.CL math.CO", status=""):
    head = f'<header{status}><identifier>oai:x:{i}</identifier></header>'
    if status:
        return f"<record>{head}</record>"
    return f"""<record>{head}<metadata><arXiv xmlns="http://arxiv.org/OAI/arXiv/"><id>2401.{i:05}</id><created>2024-01-0{1 + i % 9}</created><title>Title {i} &amp; more</title><abstract>Text
      of {i}</abstract><categories>{cats}</categories><authors><author><keyname>Moreau</keyname><forenames>Ada</forenames></author><author><keyname>Stein</keyname></author></authors></arXiv></metadata></record>"""


def land(folder, number, token, body, kind="json"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{number:08}~{quote(token, safe='')}.{kind}").write_text(body)


def oai_page(records, token):
    return OAI.format(f"<ListRecords>{''.join(records)}<resumptionToken>{token}</resumptionToken></ListRecords>")


def drain(spark, df, out, checkpoint):
    df.writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{checkpoint}").trigger(availableNow=True).start().awaitTermination(120)
    return sorted(r[0] for r in spark.read.parquet(f"file://{out}").select("value" if "value" in df.columns else "id").collect())


def test_harvested_papers(spark, tmp_path):
    day = tmp_path / "in" / "cs"
    land(day, 0, "", oai_page([oai_record(1), oai_record(2, cats="math.CO"), oai_record(3, status=' status="deleted"')], "t/1|a"), "xml")
    land(day, 1, "t/1|a", oai_page([oai_record(4)], ""), "xml")
    land(tmp_path / "in" / "empty", 0, "", OAI.format("<ListRecords/>"), "xml")
    rows = {r["id"]: r for r in paged.CONNECTORS["arxiv"].papers(spark, f"file://{tmp_path}/in").collect()}
    assert set(rows) == {"arxiv:2401.00001", "arxiv:2401.00004"}
    one = rows["arxiv:2401.00001"]
    assert (one["title"], one["abstract"], one["authors"], one["year"], one["tags"]) == ("Title 1 & more", "Text of 1", ["Ada Moreau", "Stein"], 2024, ["NLP"])


@pytest.mark.parametrize("protocol", ["oai", "notes", "bulk"])
def test_a_stopped_stream_goes_on_and_reads_each_record_once(spark, tmp_path, protocol):
    source, n, last = tmp_path / "in", 3, 5

    def put(harvest, page):
        token = lambda p: "" if p == 0 else str(p * n) if protocol == "notes" else f"{harvest}+{p}/="
        ids, end = [f"{harvest}-{page * n + i}" for i in range(n if page < last else 1)], page == last
        following = "" if end else token(page + 1)
        if protocol == "oai":
            land(source / harvest, page, token(page), oai_page([f"<record><header><identifier>{i}</identifier></header></record>" for i in ids], following), "xml")
        else:
            land(source / harvest, page, token(page), json.dumps({"notes": [{"id": i} for i in ids]} if protocol == "notes" else {"data": [{"paperId": i} for i in ids], "token": following or None}))

    def seen():
        stream = paged.records(spark, f"file://{source}", protocol, stream=True, page_size=str(n))
        return drain(spark, stream, tmp_path / "out", tmp_path / "checkpoint")

    put("a", 0)
    put("a", 1)
    assert len(seen()) == 2 * n
    assert len(seen()) == 2 * n  # nothing new
    for page in (2, 3):
        put("a", page)
    put("a", 5)  # page 4 is missing yet
    put("b", 0)
    assert len(seen()) == 5 * n
    put("a", 4)
    rows = seen()
    assert len(rows) == len(set(rows)) == 6 * n + 1
    whole = paged.records(spark, f"file://{source}", protocol, page_size=str(n))
    assert sorted(r["value"] for r in whole.collect()) == rows
    assert {(r["harvest"], r["page"]) for r in whole.collect()} == {("a", p) for p in range(6)} | {("b", 0)}


def test_notes_and_bulk_records_become_papers(spark, tmp_path):
    land(tmp_path / "n" / "v", 0, "", json.dumps({"notes": [{"id": "n1", "content": {"title": {"value": "A"}, "authors": ["x"]}}, {"id": "n2", "content": {}}]}))
    got = paged.CONNECTORS["openreview"].papers(spark, f"file://{tmp_path}/n", venue="ICLR", rank="A*", year=2025).collect()
    assert [(r["id"], r["title"], r["venue"], r["year"]) for r in got] == [("openreview:n1", "A", "ICLR", 2025)]
    land(tmp_path / "b" / "v", 0, "", json.dumps({"data": [{"paperId": "p", "title": "T", "year": 2020, "externalIds": {"DOI": "10.1/x"}}, {"paperId": "q"}]}))
    got = paged.CONNECTORS["s2"].papers(spark, f"file://{tmp_path}/b").collect()
    assert [(r["id"], r["paper_url"]) for r in got] == [("s2:p", "https://doi.org/10.1/x")]


def broken(spark, path, protocol, stream=False):
    with pytest.raises(Exception) as e:
        if stream:
            drain(spark, paged.records(spark, f"file://{path}", protocol, stream=True), path.parent / "o", path.parent / "c")
        else:
            paged.records(spark, f"file://{path}", protocol).collect()
    return str(e.value)


def test_errors_and_broken_chains_fail(spark, tmp_path):
    land(tmp_path / "e" / "x", 0, "", OAI.format('<error code="badResumptionToken">gone</error>'), "xml")
    assert "badResumptionToken: gone" in broken(spark, tmp_path / "e", "oai")
    assert "badResumptionToken: gone" in broken(spark, tmp_path / "e", "oai", stream=True)
    land(tmp_path / "m" / "x", 0, "", json.dumps({"message": "too many requests"}))
    assert "too many requests" in broken(spark, tmp_path / "m", "bulk")
    land(tmp_path / "s" / "x", 0, "", json.dumps({"data": [], "token": "t1"}))
    land(tmp_path / "s" / "x", 1, "t2", json.dumps({"data": []}))
    assert "'t2' follows" in broken(spark, tmp_path / "s", "bulk")
    land(tmp_path / "l" / "x", 0, "", json.dumps({"data": []}))
    land(tmp_path / "l" / "x", 1, "t", json.dumps({"data": []}))
    assert "pages follow the last one" in broken(spark, tmp_path / "l", "bulk")
    land(tmp_path / "f" / "x", 0, "t", json.dumps({"data": []}))
    assert "first page was asked for with a token" in broken(spark, tmp_path / "f", "bulk")
    # The page before was read by an earlier batch.
    land(tmp_path / "g" / "x", 0, "", json.dumps({"data": [], "token": "t1"}))
    assert drain(spark, paged.records(spark, f"file://{tmp_path}/g", "bulk", stream=True), tmp_path / "go", tmp_path / "gc") == []
    land(tmp_path / "g" / "x", 1, "t9", json.dumps({"data": [{"paperId": "p"}]}))
    with pytest.raises(Exception, match="the next page is 't1', but 't9' follows"):
        drain(spark, paged.records(spark, f"file://{tmp_path}/g", "bulk", stream=True), tmp_path / "go", tmp_path / "gc")
    land(tmp_path / "d" / "x", 0, "", json.dumps({"data": []}))
    land(tmp_path / "d" / "x", 0, "u", json.dumps({"data": []}))
    assert "two pages of one number" in broken(spark, tmp_path / "d", "bulk")
    assert "protocol must be one of" in broken(spark, tmp_path / "d", "none")


def test_a_folder_without_pages(spark, tmp_path):
    (tmp_path / "in" / "x").mkdir(parents=True)
    (tmp_path / "in" / "x" / "readme.txt").write_text("no page")
    assert paged.records(spark, f"file://{tmp_path}/in", "bulk").count() == 0
