"""Arrays in scripts of pages, with quotes, comments and brackets in all places."""

import pytest

from paperloom.sources import embedded as E

PAGE = r"""<html><script>const OTHER = [{short: 'no'}];
const DEADLINES = [ // first [ of all
  { name: 'A "quoted" [one] {two}', short: "ACL", confirmed: true, tags: ['x', 'y'], /* gone: 'no', } */ location: 'St. John\'s, key: "z"' },
  { name: "It's // here", short: ' acl ', area: 'NLP', area: 'CL', meta: { rank: 'A*' }, year: 2026 },
  { short: '' , name: 'nameless' },
  { short: 'ICML', confirmed: false }
]; const AFTER = [{short: 'late'}];</script></html>"""


def test_objects_in_order():
    found = list(E.objects(PAGE, "DEADLINES"))
    assert found == [
        {"name": 'A "quoted" [one] {two}', "short": "ACL", "confirmed": "true", "location": "St. John's, key: \"z\""},
        {"name": "It's // here", "short": " acl ", "area": "CL", "rank": "A*", "year": "2026"},
        {"short": "", "name": "nameless"},
        {"short": "ICML", "confirmed": "false"},
    ]
    assert list(E.objects("const DEADLINES = nothing", "DEADLINES")) == list(E.objects("", "DEADLINES")) == []
    assert list(E.objects("const DEADLINES = [{short: 'cut'", "DEADLINES")) == []


def test_pages_to_rows(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "const DEADLINES = [{short: 'ICML', name: 'newer'}]"), (3, None), (4, "none")], "page_id int, html string")
    rows = E.embedded(pages, "DEADLINES")
    assert rows.columns == ["page_id", "at", "key", "value"]
    assert rows.groupBy("page_id").count().orderBy("page_id").collect() == [(1, 13), (2, 2)]
    got = {r["id"]: r["fields"] for r in E.by_key(rows, "page_id").collect()}
    assert set(got) == {"acl", "icml"}
    assert got["acl"]["area"] == "CL" and got["icml"] == {"short": "ICML", "name": "newer"}
    assert E.embedded(pages.limit(0), "DEADLINES").count() == 0
    with pytest.raises(ValueError):
        E.embedded(pages.withColumnRenamed("page_id", "key"), "DEADLINES")
