import math
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm import urls

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
    rule = max(fits, key=len, default=None)
    return host, path, rule


def test_rules_and_model(spark):
    given = [
        None, "", "no-scheme.org/x", "http://example.org/es/1", "https://WWW.Example.ORG/en/12?q#f", "http://a.com/fr/", "http://a.com/de/x", "http://org/x", "http://x.org",
        "http://x.org?y", "http://xorg/", "http://ÉX.com/fr/é", "ftp://u@h.com:80/de/", "http://example.org/en/2", "http://cheap-pills.example.net/en/9", "http://library.example.net/en/9", "://", "http:///p", "a://b://c/d",
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(given)], "page_id long, url string, host string, rule string")
    pages = pages.union(pages.where("page_id < 3"))
    got = urls.filter_urls(pages, urls.train(urls.labelled_urls(spark))).collect()
    assert len(got) == len(given) + 3
    for r in got:
        host, path, rule = brute(given[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), given[r["page_id"]]
        assert r["verdict"] == (RULES[rule] if rule else "block" if r["score"] > 0.5 else "allow")
    verdicts = {given[r["page_id"]]: r["verdict"] for r in got}
    assert verdicts["http://cheap-pills.example.net/en/9"] == "block" and verdicts["http://library.example.net/en/9"] == "allow"
    assert verdicts[None] == "allow"


def test_empty(spark):
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), [0.0] * (urls.BUCKETS + 1)).count() == 0


def grams(url):
    host, path, _ = brute(url)
    found = set()
    for mark, text in (("h", host), ("p", path)):
        whole = f"^{text}$" if text else ""
        found |= {zlib.crc32((mark + whole[i : i + 3]).encode()) % urls.BUCKETS for i in range(max(1, len(whole) - 2) if text else 0)}
    return sorted(found)


def descent(rows, epochs):
    w = [0.0] * urls.BUCKETS + [math.log(urls.BASE_RATE / (1 - urls.BASE_RATE))]
    for _ in range(epochs):
        for _, _, y, g in sorted((zlib.crc32(u.encode()), u, y, grams(u)) for u, y in rows if y is not None and grams(u)):
            x = 1 / math.sqrt(len(g))
            e = y - 1 / (1 + math.exp(-(sum(w[b] for b in g) * x + w[-1])))
            for b in g:
                w[b] = w[b] * (1 - urls.SHRINK) + urls.RATE * e * x
    return w


def test_training_equals_a_plain_descent(spark):
    rows = [("http://abc.example/x", 1.0), ("http://abd.example/y", 0.0), ("http://q.example", 1.0), ("http://q.example", 1.0), ("none", 1.0), ("http://null.example/", None)]
    labelled = spark.createDataFrame(rows, "url string, blocked double")
    got, want = urls.train(labelled, 4), descent(rows, 4)
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-12
    one_class = urls.train(labelled.where("blocked = 1"), 2)
    assert len(one_class) == urls.BUCKETS + 1
    none = urls.train(labelled.limit(0))
    assert none == [0.0] * urls.BUCKETS + [want[-1]]
    pages = [(i, u) for i, (u, _) in enumerate(rows)]
    for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), got, []).collect():
        g = grams(rows[r["page_id"]][0])
        z = sum(want[b] for b in g) / math.sqrt(max(len(g), 1)) + want[-1]
        assert abs(r["score"] - (1 / (1 + math.exp(-z)) if g else 0.0)) < 1e-9


def test_too_many_labels_are_refused(spark):
    many = spark.range(urls.MAX_LABELLED + 1).selectExpr("concat('http://h', id, '.example/') AS url", "1.0 AS blocked")
    with pytest.raises(ValueError):
        urls.train(many)


def test_model_on_its_rows_and_on_rows_held_out(spark):
    labelled = urls.labelled_urls(spark).cache()
    fold = F.crc32("url") % 5

    def judged(rows, weights):
        got = urls.filter_urls(rows.select(F.col("blocked").cast("long").alias("page_id"), "url"), weights, [])
        n = {(r["page_id"], r["verdict"]): r["count"] for r in got.groupBy("page_id", "verdict").count().collect()}
        hit, missed, wrong = (n.get(k, 0) for k in ((1, "block"), (1, "allow"), (0, "block")))
        return hit / (hit + missed), hit / max(1, hit + wrong)

    recall, precision = judged(labelled, urls.train(labelled))
    assert recall > 0.95 and precision > 0.95
    recall, precision = zip(*(judged(labelled.where(fold == k), urls.train(labelled.where(fold != k))) for k in range(5)))
    assert sum(recall) / 5 > 0.6 and sum(precision) / 5 > 0.8
