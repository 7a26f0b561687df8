"""Queries on papers read the whole text, foreign letters included; held against plain Python."""

import re

import pytest

from paperloom.rules.tables import STOP_WORDS
from paperloom import queries as library
from paperloom.rules import tables as R

FILL = "lorem ipsum dolor sit amet " * 400
TEXTS = {
    1: FILL + "Grün größer: a knowledge graph with text-to-image diffusion at Stanford.",
    2: FILL + "dialogue ñre über ner2 éusc, écot straße",
    3: FILL + "relation extraction by NER, re and “cot”. " + FILL,
    4: "größe año où",
    5: None,
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    rows = [(k, t, len(t or "")) for k, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def rows_of(spark, folder, name):
    return {r["pos"]: r for r in library.queries()[name](spark, folder).collect()}


def papers(spark, folder):
    from paperloom.functions.dialect import Spark
    from paperloom.sources.corpus import papers

    return {r["pos"]: r for r in spark.sql(papers(Spark(folder))).collect()}


def test_abstract_holds_the_whole_text(spark, folder):
    for pos, row in papers(spark, folder).items():
        assert row["abstract"].startswith((TEXTS[pos] or "") + " ")


def test_rules_see_the_whole_text(spark, folder):
    from paperloom.functions.dialect import Spark
    from paperloom.plans.corpus import chain

    got = {r["pos"]: r for r in spark.sql(f"{chain(Spark(folder), 'prestiged')} SELECT pos, title, abstract, tags0, hit_tags, affiliations_raw, institution_prestige FROM prestiged").collect()}
    for row in got.values():
        text = f"{row['title']} {row['abstract']}"
        assert row["hit_tags"] == [t for t, p in R.TAGS if t in row["tags0"] or re.search(p, text, re.I)]
        where = " ".join(row["affiliations_raw"]) or row["abstract"]
        assert row["institution_prestige"] == next((float(s) for s, p in R.INSTITUTIONS if re.search(p, where, re.I)), 0.0)
    assert {"Knowledge Graphs", "Diffusion"} & set(got[1]["hit_tags"])


def test_tokens_come_from_the_whole_text(spark, folder):
    kept = rows_of(spark, folder, "tokenise")
    for pos, row in papers(spark, folder).items():
        words = re.findall(r"[a-zA-Z][a-zA-Z0-9+-]{2,}", f"{row['title']} {row['abstract']}".lower())
        assert kept[pos]["n"] == sum(len(w) <= 32 and w not in STOP_WORDS for w in words)
