"""Counts of terms and pairs keep the rare ones and leave out stop words; held against plain Python."""

import re
from collections import Counter

from paperloom import queries as library
from paperloom.functions.dialect import Spark
from paperloom.rules.tables import STOP_WORDS
from paperloom.sources.corpus import papers


def test_rare_terms_and_pairs_are_counted(spark, tmp_path):
    texts = ["solitary word pair here", "other other words", None, "solitary again"]
    spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    terms, pairs = Counter(), Counter()
    for r in spark.sql(papers(Spark(str(tmp_path)))).collect():
        ws = [w for w in re.findall(r"[a-zA-Z][a-zA-Z0-9+-]{2,}", f"{r['title']} {r['abstract']}".lower()) if len(w) <= 32 and w not in STOP_WORDS]
        terms.update((r["venue"], w) for w in ws)
        pairs.update((r["venue"], f"{a} {b}") for a, b in zip(ws, ws[1:]) if a != b)
    run = library.queries()
    assert {(r["venue"], r["term"]): r["n"] for r in run["term_counts"](spark, str(tmp_path)).collect()} == terms
    assert {(r["venue"], r["g"]): r["n"] for r in run["bigram_counts"](spark, str(tmp_path)).collect()} == pairs
