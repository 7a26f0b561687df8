"""Queries against the same tables in DuckDB; one of each family here, all of them by the driver."""

import math

import duckdb
import pytest

from paperloom import queries as library

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "events", "customer", "orders", "nation", "pages"]
SOME = ["papers_view", "tag_supersede", "difficulty", "paper_score", "content_tweet", "topic_agg", "topic_starter_pack", "gap_union_dedup", "author_agg", "author_momentum", "lab_momentum", "stats_by_dimension", "browse_filter_page", "potd", "dedup_exact_best", "dedup_title_pairs", "dedup_papers", "library_toggle", "tfidf_profile", "graph_topic_topic", "upsert_latest", "anti_join", "venue_status", "recommend_venues", "venue_keywords", "venue_fits", "venue_index", "decode_papers", "embedded_venues", "similar_papers", "gap_browse", "graph_inputs", "html_parse", "event_windows"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", SOME)
def test_equals_duckdb(spark, duck, name):
    df = library.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(library.oracle_sql()[name])
    names = [x[0] for x in found.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert sorted(names) == cols
    assert got == want


def test_every_query_has_its_sql():
    assert set(library.queries()) == set(library.oracle_sql())


def test_entry_imports_and_lists():
    import __spark_entry__ as entry

    assert set(library.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
