"""Exact values on a graph of three topics and four papers."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import topicgraph as G

TOPICS = [
    ("llms", "LLMs", ["large language model", "generation"], ["p1", "p2", "p3"], 9.0, ["p1"], ["p2"], "frontier", ["NLP"], ["transformers"]),
    ("nlp", "NLP", ["language", "generation"], ["p1", "p2"], 7.0, None, None, "intermediate", ["LLMs"], None),
    ("transformers", "Transformers", ["attention"], ["p2", "p3"], 6.0, None, None, "L3", None, None),
]
PAPERS = [
    ("p1", "A Survey of Large Language Models", ["Ada Lovelace", "Grace Hopper"], ["LLMs", "NLP", "Survey"], "ACL 2025", "acl_anthology", 2025, "survey", "L1", 8.9, 8.1),
    ("p2", "Efficient Transformer Reasoning", ["Ada Lovelace"], ["LLMs", "Transformers"], "ICLR 2026", "openreview", 2026, "methods", "L4", 9.2, 6.2),
    ("p3", "Attention Systems", ["Alan Turing"], ["Transformers", "Systems"], "arXiv", "arxiv", 2024, "systems", "advanced", 7.2, 4.3),
    ("p4", "Unrelated Vision Paper", ["Katherine Johnson"], ["Computer Vision"], "CVPR 2024", "cvf", 2024, "benchmark", "L2", 8.0, 5.0),
]


@pytest.fixture(scope="module")
def given(spark):
    topics = spark.createDataFrame(TOPICS, "topic_id string, name string, keywords array<string>, paper_ids array<string>, trend_score double, starter_pack_ids array<string>, frontier_pack_ids array<string>, difficulty string, related_topics array<string>, prerequisites array<string>")
    papers = spark.createDataFrame(PAPERS, "id string, title string, authors array<string>, tags array<string>, venue string, source string, year int, paper_type string, difficulty_level string, paper_score double, read_first_score double")
    return topics, G.memberships(topics), papers


def by_id(edges):
    return {r["edge_id"]: r for r in edges.collect()}


def test_levels_and_sources(spark):
    rows = spark.createDataFrame([("beginner",), ("intermediate",), ("advanced",), ("frontier",), ("L3",), ("unknown",), (None,)], "x string")
    assert [r[0] for r in rows.select(G.level(F.col("x"))).collect()] == ["L1", "L2", "L3", "L4", "L3", "L2", "L2"]
    rows = spark.createDataFrame([("acl_anthology", "x"), (None, "cvf:1"), ("Blog", "y"), (None, None)], "s string, i string")
    assert [r[0] for r in rows.select(G.source_group(F.col("s"), F.col("i"))).collect()] == ["acl", "cvf", "blog", "other"]


def test_topic_topic_weights(given):
    got = by_id(G.topic_topic_edges(given[0], given[1]))
    assert {k: (r["kind"], r["weight"]) for k, r in got.items()} == {
        "edge:topic:llms:nlp": ("topic-topic", 6.33), "edge:topic:llms:transformers": ("prerequisite", 4.67), "edge:topic:nlp:transformers": ("topic-topic", 1.33),
    }
    assert got["edge:topic:llms:nlp"]["explanation"] == "listed as related topics; overlapping papers; overlapping keywords"


def test_topic_paper_weights(given):
    got = by_id(G.topic_paper_edges(*given))
    assert len(got) == 7
    assert (got["edge:topic-paper:llms:p1"]["weight"], got["edge:topic-paper:llms:p1"]["explanation"]) == (1.5, "Paper is part of this topic starter path.")
    assert (got["edge:topic-paper:llms:p2"]["weight"], got["edge:topic-paper:llms:p2"]["evidence"]) == (1.7, ["frontier paper"])
    assert (got["edge:topic-paper:nlp:p1"]["weight"], got["edge:topic-paper:nlp:p1"]["explanation"]) == (1.0, "Paper belongs to this topic.")


def test_paper_paper_weights_and_evidence(given):
    got = by_id(G.paper_paper_edges(given[2], given[1]))
    assert {k: r["weight"] for k, r in got.items()} == {"edge:paper:p1:p2": 10.2, "edge:paper:p1:p3": 3.3, "edge:paper:p2:p3": 7.7}
    first = got["edge:paper:p1:p2"]["evidence"]
    assert first[1:] == ["shared tags: llms", "shared authors: ada lovelace", "published in a close year window"]
    assert set(first[0].removeprefix("shared topics: ").split(", ")) == {"llms", "nlp"}


def test_whole_graph(given):
    topics, papers = G.select_inputs(*given, max_topics=3, max_papers=3)
    assert [r["id"] for r in papers.collect()] == ["p2", "p1", "p3"]
    nodes, edges = G.nodes(topics, given[1], papers), G.edges(topics, given[1], papers, density="dense")
    row = G.summary(nodes, edges).first().asDict()
    assert row == {"n_topics": 3, "n_papers": 3, "n_edges": 13, "n_topic_paper": 7, "n_topic_topic": 3, "n_paper_paper": 3}
    off = G.edges(topics, given[1], papers, relations=frozenset({"topic-topic"}))
    assert {r["kind"] for r in off.collect()} == {"topic-topic"}
    assert G.edges(topics, given[1], papers, relations=frozenset()).count() == 0


def test_filters(given):
    _, papers = G.select_inputs(*given, difficulty="all", source="openreview", year_min=2025, paper_type="methods", min_paper_score=9, paper_query="transformer")
    assert [r["id"] for r in papers.collect()] == ["p2"]
    topics, papers = G.select_inputs(*given, topic_query="attention")
    assert [r["topic_id"] for r in topics.collect()] == ["transformers"] and sorted(r["id"] for r in papers.collect()) == ["p2", "p3"]
    topics, papers = G.select_inputs(*given, topic_query="nothing")
    assert topics.count() == papers.count() == 0
