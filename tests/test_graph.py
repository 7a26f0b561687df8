"""The caps of the graph against one edge after the other."""

import random

import pytest

from paperloom.operators import topicgraph as G
from paperloom.operators.graph import limit_edges, matching

from .test_topicgraph import given  # noqa: F401

SCHEMA = "edge_id string, kind string, source string, target string, weight double, extra string"


def greedy(edges, max_edges, per_paper):
    used, kept = {}, []
    for e in sorted(edges, key=lambda e: (-e[4], e[0])):
        if len(kept) >= max_edges:
            break
        if e[1] == "paper-paper":
            if used.get(e[2], 0) >= per_paper or used.get(e[3], 0) >= per_paper:
                continue
            used[e[2]], used[e[3]] = used.get(e[2], 0) + 1, used.get(e[3], 0) + 1
        kept.append(e[0])
    return set(kept)


def check(spark, edges, max_edges, per_paper):
    got = {r["edge_id"] for r in limit_edges(spark.createDataFrame(edges, SCHEMA), max_edges, per_paper).collect()}
    assert got == greedy(edges, max_edges, per_paper)
    return got


def edge(i, a, b, weight, kind="paper-paper"):
    return (f"e{i:05}", kind, f"paper:{a}", f"paper:{b}", weight, "x")


@pytest.mark.parametrize("seed, papers, n, per_paper, max_edges", [(1, 12, 60, 3, 1000), (2, 40, 400, 5, 90), (3, 9, 36, 1, 1000), (4, 30, 300, 2, 25)])
def test_equals_one_edge_after_the_other(spark, seed, papers, n, per_paper, max_edges):
    rng = random.Random(seed)
    pairs = rng.sample([(a, b) for a in range(papers) for b in range(a)], n)
    edges = [edge(i, a, b, rng.choice([1.0, 2.0, 2.5, 4.0])) for i, (a, b) in enumerate(pairs)]
    edges += [(f"t{i:05}", "topic-paper", "topic:x", f"paper:{i % papers}", rng.choice([1.0, 1.5, 2.2]), "x") for i in range(30)]
    assert len(check(spark, edges, max_edges, per_paper)) < len(edges)


def test_a_hub_and_a_chain(spark):
    hub = [edge(i, "hub", i, float(i)) for i in range(300)]
    assert len(check(spark, hub, 1000, 4)) == 4
    chain = [edge(i, i, i + 1, 20.0 - i) for i in range(12)]
    assert len(check(spark, chain, 1000, 1)) == 6


def test_caps_over_all_kinds(spark):
    edges = [edge(1, "a", "b", 9.0), edge(2, "a", "c", 8.0), edge(3, "a", "d", 7.0), edge(4, "x", "a", 1.0, "topic-paper")]
    assert check(spark, edges, 2, 1) == {"e00001", "e00004"}
    assert check(spark, edges, 0, 1) == set()
    assert check(spark, edges, 9, 0) == {"e00004"}
    assert check(spark, edges[:1], 9, 1) == {"e00001"}
    none = spark.createDataFrame([], SCHEMA)
    assert limit_edges(none).count() == matching(none, 3).count() == 0


def test_assembled_graph(given):  # noqa: F811
    graph = G.assemble(*given, max_topics=3, max_papers=2, density="dense", per_paper=1, max_edges=6)
    row = graph.stats.first().asDict()
    assert row == {"n_topics": 3, "n_papers": 2, "n_edges": 6, "n_topic_paper": 2, "n_topic_topic": 3, "n_paper_paper": 1, "n_hidden_papers": 1, "n_hidden_edges": 3}
    assert [r["edge_id"] for r in graph.edges.collect()] == sorted(r["edge_id"] for r in graph.edges.collect())
    assert {r["node_id"] for r in graph.nodes.collect()} == {"topic:llms", "topic:nlp", "topic:transformers", "paper:p1", "paper:p2"}


def test_nothing_passes_the_filters(given):  # noqa: F811
    graph = G.assemble(*given, topic_query="nothing")
    assert set(graph.stats.first().asDict().values()) == {0} and graph.edges.count() == graph.nodes.count() == 0
    hidden = G.assemble(*given, show_papers=False)
    assert hidden.stats.first()["n_papers"] == 0 and hidden.stats.first()["n_hidden_papers"] == 3
    assert {r["kind"] for r in hidden.edges.collect()} == {"topic-topic", "prerequisite"}
