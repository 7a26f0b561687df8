"""Queries on the topic graph: the rules run once, into a table that all graph inputs are read from.

The SQL they are held against is written apart from the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialect import DUCK
from ..functions.dialect import quoted as q
from ..operators import topicgraph as G
from ..rules import tables as R
from ..sources.corpus import corpus
from .corpus import AS_OF_YEAR, _topic_sums, chain
from .stage import staged

PACK = 5
RELATED = 5


def scored_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the graph needs of the scored papers, written once."""
    columns = "pos, id, title, tags, authors, venue, source, year, paper_type, difficulty_level, paper_score, read_first_score"
    return staged(spark.sql(f"{chain(corpus(spark, sf_dir), 'scored')} SELECT {columns} FROM scored"), "graph-papers")


def _of(table: dict, tag: Column, otherwise: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[tag], otherwise)


def topic_tables(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics and membership of the tags of papers; a topic's related ones are the five largest others."""
    rows = papers.select("id", "pos", "year", "difficulty_level", "paper_score", "read_first_score", F.explode("tags").alias("tag"))
    recent = F.count(F.when(AS_OF_YEAR - F.col("year") <= 2, 1))
    sums = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), recent.alias("n_recent"))
    base = F.when(F.col("tag").isin(R.TRENDING), 10.0).otherwise(5.0)
    trend = F.round(F.round(F.least(base * F.col("n_recent") / F.col("n") + 0.01 * F.col("n"), F.lit(10.0)), 6), 2)
    # The largest topics other than one are among the first six of all: one row of six names.
    six = sums.orderBy(F.desc("n"), "tag").limit(RELATED + 1).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "tag"))).alias("six"))
    empty = F.array().cast("array<string>")
    topics = sums.join(F.broadcast(six)).select(
        G.slug(F.col("tag")).alias("topic_id"), F.col("tag").alias("name"), _of(R.TOPIC_KEYWORDS, F.col("tag"), F.array(F.lower("tag"))).alias("keywords"),
        F.slice(F.filter(F.col("six.tag"), lambda t: t != F.col("tag")), 1, RELATED).alias("related_topics"), _of(R.PREREQUISITES, F.col("tag"), empty).alias("prerequisites"),
        _of(R.TOPIC_LEVELS, F.col("tag"), F.lit("L2")).alias("difficulty"), trend.alias("trend_score"),
    )

    def pack(levels: list[str], score: str) -> Column:
        order = Window.partitionBy("tag", F.col("difficulty_level").isin(levels)).orderBy(F.desc(score), F.desc("paper_score"), "pos")
        return F.col("difficulty_level").isin(levels) & (F.row_number().over(order) <= PACK)

    membership = rows.select(G.slug(F.col("tag")).alias("topic_id"), F.col("id").alias("paper_id"), pack(["L1", "L2"], "read_first_score").alias("starter"), pack(["L3", "L4"], "paper_score").alias("frontier"))
    return topics, membership


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    papers = scored_papers(spark, sf_dir)
    topics, membership = topic_tables(papers)
    topics, best = G.select_inputs(topics, membership, papers)
    return topics, membership, best


def _flat(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", "kind", "weight", "explanation")


def graph_topic_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics, membership, _ = _inputs(spark, sf_dir)
    return _flat(G.topic_topic_edges(topics, membership))


def graph_topic_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(G.topic_paper_edges(*_inputs(spark, sf_dir)))


def graph_paper_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, membership, papers = _inputs(spark, sf_dir)
    return G.paper_paper_edges(papers, membership).select("source", "target", "weight")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nodes(*_inputs(spark, sf_dir))


def _assembled(spark: SparkSession, sf_dir: str) -> G.Graph:
    papers = scored_papers(spark, sf_dir)
    topics, membership = (staged(x, "graph-tags") for x in topic_tables(papers))
    return G.assemble(topics, membership, papers)


def graph_edge_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir).edges.select("edge_id", "kind", "source", "target", "weight")


def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir).stats


QUERIES = {f.__name__: f for f in (graph_topic_topic, graph_topic_paper, graph_paper_paper, graph_nodes, graph_edge_limit, graph_summary)}


def _values(table: dict[str, list[str]]) -> str:
    return ", ".join(f"({q(t)}, {q(x)})" for t, xs in table.items() for x in xs)


def _oracle() -> str:
    d = DUCK
    slug = "trim(regexp_replace(lower(trim({})), '[^a-z0-9]+', '_', 'g'), '_')"
    pack = "row_number() OVER (PARTITION BY tag, difficulty_level IN ({0}) ORDER BY {1} DESC, paper_score DESC, pos) <= 5 AND difficulty_level IN ({0})"
    return f"""{chain(d, 'topics')}, sums AS MATERIALIZED ({_topic_sums(d)}),
    strong AS (SELECT tag, {slug.format('tag')} AS tid, trend_score FROM sums ORDER BY trend_score DESC, tid LIMIT 30),
    levels(tag, l) AS (VALUES {', '.join(f'({q(t)}, {q(x)})' for t, x in R.TOPIC_LEVELS.items())}),
    member AS MATERIALIZED (SELECT *, {slug.format('tag')} AS tid, {pack.format("'L1', 'L2'", 'read_first_score')} AS starter, {pack.format("'L3', 'L4'", 'paper_score')} AS frontier FROM topics),
    best AS MATERIALIZED (SELECT * FROM scored WHERE id IN (SELECT id FROM member WHERE tid IN (SELECT tid FROM strong)) ORDER BY paper_score DESC, title, id LIMIT 75),
    tp AS (SELECT 'topic:' || tid AS source, 'paper:' || id AS target, 'topic-paper' AS kind, 1.0e0 + CASE WHEN starter THEN 0.5e0 ELSE 0 END + CASE WHEN frontier THEN 0.7e0 ELSE 0 END AS weight,
      CASE WHEN starter THEN 'Paper is part of this topic starter path.' WHEN frontier THEN 'Paper is part of this topic frontier path.' ELSE 'Paper belongs to this topic.' END AS explanation
      FROM member WHERE tid IN (SELECT tid FROM strong) AND id IN (SELECT id FROM best)),
    needs(tag, p) AS (VALUES {_values(R.PREREQUISITES)}), given(tag, w) AS (VALUES {_values(R.TOPIC_KEYWORDS)}),
    words AS (SELECT s.tag, s.tid, g.w FROM strong s JOIN given g ON s.tag = g.tag UNION SELECT tag, tid, lower(tag) FROM strong WHERE tag NOT IN (SELECT tag FROM given)),
    ranked AS (SELECT tag, row_number() OVER (ORDER BY n DESC, tag) AS r FROM sums),
    pairs AS (SELECT x.tag AS xt, y.tag AS yt, x.tid AS a, y.tid AS b FROM strong x JOIN strong y ON x.trend_score > y.trend_score OR (x.trend_score = y.trend_score AND x.tid < y.tid)),
    told AS (SELECT xt, yt, a, b,
      EXISTS (SELECT 1 FROM ranked u JOIN ranked v ON TRUE WHERE u.tag = xt AND v.tag = yt AND (v.r <= 5 + CASE WHEN u.r <= 5 THEN 1 ELSE 0 END OR u.r <= 5 + CASE WHEN v.r <= 5 THEN 1 ELSE 0 END)) AS rel,
      EXISTS (SELECT 1 FROM needs WHERE (needs.tag = xt AND {slug.format('p')} = b) OR (needs.tag = yt AND {slug.format('p')} = a)) AS pre,
      (SELECT count(*) FROM (SELECT id FROM member WHERE tid = a INTERSECT SELECT id FROM member WHERE tid = b)) * 1.0e0 / (SELECT count(DISTINCT id) FROM member WHERE tid IN (a, b)) AS o,
      (SELECT count(*) FROM (SELECT w FROM words WHERE tid = a INTERSECT SELECT w FROM words WHERE tid = b)) * 1.0e0 / (SELECT count(DISTINCT w) FROM words WHERE tid IN (a, b)) AS k FROM pairs),
    weighed AS (SELECT *, CASE WHEN rel THEN 3 ELSE 0 END + CASE WHEN pre THEN 2 ELSE 0 END + 4 * o + 2 * k AS w FROM told),
    tt AS (SELECT 'topic:' || a AS source, 'topic:' || b AS target, CASE WHEN pre THEN 'prerequisite' ELSE 'topic-topic' END AS kind, round(w, 2) AS weight,
      concat_ws('; ', CASE WHEN rel THEN 'listed as related topics' END, CASE WHEN pre THEN 'prerequisite relationship' END, CASE WHEN o > 0 THEN 'overlapping papers' END, CASE WHEN k > 0 THEN 'overlapping keywords' END) AS explanation FROM weighed WHERE w >= 0.7),
    lists AS (SELECT id, list_transform(tags, lambda t: {slug.format('t')}) AS topic, list_distinct(list_transform(tags, lambda t: lower(trim(t)))) AS tag, list_distinct(list_transform(authors, lambda t: lower(trim(t)))) AS author, lower(trim(venue)) AS venue, paper_type, difficulty_level, year FROM best),
    posted AS (SELECT DISTINCT 'topic' AS kind, unnest(topic) AS k, id FROM lists UNION SELECT 'tag', unnest(tag), id FROM lists UNION SELECT 'author', unnest(author), id FROM lists UNION SELECT 'venue', venue, id FROM lists WHERE venue <> ''),
    first140 AS (SELECT * FROM posted QUALIFY row_number() OVER (PARTITION BY kind, k ORDER BY id) <= 140),
    met AS (SELECT DISTINCT x.id AS a, y.id AS b FROM first140 x JOIN first140 y ON x.kind = y.kind AND x.k = y.k AND x.id < y.id),
    pp AS (SELECT 'paper:' || m.a AS source, 'paper:' || m.b AS target, 3.0e0 * len(list_intersect(x.topic, y.topic)) + 1.4e0 * len(list_intersect(x.tag, y.tag)) + 2.5e0 * len(list_intersect(x.author, y.author))
      + CASE WHEN x.venue = y.venue AND x.venue <> '' THEN 0.8e0 ELSE 0 END + CASE WHEN x.paper_type = y.paper_type THEN 0.5e0 ELSE 0 END + CASE WHEN x.difficulty_level = y.difficulty_level THEN 0.3e0 ELSE 0 END
      + CASE WHEN x.year = y.year THEN 0.6e0 WHEN abs(x.year - y.year) <= 2 THEN 0.3e0 ELSE 0 END AS w FROM met m JOIN lists x ON x.id = m.a JOIN lists y ON y.id = m.b),
    kept AS (SELECT source, target, round(w, 2) AS weight FROM pp WHERE round(w, 6) >= 3.2)"""


#: The caps as the sequential rule: one edge between papers after the other, with the edges taken so far at each paper.
_CAPPED = """, every AS MATERIALIZED (SELECT 'edge:topic-paper:' || source[7:] || ':' || target[7:] AS edge_id, kind, source, target, weight FROM tp
      UNION ALL SELECT 'edge:topic:' || source[7:] || ':' || target[7:], kind, source, target, weight FROM tt
      UNION ALL SELECT 'edge:paper:' || source[7:] || ':' || target[7:], 'paper-paper', source, target, weight FROM kept),
    named AS (SELECT 'paper:' || id AS node, row_number() OVER (ORDER BY id) AS i FROM best),
    queue AS MATERIALIZED (SELECT row_number() OVER (ORDER BY weight DESC, edge_id) AS k, edge_id, x.i AS a, y.i AS b FROM every JOIN named x ON x.node = source JOIN named y ON y.node = target WHERE kind = 'paper-paper'),
    walk AS (SELECT 0::BIGINT AS k, list_transform(range(75), lambda z: 0) AS used, '' AS edge_id, false AS took
      UNION ALL SELECT q.k, CASE WHEN used[a] < 5 AND used[b] < 5 THEN list_transform(used, lambda u, i: u + CASE WHEN i IN (a, b) THEN 1 ELSE 0 END) ELSE used END, q.edge_id, used[a] < 5 AND used[b] < 5 FROM walk JOIN queue q ON q.k = walk.k + 1),
    shown AS (SELECT * FROM every WHERE kind <> 'paper-paper' OR edge_id IN (SELECT edge_id FROM walk WHERE took) ORDER BY weight DESC, edge_id LIMIT 1600)"""


def _recursive(text: str) -> str:
    return text.replace("WITH", "WITH RECURSIVE", 1)


_PLAIN = "source, target, kind, weight, explanation"
ORACLE_SQL = {
    "graph_topic_topic": f"{_oracle()} SELECT {_PLAIN} FROM tt",
    "graph_topic_paper": f"{_oracle()} SELECT {_PLAIN} FROM tp",
    "graph_paper_paper": f"{_oracle()} SELECT source, target, weight FROM kept",
    "graph_nodes": f"""{_oracle()} SELECT 'topic:' || tid AS node_id, 'topic' AS kind, s.tag AS label, coalesce(l, 'L2') AS level, trend_score AS score, (SELECT count(*) FROM member m WHERE m.tid = s.tid) AS size FROM strong s LEFT JOIN levels ON levels.tag = s.tag
      UNION ALL SELECT 'paper:' || id, 'paper', title, difficulty_level, paper_score, (SELECT count(*) FROM member m WHERE m.id = best.id AND m.tid IN (SELECT tid FROM strong)) FROM best""",
    "graph_edge_limit": f"{_recursive(_oracle())}{_CAPPED} SELECT edge_id, kind, source, target, weight FROM shown",
    "graph_summary": f"""{_recursive(_oracle())}{_CAPPED} SELECT (SELECT count(*) FROM strong) AS n_topics, (SELECT count(*) FROM best) AS n_papers, count(*) AS n_edges, count(*) FILTER (kind = 'topic-paper') AS n_topic_paper,
      count(*) FILTER (kind IN ('topic-topic', 'prerequisite')) AS n_topic_topic, count(*) FILTER (kind = 'paper-paper') AS n_paper_paper,
      (SELECT count(DISTINCT id) FROM member WHERE tid IN (SELECT tid FROM strong)) - (SELECT count(*) FROM best) AS n_hidden_papers, (SELECT count(*) FROM every) - count(*) AS n_hidden_edges FROM shown""",
}
