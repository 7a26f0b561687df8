"""The graph of topics and papers: nodes, scored edges with their evidence, and caps.

Topics: ``topic_id, name, keywords, related_topics, prerequisites, difficulty,
trend_score``; membership: ``topic_id, paper_id, starter, frontier``; papers:
``id, title, tags, authors, venue, source, year, paper_type, difficulty_level,
paper_score, read_first_score``.  Edges are ``edge_id, kind, source, target,
weight, evidence, explanation``.  Membership is a table of its own, so that no
topic holds all its papers in one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import staged
from .graph import limit_edges

# Weights of what two topics or two papers share, least weights, caps.
RELATED, PREREQUISITE, PAPERS, KEYWORDS, LEAST_TOPIC_WEIGHT = 3.0, 2.0, 4.0, 2.0, 0.7
SHARED_TOPIC, SHARED_TAG, SHARED_AUTHOR, SAME_VENUE, SAME_TYPE, SAME_LEVEL = 3.0, 1.4, 2.5, 0.8, 0.5, 0.3
SAME_YEAR, CLOSE_YEAR, YEARS = 0.6, 0.3, 2
STARTER, FRONTIER = 0.5, 0.7
DENSITY = {"focused": (3, 4.2, 900), "balanced": (5, 3.2, 1600), "dense": (8, 2.4, 2500)}  # edges a paper, least weight, edges in all
RELATIONS = frozenset({"topic-paper", "topic-topic", "prerequisite", "paper-paper"})
MAX_TOPICS, MAX_PAPERS, POSTING = 30, 75, 140
LEVELS = {"beginner": "L1", "intermediate": "L2", "advanced": "L3", "frontier": "L4", "l1": "L1", "l2": "L2", "l3": "L3", "l4": "L4"}
SOURCES = [("acl", "acl"), ("openreview", "openreview"), ("cvf", "cvf"), ("pmlr", "pmlr"), ("arxiv", "arxiv")]


def key(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x.cast("string"), F.lit(""))))


def slug(x: Column) -> Column:
    return F.trim(F.regexp_replace(key(x), "[^a-z0-9]+", "_"), F.lit("_"))


def level(x: Column) -> Column:
    """L1 to L4 of a word or code; L2 for anything else."""
    return F.coalesce(*[F.when(key(x) == k, v) for k, v in LEVELS.items()], F.lit("L2"))


def source_group(source: Column, paper_id: Column) -> Column:
    found = F.when(F.lit(False), "")
    for name, group in SOURCES:
        found = found.when(key(source).contains(name) | key(paper_id).startswith(f"{name}:"), group)
    return found.otherwise(F.coalesce(F.nullif(key(source), F.lit("")), F.lit("other")))


def keys(x: Column) -> Column:
    """Distinct non-empty keys of an array; null is empty."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), key), lambda k: k != ""))


def memberships(topics: DataFrame) -> DataFrame:
    """The membership table of topics that hold arrays: ``paper_ids`` and the two packs."""
    rows = topics.select("topic_id", "starter_pack_ids", "frontier_pack_ids", F.explode("paper_ids").alias("paper_id"))
    within = [F.coalesce(F.array_contains(f"{name}_pack_ids", F.col("paper_id")), F.lit(False)).alias(name) for name in ("starter", "frontier")]
    return rows.select("topic_id", F.col("paper_id").cast("string").alias("paper_id"), *within).distinct()


def select_inputs(topics: DataFrame, membership: DataFrame, papers: DataFrame, *, max_topics: int = MAX_TOPICS, max_papers: int = MAX_PAPERS, topic_query: str = "", paper_query: str = "",
                  difficulty: str = "all", source: str = "all", paper_type: str = "all", year_min: int = 0, year_max: int = 0, min_paper_score: float = 0, min_read_first_score: float = 0) -> tuple[DataFrame, DataFrame]:
    """The strongest topics within the filters, and of their papers within the filters the best."""
    kept = topics
    if topic_query:
        kept = kept.where(F.lower(F.concat_ws(" ", "name", "keywords")).contains(topic_query.strip().lower()))
    if difficulty != "all":
        kept = kept.where(level(F.col("difficulty")) == difficulty)
    kept = kept.orderBy(F.desc(F.coalesce("trend_score", F.lit(0.0))), "topic_id").limit(max_topics)
    wanted = membership.join(kept.select("topic_id"), "topic_id", "left_semi").select(F.col("paper_id").alias("id"))
    rows = papers.join(wanted, "id", "left_semi")
    if paper_query:
        text = F.concat_ws(" ", "title", *[c for c in ("abstract", "summary") if c in papers.columns], "venue", "paper_type", "authors", "tags")
        rows = rows.where(F.lower(text).contains(paper_query.strip().lower()))
    if difficulty != "all":
        rows = rows.where(level(F.col("difficulty_level")) == difficulty)
    if source != "all":
        rows = rows.where(source_group(F.col("source"), F.col("id")) == source)
    if paper_type != "all":
        rows = rows.where(key(F.col("paper_type")) == paper_type)
    year = F.coalesce("year", F.lit(0))
    if year_min:
        rows = rows.where((year == 0) | (year >= year_min))
    if year_max:
        rows = rows.where((year == 0) | (year <= year_max))
    rows = rows.where((F.coalesce("paper_score", F.lit(0.0)) >= min_paper_score) & (F.coalesce("read_first_score", F.lit(0.0)) >= min_read_first_score))
    return kept, rows.orderBy(F.desc(F.coalesce("paper_score", F.lit(0.0))), F.coalesce("title", "id"), "id").limit(max_papers)


def _evidence(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def _edges(rows: DataFrame, edge_id: Column, kind: Column, source: Column, target: Column, weight: Column, explanation: Column) -> DataFrame:
    return rows.select(edge_id.alias("edge_id"), kind.alias("kind"), source.alias("source"), target.alias("target"), weight.alias("weight"), "evidence", explanation.alias("explanation"))


def topic_paper_edges(topics: DataFrame, membership: DataFrame, papers: DataFrame) -> DataFrame:
    rows = membership.join(topics.select("topic_id"), "topic_id", "left_semi").join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    rows = rows.withColumn("evidence", _evidence(F.when(F.col("starter"), "starter paper"), F.when(F.col("frontier"), "frontier paper")))
    weight = 1 + F.when(F.col("starter"), STARTER).otherwise(0.0) + F.when(F.col("frontier"), FRONTIER).otherwise(0.0)
    told = F.when(F.col("starter"), "Paper is part of this topic starter path.").when(F.col("frontier"), "Paper is part of this topic frontier path.").otherwise("Paper belongs to this topic.")
    return _edges(rows, F.concat(F.lit("edge:topic-paper:"), "topic_id", F.lit(":"), "paper_id"), F.lit("topic-paper"), F.concat(F.lit("topic:"), "topic_id"), F.concat(F.lit("paper:"), "paper_id"), weight, told)


def _overlaps(sets: DataFrame, member: str, item: str) -> DataFrame:
    """``a, b, overlap``: the Jaccard similarity of the items of two members that share one, a < b."""
    sets = sets.select(F.col(member).alias("m"), F.col(item).alias("i")).distinct()
    sizes = sets.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    # An item's members are few (the topics of a paper or of a keyword); pairs are made within its row.
    held = sets.groupBy("i").agg(F.array_sort(F.collect_set("m")).alias("ms"))
    pairs = held.select("ms", F.explode("ms").alias("a")).select("a", F.explode("ms").alias("b")).where("a < b")
    shared = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    rows = shared.join(sizes.select(F.col("m").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("m").alias("b"), F.col("n").alias("nb")), "b")
    return rows.select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("overlap"))


def _references(topics: DataFrame, column: str) -> DataFrame:
    """``a, b`` of topics of which one names the other, by id or by a name of the same slug."""
    names = topics.select(F.col("topic_id").alias("to"), F.col("topic_id").alias("ref")).union(topics.select("topic_id", slug(F.col("name")))).distinct()
    named = topics.select("topic_id", F.explode(column).alias("said"))
    named = named.select("topic_id", F.explode(F.array_distinct(F.array(F.col("said"), slug(F.col("said"))))).alias("ref"))
    rows = named.join(names, "ref").where("topic_id <> to")
    return rows.select(F.least("topic_id", "to").alias("a"), F.greatest("topic_id", "to").alias("b")).distinct()


def topic_topic_edges(topics: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges of topics that name each other or share papers or keywords, of weight LEAST_TOPIC_WEIGHT or more."""
    own = membership.join(topics.select("topic_id"), "topic_id", "left_semi")
    words = topics.select("topic_id", F.explode(keys(F.col("keywords"))).alias("word"))
    nothing = F.lit(0.0)
    parts = [
        _references(topics, "related_topics").select("a", "b", F.lit(1.0).alias("r"), nothing.alias("p"), nothing.alias("o"), nothing.alias("k")),
        _references(topics, "prerequisites").select("a", "b", nothing.alias("r"), F.lit(1.0).alias("p"), nothing.alias("o"), nothing.alias("k")),
        _overlaps(own, "topic_id", "paper_id").select("a", "b", nothing.alias("r"), nothing.alias("p"), F.col("overlap").alias("o"), nothing.alias("k")),
        _overlaps(words, "topic_id", "word").select("a", "b", nothing.alias("r"), nothing.alias("p"), nothing.alias("o"), F.col("overlap").alias("k")),
    ]
    rows = reduce(DataFrame.union, parts).groupBy("a", "b").agg(*[F.max(c).alias(c) for c in "rpok"])
    rows = rows.withColumn("w", RELATED * F.col("r") + PREREQUISITE * F.col("p") + PAPERS * F.col("o") + KEYWORDS * F.col("k")).where(F.col("w") >= LEAST_TOPIC_WEIGHT)
    # The stronger topic comes first.
    rank = topics.select("topic_id", F.coalesce("trend_score", F.lit(0.0)).alias("t"))
    rows = rows.join(rank.select(F.col("topic_id").alias("a"), F.col("t").alias("ta")), "a").join(rank.select(F.col("topic_id").alias("b"), F.col("t").alias("tb")), "b")
    turned = F.col("tb") > F.col("ta")
    rows = rows.withColumn("s", F.when(turned, F.col("b")).otherwise(F.col("a"))).withColumn("d", F.when(turned, F.col("a")).otherwise(F.col("b")))
    told = [("r", "listed as related topics"), ("p", "prerequisite relationship"), ("o", "overlapping papers"), ("k", "overlapping keywords")]
    rows = rows.withColumn("evidence", _evidence(*[F.when(F.col(c) > 0, text) for c, text in told]))
    kind = F.when(F.col("p") > 0, "prerequisite").otherwise("topic-topic")
    return _edges(rows, F.concat(F.lit("edge:topic:"), "s", F.lit(":"), "d"), kind, F.concat(F.lit("topic:"), "s"), F.concat(F.lit("topic:"), "d"), F.round("w", 2), F.array_join("evidence", "; "))


def paper_paper_edges(papers: DataFrame, membership: DataFrame, least_weight: float = DENSITY["balanced"][1], posting: int = POSTING) -> DataFrame:
    """Pairs that meet in one of the first ``posting`` ids of a topic, tag, author or venue, scored whole."""
    own = membership.join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi").groupBy("paper_id").agg(F.collect_set("topic_id").alias("topics"))
    rows = papers.join(own, papers["id"] == own["paper_id"], "left").select(
        "id", keys(F.col("topics")).alias("topics"), keys(F.col("tags")).alias("tags"), keys(F.col("authors")).alias("authors"), key(F.col("venue")).alias("venue"), F.col("venue").alias("venue_name"),
        key(F.col("paper_type")).alias("type"), level(F.col("difficulty_level")).alias("level"), F.coalesce("year", F.lit(0)).alias("year"),
    )
    lists = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(c).alias("ks")) for n, c in (("topic", "topics"), ("tag", "tags"), ("author", "authors"))], F.struct(F.lit("venue").alias("kind"), F.filter(F.array("venue"), lambda v: v != "").alias("ks")))
    postings = rows.select("id", F.inline(lists)).select("kind", F.explode("ks").alias("k"), "id").distinct()
    # A rank below a bound is taken by each task before the shuffle, so a hot list never meets whole.
    first = postings.withColumn("rn", F.row_number().over(Window.partitionBy("kind", "k").orderBy("id"))).where(F.col("rn") <= posting).drop("rn")
    met = first.select("kind", "k", F.col("id").alias("a")).join(first.select("kind", "k", F.col("id").alias("b")), ["kind", "k"]).where("a < b").select("a", "b").distinct()
    left, right = (rows.select(*[F.col(c).alias(c if c == "id" else f"{side}_{c}") for c in rows.columns]).withColumnRenamed("id", side) for side in ("a", "b"))
    both = met.join(left, "a").join(right, "b")
    shared = {c: F.array_intersect(f"b_{c}", f"a_{c}") for c in ("topics", "tags", "authors")}
    apart = F.abs(F.col("a_year") - F.col("b_year"))
    same = {c: (F.col(f"a_{c}") == F.col(f"b_{c}")) & (F.col(f"a_{c}") != "") for c in ("venue", "type", "level")}
    near = F.when(apart == 0, SAME_YEAR).when(apart <= YEARS, CLOSE_YEAR).otherwise(0.0)
    points = [F.size(shared["topics"]) * SHARED_TOPIC, F.size(shared["tags"]) * SHARED_TAG, F.size(shared["authors"]) * SHARED_AUTHOR]
    points += [F.when(same[c], w).otherwise(0.0) for c, w in (("venue", SAME_VENUE), ("type", SAME_TYPE), ("level", SAME_LEVEL))] + [near]
    both = both.withColumn("w", reduce(lambda x, y: x + y, points)).where(F.round("w", 6) >= least_weight)

    def listed(name: str, c: str, most: int | None = None) -> Column:
        items = F.slice(shared[c], 1, most) if most else shared[c]
        return F.when(F.size(shared[c]) > 0, F.concat(F.lit(f"shared {name}: "), F.array_join(items, ", ")))

    both = both.withColumn("evidence", _evidence(
        listed("topics", "topics"), listed("tags", "tags", 5), listed("authors", "authors", 4), F.when(same["venue"], F.concat(F.lit("same venue: "), "a_venue_name")),
        F.when(same["type"], F.concat(F.lit("same paper type: "), "a_type")), F.when(same["level"], F.concat(F.lit("same difficulty: "), "a_level")), F.when(near > 0, "published in a close year window"),
    ))
    told = F.when(F.size("evidence") > 0, F.array_join("evidence", "; ")).otherwise("Papers share weak bibliographic or topic signals.")
    return _edges(both, F.concat(F.lit("edge:paper:"), "a", F.lit(":"), "b"), F.lit("paper-paper"), F.concat(F.lit("paper:"), "a"), F.concat(F.lit("paper:"), "b"), F.round("w", 2), told)


def nodes(topics: DataFrame, membership: DataFrame, papers: DataFrame) -> DataFrame:
    """``node_id, kind, label, level, score, size``: size counts a topic's papers and a paper's visible topics."""
    counts = membership.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    of_topics = topics.join(counts, "topic_id", "left").select(F.concat(F.lit("topic:"), "topic_id").alias("node_id"), F.lit("topic").alias("kind"), F.coalesce("name", "topic_id").alias("label"), level(F.col("difficulty")).alias("level"), F.coalesce(F.col("trend_score").cast("double"), F.lit(0.0)).alias("score"), F.coalesce("n", F.lit(0)).alias("size"))
    seen = membership.join(topics.select("topic_id"), "topic_id", "left_semi").groupBy(F.col("paper_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    of_papers = papers.join(seen, "id", "left").select(F.concat(F.lit("paper:"), "id").alias("node_id"), F.lit("paper").alias("kind"), F.coalesce("title", "id").alias("label"), level(F.col("difficulty_level")).alias("level"), F.coalesce(F.col("paper_score").cast("double"), F.lit(0.0)).alias("score"), F.coalesce("n", F.lit(0)).alias("size"))
    return of_topics.unionByName(of_papers)


def edges(topics: DataFrame, membership: DataFrame, papers: DataFrame, relations: frozenset[str] = RELATIONS, density: str = "balanced") -> DataFrame:
    """All edges of the relations switched on, before the caps."""
    parts = []
    if "topic-paper" in relations:
        parts.append(topic_paper_edges(topics, membership, papers))
    if "topic-topic" in relations:
        parts.append(topic_topic_edges(topics, membership).where((F.col("kind") == "topic-topic") | F.lit("prerequisite" in relations)))
    if "paper-paper" in relations:
        parts.append(paper_paper_edges(papers, membership, DENSITY[density][1]))
    empty = topic_paper_edges(topics, membership, papers).limit(0)
    return reduce(DataFrame.unionByName, parts, empty)


def summary(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """``n_topics, n_papers, n_edges`` and the edges of each kind, in one row."""
    of_nodes = node_rows.agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}s") for k in ("topic", "paper")])
    kinds = {"n_topic_paper": ["topic-paper"], "n_topic_topic": ["topic-topic", "prerequisite"], "n_paper_paper": ["paper-paper"]}
    of_edges = edge_rows.agg(F.count(F.lit(1)).alias("n_edges"), *[F.count(F.when(F.col("kind").isin(ks), 1)).alias(n) for n, ks in kinds.items()])
    return of_nodes.join(of_edges)


@dataclass(frozen=True)
class Graph:
    """What is shown: nodes, capped edges, and one row of figures, hidden papers and edges included."""

    nodes: DataFrame
    edges: DataFrame
    stats: DataFrame


def assemble(topics: DataFrame, membership: DataFrame, papers: DataFrame, *, relations: frozenset[str] = RELATIONS, density: str = "balanced", max_edges: int | None = None, per_paper: int | None = None, show_papers: bool = True, **filters) -> Graph:
    """The whole graph of the topics and papers that pass ``filters`` (those of ``select_inputs``).

    An unknown density counts as balanced.  Hidden papers are those of the shown topics
    that aren't shown, hidden edges those that the caps take.
    """
    density = density if density in DENSITY else "balanced"
    kept, best = select_inputs(topics, membership, papers, **filters)
    kept, best = staged(kept, "graph-topics"), staged(best if show_papers else best.limit(0), "graph-best")
    reached = membership.join(kept.select("topic_id"), "topic_id", "left_semi").agg(F.count_distinct("paper_id").alias("reached"))
    found = staged(edges(kept, membership, best, relations, density), "graph-edges")
    shown = staged(limit_edges(found, DENSITY[density][2] if max_edges is None else max_edges, DENSITY[density][0] if per_paper is None else per_paper), "graph-shown")
    node_rows = nodes(kept, membership, best)
    figures = summary(node_rows, shown).join(reached).join(found.agg(F.count(F.lit(1)).alias("found")))
    stats = figures.select("*", (F.col("reached") - F.col("n_papers")).alias("n_hidden_papers"), (F.col("found") - F.col("n_edges")).alias("n_hidden_edges")).drop("reached", "found")
    return Graph(node_rows.orderBy("node_id"), shown.orderBy("edge_id"), stats)
