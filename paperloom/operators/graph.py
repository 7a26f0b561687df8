"""The paper graph's edge caps: greedy by weight, in parallel rounds.

Edges are taken in one total order, weight descending, then edge_id.  Whether an
edge between papers stays depends on the heavier ones at its ends alone, so all
edges that are among the heaviest open ones at both ends, within what the ends can
still take, are decided in one round; they are just those that the sequential rule
takes.  A round is a bounded ranking at each end, which every task cuts before the
shuffle, and joins; its outcome is written, so no lineage grows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import staged

#: Edges kept in all and at each paper.
MAX_EDGES, PER_PAPER = 1_600, 5
CAPPED = "paper-paper"


def _ends(*names: str) -> Column:
    """A row for each end of an edge: ``node`` and the columns ``name_source``, ``name_target`` as ``name``."""
    return F.inline(F.array(*[F.struct(F.col(end).alias("node"), *[F.col(f"{n}_{end}").alias(n) for n in names]) for end in ("source", "target")]))


def matching(edges: DataFrame, per_node: int) -> DataFrame:
    """``edge_id`` of the edges that stay if none may have an end with ``per_node`` heavier edges that stay.

    Ids must be distinct.  An edge whose ends are one node counts once there and never
    stays, nor does any edge if ``per_node`` is below one.
    """
    none = F.lit(0)
    open_ = staged(edges.where(F.col("source") != F.col("target")).select("edge_id", "weight", "source", "target", none.alias("used_source"), none.alias("used_target")), "open-edges")
    order = Window.partitionBy("node").orderBy(F.desc("weight"), "edge_id")
    won = [open_.select("edge_id").limit(0)]
    while per_node > 0 and not open_.isEmpty():
        first = open_.select("edge_id", "weight", _ends("used")).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_node)
        both = first.where(F.col("rn") <= per_node - F.col("used")).groupBy("edge_id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("edge_id")
        won.append(staged(both, "won-edges"))
        taken = open_.join(won[-1], "edge_id", "left_semi").select(_ends()).groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("more"))
        rest = open_.join(won[-1], "edge_id", "left_anti")
        for end in ("source", "target"):
            rest = rest.join(taken.select(F.col("node").alias(end), "more"), end, "left").withColumn(f"used_{end}", F.col(f"used_{end}") + F.coalesce("more", none)).drop("more")
        rest = rest.where((F.col("used_source") < per_node) & (F.col("used_target") < per_node))
        open_ = staged(rest.select(*open_.columns), "open-edges")
    return reduce(DataFrame.unionByName, won)


def limit_edges(edges: DataFrame, max_edges: int = MAX_EDGES, per_paper: int = PER_PAPER) -> DataFrame:
    """The heaviest ``max_edges`` of the edges that stay; the cap at each end holds for edges between papers, the cap in all for every kind.

    A sequential pass that stops at ``max_edges`` takes the first of what it would take
    without a stop, so the matching comes first and the cap in all is a top-k.
    """
    capped = F.col("kind") == CAPPED
    stays = edges.where(~capped).unionByName(edges.where(capped).join(matching(edges.where(capped), per_paper), "edge_id", "left_semi").select(*edges.columns))
    return stays.orderBy(F.desc("weight"), "edge_id").limit(max_edges)
