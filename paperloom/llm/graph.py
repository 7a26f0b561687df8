"""Connected components by alternating large-star and small-star rounds.

Each round is joins and a partial minimum, so a hub is pre-aggregated where its
edges lie; a round's edges are written to the shared folder and the ones before
are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, staged


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """``node, root`` for every node of ``edges`` (u, v: long), root being the smallest node it reaches; and the path of the table."""
    spark = edges.sparkSession
    first = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = staged(first, "edges")
    before = None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == before:
            break
        before = sign
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        nxt, nxt_path = staged(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_path(spark, path)
        now, path = nxt, nxt_path
    roots = now.select("u", "v")
    return roots.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), path
