"""The whole chain on a frame of papers, and its command line.

    python -m paperloom.pipeline --papers landed/papers.parquet --out results
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.told import Told, register
from .operators.dedup import deduplicate
from .plans import venues as _venues  # noqa: F401  registers its queries
from .plans.corpus import QUERIES
from .plans.stage import staged
from .schemas import normalize_legacy

#: Output of the pipeline and the query that makes it.
OUTPUTS = {
    "search_index": "search_index",
    "papers": "slim_export",
    "levels": "difficulty",
    "summaries": "content_summary",
    "threads": "content_tweet",
    "newsletter": "content_newsletter",
    "topics": "topic_agg",
    "topic_trends": "topic_trend",
    "starter_packs": "topic_starter_pack",
    "frontier_packs": "topic_frontier_pack",
    "related_topics": "topic_related",
    "gaps": "gap_union_dedup",
    "authors": "author_agg",
    "author_momentum": "author_momentum",
    "labs": "lab_agg",
    "lab_momentum": "lab_momentum",
    "universities": "university_agg",
    "university_momentum": "university_momentum",
    "editorial": "editorial_top5",
    "stats": "stats_by_dimension",
    "venue_profiles": "tfidf_profile",
    "recommendations": "recommend_venues",
}


def on(papers: DataFrame, name: str) -> DataFrame:
    """A named query over a frame of papers instead of the derived relation."""
    rows = normalize_legacy(papers)
    if "pos" not in rows.columns:
        rows = rows.withColumn("pos", F.monotonically_increasing_id())
    view = f"papers_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    register(papers.sparkSession)
    return papers.sparkSession.sql(QUERIES[name](Told(relation=view)))


def run(batches: list[DataFrame], dedup: bool = True) -> dict[str, DataFrame]:
    """New and stored papers, in this order, through every step; the outputs by name.

    An empty list, or one of empty frames, gives empty outputs.
    """
    rows = None
    for order, batch in enumerate(batches):
        batch = normalize_legacy(batch).drop("pos").withColumn("pos", F.lit(order).cast("long") * F.lit(1 << 56) + F.monotonically_increasing_id())
        rows = batch if rows is None else rows.unionByName(batch, allowMissingColumns=True)
    if rows is None:
        raise ValueError("no papers")
    rows = staged(rows, "papers")  # positions are fixed from here on
    rows = staged(deduplicate(rows), "deduplicated") if dedup else rows
    return {out: on(rows, name) for out, name in OUTPUTS.items()}


def main() -> None:
    cli = argparse.ArgumentParser(description=__doc__)
    cli.add_argument("--papers", nargs="+", required=True, help="Parquet or JSON lines, new ones first")
    cli.add_argument("--out", required=True)
    cli.add_argument("--skip-dedup", action="store_true")
    args = cli.parse_args()
    spark = SparkSession.builder.appName("paperloom").getOrCreate()
    frames = [spark.read.json(p) if p.endswith((".json", ".jsonl")) else spark.read.parquet(p) for p in args.papers]
    for name, df in run(frames, not args.skip_dedup).items():
        df.write.mode("overwrite").parquet(f"{args.out}/{name}")


if __name__ == "__main__":
    main()
