"""Sinks: slim projections, JSON with a size guard, upserts by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that the slim form leaves out.
HEAVY = ["affiliations_raw", "limitations", "future_work", "score_breakdown", "difficulty_reason", "tweet_thread", "linkedin_post", "newsletter_blurb", "video_script", "technical_summary", "plain_english"]
LIMIT_BYTES = 100_000_000
WARN_SHARE = 0.85


def slim(papers: DataFrame) -> DataFrame:
    return papers.drop(*HEAVY)


def slim_author(authors: DataFrame) -> DataFrame:
    return authors.withColumn("paper_count", F.size("paper_ids")).drop("paper_ids", "momentum_breakdown", "summary_profile")


def json_bytes(df: DataFrame) -> int:
    return df.select(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 1)).first()[0] or 0


def write_json(df: DataFrame, path: str, limit: int = LIMIT_BYTES) -> str:
    """Writes one JSON lines file; refuses ``limit`` bytes or more and answers ``warn`` from 85 % on."""
    size = json_bytes(df)
    if size >= limit:
        raise ValueError(f"{size} bytes of JSON; the limit is {limit}")
    df.coalesce(1).write.mode("overwrite").json(path)
    return "warn" if size >= WARN_SHARE * limit else "ok"


def first_per_key(df: DataFrame, key: str, order: str | Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    return first_per_key(df, key, F.desc(order))


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """``table`` with ``rows`` laid over it; of new rows of one key the first counts."""
    new = first_per_key(rows, key, order)
    return table.join(new.select(key), key, "left_anti").unionByName(new.select(table.columns), allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def webhook_payload(papers: DataFrame) -> DataFrame:
    """A JSON message for each paper: authors beyond three become et al., long abstracts are cut."""
    names = F.concat(F.array_join(F.slice("authors", 1, 3), ", "), F.when(F.size("authors") > 3, " et al.").otherwise(""))
    about = F.when(F.length("abstract") > 300, F.concat(F.left("abstract", F.lit(297)), F.lit("..."))).otherwise(F.col("abstract"))
    return papers.select("id", F.to_json(F.struct(F.col("title"), F.col("paper_url").alias("url"), names.alias("authors"), about.alias("description"))).alias("payload"))
