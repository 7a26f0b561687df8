"""Queries on reading lists: the events are actions on them, and the orders what is listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import library

#: Ids on the lists: few enough to be met again.
ITEMS = 60
ACTIONS = {"purchase": "add", "error": "remove", "click": "toggle", "view": "toggle"}


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[F.col("event_type")]
    return library.replay(events.select("user_id", (F.col("event_id") % ITEMS).alias("paper_id"), action.alias("action"), F.struct("ts", "event_id").alias("at")))


def library_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's list after all actions, in order."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("seq"))
    return _lists(spark, sf_dir).select("user_id", place.alias("place"), "paper_id")


def library_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lists hold, in their order; ids that aren't there are skipped."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus", "o_totalprice")
    rows = library.papers_of(_lists(spark, sf_dir), orders)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("seq"))
    return rows.select("user_id", place.alias("place"), "paper_id", "o_orderstatus", "o_totalprice")


QUERIES = {f.__name__: f for f in (library_toggle, library_join)}

#: One action after the other, for each user and paper.
_FOLD = f"""WITH a AS (SELECT user_id, event_id % {ITEMS} AS p, event_type AS t, row_number() OVER (ORDER BY ts, event_id) AS k FROM events WHERE event_type <> 'signup'),
    s AS (SELECT user_id, p, list_reduce(list({{'on': t = 'none', 'since': 0::BIGINT, 't': t, 'k': k}} ORDER BY k), lambda x, y: {{'on': CASE y.t WHEN 'purchase' THEN true WHEN 'error' THEN false ELSE NOT x."on" END,
      'since': CASE WHEN NOT x."on" AND y.t <> 'error' THEN y.k ELSE x.since END, 't': y.t, 'k': y.k}}, {{'on': false, 'since': 0::BIGINT, 't': '', 'k': 0::BIGINT}}) AS f FROM a GROUP BY user_id, p),
    kept AS (SELECT user_id, p, f.since AS since FROM s WHERE f."on")"""
ORACLE_SQL = {
    "library_toggle": f"{_FOLD} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY since)::INT AS place, p::VARCHAR AS paper_id FROM kept",
    "library_join": f"{_FOLD} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY since)::INT AS place, p::VARCHAR AS paper_id, o_orderstatus, o_totalprice FROM kept JOIN orders ON o_orderkey = p",
}
