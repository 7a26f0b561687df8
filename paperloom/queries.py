"""All queries of the library: what Spark runs, and the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions.dialect import DUCK, Spark
from .plans import dedup, graph, library, recommend, records
from .plans import venues as _venues  # noqa: F401  registers its queries
from .plans.corpus import QUERIES as _SQL
from .plans.scored import scored
from .sources.corpus import corpus
from .streaming.events import windowed_counts


_GAPS = "pos tags paper_score abstract told"
_LABS = "pos year paper_score conference_rank affiliations_raw told"
#: Queries whose relations are read more than once: the rules run first, into a table of the columns that the query reads.
STAGED = {
    "tfidf_profile": "pos venue year paper_score title abstract",
    "recommend_venues": "pos venue year paper_score title abstract",
    "similar_papers": "pos venue year paper_score title abstract tags",
    "gap_union_dedup": _GAPS, "gap_browse": _GAPS, "editorial_gap": _GAPS,
    "lab_momentum": _LABS, "editorial_rising_lab": _LABS,
    "cross_entity_search": "pos id title authors paper_score",
    "topic_related": "tags",
    "browse_filter_page": "pos id title abstract paper_score difficulty_level",
    "graph_inputs": "pos id title abstract year tags paper_score read_first_score",
}


def _runner(name: str, make: Callable[[Spark], str]) -> Callable[[SparkSession, str], DataFrame]:
    if name in STAGED:
        return lambda spark, sf_dir: spark.sql(make(scored(spark, sf_dir, STAGED[name].split())))
    return lambda spark, sf_dir: spark.sql(make(corpus(spark, sf_dir)))


def _event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))


_EVENT_WINDOWS = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value::DECIMAL(20, 6)), 6)::DOUBLE AS total FROM events GROUP BY 1, 2"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = graph.QUERIES | dedup.QUERIES | library.QUERIES | recommend.QUERIES | records.QUERIES | {"event_windows": _event_windows}
    return {name: _runner(name, make) for name, make in _SQL.items()} | own


def oracle_sql() -> dict[str, str]:
    return {name: make(DUCK) for name, make in _SQL.items()} | graph.ORACLE_SQL | dedup.ORACLE_SQL | library.ORACLE_SQL | recommend.ORACLE_SQL | records.ORACLE_SQL | {"event_windows": _EVENT_WINDOWS}
