"""Row operators on papers: DataFrame in, DataFrame out.

Input columns are those of ``schemas.PAPER``; missing ones take its defaults.
Every operator is one projection of built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions.dialect import SPARK
from ..rules import tables as R
from ..schemas import with_defaults


def _barrier(df: DataFrame) -> DataFrame:
    """Keeps later filters from being rewritten in terms of the rules; see plans.corpus."""
    return df.select(F.inline_outer(F.array(F.struct("*"))))


def _without(arr: str, gone: list[str]) -> Column:
    return F.filter(arr, lambda x: ~x.isin(gone))


def tag(papers: DataFrame) -> DataFrame:
    """``tags``: built-in ones by priority, then those given, five at most; ``paper_type`` where none is set."""
    rows = with_defaults(papers)
    cols = rows.columns
    rows = rows.withColumn("tags0", F.col("tags")).withColumn("txt", F.expr(S.TEXT))
    rows = rows.withColumn("kept_tags", F.expr(S.matched_tags(SPARK)))
    for name, gone in R.SUPERSEDED:
        kept = _without("kept_tags", gone)
        rows = _barrier(rows.withColumn("kept_tags", F.when(F.array_contains("kept_tags", name), kept).otherwise(F.col("kept_tags"))))
    found = F.expr(S.cascade(SPARK, "txt", R.PAPER_TYPES, SPARK.text(R.DEFAULT_TYPE)))
    rows = rows.withColumns({
        "tags": F.expr(SPARK.slice(SPARK.concat("kept_tags", S.custom_tags(SPARK)), 5)),
        "paper_type": F.when(F.col("paper_type") == "", found).otherwise(F.col("paper_type")),
    })
    return _barrier(rows.select(*cols))


def assess(papers: DataFrame) -> DataFrame:
    """``difficulty_level`` and ``difficulty_reason`` from text, tags and type."""
    rows = with_defaults(papers)
    cols = rows.columns
    rows = rows.withColumn("txt", F.expr(S.TEXT)).withColumn("difficulty_level", F.expr(S.level(SPARK)))
    return rows.withColumn("difficulty_reason", F.expr(S.level_reason(SPARK))).select(*cols)


def score(papers: DataFrame, as_of_year: int, weights: dict[str, float] | None = None) -> DataFrame:
    """The three scores, interestingness and the components as ``score_breakdown``."""
    rows = with_defaults(papers)
    cols = [c for c in rows.columns if c != "score_breakdown"]
    rows = rows.withColumn("txt", F.expr(S.TEXT))
    summary = "CASE WHEN summary <> '' THEN 1.5e0 ELSE 0e0 END + CASE WHEN size(limitations) > 0 THEN 1.0e0 ELSE 0e0 END"
    parts = {
        "recency": S.recency(as_of_year), "novelty": S.novelty(SPARK), "quality_hint": S.quality_hint(), "completeness": f"least({S.completeness(SPARK)} + {summary}, 10.0e0)",
        "institution_prestige": S.institution(SPARK), "clarity": S.clarity(SPARK), "foundational": S.capped(SPARK, R.FOUNDATIONAL, 3.0), "accessibility": S.accessibility(), "topic_centrality": S.hot(SPARK),
        "surprise": S.capped(SPARK, R.SURPRISE, 3.0), "practical_value": S.capped(SPARK, R.PRACTICAL, 1.5), "explainability": S.capped(SPARK, R.EXPLAIN, 2.0), "broad_relevance": S.capped(SPARK, R.BROAD, 1.5),
    }
    rows = rows.withColumns({k: F.expr(v) for k, v in parts.items()}).withColumn("author_prestige", F.expr(S.author(SPARK)))
    rows = rows.withColumns({
        "paper_score": F.expr(S.weighted(weights or S.WEIGHTS["configured"])),
        "read_first_score": F.expr(S.clamped("0.3e0 * clarity + 0.25e0 * foundational + 0.25e0 * accessibility + 0.2e0 * topic_centrality")),
        "content_potential_score": F.expr(S.clamped("0.25e0 * surprise + 0.25e0 * practical_value + 0.2e0 * explainability + 0.2e0 * broad_relevance + 0.1e0 * topic_centrality")),
    })
    rows = rows.withColumn("interestingness_score", F.round(F.round(0.5 * F.col("paper_score") + 0.5 * F.col("content_potential_score"), 6), 2))
    breakdown = F.struct(*[F.round(c, 2).alias(c) for c in [*parts, "author_prestige"]]).alias("score_breakdown")
    scores = ["paper_score", "read_first_score", "content_potential_score", "interestingness_score"]
    return rows.select(*[c for c in cols if c not in scores], *scores, breakdown)


def affiliations(papers: DataFrame) -> DataFrame:
    """``affiliations``: those given, else every lab and then university named in title and abstract."""
    rows = with_defaults(papers).withColumn("txt", F.expr(S.TEXT))
    found = SPARK.filter(SPARK.array(*[f"CASE WHEN {SPARK.like('txt', p)} THEN {SPARK.text(n)} END" for n, p in [*R.LABS, *R.UNIVERSITIES]]), "x IS NOT NULL")
    return rows.withColumn("affiliations", F.when(F.size("affiliations_raw") > 0, F.col("affiliations_raw")).otherwise(F.expr(found))).drop("txt")


def lab_of(x: str) -> str:
    return S.cascade(SPARK, x, R.LABS, "NULL")


def university_of(x: str) -> str:
    return S.cascade(SPARK, x, R.UNIVERSITIES, "NULL")


def search_entry(papers: DataFrame) -> DataFrame:
    return papers.select("id", "title", F.left("abstract", F.lit(300)).alias("abstract"), F.slice("authors", 1, 5).alias("authors"), F.slice("tags", 1, 5).alias("tags"), F.round("paper_score", 1).alias("paper_score"), "year", "venue", "difficulty_level")


def browse(papers: DataFrame, search: str = "", tags: list[str] | None = None, page: int = 1, page_size: int = 25, sort: str = "paper_score", **equal: object) -> DataFrame:
    """A page of papers and ``n_all``, the number of all that match.  Wildcards in ``search`` are taken as given."""
    rows = papers
    if search:
        rows = rows.where(F.col("title").ilike(f"%{search}%") | F.col("abstract").ilike(f"%{search}%"))
    if tags:
        rows = rows.where(F.arrays_overlap("tags", F.lit(tags)))
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    total = rows.agg(F.count(F.lit(1))).first()[0]
    first = F.col(sort).asc() if sort == "title" else F.col(sort).desc()
    return rows.orderBy(first, "id").offset((page - 1) * page_size).limit(page_size).withColumn("n_all", F.lit(total))


def rank(papers: DataFrame, as_of: str, citations: float = 1.0, recency: float = 1.0) -> DataFrame:
    """Citations and recency in months weighed against each other; papers without a date have no recency."""
    days = F.datediff(F.lit(as_of).cast("date"), F.try_to_date("published_date", F.lit("yyyy-MM-dd")))
    fresh = F.coalesce(F.greatest(F.lit(0.0), 365 - days / 30.0), F.lit(0.0))
    return papers.withColumn("rank_score", citations * F.col("citations") + recency * fresh).orderBy(F.desc("rank_score"), "id")


def norm_title(x: str) -> str:
    return T.norm_title(SPARK, x)
