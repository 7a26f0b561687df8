"""Record schemas and the defaults that absent columns take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())

#: Column, type, default.
PAPER_FIELDS: list[tuple[str, T.DataType, object]] = [
    *((c, T.StringType(), "") for c in ("id", "canonical_id", "source", "source_type", "title", "abstract")),
    ("authors", _TEXTS, []),
    ("affiliations_raw", _TEXTS, []),
    ("year", T.IntegerType(), 0),
    *((c, T.StringType(), "") for c in ("published_date", "venue", "conference_rank", "paper_url", "pdf_url")),
    ("citations", T.LongType(), 0),
    ("tags", _TEXTS, []),
    *((c, T.StringType(), "") for c in ("paper_type", "difficulty_level", "difficulty_reason", "summary")),
    ("limitations", _TEXTS, []),
    ("future_work", _TEXTS, []),
]
PAPER = T.StructType([T.StructField(n, t) for n, t, _ in PAPER_FIELDS])


def with_defaults(papers: DataFrame) -> DataFrame:
    """Adds the columns of PAPER that are absent and fills nulls; other columns stay."""
    filled = {}
    for name, kind, default in PAPER_FIELDS:
        value = F.array().cast(kind) if default == [] else F.lit(default).cast(kind)
        filled[name] = F.coalesce(F.col(name).cast(kind), value) if name in papers.columns else value
    return papers.withColumns(filled)


def normalize_legacy(papers: DataFrame) -> DataFrame:
    """Old names and words: ``url`` for paper_url, a difficulty word for the level."""
    if "url" in papers.columns:
        known = F.col("paper_url") if "paper_url" in papers.columns else F.lit(None).cast("string")
        papers = papers.withColumn("paper_url", F.coalesce(F.nullif(known, F.lit("")), F.col("url"))).drop("url")
    if "difficulty" in papers.columns:
        words = F.create_map(*[F.lit(x) for pair in (("beginner", "L1"), ("intermediate", "L2"), ("advanced", "L3"), ("frontier", "L4")) for x in pair])
        given = F.try_element_at(words, F.lower("difficulty"))
        known = F.col("difficulty_level") if "difficulty_level" in papers.columns else F.lit(None).cast("string")
        papers = papers.withColumn("difficulty_level", F.coalesce(F.nullif(known, F.lit("")), given, F.lit("L2"))).drop("difficulty")
    return with_defaults(papers)
