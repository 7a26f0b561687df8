"""Queries on de-duplication: Spark runs the operators, the SQL they are held against goes row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dialect import DUCK
from ..operators import dedup
from ..sources.corpus import corpus
from . import corpus as C
from .stage import staged


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark.sql(f"{C.chain(corpus(spark, sf_dir), 'papers')} SELECT * FROM papers").withColumnRenamed("tags0", "tags"), "dedup-papers")


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("pos", "id", "title", "pdf_url", "citations", F.array_join("affiliations_raw", "|").alias("affiliations"), F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"))


def dedup_title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.title_pairs(_papers(spark, sf_dir)).select("p", "q", F.round("similarity", 6).alias("similarity"))


def dedup_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.leaders(_papers(spark, sf_dir))


def dedup_exact_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(dedup.fold_exact(_papers(spark, sf_dir)))


def dedup_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(dedup.deduplicate(_papers(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (dedup_title_pairs, dedup_leaders, dedup_exact_best, dedup_papers)}

_POINTS = "len(authors) + len(tags0) + CASE WHEN coalesce(venue, '') NOT IN ('', 'arXiv', 'Unknown') THEN 5 ELSE 0 END + CASE WHEN conference_rank <> '' THEN 3 ELSE 0 END"


def _points(row: str) -> str:
    return f"{row}.points + ({row}.abstract <> '')::INT + ({row}.pdf_url <> '')::INT + ({row}.citations > 0)::INT"


_FIELDS = ("id", "title", "points", "abstract", "pdf_url", "citations", "affiliations_raw")


def _row(row: str, other: str = "") -> str:
    """A row as a struct; with ``other`` what it lacks comes from there."""
    values = {n: f"{row}.{n}" for n in _FIELDS}
    if other:
        values |= {n: f"coalesce(nullif({row}.{n}, ''), {other}.{n})" for n in ("abstract", "pdf_url")}
        values["citations"] = f"CASE WHEN {row}.citations > 0 THEN {row}.citations ELSE {other}.citations END"
        values["affiliations_raw"] = f"CASE WHEN len({row}.affiliations_raw) > 0 THEN {row}.affiliations_raw ELSE {other}.affiliations_raw END"
    return "{" + ", ".join(f"'{n}': {v}" for n, v in values.items()) + "}"


def _folds(rows: str, group: str, name: str, fill_loser: bool) -> str:
    """The rows of a group in order of position: each is laid over what stands before it, the more complete one wins and is filled from the other."""
    step = f"CASE WHEN {_points('r')} > {_points('w.s')} THEN {_row('r', 'w.s')} ELSE {_row('w.s', 'r' if fill_loser else '')} END"
    return f"""{name}_turn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY pos) AS turn, min(pos) OVER (PARTITION BY {group}) AS place, count(*) OVER (PARTITION BY {group}) AS n FROM {rows}),
    {name}_walk AS (SELECT {group} AS g, place, turn, n, {_row('r')} AS s FROM {name}_turn r WHERE turn = 1
      UNION ALL SELECT w.g, w.place, r.turn, w.n, {step} FROM {name}_walk w JOIN {name}_turn r ON r.{group} = w.g AND r.turn = w.turn + 1),
    {name} AS MATERIALIZED (SELECT place AS pos, {', '.join(f's.{n} AS {n}' for n in _FIELDS)} FROM {name}_walk WHERE turn = n)"""


def _greedy(rows: str) -> str:
    """Leaders of the rows, one position after the other: a paper follows the first leader it is similar to."""
    title = T.norm_title(DUCK, "title")
    return f"""titled AS (SELECT pos, string_split({title}, ' ') AS w FROM {rows} WHERE {title} <> ''),
    bags AS (SELECT pos, list_distinct(w) AS ws, CASE WHEN len(w) < 2 THEN [w[1] || ' '] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END AS bs FROM titled),
    grams AS (SELECT DISTINCT pos, unnest(bs) AS g FROM bags), met AS (SELECT DISTINCT x.pos AS p, y.pos AS q FROM grams x JOIN grams y ON x.g = y.g AND x.pos < y.pos),
    alike AS (SELECT p, q FROM met JOIN bags a ON a.pos = p JOIN bags b ON b.pos = q WHERE len(list_intersect(a.ws, b.ws)) * 1.0e0 / len(list_distinct(list_concat(a.ws, b.ws))) >= 0.85),
    queue AS MATERIALIZED (SELECT q, list(p ORDER BY p) AS ps, row_number() OVER (ORDER BY q) AS k FROM alike GROUP BY q),
    pass AS (SELECT 0::BIGINT AS k, 0::BIGINT AS q, []::BIGINT[] AS led, NULL::BIGINT AS leader
      UNION ALL SELECT n.k, n.q, CASE WHEN len(list_filter(n.ps, lambda p: NOT list_contains(pass.led, p))) > 0 THEN list_append(pass.led, n.q) ELSE pass.led END, list_filter(n.ps, lambda p: NOT list_contains(pass.led, p))[1] FROM pass JOIN queue n ON n.k = pass.k + 1),
    leader AS MATERIALIZED (SELECT r.pos, coalesce(pass.leader, r.pos) AS leader FROM {rows} r LEFT JOIN pass ON pass.k > 0 AND pass.q = r.pos)"""


_HEAD = f"{C.chain(DUCK, 'papers').replace('WITH', 'WITH RECURSIVE', 1)}, keyed AS (SELECT *, coalesce({T.arxiv_id(DUCK, 'id', 'paper_url')}, 'own:' || pos) AS k, {_POINTS} AS points FROM papers)"
_SHOWN = "pos, id, title, pdf_url, citations, array_to_string(affiliations_raw, '|') AS affiliations, md5(abstract) AS abstract_md5"
ORACLE_SQL = {
    "dedup_leaders": f"{_HEAD}, {_greedy('papers')} SELECT pos, leader FROM leader",
    "dedup_exact_best": f"{_HEAD}, {_folds('keyed', 'k', 'folded', True)} SELECT {_SHOWN} FROM folded",
    "dedup_papers": f"{_HEAD}, {_folds('keyed', 'k', 'folded', True)}, {_greedy('folded')}, joined AS (SELECT f.*, leader FROM folded f JOIN leader USING (pos)), {_folds('joined', 'leader', 'kept', False)} SELECT {_SHOWN} FROM kept",
}
