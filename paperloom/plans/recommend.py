"""Queries on keywords of venues and the venues that fit drafts; the SQL they are held against is written apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions.dialect import DUCK, Spark
from ..operators import recommend as O
from ..operators import venueindex as V
from ..rules import tables as R
from .corpus import chain, tfidf_profile
from .scored import scored
from .stage import staged

#: Papers of a venue that its profile is made from, and papers without which it has none.
BEST, LEAST = 250, 8
IGNORED = ["", "arxiv", "corr", "unknown", "openreview", "jmlr", "tacl", "tpami"]


def _venue_papers(spark: SparkSession, d: Spark) -> DataFrame:
    """Ranked papers of the venues that have profiles."""
    rows = spark.table(d.scored).where(F.col("source_type").isin("", "conference") & ~F.lower("venue").isin(IGNORED))
    best = Window.partitionBy("venue").orderBy(F.desc("paper_score"), F.desc("year"), "pos")
    ranked = rows.select("venue", "conference_rank", "tags", "id", "title", "abstract", "year", "paper_url", "paper_type", F.concat_ws(" ", "title", "abstract", F.array_join("tags", " ")).alias("text"), F.row_number().over(best).alias("rank"))
    sizes = rows.groupBy("venue").agg(F.count(F.lit(1)).alias("n"))
    return ranked.where(F.col("rank") <= BEST).join(sizes.where(F.col("n") >= LEAST), "venue")


def _keywords(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    fields = staged(O.venue_fields(papers), "venue-fields")
    ranks = papers.where("conference_rank <> ''").groupBy("venue").agg(F.mode("conference_rank", True).alias("rank"))
    return fields.join(ranks, "venue", "left").select("venue", "field", "rank"), O.derived_keywords(papers, fields)


def venue_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each venue's keywords without weights, in order."""
    return _keywords(staged(_venue_papers(spark, scored(spark, sf_dir)), "venue-papers"))[1]


def _profiles(spark: SparkSession, d: Spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers, venues and profiles."""
    papers = staged(_venue_papers(spark, d), "venue-papers")
    venues, keywords = _keywords(papers)
    weights = spark.sql(tfidf_profile(d)).join(venues, "venue", "left_semi")
    return papers, venues, staged(O.profiles(weights, keywords), "venue-profiles")


def venue_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of venues, its nested parts joined to texts; two of the venues have a deadline."""
    papers, venues, profile = _profiles(spark, scored(spark, sf_dir))
    key = F.col("n_nationkey")
    short = F.element_at(F.array(F.lit("neurips"), F.lit("ACL"), F.lit("none")), (key + 1).cast("int"))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").where(key < 3)
    due = nations.select(short.alias("short"), F.concat_ws(" ", "n_name", F.lit("2026")).alias("name"), F.when(key == 1, "IR").otherwise("odd").alias("area"), F.when(key == 1, "B").otherwise("").alias("rank"), F.lit("2026-09-01").alias("paper_deadline"))
    rows = V.build(papers, venues.drop("rank"), profile, due)

    def joined(items: str, part: str) -> Column:
        return F.array_join(F.transform(items, lambda x: x[part].cast("string")), "|")

    terms = F.array_join(F.transform("accepted_papers", lambda p: F.array_join(p["terms"], " ")), "|")
    return rows.select("id", "short", "name", "field", "rank", "paper_count", F.array_join("keywords", "|").alias("keywords"), F.array_join("expectations", "|").alias("expectations"), F.col("deadline.short").alias("due"), joined("accepted_papers", "title").alias("titles"), F.md5(terms.cast("binary")).alias("terms_md5"))


def venue_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paper as a draft, in turn of each stage, with a field that is inferred, of no matter, or given."""
    d = scored(spark, sf_dir)
    _, venues, profile = _profiles(spark, d)
    stage = F.element_at(F.array(*map(F.lit, ("any", "early", "solid", "mature"))), (F.col("pos") % 4 + 1).cast("int"))
    field = F.element_at(F.array(*map(F.lit, ("auto", "any", "NLP"))), (F.col("pos") % 3 + 1).cast("int"))
    drafts = spark.table(d.scored).select(F.col("pos").alias("draft"), F.concat_ws(" ", "title", "abstract").alias("text"), field.alias("field"), stage.alias("stage"))
    return O.recommend(drafts, venues, profile).withColumn("matched", F.array_join("matched", "|"))


QUERIES = {f.__name__: f for f in (venue_keywords, venue_fits, venue_index)}

_WS = T.tokens(DUCK, "body")
_TEXTS = ", ".join(map(DUCK.text, IGNORED))
_HINTS = ", ".join(f"({DUCK.text(f)}, {DUCK.text(t)}, {i})" for i, (f, ts) in enumerate(R.VENUE_HINTS.items()) for t in ts)
_DRAFT_HINTS = ", ".join(f"({DUCK.text(f)}, {DUCK.text(t)}, {i})" for i, (f, ts) in enumerate(R.DRAFT_HINTS.items()) for t in ts)
_FILLER = ", ".join(map(DUCK.text, R.PLACEHOLDER_WORDS))
_KEYS = f"""hinted(field, hint, place) AS (VALUES {_HINTS}),
    own AS (SELECT venue, conference_rank, tags, title, paper_type, concat_ws(' ', title, abstract, array_to_string(tags, ' ')) AS body, row_number() OVER (PARTITION BY venue ORDER BY paper_score DESC, year DESC, pos) AS rk, count(*) OVER (PARTITION BY venue) AS size
      FROM scored WHERE source_type IN ('', 'conference') AND lower(venue) NOT IN ({_TEXTS})),
    said AS MATERIALIZED (SELECT venue, conference_rank, title, paper_type, size, rk, {_WS} AS ws, list_filter(list_transform(tags, lambda x: lower(trim(x))), lambda x: x <> '') AS ts FROM own WHERE rk <= {BEST} AND size >= {LEAST}),
    tag_words AS (SELECT venue, rk, list_filter({T.tokens(DUCK, "array_to_string(ts, ' ')")}, lambda x: true) AS tw FROM said),
    hit AS (SELECT venue, field, place, count(*) AS n FROM (SELECT venue, unnest(ws) AS w FROM said WHERE rk <= {O.FIELD_PAPERS} UNION ALL SELECT venue, unnest(tw) FROM tag_words WHERE rk <= {O.FIELD_PAPERS}) u JOIN hinted ON w = hint GROUP BY ALL),
    venue_field AS (SELECT DISTINCT said.venue, coalesce((SELECT field FROM hit WHERE hit.venue = said.venue ORDER BY n DESC, place LIMIT 1), 'ML') AS field FROM said),
    phrase_rows AS (SELECT venue, unnest(ts) AS item, {O.TAG_POINTS} AS p, rk * 1000000000000 + generate_subscripts(ts, 1) AS seen FROM said
      UNION ALL SELECT venue, ws[i] || ' ' || ws[i + 1], 1, rk * 1000000000000 + 100000000000 + i FROM (SELECT venue, rk, ws, unnest(range(1, len(ws))) AS i FROM said) x WHERE ws[i] <> ws[i + 1]),
    term_rows AS (SELECT venue, unnest(ws) AS item, rk * 1000000000000 + generate_subscripts(ws, 1) AS seen FROM said UNION ALL SELECT venue, unnest(tw), rk * 1000000000000 + 100000000000 + generate_subscripts(tw, 1) FROM tag_words),
    phrases AS (SELECT venue, item, row_number() OVER (PARTITION BY venue ORDER BY sum(p) DESC, min(seen)) AS k FROM phrase_rows GROUP BY venue, item QUALIFY k <= {O.PHRASES}),
    singles AS (SELECT venue, item, row_number() OVER (PARTITION BY venue ORDER BY count(*) DESC, min(seen)) AS k FROM term_rows GROUP BY venue, item QUALIFY k <= {O.TERMS}),
    layers AS (SELECT venue, hint AS item, 0 AS l, row_number() OVER (PARTITION BY venue ORDER BY hint) AS k FROM venue_field JOIN hinted USING (field)
      UNION ALL SELECT venue, item, 1, k FROM phrases WHERE len(item) BETWEEN 3 AND 56 UNION ALL SELECT venue, item, 2, k FROM singles),
    keyed AS (SELECT venue, item, row_number() OVER (PARTITION BY venue ORDER BY min(l * 1000 + k)) AS place FROM layers GROUP BY venue, item),
    keywords AS MATERIALIZED (SELECT venue, place::INT AS place, item AS term FROM keyed WHERE place <= {O.KEYWORDS})"""
_TFIDF = tfidf_profile(DUCK)
_WEIGHTS = _TFIDF[: _TFIDF.rindex("SELECT venue, term")].rstrip()
_FILLED = f"""heavy AS (SELECT venue, term, greatest(weight, 0.0001e0) AS weight, row_number() OVER (PARTITION BY venue ORDER BY greatest(weight, 0.0001e0) DESC, term) AS place FROM ranked WHERE rn <= {O.KEYWORDS} AND venue IN (SELECT venue FROM venue_field)),
    filled AS (SELECT venue, term, weight, place FROM heavy UNION ALL SELECT k.venue, k.term, CASE WHEN had IS NULL THEN 0.35 ELSE 0.2 END, coalesce(had, 0) + row_number() OVER (PARTITION BY k.venue ORDER BY k.place)
      FROM keywords k LEFT JOIN (SELECT venue, count(*) AS had FROM heavy GROUP BY venue) c ON c.venue = k.venue WHERE (k.venue, k.term) NOT IN (SELECT (venue, term) FROM heavy)),
    cut AS (SELECT venue, place, term, weight, {T.tokens(DUCK, 'term')} AS parts FROM filled WHERE place <= {O.KEYWORDS})"""
ORACLE_SQL = {
    "venue_keywords": f"{chain(DUCK, 'scored')}, {_KEYS} SELECT venue, place, term FROM keywords",
    "venue_fits": f"""{_WEIGHTS}, {_KEYS},
    {_FILLED},
    spread AS MATERIALIZED (SELECT venue, place, term, weight, len(parts) AS n, unnest(parts) AS part FROM cut),
    drawn AS (SELECT pos, concat_ws(' ', title, abstract) AS body FROM scored),
    split AS (SELECT pos, body, {_WS} AS ws FROM drawn),
    told AS (SELECT pos, body, ws, list_filter(ws, lambda x: x NOT IN ({_FILLER})) AS tw FROM split),
    fine AS MATERIALIZED (SELECT pos, list_distinct(tw) AS dw FROM told WHERE len(trim(body)) >= 80 AND NOT regexp_matches(body, '\\blorem\\s+ipsum\\b', 'i') AND len(ws) - len(tw) < 0.35e0 * len(ws) AND len(tw) >= 35 AND len(list_distinct(tw)) >= 18),
    draft_hint(field, hint, place) AS (VALUES {_DRAFT_HINTS}),
    guess AS (SELECT pos, arg_min(field, -n * 100 + place) AS field FROM (SELECT pos, field, place, count(*) AS n FROM (SELECT pos, unnest(dw) AS w FROM fine) JOIN draft_hint ON w = hint GROUP BY ALL) GROUP BY pos),
    wish AS (SELECT fine.pos, CASE fine.pos % 3 WHEN 0 THEN coalesce(guess.field, 'ML') WHEN 1 THEN 'any' ELSE 'NLP' END AS wanted FROM fine LEFT JOIN guess ON guess.pos = fine.pos),
    met AS (SELECT pos, venue, place, term, weight, n, count(*) AS h FROM (SELECT pos, unnest(dw) AS part FROM fine) JOIN spread USING (part) GROUP BY ALL),
    summed AS (SELECT pos, venue, round(sum(weight * CASE WHEN h < n THEN 4.0e0 * h / n WHEN n > 1 THEN 18.0e0 ELSE 12.0e0 END), 6) AS overlap, list(term ORDER BY place) FILTER (WHERE h = n) AS terms FROM met GROUP BY pos, venue),
    top AS (SELECT venue, mode(conference_rank) AS rank FROM said WHERE conference_rank <> '' GROUP BY venue),
    judged AS (SELECT s.pos, s.venue, wanted, overlap, coalesce(terms, []) AS terms, CASE wanted WHEN 'any' THEN 0.0e0 WHEN f.field THEN 8.0e0 ELSE -4.0e0 END AS field_points,
      CASE s.pos % 4 WHEN 2 THEN 3.0e0 WHEN 3 THEN CASE WHEN rank = 'A*' THEN 3.0e0 ELSE 0.0e0 END WHEN 1 THEN CASE WHEN rank = 'A*' THEN -5.0e0 ELSE 0.0e0 END ELSE 0.0e0 END AS maturity_points, CASE WHEN rank = 'A*' THEN 2.0e0 ELSE 0.0e0 END AS rank_points
      FROM summed s JOIN wish USING (pos) JOIN venue_field f ON f.venue = s.venue LEFT JOIN top ON top.venue = s.venue),
    marks AS (SELECT *, round(greatest(0.0e0, overlap + field_points + maturity_points + rank_points), 4) AS score FROM judged),
    ordered AS (SELECT *, row_number() OVER w AS place, len(first_value(terms) OVER w) AS lead FROM marks WHERE len(terms) > 0 OR score >= 14 WINDOW w AS (PARTITION BY pos ORDER BY score DESC, venue))
    SELECT pos AS draft, place::INT AS place, venue, wanted, round(overlap, 4) AS overlap, field_points, maturity_points, rank_points, score, CASE WHEN score >= 24 THEN 'Strong fit' WHEN score >= 14 THEN 'Moderate fit' ELSE 'Stretch fit' END AS fit,
      array_to_string(terms[1:10], '|') AS matched FROM ordered WHERE place <= 8 AND lead > 0""",
    "venue_index": f"""{_WEIGHTS}, {_KEYS}, {_FILLED},
    due(short, area, rank, k) AS (VALUES ('neurips', 'odd', '', 0), ('acl', 'IR', 'B', 1)),
    dues AS (SELECT due.*, n_name || ' 2026' AS name FROM due JOIN nation ON n_nationkey = k),
    kinds AS (SELECT venue, paper_type AS kind, row_number() OVER (PARTITION BY venue ORDER BY count(*) DESC, paper_type) AS o FROM said WHERE paper_type <> '' GROUP BY venue, paper_type),
    stars AS (SELECT venue, conference_rank AS star, row_number() OVER (PARTITION BY venue ORDER BY count(*) DESC, conference_rank) AS o FROM said WHERE conference_rank <> '' GROUP BY venue, conference_rank),
    seen AS (SELECT venue, rk, w, count(*) AS n, min(i) AS i FROM (SELECT venue, rk, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM said WHERE rk <= 18) GROUP BY ALL),
    main AS (SELECT venue, rk, array_to_string(list(w ORDER BY n DESC, i)[1:32], ' ') AS terms FROM seen GROUP BY venue, rk),
    shown AS (SELECT s.venue, array_to_string(list(s.title ORDER BY s.rk), '|') AS titles, md5(array_to_string(list(coalesce(terms, '') ORDER BY s.rk), '|')) AS terms_md5, max(size) AS paper_count FROM said s LEFT JOIN main m ON m.venue = s.venue AND m.rk = s.rk WHERE s.rk <= 18 GROUP BY s.venue),
    words AS (SELECT venue, array_to_string(list(term ORDER BY place), '|') AS keywords FROM cut GROUP BY venue),
    looks(field, texts) AS (VALUES {', '.join(f"({DUCK.text(f)}, {DUCK.text('|'.join(t))})" for f, t in R.FIELD_EXPECTATIONS.items())}),
    whole AS (SELECT s.venue, CASE WHEN area = 'IR' THEN area ELSE f.field END AS field, coalesce(nullif(d.rank, ''), star, '') AS rank, coalesce(d.name, s.venue) AS name, CASE WHEN s.venue = 'ACL' THEN 'ACL' ELSE d.short END AS due, kind, titles, terms_md5, paper_count, keywords
      FROM shown s JOIN venue_field f USING (venue) JOIN words USING (venue) LEFT JOIN dues d ON d.short = lower(s.venue) LEFT JOIN kinds ON kinds.venue = s.venue AND kinds.o = 1 LEFT JOIN stars ON stars.venue = s.venue AND stars.o = 1)
    SELECT lower(venue) AS id, venue AS short, replace(name, ' 2026', '') AS name, whole.field AS field, rank, paper_count, keywords,
      texts || CASE WHEN kind IS NOT NULL THEN '|Recent accepted papers skew toward ' || replace(kind, '_', ' ') || '; make that contribution type explicit.' WHEN rank = 'A*' THEN '|Top-tier selectivity means reviewers will expect novelty, depth, and polished evidence.' ELSE '' END AS expectations, due, titles, terms_md5
    FROM whole JOIN looks ON looks.field = whole.field""",
}
