"""The index of venues: one nested row for each, written only if every row holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..rules import tables as R
from .recommend import words

#: Papers without which a venue needs a deadline to be listed; papers shown, their main words and characters.
LEAST, SHOWN, MAIN, CHARS, TAGS = 8, 18, 32, 260, 6
VENUES = 10
EXPECTED = 4


def expectations(field: Column, kind: Column, rank: Column) -> Column:
    """What reviewers look for: that of the field, the usual kind of paper, and selectivity at A*; four at most."""
    known = F.create_map(*[x for f, texts in R.FIELD_EXPECTATIONS.items() for x in (F.lit(f), F.array(*map(F.lit, texts)))])
    usual = F.concat(F.lit("Recent accepted papers skew toward "), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit("; make that contribution type explicit."))
    top = F.when(rank == "A*", "Top-tier selectivity means reviewers will expect novelty, depth, and polished evidence.")
    every = F.concat(F.coalesce(F.try_element_at(known, field), F.array(*map(F.lit, R.GENERIC_EXPECTATIONS))), F.array(F.when(kind != "", usual), top))
    return F.slice(F.filter(every, lambda t: t.isNotNull()), 1, EXPECTED)


def _common(rows: DataFrame, column: str) -> DataFrame:
    """The value of a venue's rows that most have, the smallest on a tie; blanks and nulls don't count."""
    return rows.where(F.col(column) != "").groupBy("venue").agg(F.mode(column, True).alias(column))


def accepted(papers: DataFrame) -> DataFrame:
    """``venue, accepted_papers``: the first 18 by rank, each with its 32 most frequent words, ties in order of text."""
    best = papers.where(F.col("rank") <= SHOWN)
    said = best.select("venue", "rank", F.posexplode(words(F.col("text"))).alias("at", "word"))
    counts = said.groupBy("venue", "rank", "word").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    placed = counts.withColumn("k", F.row_number().over(Window.partitionBy("venue", "rank").orderBy(F.desc("n"), "at"))).where(F.col("k") <= MAIN)
    main = placed.groupBy("venue", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias("terms"))
    paper = F.struct("rank", "id", "title", "year", F.col("paper_url").alias("url"), F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, TAGS).alias("tags"), F.left(F.coalesce("abstract", F.lit("")), F.lit(CHARS)).alias("abstract"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    return best.join(main, ["venue", "rank"], "left").groupBy("venue").agg(F.transform(F.array_sort(F.collect_list(paper)), lambda x: x.dropFields("rank")).alias("accepted_papers"))


def build(papers: DataFrame, fields: DataFrame, profile: DataFrame, deadlines: DataFrame) -> DataFrame:
    """One row for each venue of eight or more papers, or with a deadline.

    ``papers``: venue, rank (place among the venue's papers), n (their number), id, title,
    abstract, text, tags, year, paper_url, paper_type, conference_rank; ``fields``: venue,
    field; ``profile``: venue, place, term, weight; ``deadlines``: short, name, area, rank,
    paper_deadline, one row for each short.  A deadline's area, if known, and its rank come
    before what the papers say.  Names lose their year.  Venues without papers aren't listed.
    """
    sizes = papers.groupBy("venue").agg(F.max("n").alias("paper_count"))
    due = deadlines.select(F.lower("short").alias("_short"), F.col("name").alias("_name"), F.col("area").alias("_area"), F.col("rank").alias("_rank"), F.struct("name", "short", "area", "rank", "paper_deadline").alias("deadline"))
    listed = sizes.join(due, F.lower("venue") == F.col("_short"), "left").where((F.col("paper_count") >= LEAST) | F.col("deadline").isNotNull())
    weighted = profile.groupBy("venue").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term", "weight"))), lambda x: x.dropFields("place")).alias("weighted_keywords"))
    rows = listed
    for part in (fields, weighted, accepted(papers), _common(papers, "paper_type"), _common(papers, "conference_rank")):
        rows = rows.join(part, "venue", "left")
    field = F.when(F.col("_area").isin(list(R.VENUE_HINTS)), F.col("_area")).otherwise(F.coalesce("field", F.lit("ML")))
    rank = F.coalesce(F.nullif("_rank", F.lit("")), F.col("conference_rank"), F.lit(""))
    name = F.coalesce(F.nullif(F.trim(F.regexp_replace(F.trim("_name"), r"\s+20\d{2}\b", "")), F.lit("")), F.col("venue"))
    short = F.trim(F.regexp_replace(F.lower("venue"), "[^a-z0-9]+", " "))
    shaped = rows.select(
        F.replace(short, F.lit(" "), F.lit("-")).alias("id"), F.col("venue").alias("short"), name.alias("name"), F.lit("conference").alias("type"), field.alias("field"), rank.alias("rank"), "paper_count",
        F.coalesce("weighted_keywords", F.array().cast("array<struct<term:string,weight:double>>")).alias("weighted_keywords"), F.coalesce("paper_type", F.lit("")).alias("_kind"), "deadline", "accepted_papers",
    )
    return shaped.withColumns({"keywords": F.transform("weighted_keywords", lambda k: k["term"]), "expectations": expectations(F.col("field"), F.col("_kind"), F.col("rank"))}).drop("_kind")


#: What a row must not be.
VIOLATIONS = {
    "no id": lambda: F.coalesce(F.col("id"), F.lit("")) == "",
    "wrong type": lambda: ~F.col("type").eqNullSafe(F.lit("conference")),
    "no keywords": lambda: F.coalesce(F.size("keywords"), F.lit(0)) < 1,
    "no weighted keywords": lambda: F.coalesce(F.size("weighted_keywords"), F.lit(0)) < 1,
    "weight not in (0, 1]": lambda: F.coalesce(F.exists("weighted_keywords", lambda k: ~F.coalesce((k["weight"] > 0) & (k["weight"] <= 1), F.lit(False))), F.lit(False)),
    "keyword without term": lambda: F.coalesce(F.exists("weighted_keywords", lambda k: k["term"].isNull()), F.lit(False)),
    "no expectations": lambda: F.coalesce(F.size("expectations"), F.lit(0)) < 1,
    "paper without a title, year, url or terms": lambda: F.coalesce(F.exists("accepted_papers", lambda p: p["title"].isNull() | p["year"].isNull() | p["url"].isNull() | p["terms"].isNull()), F.lit(False)),
}


def write(index: DataFrame, path: str, least: int = VENUES) -> int:
    """Writes the index as JSON lines and returns its rows; one with fewer than ``least`` rows or with violations is refused with their counts.

    Violations are counted while the rows are written, to a folder beside ``path``, which
    takes its place only then: one pass, and no reader sees an index that doesn't hold.
    """
    spark, seen = index.sparkSession, Observation()
    counts = [F.count_if(bad()).alias(name) for name, bad in VIOLATIONS.items()]
    draft = f"{path.rstrip('/')}.draft"
    index.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.mode("overwrite").json(draft)
    found = seen.get
    faults = {name: n for name, n in found.items() if name != "rows" and n}
    if found["rows"] < least:
        faults["rows"] = found["rows"]
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new = hadoop.Path(path), hadoop.Path(draft)
    files = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if faults:
        files.delete(new, True)
        raise ValueError(f"the index does not hold: {faults}")
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{draft} could not take the place of {path}")
    return found["rows"]
