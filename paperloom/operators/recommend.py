"""Venues for drafts: keywords of venues, phrases matched in whole or in part, fit and its parts.

Nulls: a null text has no words, null tags are none; rows of a null venue have no profile.
Ties are told apart by what stands first in the papers, then by venue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import tokens
from ..plans.stage import staged
from ..rules import tables as R

KEYWORDS = 85
PHRASES, TERMS, TAG_POINTS = 45, 55, 3
PHRASE_CHARS = (3, 56)
#: Weight of keywords that fill up a profile, and of those of a venue that has no weights at all.
FILL, ALONE = 0.2, 0.35
WORD_POINTS, PHRASE_POINTS, PART_POINTS = 12.0, 18.0, 4.0
FIELD_MATCH, FIELD_OTHER, STARRED = 8.0, -4.0, 2.0
STRONG, MODERATE = 24.0, 14.0
MATCHED, SHOWN, FIELD_PAPERS = 10, 8, 120


def words(text: Column) -> Column:
    """Lower-case words of three characters or more without stop words, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(T.TOKEN), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) <= 32) & ~w.isin(R.STOP_WORDS))


def text_words(text: Column) -> Column:
    """``words`` of whole texts, cut out by columns."""
    return tokens(F.lower(F.coalesce(text, F.lit(""))))


def _hints(hints: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for field, terms in hints.items() for x in (F.lit(field), F.array_sort(F.array(*map(F.lit, terms))))])


def venue_fields(papers: DataFrame) -> DataFrame:
    """``venue, field``: the field whose hints the venue's best papers use most, ML without any.

    ``papers``: venue, rank, text, tags.  The words of tags count beside those of texts.
    """
    own = papers.where((F.col("rank") <= FIELD_PAPERS) & F.col("venue").isNotNull())
    said = own.select("venue", text_words(F.col("text")).alias("ws"), words(F.array_join("tags", " ")).alias("ts")).select("venue", F.explode(F.concat("ws", "ts")).alias("word"))
    named = [(word, field, place) for place, (field, terms) in enumerate(R.VENUE_HINTS.items()) for word in terms]
    hints = papers.sparkSession.createDataFrame(named, "word string, field string, place int")
    hits = said.join(F.broadcast(hints), "word").groupBy("venue", "field", "place").agg(F.count(F.lit(1)).alias("n"))
    best = hits.groupBy("venue").agg(F.min_by("field", F.struct(-F.col("n"), "place")).alias("field"))
    every = papers.where("venue is not null").select("venue").distinct()
    return every.join(best, "venue", "left").select("venue", F.coalesce("field", F.lit("ML")).alias("field"))


def _most(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` items of a venue with most points, what was met first before the rest."""
    sums = rows.groupBy("venue", "item").agg(F.sum("points").alias("points"), F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("venue").orderBy(F.desc("points"), "at", "item"))
    return sums.withColumn("place", place).where(F.col("place") <= n)


def derived_keywords(papers: DataFrame, fields: DataFrame) -> DataFrame:
    """``venue, place, term``: hints of the venue's field, then frequent phrases, then frequent words; 85 at most.

    ``papers``: venue, rank, text, tags.  A phrase is a pair of different neighbouring
    words, or a whole tag, which counts three times; a phrase among the 45 most frequent
    goes if its length isn't 3 to 56.  The 55 words are those of texts and tags.
    """
    base = papers.where("venue is not null").select("venue", "rank", text_words(F.col("text")).alias("ws"), F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != "").alias("ts"))

    def rows(items: Column, kind: int, points: int) -> DataFrame:
        found = base.select("venue", "rank", F.posexplode(items).alias("at", "item"))
        return found.select("venue", "item", F.lit(points).alias("points"), F.struct("rank", F.lit(kind).alias("kind"), "at").alias("at"))

    pairs = F.filter(F.arrays_zip(F.col("ws").alias("a"), F.slice("ws", F.lit(2), F.greatest(F.size("ws") - 1, F.lit(0))).alias("b")), lambda p: p["b"].isNotNull() & (p["a"] != p["b"]))
    phrases = rows(F.col("ts"), 0, TAG_POINTS).unionByName(rows(F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"])), 1, 1))
    terms = rows(F.col("ws"), 0, 1).unionByName(rows(F.flatten(F.transform("ts", words)), 1, 1))
    hinted = fields.select("venue", F.posexplode(F.coalesce(F.try_element_at(_hints(R.VENUE_HINTS), F.col("field")), F.array().cast("array<string>"))).alias("place", "item"))
    parts = [
        hinted.select("venue", "item", F.lit(0).alias("layer"), "place"),
        _most(phrases, PHRASES).where(F.length("item").between(*PHRASE_CHARS)).select("venue", "item", F.lit(1).alias("layer"), "place"),
        _most(terms, TERMS).select("venue", "item", F.lit(2).alias("layer"), "place"),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    once = every.groupBy("venue", F.col("item").alias("term")).agg(F.min(F.struct("layer", "place")).alias("at"))
    return once.select("venue", F.row_number().over(Window.partitionBy("venue").orderBy("at")).alias("place"), "term").where(F.col("place") <= KEYWORDS)


def profiles(weights: DataFrame, keywords: DataFrame) -> DataFrame:
    """``venue, place, term, weight``: 85 weighted terms of a venue, filled up from its keywords.

    ``weights``: venue, term, weight, heaviest first and by term.  Filling terms weigh 0.2;
    a venue without weights takes its keywords at 0.35.
    """
    heavy = weights.select("venue", "term", "weight", F.row_number().over(Window.partitionBy("venue").orderBy(F.desc("weight"), "term")).alias("place")).where(F.col("place") <= KEYWORDS)
    counts = heavy.groupBy("venue").agg(F.count(F.lit(1)).alias("had"))
    spare = keywords.join(heavy.select("venue", "term"), ["venue", "term"], "left_anti").join(counts, "venue", "left")
    filling = spare.select("venue", "term", F.when(F.col("had").isNull(), ALONE).otherwise(FILL).alias("weight"), (F.coalesce("had", F.lit(0)) + F.row_number().over(Window.partitionBy("venue").orderBy("place"))).alias("place"))
    return heavy.unionByName(filling.where(F.col("place") <= KEYWORDS)).select("venue", "place", "term", "weight")


def phrase_index(profile: DataFrame) -> DataFrame:
    """``part, venue, place, term, weight, n_parts``: a row for each word of each term, repeats included."""
    parts = profile.withColumn("parts", words(F.col("term"))).where(F.size("parts") > 0)
    return parts.select(F.explode("parts").alias("part"), "venue", "place", "term", "weight", F.size("parts").alias("n_parts"))


def overlaps(drafts: DataFrame, profile: DataFrame) -> DataFrame:
    """``draft, venue, overlap, matched``: what the words of ``drafts`` (draft, words) meet in profiles.

    A word met counts 12 times its weight, a phrase 18 times; of a phrase met in part,
    4 times the weight and the share of its parts.  ``matched``: first ten terms met whole.

    Drafts are dealt by their key before their words are dealt out, so that both
    groupings find a draft's rows where they are.  The index has 85 terms for each venue;
    whether it is broadcast is left to its size.
    """
    said = drafts.select("draft", F.array_distinct("words").alias("words")).repartition("draft").select("draft", F.explode("words").alias("part"))
    met = said.join(phrase_index(profile), "part").groupBy("draft", "venue", "place", "term", "weight", "n_parts").agg(F.count(F.lit(1)).alias("hits"))
    whole = F.col("hits") == F.col("n_parts")
    points = F.when(whole, F.when(F.col("n_parts") > 1, PHRASE_POINTS).otherwise(WORD_POINTS)).otherwise(PART_POINTS * F.col("hits") / F.col("n_parts"))
    named = F.array_sort(F.collect_list(F.when(whole, F.struct("place", "term"))))
    sums = met.groupBy("draft", "venue").agg(F.sum(F.col("weight") * points).alias("overlap"), named.alias("named"))
    return sums.select("draft", "venue", F.round("overlap", 6).alias("overlap"), F.slice(F.array_distinct(F.transform("named", lambda x: x["term"])), 1, MATCHED).alias("matched"))


def maturity(stage: Column, rank: Column) -> Column:
    """What a draft's stage adds: solid 3 everywhere; at A* venues mature 3 and early -5."""
    top = F.coalesce(rank == "A*", F.lit(False))
    return F.when(stage == "solid", 3.0).when((stage == "mature") & top, 3.0).when((stage == "early") & top, -5.0).otherwise(0.0)


def verdict(text: Column, said: Column | None = None) -> Column:
    """``ok``, or why a draft is not matched.  ``said``: the words of the text, where they are known."""
    said = words(text) if said is None else said
    telling = _telling(said)
    filler = F.size(said) - F.size(telling)
    plain = F.trim(F.coalesce(text, F.lit("")))
    lorem = F.lower(plain).contains("lorem") & plain.rlike(r"(?i)\blorem\s+ipsum\b")
    return (
        F.when(F.length(plain) < 80, "too short")
        .when(lorem | (filler >= 0.35 * F.size(said)) & (F.size(said) > 0), "placeholder")
        .when((F.size(telling) < 35) | (F.size(F.array_distinct(telling)) < 18), "too few details")
        .otherwise("ok")
    )


def _telling(said: Column) -> Column:
    return F.filter(said, lambda w: ~w.isin(R.PLACEHOLDER_WORDS))


def draft_field(said: Column) -> Column:
    """The field of which most hints are among the distinct words; the first of the table on a tie, ML without any."""
    counts = [F.struct(F.size(F.array_intersect(said, F.array(*map(F.lit, terms)))).alias("n"), F.lit(-i).alias("p"), F.lit(field).alias("f")) for i, (field, terms) in enumerate(R.DRAFT_HINTS.items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["f"]).otherwise("ML")


def recommend(drafts: DataFrame, venues: DataFrame, profile: DataFrame) -> DataFrame:
    """The eight venues that fit a draft best, with the parts of the score.

    ``drafts``: draft, text, field (``auto`` or null: inferred; ``any``: no matter),
    stage (``any``, ``early``, ``solid``, ``mature``); ``venues``: venue, field, rank.
    Drafts that fail :func:`verdict`, or whose best venue has no term met whole, get no row.
    A venue without a common word scores 13 at most, below what is shown, so none is lost
    by taking only those that share one.
    """
    ready = drafts.withColumn("words", text_words(F.col("text"))).where(verdict(F.col("text"), F.col("words")) == "ok").withColumn("words", F.array_distinct(_telling(F.col("words"))))
    kept = ready.select("draft", "stage", "words", F.when(F.coalesce("field", F.lit("auto")) == "auto", draft_field(F.col("words"))).otherwise(F.col("field")).alias("wanted"))
    kept = staged(kept, "drafts")
    rows = overlaps(kept, profile).join(kept.drop("words"), "draft").join(venues.select("venue", "field", "rank"), "venue")
    field = F.when(F.col("wanted") == "any", 0.0).when(F.coalesce(F.col("wanted") == F.col("field"), F.lit(False)), FIELD_MATCH).otherwise(FIELD_OTHER)
    parts = rows.withColumns({"field_points": field, "maturity_points": maturity(F.col("stage"), F.col("rank")), "rank_points": F.when(F.col("rank") == "A*", STARRED).otherwise(0.0)})
    scored = parts.withColumn("score", F.round(F.greatest(F.lit(0.0), F.col("overlap") + F.col("field_points") + F.col("maturity_points") + F.col("rank_points")), 4))
    shown = scored.where((F.size("matched") > 0) | (F.col("score") >= MODERATE))
    by = Window.partitionBy("draft").orderBy(F.desc("score"), "venue")
    placed = shown.withColumns({"place": F.row_number().over(by), "first": F.size(F.first("matched").over(by))})
    fit = F.when(F.col("score") >= STRONG, "Strong fit").when(F.col("score") >= MODERATE, "Moderate fit").otherwise("Stretch fit")
    return placed.where((F.col("place") <= SHOWN) & (F.col("first") > 0)).select("draft", "place", "venue", "wanted", F.round("overlap", 4).alias("overlap"), "field_points", "maturity_points", "rank_points", "score", fit.alias("fit"), "matched")


def bars(value: Column, top: Column) -> Column:
    """Width of a bar in per cent of the top score, 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(value / F.greatest(top, F.lit(1.0)) * 100 + 0.5)))
