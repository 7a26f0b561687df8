"""De-duplication of papers: an exact fold by arXiv number, then leaders by title.

Pass 1 folds the rows of a number in order of position: the more complete row
wins, and the other fills what the winner lacks.  Pass 2 keeps a paper as leader
unless an earlier leader shares a word bigram of the title and has a word Jaccard
similarity of at least the threshold; a leader gives its place to a follower that
is more complete, which is filled from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dialect import SPARK
from ..plans.stage import staged
from ..schemas import with_defaults

THRESHOLD = 0.85
#: Largest table, in rows, that is broadcast.
BROADCAST_ROWS = 50_000


def _present(x: Column) -> Column:
    return F.when(x != "", 1).otherwise(0)


def completeness(row: Column | None = None) -> Column:
    def c(name: str) -> Column:
        return F.col(name) if row is None else row[name]

    venue = F.when(~c("venue").isin("", "arXiv", "Unknown"), 5).otherwise(0)
    lists = F.size(c("authors")) + F.size(c("tags")) + F.size(c("limitations")) + F.size(c("future_work"))
    return _present(c("abstract")) + _present(c("pdf_url")) + _present(c("summary")) + lists + F.when(c("citations") > 0, 1).otherwise(0) + venue + 3 * _present(c("conference_rank"))


def _merged(winner: Column, loser: Column, names: list[str]) -> Column:
    def value(n: str) -> Column:
        if n in ("abstract", "pdf_url"):
            return F.coalesce(F.nullif(winner[n], F.lit("")), loser[n])
        if n == "affiliations_raw":
            return F.when(F.size(winner[n]) > 0, winner[n]).otherwise(loser[n])
        if n == "citations":
            return F.when(winner[n] > 0, winner[n]).otherwise(loser[n])
        return winner[n]

    return F.struct(*[value(n).alias(n) for n in names])


def fold_exact(papers: DataFrame) -> DataFrame:
    """One row for each arXiv number, at its first position; rows without a number pass.  ``pos`` gives the order."""
    rows = with_defaults(papers)
    names = rows.columns
    key = F.expr(T.arxiv_id(SPARK, "id", "paper_url"))
    rows = rows.withColumn("_key", key)
    keyed = rows.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*names).alias("r")))).alias("g"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(completeness(x["r"]) > completeness(acc), _merged(x["r"], acc, names)).otherwise(_merged(acc, x["r"], names))

    folded = F.aggregate(F.slice("g", 2, F.greatest(F.size("g"), F.lit(1))), F.get("g", F.lit(0))["r"], step)
    kept = keyed.select(F.get("g", F.lit(0))["pos"].alias("_pos"), folded.alias("r")).select("_pos", "r.*").withColumn("pos", F.col("_pos")).select(*names)
    return rows.where(F.col("_key").isNull()).select(*names).unionByName(kept)


def _title() -> Column:
    return F.expr(T.norm_title(SPARK, "title"))


def titles(papers: DataFrame) -> DataFrame:
    """``t, pos``: the normalised titles and the first position of each; equal titles are compared once."""
    return papers.select(_title().alias("t"), "pos").where("t <> ''").groupBy("t").agg(F.min("pos").alias("pos"))


def _bags(firsts: DataFrame) -> DataFrame:
    """``pos, ws, gs``: the words of each title, rarest first, and its word bigrams."""
    words = firsts.select("t", "pos", F.explode(F.array_distinct(F.split("t", " "))).alias("w"))
    counts = staged(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "title-words")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts.hint("merge")
    ranked = words.join(counts, "w").groupBy("t", "pos").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("ws"))
    grams = "CASE WHEN size(w) < 2 THEN array(concat(w[0], ' ')) ELSE transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1])) END"
    return ranked.withColumn("w", F.split("t", " ")).select("pos", F.col("ws.w").alias("ws"), F.array_distinct(F.expr(grams)).alias("gs"))


def similar_titles(firsts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``p < q, similarity``: first positions of titles that share a bigram and are similar enough.

    Two word sets of n and m words with that similarity share one of the n - ceil(t n) + 1
    rarest words of each, m lies between t n and n / t, and behind the first shared word
    enough of both is left.  The key is a word and the longer title's length, so even a
    frequent word brings together only titles of fitting lengths.
    """
    bags = staged(_bags(firsts), "title-bags")
    n, t = F.size("ws"), F.lit(threshold)
    prefix = bags.select("pos", n.alias("n"), F.posexplode(F.expr(f"slice(ws, 1, cast(size(ws) - ceil({threshold} * size(ws) - 1e-9) + 1 as int))")).alias("i", "w"))
    probes = prefix.select(F.col("pos").alias("a"), F.col("n").alias("na"), "i", "w", F.explode(F.sequence("n", F.floor(F.col("n") / t + 1e-9).cast("int"))).alias("m"))
    index = prefix.select(F.col("pos").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), "w")
    rest = 1 + F.least(F.col("na") - F.col("i") - 1, F.col("m") - F.col("j") - 1)
    met = probes.join(index, ["w", "m"]).where(((F.col("na") < F.col("m")) | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b")))
    met = met.where(rest >= t / (1 + t) * (F.col("na") + F.col("m")) - 1e-9)
    pairs = met.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct()
    for side in ("p", "q"):
        pairs = pairs.join(bags.select(F.col("pos").alias(side), F.col("ws").alias(f"w{side}"), F.col("gs").alias(f"g{side}")), side)
    both = F.size(F.array_intersect("wp", "wq"))
    similarity = both / (F.size("wp") + F.size("wq") - both)
    return pairs.where(F.arrays_overlap("gp", "gq") & (similarity >= threshold)).select("p", "q", similarity.alias("similarity"))


def title_pairs(papers: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``p < q, similarity`` of all positions, copies of a title included; de-duplication itself doesn't spread copies."""
    firsts = staged(titles(papers), "titles")
    copies = papers.select(_title().alias("t"), "pos").join(firsts.withColumnRenamed("pos", "first"), "t").select("pos", "first")
    found = similar_titles(firsts, threshold).select(F.inline(F.array(F.struct(F.col("p").alias("x"), F.col("q").alias("y"), "similarity"), F.struct(F.col("q").alias("x"), F.col("p").alias("y"), "similarity"))))
    found = found.unionByName(firsts.select(F.col("pos").alias("x"), F.col("pos").alias("y"), F.lit(1.0).alias("similarity")))
    spread = found.join(copies.select(F.col("first").alias("x"), F.col("pos").alias("p")), "x").join(copies.select(F.col("first").alias("y"), F.col("pos").alias("q")), "y")
    return spread.where("p < q").select("p", "q", "similarity")


def leaders(papers: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``pos, leader`` of every paper: the first maximal set of titles without similar pairs, found in rounds.

    In a round a title becomes leader if no smaller neighbour is a leader or undecided,
    and a follower if a smaller neighbour leads; the states are written after each
    round.  Copies of a title follow its first position, papers without a title lead.
    """
    firsts = staged(titles(papers), "titles")
    pairs = staged(similar_titles(firsts, threshold), "pairs")
    state = staged(firsts.select("pos", F.lit(0).alias("state")), "state")  # 0 undecided, 1 leader, 2 follower
    while not state.where("state = 0").isEmpty():
        ahead = pairs.join(state.select(F.col("pos").alias("p"), F.col("state").alias("s")), "p").groupBy("q").agg(F.max((F.col("s") == 1).cast("int")).alias("led"), F.max((F.col("s") == 0).cast("int")).alias("waits"))
        rows = state.join(ahead, state["pos"] == ahead["q"], "left")
        decided = F.when(F.col("led") == 1, 2).when(F.coalesce("waits", F.lit(0)) == 0, 1).otherwise(0)
        state = staged(rows.select("pos", F.when(F.col("state") != 0, F.col("state")).otherwise(decided).alias("state")), "state")
    led = pairs.join(state.where("state = 1").select(F.col("pos").alias("p")), "p").groupBy(F.col("q").alias("pos")).agg(F.min("p").alias("l"))
    rows = state.join(led, "pos", "left").select("pos", F.when(F.col("state") == 1, F.col("pos")).otherwise(F.col("l")).alias("leader"))
    known = firsts.join(rows, "pos").select("t", "leader")
    return papers.select("pos", _title().alias("t")).join(known, "t", "left").select("pos", F.coalesce("leader", "pos").alias("leader"))


def deduplicate(papers: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Both passes; the rows kept, each at its leader's position.

    A follower that is more complete than what stands at its leader's place takes it,
    and is filled from it; others go.  Only the first of each completeness can, so no
    more rows of a leader than that meet.
    """
    rows = staged(fold_exact(papers), "folded")
    names = rows.columns
    joined = rows.join(leaders(rows, threshold), "pos").withColumn("_c", completeness())
    some = joined.groupBy("leader", "_c").agg(F.min_by(F.struct(*names), "pos").alias("r"), F.min("pos").alias("at"))
    met = some.groupBy("leader").agg(F.array_sort(F.collect_list(F.struct("at", "r"))).alias("g"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(completeness(x["r"]) > completeness(acc), _merged(x["r"], acc, names)).otherwise(acc)

    folded = F.aggregate(F.slice("g", 2, F.greatest(F.size("g"), F.lit(1))), F.get("g", F.lit(0))["r"], step)
    return met.select(F.col("leader").alias("_pos"), folded.alias("r")).select("_pos", "r.*").withColumn("pos", F.col("_pos")).select(*names)
