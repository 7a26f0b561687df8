"""A user's ordered list of papers as a table ``user_id, paper_id, seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalized(library: DataFrame) -> DataFrame:
    """Blank ids go; of repeated ids the first stays."""
    rows = library.select("user_id", F.trim("paper_id").alias("paper_id"), "seq").where("paper_id <> ''")
    return rows.groupBy("user_id", "paper_id").agg(F.min("seq").alias("seq"))


def toggle(library: DataFrame, items: DataFrame) -> DataFrame:
    """Each of ``items`` (user_id, paper_id) leaves the list it is on, or joins at its end."""
    base = normalized(library)
    gone = base.join(items, ["user_id", "paper_id"], "left_anti")
    last = base.groupBy("user_id").agg(F.max("seq").alias("last"))
    new = items.join(base, ["user_id", "paper_id"], "left_anti").join(last, "user_id", "left")
    return gone.unionByName(new.select("user_id", "paper_id", (F.coalesce("last", F.lit(0)) + 1).alias("seq")))


def papers_of(library: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers in the order of the lists; missing ones are skipped."""
    return normalized(library).join(papers.withColumnRenamed("id", "paper_id"), "paper_id").orderBy("user_id", "seq")


def replay(actions: DataFrame) -> DataFrame:
    """The lists that ``actions`` (user_id, paper_id, action, at) leave: ``user_id, paper_id, seq``.

    ``add`` puts a paper at the end of its user's list if it isn't on it, ``remove``
    takes it off, ``toggle`` does whichever applies; other actions, and blank or null
    ids, do nothing.  ``at`` must order the actions of a user; what it gives the last
    time a paper came onto a list is its ``seq``.

    Papers don't depend on each other, so each is a state of its own: what the last
    add or remove set, turned over by the toggles since.
    """
    rows = actions.select("user_id", F.trim(F.col("paper_id").cast("string")).alias("paper_id"), "action", "at").where(F.col("action").isin("add", "remove", "toggle") & (F.col("paper_id") != ""))
    paper = Window.partitionBy("user_id", "paper_id").orderBy("at")
    sets = F.col("action") != "toggle"
    epochs = rows.withColumn("epoch", F.sum(sets.cast("int")).over(paper))
    since = Window.partitionBy("user_id", "paper_id", "epoch").orderBy("at")
    base = F.first(F.when(F.col("action") == "add", 1).otherwise(0)).over(since)
    states = epochs.withColumn("on", ((base + F.sum((~sets).cast("int")).over(since)) % 2 == 1))
    came = F.col("on") & ~F.coalesce(F.lag("on").over(paper), F.lit(False))
    last = states.select("user_id", "paper_id", "at", "on", F.when(came, F.col("at")).alias("came"))
    kept = last.groupBy("user_id", "paper_id").agg(F.max_by("on", "at").alias("on"), F.max("came").alias("seq"))
    return kept.where("on").select("user_id", "paper_id", "seq")
