"""The corpus pipeline: five operators applied to ``documents`` one after the other.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and, but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, decontam, neardup, quality, substring
from paperloom.llm.common import BROADCAST_ROWS, staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail on their own, or with their host, go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, by Jaccard similarity of five-word shingles, the document of the smallest doc_id stays."""
    return neardup.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat a smaller doc_id's window go; a text that loses none stays as it is."""
    cols = docs.columns
    done = substring.dedup(docs, carry=cols)
    cut = F.col("_n_removed") > 0
    text = F.when(cut, F.col("_kept")).otherwise(F.col("text"))
    n_chars = F.when(cut, F.char_length("_kept").cast("long")).otherwise(F.col("n_chars"))
    return done.select(*[{"text": text, "n_chars": n_chars}.get(c, F.col(c)).alias(c) for c in cols])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; rows that share only the doc_id, or a null one, with them stay."""
    judged = decontam.judge(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    bad, _ = staged(judged.where("contaminated").select(F.col("doc_id").alias("_bad"), F.col("sum").alias("_sum")).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]) & (decontam.digest() == bad["_sum"]), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256``: packed ids, and digests of them and of what they decode to."""
    done = bpe.encode(docs, decoded=True)
    return done.select("doc_id", "n_tokens", "ids", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: Byte-level BPE can't be expressed in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
