"""Quality rules with host verdicts, in DataFrame functions only.

A document fails on its own words first (``base_failed``).  Failures are then
summed by host; each host's failure rate is shrunk towards the rates of all
hosts by a beta prior whose two parameters are fitted to those rates, and the
documents of hosts whose shrunk rate exceeds ``host_limit`` go too.

Defined cases: null or empty text has no words and fails; a null source has no
host, so only the document's own verdict counts; repeated rows each get a row
of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, staged, table, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host goes when more than this share of its documents is expected to fail.
HOST_LIMIT = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 1_000_000.0)


def base_metrics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the per-document measures of the base rules; one pass, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("_text"), words_of(F.col("text")).alias("_words"))
    n, w = F.size("_words"), F.col("_words")
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW))
    rows = rows.select(
        *keep,
        "_words",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        starts.alias("_starts"),
        F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])).alias("_hashes"),
    )
    # Only documents with equal hashes pay for comparing the windows themselves.
    suspect = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    keyed = F.array_sort(F.transform("_starts", lambda i: F.struct(F.slice(w, i + 1, WINDOW).alias("k"), i.alias("p"))))
    rows = rows.withColumn("_keyed", F.when(suspect, keyed))
    pairs = F.zip_with(
        F.col("_keyed"),
        F.slice("_keyed", 2, F.greatest(F.size("_keyed"), F.lit(1))),
        lambda a, b: F.when(a["k"] == b["k"], F.array(a["p"], b["p"])),
    )
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )
    repeat = F.when(F.col("_keyed").isNotNull(), covered).otherwise(F.lit(0).cast("long"))
    rows = rows.select(
        *keep, "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", base_failed())


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(judged: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> tuple[DataFrame, int]:
    """Hosts with ``n_docs``, ``n_failed``, shrunk ``rate`` and ``host_failed``; and how many hosts there are.

    The prior is fitted by moments: mean m and variance v of the hosts' raw
    rates give it the weight m(1-m)/v - 1, held within PRIOR_WEIGHT.
    """
    hosts = (
        judged.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    )
    raw = F.col("n_failed") / F.col("n_docs")
    m, v, n_hosts = hosts.agg(F.avg(raw), F.var_samp(raw), F.count(F.lit(1))).first()
    mean = m or 0.0
    weight = mean * (1 - mean) / v - 1 if v else PRIOR_WEIGHT[1]
    weight = min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
    rate = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    return hosts.withColumn("rate", rate).withColumn("host_failed", rate > host_limit), n_hosts


def _with_hosts(rows: DataFrame, judged: DataFrame, host: str) -> DataFrame:
    hosts, n_hosts = host_verdicts(judged, host)
    failed = hosts.where("host_failed").select(F.col("host").alias("_host"), F.lit(True).alias("_host_failed"))
    failed = F.broadcast(failed) if n_hosts <= BROADCAST_ROWS else failed
    return rows.join(failed, rows[host] == failed["_host"], "left").drop("_host")


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """Measures and verdicts of every document.  The narrow measures are written once and read for both uses."""
    keep = ["doc_id", F.col(host).alias("_source")]
    rows = docs.select(*keep, "text")
    judged, _ = staged(base_metrics(rows, ["doc_id", "_source"]), "quality")
    out = _with_hosts(judged, judged, "_source")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("_host_failed").isNull()).alias("kept"),
    )


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, columns unchanged.  The judged rows are written once, for the hosts' rates and for the result."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(host).alias("_source"), "text")
    judged, _ = staged(base_metrics(rows, ["_row", "_source"]).select("_row", "_source", "base_failed"), "judged")
    out = _with_hosts(judged.where(~F.col("base_failed")), judged, "_source").where(F.col("_host_failed").isNull())
    return out.select("_row.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, source, t, ws, len(ws) AS n,
         [array_to_string(ws[i:i+7], ' ') for i in range(1, len(ws) - 6)] AS gs,
         [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM w
), p AS (
  SELECT doc_id, unnest(gs) AS s, unnest(range(1, len(gs) + 1)) AS i FROM g WHERE len(gs) > len(list_distinct(gs))
), d AS (
  SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), c AS (
  SELECT doc_id, sum(least(8, i - before)) AS k
  FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8) AS before FROM d) GROUP BY doc_id
), m AS (
  SELECT g.doc_id, source, n::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(k, 0)::BIGINT AS n_repeat_words
  FROM g LEFT JOIN c ON g.doc_id IS NOT DISTINCT FROM c.doc_id
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), h AS (
  SELECT source AS host, count(*) AS nd, sum(base_failed::INT) AS nf FROM b WHERE source IS NOT NULL GROUP BY source
), r AS (
  SELECT avg(nf / nd) AS m, var_samp(nf / nd) AS v FROM h
), q AS (
  SELECT coalesce(m, 0) AS m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000000 END, 1), 1000000) AS k FROM r
), f AS (
  SELECT host FROM h, q WHERE (nf + m * k) / (nd + k) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (source IS NULL OR source NOT IN (SELECT host FROM f)) AS kept
FROM b
"""
