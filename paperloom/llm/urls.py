"""URL filter: fixed allow and block rules, then a logistic regression on hashed
character n-grams of host and path.  DataFrame functions only, training included.

Defined cases: a null url, or one without ``://``, has an empty host and path
and no n-grams, so the intercept alone decides (allow); repeated rows are judged
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
BUCKETS = 2048
GRAM = 3
EPOCHS = 20
RATE = 3.0
SHRINK = 0.001
#: Share of urls to block that is expected before anything is known of one: the fixed intercept is its log-odds.
BASE_RATE = 0.2
#: The training rows are gathered into one array; more than this many are refused.
MAX_LABELLED = 2_000
#: The default labelled table, of invented hosts: columns url and blocked (1 or 0).
LABELS = Path(__file__).with_name("url_labels.csv")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table: ``url``, ``blocked``."""
    lines = F.explode(F.split(F.lit(LABELS.read_text().strip()), "\n")).alias("line")
    row = F.from_csv("line", "url string, blocked double")
    return spark.range(1).select(lines).where("line <> 'url,blocked'").select(row.alias("r")).select("r.*")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(F.coalesce(rest, F.lit("")), F.length(host) + 1, F.length(url)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, _, below = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{below}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def gram_buckets(host: Column, path: Column) -> Column:
    """Bucket of each n-gram of host and path; ^ and $ mark the ends, a prefix tells the two parts apart."""

    def part(mark: str, text: Column) -> Column:
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.greatest(F.length(whole) - (GRAM - 1), F.lit(1))))
        return F.coalesce(F.transform(starts, lambda i: F.pmod(F.crc32(F.concat(F.lit(mark), F.substring(whole, i, F.lit(GRAM)))), F.lit(BUCKETS)).cast("int")), F.array().cast("array<int>"))

    return F.concat(part("h", host), part("p", path))


def features(grams: Column) -> Column:
    """The distinct buckets of a url; each weighs 1 / sqrt of their number, so that all urls have length one."""
    return F.array_sort(F.array_distinct(grams))


def train(labelled: DataFrame, epochs: int = EPOCHS) -> list[float]:
    """Weights of the buckets and, last, the fixed intercept: logistic descent over the labelled rows as one SQL expression.

    The rows are visited in order of their url's checksum, so that the result
    doesn't depend on partitions and the classes take turns.  Rows with a null
    label or without n-grams teach nothing; without any row all weights but the intercept are zero.
    """
    n = labelled.count()
    if n > MAX_LABELLED:
        raise ValueError(f"{n} labelled urls; at most {MAX_LABELLED} are gathered for training")
    host, path = split_url(F.col("url"))
    rows = labelled.where("blocked IS NOT NULL").select("url", F.col("blocked").cast("double").alias("y"), features(gram_buckets(host, path)).alias("g"))
    rows = rows.where(F.size("g") > 0)
    dense = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda j: F.when(F.array_contains("g", j), 1 / F.sqrt(F.size("g"))).otherwise(F.lit(0.0)))
    steps = rows.select(F.crc32("url").alias("o"), "url", "y", "g", F.concat(dense, F.array(F.lit(0.0))).alias("x"))
    steps = steps.agg(F.array_sort(F.collect_list(F.struct("o", "url", "y", "g", "x"))).alias("s"))

    def step(w: Column, r: Column) -> Column:
        z = F.aggregate(r["g"], F.lit(0.0), lambda acc, b: acc + F.get(w, b)) / F.sqrt(F.size(r["g"])) + F.get(w, F.lit(BUCKETS))
        # A one-element array binds the error once for all weights.
        return F.aggregate(F.array(r["y"] - 1 / (1 + F.exp(-z))), w, lambda acc, e: F.zip_with(acc, r["x"], lambda a, b: F.when(b == 0, a).otherwise(a * (1 - SHRINK) + RATE * e * b)))

    intercept = math.log(BASE_RATE / (1 - BASE_RATE))
    zero = F.concat(F.array_repeat(F.lit(0.0), BUCKETS), F.array(F.lit(intercept)))
    fit = steps.select(F.aggregate(F.flatten(F.array_repeat("s", epochs)), zero, step).alias("w")).first()
    return list(fit["w"]) if fit["w"] else [0.0] * BUCKETS + [intercept]


def filter_urls(pages: DataFrame, weights: list[float], rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``; score is the method's probability of blocking."""
    w = F.lit([float(x) for x in weights[:-1]])
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_g", features(gram_buckets(F.col("host"), F.col("path"))))
    total = F.aggregate(F.transform("_g", lambda b: F.get(w, b)), F.lit(0.0), lambda acc, v: acc + v)
    z = total / F.sqrt(F.greatest(F.size("_g"), F.lit(1))) + F.lit(float(weights[-1]))
    score = F.when(F.size("_g") > 0, 1 / (1 + F.exp(-z))).otherwise(F.lit(0.0))
    rule, fixed = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), fixed.alias("_fixed"), score.alias("score"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_fixed", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), train(labelled_urls(spark)))
