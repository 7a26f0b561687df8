"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every window of an item (WINDOW consecutive words; a shorter item is one window)
is a set of shingles of SHINGLE words (a shorter window is one shingle).  The
shingles are ordered by rarity over the items; as a hit must contain all of a
window's shingles, the rarest alone is its necessary prefix.  Each document's
shingles meet these prefixes by hash, the shingle's place in document and window
bounds where the window would start and end, and the words there are compared.

The windows are broadcast in blocks of at most BLOCK rows, however many there
are; one pass over the documents for each block.

Defined cases: null or empty text has no words, is not hit and not contaminated;
items without words have no window; a null item_id counts as the empty string and
rows of one item_id are one item; repeated documents each keep their row; an
empty table of items hits nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, words_of

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 5
#: Windows in a broadcast: some 300 bytes each.
BLOCK = 50_000
#: A document is contaminated when at least one word in so many is hit.
SHARE = 20


def _hash_at(words: Column, size: int, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(size)])


def _hashes(starts: Column, size: int) -> Column:
    return F.transform(starts, lambda i: _hash_at(F.col("w"), size, i))


def item_windows(items: DataFrame) -> DataFrame:
    """``window`` (its words), ``len``, ``items``, and its prefix: ``size`` and ``hash`` of the shingle, ``offset`` in the window."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(ascii_lower(F.coalesce("text", F.lit(""))), WORDS).alias("w"))
    rows = rows.where(F.size("w") > 0)
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)))))
    windows = rows.select("item", F.slice("w", F.col("at") + 1, F.lit(WINDOW)).alias("window"))
    windows = windows.groupBy("window").agg(F.collect_set("item").alias("items"))
    windows = windows.withColumn("len", F.size("window")).withColumn("size", F.least("len", F.lit(SHINGLE)))
    sized = F.lit(None).cast("long")
    for size in range(1, SHINGLE + 1):
        sized = F.when(F.col("size") == size, _hash_at(F.col("window"), size, F.col("offset"))).otherwise(sized)
    shingles = windows.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("size")))).withColumn("hash", sized)
    rarity = shingles.groupBy("size", "hash").agg(F.sum(F.size("items")).alias("n"))
    first = F.min(F.struct("n", "hash", "offset")).alias("first")
    chosen = shingles.join(rarity, ["size", "hash"]).groupBy("window", "len", "size").agg(first, F.first("items").alias("items"))
    return chosen.select("window", "len", "size", "items", F.col("first.hash").alias("hash"), F.col("first.offset").alias("offset"))


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``doc_id, sum, n_words`` of each document once with null ``start``, and once for each ``start, len, items`` of an occurring window."""
    windows = windows.persist()
    try:
        sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
        blocks = max(1, -(-windows.count() // BLOCK))
        text = F.coalesce("text", F.lit(""))
        rows = docs.select("doc_id", digest().alias("sum"), words_of(ascii_lower(text), WORDS).alias("w"))
        n = F.size("w")
        # Hashes of all shingle sizes in one array behind a first element that stands for the document itself.
        parts, base, bases = [F.array(F.lit(0).cast("long"))], F.lit(1), F.lit(0)
        for size in sizes:
            bases = F.when(F.col("size") == size, base).otherwise(bases)
            starts = F.when(n >= size, F.sequence(F.lit(0), n - size))
            parts.append(F.coalesce(_hashes(starts, size), F.array().cast("array<long>")))
            base = base + F.greatest(n - (size - 1), F.lit(0))
        rows = rows.select("doc_id", "sum", "w", n.cast("long").alias("n_words"), F.concat(*parts).alias("hashes"))
        # The outer form keeps the optimiser from testing the array's size, and so building it, a second time below.
        rows = rows.select("doc_id", "sum", "w", "n_words", F.posexplode_outer("hashes").alias("place", "h"))
        nothing = [F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("array<string>").alias("items")]
        own = ["doc_id", "sum", "n_words"]
        out = None
        for block in range(blocks):
            some = windows.where(F.pmod("hash", F.lit(blocks)) == block).select("window", "len", "size", "items", "hash", "offset")
            # The marker meets the documents' first element; it occurs in one block.
            marker = some.sparkSession.range(1 if block == 0 else 0).select(*[F.lit(0 if f.name == "hash" else None).cast(f.dataType).alias(f.name) for f in some.schema])
            some = F.broadcast(some.unionByName(marker))
            start = F.col("place") - bases - F.col("offset")
            found = rows.join(some, rows["h"] == some["hash"])
            itself = F.col("window").isNull()
            found = found.where((itself & (F.col("place") == 0)) | (~itself & (start >= 0) & (start + F.col("len") <= n) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.coalesce("len", F.lit(0))) == F.col("window"))))
            found = found.select(*own, F.when(~itself, start).alias("start"), "len", "items")
            out = found if out is None else out.unionByName(found)
        return out if out is not None else rows.select(*own, *nothing)
    finally:
        windows.unpersist()


def digest() -> Column:
    """What tells apart texts of one doc_id."""
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def judge(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, sum, n_words, n_hit, n_items, items, contaminated`` for every row of ``docs``; sum is the text's digest."""
    found = occurrences(docs, item_windows(items))
    # A document's hits are pre-aggregated where it was read; its group is bounded by its own words.
    grouped = found.groupBy("doc_id", "sum", "n_words").agg(
        F.count(F.when(F.col("start").isNull(), 1)).alias("_copies"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "len"))).alias("_hits"),
        F.collect_set("items").alias("_items"),
    )
    covered = F.aggregate(
        F.array_sort("_hits"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["start"] + x["len"]).alias("end"),
            (acc["sum"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(acc["end"], x["start"]))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    rows = grouped.select("doc_id", "sum", "n_words", covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("_items"))).alias("items"), "_copies")
    rows = rows.select(
        "doc_id", "sum", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"),
    )
    return rows.drop("_copy")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated`` for every row of ``docs``."""
    return judge(docs, items).drop("sum")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), v AS (
  SELECT DISTINCT item, array_to_string(w[i:i+12], ' ') AS s, least(len(w), 13) AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), s AS (
  SELECT doc_id, i, k, array_to_string(w[i:i+k-1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM v))
), o AS (
  SELECT s.doc_id, s.i, s.k, v.item FROM s JOIN v ON s.s = v.s AND s.k = v.k
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM o)) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM o GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
