"""Incremental substring deduplication on a log-structured fingerprint index.

The index is a list of immutable runs: the fingerprints of all historical windows
of WINDOW words, sorted, in buckets of leading bits.  A new batch of documents
sends its window fingerprints, sorted, to the buckets; there they are merged with
the runs, a match is verified against 16 further bits of an independent hash, and
a word is removed if a window over it was met in history or starts in a
document of the batch with a smaller doc_id.  The fingerprints that were new form
the next run; runs of equal level are compacted into one while they are merged.

A word is known by the two halves of its BLAKE2b digest; a window's key is a
multilinear hash of the one halves of its words, its check one of the others.

``dedup`` feeds a whole table in ascending batches of doc_id.  With ``index_dir``
it goes on from the runs an earlier job left there, whose documents count as
smaller, and leaves its own.

Defined cases: null or blank text has no words; a text of fewer words than a
window keeps them all; rows of equal doc_id are one document to the rule and each
keep their row; a null doc_id counts as larger than all others; an empty table
gives an empty result; other columns can be carried along by name.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import block_of, bounds, mixed, number_of_blocks, planes, slices, unplanes
from .common import new_path, release, table

WINDOW = 13
BATCHES = 3
#: Most buckets of the index; Spark refuses tables of more than spark.sql.sources.bucketing.maxBuckets, 100,000 by default.
MAX_BUCKETS = 65_536
_rng = np.random.default_rng(13)
_KEYS, _CHECKS = (_rng.integers(0, 1 << 63, WINDOW, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))

#: kind: ``run`` for fingerprints of the index, ``hit`` for answers to a block.
ROW = "block long, keys binary, checks binary, owners binary, kind string, bucket int"


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, check, first word and text number of every window; and the text number of every word."""
    split = [t.split() for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
    numbers: dict[bytes, int] = {}
    word = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in split for w in ws), np.int64, len(owner))
    n = max(0, len(owner) - WINDOW + 1)
    first = np.flatnonzero(owner[:n] == owner[WINDOW - 1 : WINDOW - 1 + n]) if n else np.zeros(0, np.int64)
    digests = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in numbers]), "<u8").reshape(-1, 2)
    one, other = digests[word, 0], digests[word, 1]
    key, check = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
    for k in range(WINDOW):
        key += one[first + k] * _KEYS[k]
        check += other[first + k] * _CHECKS[k]
    return mixed(key), (mixed(check) >> np.uint64(48)).astype(np.uint16), first, owner[first], owner


def fingerprints(n_buckets: int):
    """Of a block: its distinct windows with their smallest doc_id, a packed row for each bucket."""

    def of_block(group: pa.Table) -> pa.Table:
        group = group.sort_by("_id")
        (levels, ids), block = _owners(group.column("_id")), group.column("_block")[0].as_py()
        keys, checks, owners = [], [], []
        for at, texts in slices(group.column("_text")):
            key, check, _, who, _ = windows(texts)
            keys.append(key)
            checks.append(check)
            owners.append(at + who)
        key, check, who = map(np.concatenate, (keys, checks, owners))
        order = np.argsort(key, kind="stable")  # the smallest doc_id of a key comes first
        key, check, level, own = key[order], check[order], levels[who[order]], ids[who[order]]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        # The last of a key differs from its first if a second document of the block has it.
        last = np.append(at[1:], len(key)) - 1 if len(at) else at
        several = (own[last] != own[at]) | (level[last] != level[at])
        key, check, level, own = key[at], check[at], level[at], own[at]
        rows = [(block, planes(key[a:b]), planes(check[a:b]), _packed(level[a:b], own[a:b], several[a:b]), "new", bucket) for bucket, a, b in bounds(key, n_buckets)]
        return _rows(rows)

    return of_block


#: What a document's place among all is led by: windows of earlier batches, a doc_id, none.
HISTORY, DOCUMENT, NOBODY = 0, 1, 2
_SIGN = np.uint64(1 << 63)


def _owners(ids: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Level and unsigned id of each doc_id, which compare as the documents do."""
    level = np.where(ids.is_null().to_numpy(), NOBODY, DOCUMENT).astype(np.uint8)
    return level, ids.fill_null(0).to_numpy().view(np.uint64) ^ _SIGN


def _smaller(level: np.ndarray, own: np.ndarray, than_level: np.ndarray, than: np.ndarray) -> np.ndarray:
    return (level < than_level) | ((level == than_level) & (own < than))


def _packed(level: np.ndarray, own: np.ndarray, mark: np.ndarray | int = 0) -> bytes:
    """Ids in planes, then a byte for each with level and mark."""
    return planes(own) + (level * 2 + mark).astype(np.uint8).tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels, ids and marks."""
    n = len(raw) // 9
    flags = np.frombuffer(raw, np.uint8, n, 8 * n)
    return flags >> 1, unplanes(raw[: 8 * n], "<u8"), (flags & 1).astype(bool)


def _rows(rows: list[tuple]) -> pa.Table:
    schema = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()), ("owners", pa.binary()), ("kind", pa.string()), ("bucket", pa.int32())])
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, schema.types)], schema=schema)


def _run(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and checks of a bucket's runs, merged."""
    keys = [unplanes(x.as_py(), "<u8") for x in group.column("keys")]
    checks = [unplanes(x.as_py(), "<u2") for x in group.column("checks")]
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    key, check = np.concatenate(keys), np.concatenate(checks)
    order = np.argsort(key, kind="stable")
    return key[order], check[order]


def _known(key: np.ndarray, check: np.ndarray, run_key: np.ndarray, run_check: np.ndarray) -> np.ndarray:
    """Which fingerprints stand in a run, check included."""
    at = np.searchsorted(run_key, key)
    found = np.zeros(len(key), bool)
    live = np.flatnonzero(at < len(run_key))
    while len(live):
        live = live[run_key[at[live]] == key[live]]
        found[live] |= run_check[at[live]] == check[live]
        live = live[~found[live]]
        at[live] += 1
        live = live[at[live] < len(run_key)]
    return found


def merge():
    """Of a bucket: the batch merged with the runs; answers to the blocks and the next run, with the runs marked ``fold`` compacted into it."""

    def of_bucket(key: tuple, new: pa.Table, runs: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        run_key, run_check = _run(runs)
        out = []
        blocks = new.column("block").to_pylist()
        parts = [unplanes(x.as_py(), "<u8") for x in new.column("keys")]
        if parts:
            keys, checks = np.concatenate(parts), np.concatenate([unplanes(x.as_py(), "<u2") for x in new.column("checks")])
            level, own, several = map(np.concatenate, zip(*(_unpacked(x.as_py()) for x in new.column("owners"))))
            source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            order = np.lexsort((own, level, checks, keys))
            keys, checks, level, own, several, source = (x[order] for x in (keys, checks, level, own, several, source))
            first = np.ones(len(keys), bool)
            first[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
            group = np.cumsum(first) - 1
            at = np.flatnonzero(first)
            known = _known(keys[at], checks[at], run_key, run_check)
            owner_level, owner = np.where(known, HISTORY, level[at]).astype(np.uint8)[group], own[at][group]
            asked = _smaller(owner_level, owner, level, own) | several
            hit_order = np.argsort(source[asked], kind="stable")
            h, c, v, o, s = (x[asked][hit_order] for x in (keys, checks, owner_level, owner, source))
            cuts = np.searchsorted(s, np.arange(len(parts) + 1))
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    out.append((blocks[i], planes(h[a:b]), planes(c[a:b]), _packed(v[a:b], o[a:b]), "hit", bucket))
            fresh_key, fresh_check = keys[at][~known], checks[at][~known]
        else:
            fresh_key, fresh_check = np.zeros(0, np.uint64), np.zeros(0, np.uint16)
        old_key, old_check = _run(runs.filter(runs.column("fold")))
        if len(old_key):
            fresh_key, fresh_check = np.concatenate([old_key, fresh_key]), np.concatenate([old_check, fresh_check])
            order = np.argsort(fresh_key, kind="stable")
            fresh_key, fresh_check = fresh_key[order], fresh_check[order]
        if len(fresh_key):
            out.append((0, planes(fresh_key), planes(fresh_check), b"", "run", bucket))
        return _rows(out)

    return of_bucket


class FingerprintIndex:
    """Runs of historical fingerprints below the shared folder, as tables bucketed by leading bits: a merge shuffles the batch alone."""

    def __init__(self, spark: SparkSession, n_buckets: int) -> None:
        self.spark, self.n_buckets = spark, n_buckets
        self.runs: list[tuple[int, str, str]] = []  # level, table ("" for a run of another job, read by its path), path
        self.hits: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex | None:
        """The index an earlier job saved to ``folder``; None where there is none."""
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
        if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return None
        rows = spark.read.schema("n_buckets int, level int, place int, path string").json(f"{folder}/manifest").orderBy("place").collect()
        index = cls(spark, rows[0]["n_buckets"])
        index.runs = [(r["level"], "", r["path"]) for r in rows]
        return index

    def save(self, folder: str) -> None:
        """Copies the runs to ``folder``, which outlives this session; a later job opens them."""
        held = []
        for place, (level, _, path) in enumerate(self.runs):
            kept = path if path.startswith(f"{folder}/") else f"{folder}/{uuid.uuid4().hex}"
            if kept != path:
                self.spark.read.schema(ROW).parquet(path).where("kind = 'run'").write.option("compression", "zstd").partitionBy("kind").parquet(kept)
            held.append((self.n_buckets, level, place, kept))
        if held:
            self.spark.createDataFrame(held, "n_buckets int, level int, place int, path string").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")

    def _history(self, kept: int) -> DataFrame:
        """The runs' rows; ``fold`` marks all but the first ``kept`` runs."""
        rows = None
        for i, (_, name, _) in enumerate(self.runs):
            held = self.spark.table(name) if name else self.spark.read.schema(ROW).parquet(self.runs[i][2])
            run = held.where("kind = 'run'").select("keys", "checks", "bucket", F.lit(i >= kept).alias("fold"))
            rows = run if rows is None else rows.unionByName(run)
        return rows if rows is not None else self.spark.range(0).selectExpr("cast(null as binary) keys", "cast(null as binary) checks", "0 as bucket", "false as fold")

    def add(self, batch: DataFrame) -> None:
        """Merges a batch ``_block, _id, _text``; its hits go to ``hits``, its new fingerprints to a run."""
        spark, path = self.spark, new_path(self.spark, "index")
        name = f"paperloom_{uuid.uuid4().hex}"
        level, kept = 0, len(self.runs)
        while kept and self.runs[kept - 1][0] == level:
            level, kept = level + 1, kept - 1
        new = batch.groupBy("_block").applyInArrow(fingerprints(self.n_buckets), ROW)
        merged = new.groupBy("bucket").cogroup(self._history(kept).groupBy("bucket")).applyInArrow(merge(), ROW)
        merged.write.format("parquet").option("compression", "zstd").option("path", path).partitionBy("kind").bucketBy(self.n_buckets, "bucket").saveAsTable(name)
        self.drop_runs(kept)
        self.runs.append((level, name, path))
        self.hits.append(path)
        release(spark)

    def drop_runs(self, kept: int = 0) -> None:
        """Forgets all runs but the first ``kept``; the answers of their batches stay."""
        for _, name, path in self.runs[kept:]:
            if not name:
                continue  # another job's
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind=run")
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        self.runs = self.runs[:kept]

    def answers(self) -> DataFrame:
        schema = "block long, keys binary, checks binary, owners binary, bucket int, kind string"
        rows = None
        for path in self.hits:
            some = self.spark.read.schema(schema).parquet(path).where("kind = 'hit'").select(F.col("block").alias("_block"), "keys", "checks", "owners")
            rows = some if rows is None else rows.unionByName(some)
        return rows


def remove(carried: list[str], schema: pa.Schema):
    """Of a block: its texts without the words that the answers cover."""

    def of_block(docs: pa.Table, answers: pa.Table) -> pa.Table:
        levels, ids = _owners(docs.column("_id"))
        keys = np.concatenate([np.zeros(0, np.uint64), *(unplanes(x.as_py(), "<u8") for x in answers.column("keys"))])
        checks = np.concatenate([np.zeros(0, np.uint16), *(unplanes(x.as_py(), "<u2") for x in answers.column("checks"))])
        owner_levels, owners, _ = map(np.concatenate, zip(_unpacked(b""), *(_unpacked(x.as_py()) for x in answers.column("owners"))))
        order = np.lexsort((checks, keys))
        keys, checks, owner_levels, owners = keys[order], checks[order], owner_levels[order], owners[order]
        n_words, n_removed, kept = [], [], []
        for at, texts in slices(docs.column("_text")):
            key, check, first, who, owner = windows(texts) if len(keys) else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
            found = np.searchsorted(keys, key)
            hit = np.zeros(len(key), bool)
            live = np.flatnonzero(found < len(keys))
            while len(live):
                live = live[keys[found[live]] == key[live]]
                same = live[checks[found[live]] == check[live]]
                hit[same] = _smaller(owner_levels[found[same]], owners[found[same]], levels[at + who[same]], ids[at + who[same]])
                live = live[checks[found[live]] != check[live]]
                found[live] += 1
                live = live[found[live] < len(keys)]
            marks = np.zeros(len(owner) + WINDOW + 1, np.int64)
            np.add.at(marks, first[hit], 1)
            np.add.at(marks, first[hit] + WINDOW, -1)
            gone = np.cumsum(marks)[: len(owner)] > 0
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            for i, text in enumerate(texts):
                words = text.split()
                out = gone[cuts[i] : cuts[i + 1]]
                n = int(out.sum())
                if n:
                    words = [w for w, g in zip(words, out.tolist()) if not g]
                n_words.append(len(words) + n)
                n_removed.append(n)
                kept.append(b" ".join(words).decode())
        columns = [docs.column(c) for c in carried]
        return pa.Table.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[*carried, *schema.names])

    return of_block


def dedup(docs: DataFrame, carry: list[str] | None = None, batches: int = BATCHES, index_dir: str | None = None) -> DataFrame:
    """The ``carry`` columns (doc_id) of every row with ``_n_words``, ``_n_removed`` and ``_kept``, the words left joined by one space."""
    spark, carry = docs.sparkSession, carry or ["doc_id"]
    n = number_of_blocks(docs)
    ids = F.col("doc_id").cast("long")
    cuts = docs.agg(F.approx_percentile("doc_id", [i / batches for i in range(1, batches)] or [0.5])).first()[0] or []
    cuts = sorted({int(c) for c in cuts}) if batches > 1 else []
    turn: Column = F.lit(0)
    for c in cuts:
        turn = turn + F.when(ids.isNull() | (ids > c), 1).otherwise(0)
    # What is carried travels in one column, so that no name can clash.
    rows = docs.select(F.struct(*carry).alias("_row"), ids.alias("_id"), F.col("text").alias("_text"), turn.alias("_turn"))
    # Rows of one doc_id, or of none, are dealt over the blocks by their text.
    rows = rows.withColumn("_block", F.col("_turn") * F.lit(n).cast("long") + block_of(F.xxhash64("_id", "_text"), n))
    index = (FingerprintIndex.open(spark, index_dir) if index_dir else None) or FingerprintIndex(spark, n_buckets(n))
    try:
        for i in range(len(cuts) + 1):
            index.add(rows.where(F.col("_turn") == i).select("_block", "_id", "_text"))
        if index_dir:
            index.save(index_dir)
    finally:
        index.drop_runs()
    out = T.StructType([T.StructField("_row", rows.schema["_row"].dataType), T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType()), T.StructField("_kept", T.StringType())])
    names = pa.schema([("_n_words", pa.int64()), ("_n_removed", pa.int64()), ("_kept", pa.string())])
    done = rows.groupBy("_block").cogroup(index.answers().groupBy("_block")).applyInArrow(remove(["_row"], names), out)
    return done.select(*[F.col("_row")[c].alias(c) for c in carry], "_n_words", "_n_removed", "_kept")


def n_buckets(n_blocks: int) -> int:
    return min(n_blocks, MAX_BUCKETS)


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), f AS (
  SELECT s, min(doc_id) AS m FROM g GROUP BY s
), h AS (
  SELECT DISTINCT doc_id, p FROM (SELECT g.doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f ON g.s = f.s WHERE m < g.doc_id)
), x AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), k AS (
  SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM x LEFT JOIN h ON x.doc_id = h.doc_id AND x.p = h.p WHERE h.p IS NULL GROUP BY x.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
