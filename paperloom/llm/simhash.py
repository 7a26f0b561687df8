"""SimHash near-duplicates with pigeonring filtering.

A fingerprint of 64 bits is a ring of three segments.  If two fingerprints differ
in at most two bits, then by the pigeonring principle some segment starts a chain
whose cumulative differences stay within the proportional budgets 2/3, 4/3 and 2:
it agrees wholly, together with its successor in all but one bit, and with the
last in all but two.  So the first two segments of a chain, with at most one flip
in the second, are the join key; the full Hamming check follows.  For another
limit the ring has one segment more than bits may differ; the key is the same.

Fingerprints are compared once each, not once for each document.  Where a key is
shared by more than DENSE fingerprints, the fingerprints it meets are linked
without pairs: two are within two bits exactly if a third value lies within one
bit of both, so each emits itself and its 64 neighbours and joins the least
fingerprint that emitted the same value.  Components come from star contraction.

Defined cases: null, empty and blank texts have fingerprint zero and are linked
like any other; fewer than three words are one shingle; rows of equal doc_id are
kept, and a null doc_id never names a component unless it holds nothing else;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_by_key, staged, table
from .graph import components

SHINGLE = 3
SEED = 42
LIMIT = 2
#: Fingerprints of one key that are still compared pairwise.
DENSE = 24

_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(x), SEED) for x in zip(*[words[i:] for i in range(SHINGLE)])]
    return majority(np.array(hashes, dtype="<u8"))


def majority(found: np.ndarray) -> int:
    """The fingerprint of a text's hashes, as a signed 64-bit integer; zero of none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), 65_536):
        ones += np.unpackbits(found[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * ones > len(found)].sum(dtype=np.uint64).astype(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ring(limit: int) -> list[tuple[int, int, list[int]]]:
    """Of each chain: its number, the mask of its first two segments, the flips of the second."""
    starts = [64 * i // (limit + 1) for i in range(limit + 1)]
    widths = [b - a for a, b in zip(starts, [*starts[1:], 64])]
    masks = [((1 << w) - 1) << s for w, s in zip(widths, starts)]
    out = []
    for r in range(len(starts)):
        nxt = (r + 1) % len(starts)
        flips = [0, *(1 << (starts[nxt] + b) for b in range(widths[nxt]))]
        out.append((r, _signed(masks[r] | masks[nxt]), [_signed(f) for f in flips]))
    return out


def _keys(fps: DataFrame, name: str, probing: bool, limit: int) -> DataFrame:
    chains = [F.struct(F.lit(r).cast("byte").alias("r"), F.lit(m).alias("m"), F.lit(f).alias("f")) for r, m, flips in _ring(limit) for f in (flips if probing else [0])]
    rows = fps.select(F.col("fp").alias(name), F.explode(F.array(*chains)).alias("c"))
    return rows.select(name, F.col("c.r").alias("r"), F.col(name).bitwiseXOR(F.col("c.f")).bitwiseAND(F.col("c.m")).alias("key"))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def links(fps: DataFrame, dense: int = DENSE, limit: int = LIMIT) -> DataFrame:
    """Edges ``u, v`` that connect the distinct ``fp`` within ``limit`` bits of each other; those of crowded keys, within two."""
    # Spark judges an exploded side by the size of what it comes from; these joins must not become broadcasts.
    index, probes = _keys(fps, "b", probing=False, limit=limit).hint("merge"), _keys(fps, "a", probing=True, limit=limit)
    hot = index.groupBy("r", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense).select("r", "key")
    hot, _ = staged(hot, "dense_keys")
    n_hot = hot.count()
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit
    if not n_hot:
        pairs = probes.join(index, ["r", "key"]).where(F.col("a") < F.col("b"))
        return pairs.where(near).select(F.col("b").alias("u"), F.col("a").alias("v")).distinct()
    hot = _bounded(hot, n_hot)
    cool = index.join(hot, ["r", "key"], "left_anti")
    pairs = probes.join(cool.hint("merge"), ["r", "key"]).where(F.col("a") < F.col("b"))
    pairs = pairs.where(near).select(F.col("b").alias("u"), F.col("a").alias("v"))
    crowd = probes.join(hot, ["r", "key"], "left_semi").select(F.col("a").alias("fp")).distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(64)])
    points = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    balls, _ = staged(points, "balls")
    least = balls.groupBy("point").agg(F.min("fp").alias("v")).hint("merge")
    stars = balls.join(least, "point").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest doc_id reached over links, for every row of ``docs``."""
    found, _ = staged(fingerprints(docs), "fingerprints")
    classes, _ = staged(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("_n")), "classes")
    roots, _ = components(links(classes.select("fp")))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(named, "root").select("fp", "component_id")
    classes, _ = staged(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "_n"), "named")
    return join_by_key(found, classes, "fp", found.count()).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component, columns unchanged.  Rows of a null doc_id stay."""
    kept = near_duplicates(docs).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept"))
    stay = docs.where(F.col("doc_id").isNull())
    return docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi").unionByName(stay)


def _hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")
