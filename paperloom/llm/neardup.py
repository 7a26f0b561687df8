"""Near copies by content: five-word shingles with a Jaccard similarity of 0.8 or more.

Texts of equal shingles are one class and are compared once.  The method is that of
``simhash``: a class has the SimHash of its shingles, fingerprints within BITS bits
meet by pigeonring chains, and components come from star contraction.  As similar
texts may differ in far more bits, what meets is judged by its shingles, and an exact
way for the rest follows: two similar classes share one of the n - ceil(0.8 n) + 1
rarest shingles of each, are of fitting lengths and have enough shingles behind the
first shared one.

In ROUNDS rounds the classes of such a shingle that lie outside the component with most
of them are judged with REPS of that component, which joins most of a large group.
Then classes that aren't joined yet meet by these shingles, every pair of them: of a
shingle's classes those of its largest component meet the others alone.

Rarity is the number of shingles of all texts that fall into one of SLOTS slots with
it; any order that all texts agree on finds the same pairs.

Defined cases are those of ``simhash``: words are those of the bytes, A-Z
lower-cased; fewer than five are one shingle; null, empty and blank texts are one
class; a null doc_id never names a component unless it holds nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import BROADCAST_ROWS, drop_path, join_by_key, release, staged
from .graph import components

SHINGLE = 5
SEED = 42
#: Bits in which fingerprints that meet may differ.
BITS = 3
#: Rounds in which classes are judged with a few others, and how many of a shingle those are.
ROUNDS, REPS = 2, 4
#: Slots of shingles that are counted together, and those that make a row.
SLOTS, ROW = 1 << 20, 1 << 14
#: Whether classes of ``n_u`` and ``n_v`` shingles that first share those of places ``i_u`` and ``i_v`` can be similar.
FIT = "5 * least(n_u, n_v) >= 4 * greatest(n_u, n_v)"
REACH = f"{FIT} AND 9 * (1 + least(n_u - i_u - 1, n_v - i_v - 1)) >= 4 * (n_u + n_v)"


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of the shingles, ascending."""
    import xxhash

    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    runs = zip(*[words[i:] for i in range(SHINGLE)]) if len(words) >= SHINGLE else [words] if words else []
    return np.unique(np.fromiter((digest(b" ".join(x), SEED) for x in runs), np.uint64))


def _signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, sum, fp, sim, n, marks``: sum stands for the text, fp for the set of shingles, sim is its SimHash; marks are the shingles' upper 32 bits."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            fps, sims, marks = [], [], []
            for t in batch.column(2):
                found = shingles(t.as_py())
                fps.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sims.append(simhash.majority(found))
                marks.append(np.unique(found >> np.uint64(32)).astype(np.uint32).view(np.int32))
            n = pa.array([len(m) for m in marks], pa.int32())
            fp = pa.array(np.array(fps, np.uint64).astype(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp, pa.array(sims, pa.int64()), n, pa.array(marks, pa.list_(pa.int32()))], ["doc_id", "sum", "fp", "sim", "n", "marks"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sum"), "text").mapInArrow(each, "doc_id long, sum long, fp long, sim long, n int, marks array<int>")


def _slots(marks: np.ndarray) -> np.ndarray:
    return marks.view(np.uint32) >> np.uint32(32 - SLOTS.bit_length() + 1)


def _rarity(signed: DataFrame) -> np.ndarray:
    """How many shingles of all texts fall into each slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            total += np.bincount(_slots(batch.column(0).flatten().to_numpy(zero_copy_only=False)), minlength=SLOTS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS // ROW), pa.int32()), pa.array([x.tobytes() for x in total.reshape(-1, ROW)], pa.binary())], ["at", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(ROW, np.uint64)
        for x in rows.column("counts"):
            total += np.frombuffer(x.as_py(), np.uint32)
        return pa.table({"at": rows.column("at")[:1], "counts": pa.array([np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32).tobytes()], pa.binary())})

    kind = "at int, counts binary"
    out = np.zeros((SLOTS // ROW, ROW), np.uint32)
    for r in signed.select("marks").mapInArrow(count, kind).groupBy("at").applyInArrow(add, kind).collect():
        out[r["at"]] = np.frombuffer(r["counts"], np.uint32)
    return out.reshape(-1)


def _rarest(signed: DataFrame) -> DataFrame:
    """``mark, fp, n, i``: of each class the shingles one of which it shares with every similar one, and their places, rarest first."""
    rarity = signed.sparkSession.sparkContext.broadcast(_rarity(signed))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = rarity.value
        for batch in batches:
            fps, ns, places, found, seen = [], [], [], [], set()
            marks = batch.column(1)
            flat, ends = marks.flatten().to_numpy(zero_copy_only=False), np.cumsum(marks.value_lengths().to_numpy(zero_copy_only=False))
            for fp, end, n in zip(batch.column(0).to_pylist(), ends.tolist(), marks.value_lengths().to_pylist()):
                if n and fp not in seen:
                    seen.add(fp)
                    own = flat[end - n : end]
                    first = own[np.lexsort((own, counts[_slots(own)]))][: n - -(-4 * n // 5) + 1]
                    fps.append(np.full(len(first), fp, np.int64))
                    ns.append(np.full(len(first), n, np.int32))
                    places.append(np.arange(len(first), dtype=np.int32))
                    found.append(first)
            if fps:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found, fps, ns, places)], ["mark", "fp", "n", "i"])

    return signed.select("fp", "marks").mapInArrow(each, "mark int, fp long, n int, i int")


def _shared(signed: DataFrame) -> DataFrame:
    """The rows of ``_rarest`` whose shingle several classes have, and ``s``, how many its class has of them."""
    # Dealt once; what follows needs the rows of a shingle together.
    rows = _rarest(signed).repartition("mark").dropDuplicates(["mark", "fp"])
    rows = rows.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("mark"))).where("c > 1").drop("c")
    return rows.withColumn("s", F.count(F.lit(1)).over(Window.partitionBy("fp")))


def _rooted(shared: DataFrame, roots: DataFrame | None) -> tuple[DataFrame, str]:
    """``shared`` with ``root``, the component, ``hub``, that of most classes of the shingle, and ``r``, up to REPS classes of the hub; shingles of one component alone go."""
    if roots is None:
        rows = shared.withColumn("root", F.col("fp"))
    else:
        rows = shared.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Dealt once, for the groupings and the join alike: a component's row with its classes is several times as wide.
    rows = rows.repartition("mark")
    # Of a large group the least edited texts are near to most others; they have the fewest shingles of their own.
    first = [F.min(F.struct((F.col("s") * (j % 2 - 1)).alias("p"), F.xxhash64("fp", F.lit(j)).alias("o"), "fp", "n", "i")).alias(f"r{j}") for j in range(REPS)]
    comps = rows.groupBy("mark", "root").agg(F.count(F.lit(1)).alias("c"), *first)
    comps = comps.select("mark", "root", "c", F.array_distinct(F.array(*[F.struct(f"r{j}.fp", f"r{j}.n", f"r{j}.i") for j in range(REPS)])).alias("r"))
    hubs = comps.groupBy("mark").agg(F.max_by(F.struct("root", "r"), F.struct("c", "root")).alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return staged(rows.join(hubs.select("mark", F.col("hub.root").alias("hub"), "hub.r").hint("merge"), "mark"), "rooted")


def _alike(signed: DataFrame, dense: int) -> DataFrame:
    """Candidates ``u, v`` by SimHash: one class of each fingerprint meets those of the same and those of fingerprints within BITS bits."""
    classes = signed.groupBy("fp", "sim").agg(F.first("n").alias("n"))
    one = classes.groupBy("sim").agg(F.min(F.struct("fp", "n")).alias("x")).select("sim", F.col("x.fp").alias("fp"), F.col("x.n").alias("n"))
    one, _ = staged(one, "similar")
    near = simhash.links(one.select(F.col("sim").alias("fp")), dense, BITS)
    u, v = (one.select(F.col("sim").alias(x), F.col("fp").alias(f"fp_{x}"), F.col("n").alias(f"n_{x}")) for x in "uv")
    met = near.join(u, "u").join(v, "v").select("fp_u", "n_u", "fp_v", "n_v")
    same = classes.select("sim", F.col("fp").alias("fp_u"), F.col("n").alias("n_u")).join(v.withColumnRenamed("v", "sim"), "sim").where("fp_u <> fp_v")
    return met.unionByName(same.drop("sim")).where(FIT).select(F.col("fp_u").alias("u"), F.col("fp_v").alias("v"))


def _judged(pairs: DataFrame, found: DataFrame, tried: DataFrame | None) -> tuple[DataFrame, str, DataFrame, str]:
    """Those of the candidates ``u, v`` but for those ``tried`` before that are similar enough, all that were judged, and both tables' paths.

    Wide tables and the shuffles on the way are gone when it returns.
    """
    spark = pairs.sparkSession
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs, pairs_path = staged(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "candidates")
    wanted, wanted_path = staged(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), "wanted")
    release(spark)
    # Few classes are told by broadcast, so that only their shingles are shuffled.
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("merge")
    marks = found.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.first("marks").alias("marks"))
    marks, marks_path = staged(marks, "marks")
    release(spark)
    judged = pairs.join(marks.select(F.col("fp").alias("u"), F.col("marks").alias("mu")).hint("merge"), "u")
    judged = judged.join(marks.select(F.col("fp").alias("v"), F.col("marks").alias("mv")).hint("merge"), "v")
    links, path = staged(judged.where("9 * size(array_intersect(mu, mv)) >= 4 * (size(mu) + size(mv))").select("u", "v"), "links")
    for x in (wanted_path, marks_path):
        drop_path(spark, x)
    release(spark)
    return links, path, pairs, pairs_path


def _few_met(rows: DataFrame) -> DataFrame:
    """Candidates ``u, v``: of each shingle's classes those outside the hub with a few of it.

    A pair that first shares another shingle may be passed over here; it meets by that one, at the latest in ``_all_met``.
    """
    met = rows.where("root <> hub").select(*[F.col(c).alias(f"{c}_u") for c in ("fp", "n", "i")], F.explode("r").alias("r"))
    met = met.select("*", *[F.col(f"r.{c}").alias(f"{c}_v") for c in ("fp", "n", "i")]).where(REACH)
    return met.select(F.col("fp_u").alias("u"), F.col("fp_v").alias("v"))


def _all_met(rows: DataFrame) -> DataFrame:
    """Candidates ``u, v`` of one shingle that lie in different components."""
    left = rows.where("root <> hub").select("mark", *[F.col(c).alias(f"{c}_u") for c in ("fp", "n", "i", "root")])
    right = rows.select("mark", *[F.col(c).alias(f"{c}_v") for c in ("fp", "n", "i", "root")], (F.col("root") == F.col("hub")).alias("in_hub"))
    met = left.hint("merge").join(right, "mark").where(f"root_u <> root_v AND (in_hub OR fp_u < fp_v) AND {REACH}")
    return met.select(F.col("fp_u").alias("u"), F.col("fp_v").alias("v"))


def near_copies(docs: DataFrame, dense: int = simhash.DENSE) -> DataFrame:
    """``doc_id, sum, fp, root, component_id``: the smallest doc_id reached over links, for every row of ``docs``; ``root`` tells components apart."""
    spark = docs.sparkSession
    signed, signed_path = staged(_signatures(docs), "signatures")
    found, _ = staged(signed.select("doc_id", "sum", "fp"), "fingerprints")
    classes, _ = staged(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("_n")), "classes")
    alike, alike_path = staged(_alike(signed, dense), "alike")
    release(spark)
    shared, shared_path = staged(_shared(signed), "shared")
    release(spark)
    roots, tried, read, pair_paths = None, None, [alike_path], []
    for k in range(ROUNDS + 1):
        rows, rows_path = _rooted(shared, roots)
        release(spark)
        met = _few_met(rows) if k < ROUNDS else _all_met(rows)
        edges, edges_path, pairs, pairs_path = _judged(met if roots else met.unionByName(alike), signed, tried)
        tried = tried.unionByName(pairs) if tried else pairs
        pair_paths.append(pairs_path)
        # A component of the rounds before is its star.
        roots, roots_path = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(edges) if roots else edges)
        for path in [rows_path, edges_path, *read]:
            drop_path(spark, path)
        read = [roots_path]
        release(spark)
    for path in (signed_path, shared_path, *pair_paths):
        drop_path(spark, path)
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Partial minima leave one row of a component in each task.
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    named, _ = staged(named, "components")
    linked, _ = staged(linked.select("fp", "root", F.col("_n").alias("_rows")), "linked")
    classes, _ = staged(join_by_key(linked, named, "root", linked.count()).select("fp", "root", "component_id", F.col("_rows").alias("_n")), "named")
    return join_by_key(found, classes, "fp", found.count()).select("doc_id", "sum", "fp", "root", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, columns unchanged: one whose doc_id names it.  Rows of a null doc_id stay.

    A row is known by its doc_id and text, so rows that share a doc_id alone are told apart.
    """
    found = near_copies(docs).where(F.col("doc_id") == F.col("component_id"))
    sums = found.groupBy("root", "doc_id", "sum").agg(F.count(F.lit(1)).alias("_n"))
    kept = sums.groupBy("root").agg(F.min(F.struct("sum", "doc_id", "_n")).alias("x")).select(F.col("x.doc_id").alias("_kept"), F.col("x.sum").alias("_sum"), F.col("x._n").alias("_n"))
    kept, _ = staged(kept, "kept")
    same = (docs["doc_id"] == F.col("_kept")) & (F.xxhash64(docs["text"]) == F.col("_sum"))
    single = docs.join(kept.where("_n = 1"), same, "left_semi")
    # Of rows of one doc_id and text one stays; a hot one is pre-aggregated before its shuffle.
    several = kept.where("_n > 1")
    several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    rows = docs.join(several, same).groupBy("_kept", "_sum").agg(F.first(F.struct(*docs.columns)).alias("x")).select("x.*")
    return single.unionByName(rows).unionByName(docs.where(F.col("doc_id").isNull()))
