"""Hard negatives by dual-tree search.

Anchors are the queries, all rows are candidates.  Both sides are trees of balls:
a node has a centre and a radius, so the inner products of two nodes lie in an
interval.  A pair of nodes is dropped, whole group of anchors at once, if its
interval misses what every anchor of the group can still use; pairs of leaves are
scored exactly.

Anchors are handled in rounds of bounded bytes, each a tree that is sent to the
workers; candidates stay where they are, dealt by ranges of (wave, label, sum,
hash), and every Arrow batch of them becomes a tree.  The candidates come in waves
that grow by WAVE times: what an anchor has found in one wave bounds the next, so
an anchor collects about k x WAVE rows in a wave and not k rows in every task.

Two searches follow each other: the first positives of an anchor's own label, then,
for each positive, the first rows of other labels between the bounds its score sets.

Components are whole numbers, so scores are sums without rounding; where they
could pass 2**53, Python's integers take the place of floats.

Defined cases: rows without label, vector or a finite component take no part; a
vector that is shorter than another counts as filled up with zeros; rows of one
vec_id are rows of their own, and an anchor leaves out itself once; a null vec_id
is no anchor and comes last among ties; equal rows are listed as often as they
occur; an empty table gives an empty result; other columns are ignored.  A
component of more than 2**63 / 256 counts as that, and scores must fit a long.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_path, new_path, shuffle_partitions, staged, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
ANCHORS_AT, MOVED_AT, LABELS = 100, 7, 10
#: Anchors and candidates of a leaf, candidates of a tree.
ANCHOR_LEAF, LEAF, BLOCK = 32, 256, 8192
#: Bytes of anchors that are sent to the workers at a time.
ROUND_BYTES = 8 << 20
#: Growth of the waves, and their number.
WAVE, WAVES = 16, 3
_LAST = np.iinfo(np.int64).max
_FLOOR = -(2.0**100)


def prepared(rows: DataFrame) -> DataFrame:
    """``vec_id, label, v``: rows that take part, with their whole-number vectors."""
    x = F.col("embedding")
    fit = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    moved = F.when(F.col("vec_id") % MOVED_AT == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return rows.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v"))


class Tree:
    """Balls over the rows of a matrix; ``order`` lists the rows leaf by leaf, a node is a range of it."""

    def __init__(self, vectors: np.ndarray, leaf: int) -> None:
        self.vectors = vectors
        floats = vectors.astype(np.float64)
        self.order = np.arange(len(vectors))
        self.start, self.end, self.children, self.centre, self.radius, self.norm = [], [], [], [], [], []
        self._grow(floats, 0, len(vectors), leaf)
        self.vectors = vectors[self.order]

    def _grow(self, x: np.ndarray, start: int, end: int, leaf: int) -> int:
        node, own = len(self.start), self.order[start:end]
        centre = x[own].mean(axis=0)
        self.start.append(start)
        self.end.append(end)
        self.children.append(())
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((x[own] - centre) ** 2).sum(axis=1).max())))
        self.norm.append(float(np.sqrt(centre @ centre)))
        if end - start > leaf:
            # Halves by place, so that equal rows are divided too.
            axis = int(np.argmax(x[own].max(axis=0) - x[own].min(axis=0)))
            half = (end - start) // 2
            self.order[start:end] = own[np.argpartition(x[own, axis], half)]
            self.children[node] = (self._grow(x, start, start + half, leaf), self._grow(x, start + half, end, leaf))
        return node


class Wanted:
    """What the anchors of a round look for: ``slots`` ranges of scores for each, and the first ``k`` rows found in each range.

    The lists are kept by descending score, then ascending id.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        self.scores = np.full((*low.shape, k), _FLOOR, low.dtype)
        self.ids = np.full((*low.shape, k), _LAST, np.int64)

    def least(self) -> np.ndarray:
        """The least score an anchor can use in each range; a range without numbers wants more than there is."""
        return np.where(self.low <= self.high, np.maximum(self.low, self.scores[:, :, -1]), np.inf)

    def offer(self, anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> bool:
        """Takes what is better than the present lists of some anchors from a matrix of scores; whether there was any."""
        last, last_id = self.scores[anchors, :, -1], self.ids[anchors, :, -1]
        taken = False
        for slot in range(self.low.shape[1]):
            s = scores
            good = (s >= self.low[anchors, slot, None]) & (s <= self.high[anchors, slot, None])
            good &= (s > last[:, slot, None]) | ((s == last[:, slot, None]) & (ids[None, :] < last_id[:, slot, None]))
            for i in np.flatnonzero(good.any(axis=1)).tolist():
                at = np.flatnonzero(good[i])
                self.put(int(anchors[i]), slot, s[i, at], ids[at])
                taken = True
        return taken

    def put(self, anchor: int, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[anchor, slot], scores]), np.concatenate([self.ids[anchor, slot], ids])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores[anchor, slot], self.ids[anchor, slot] = scores[first], ids[first]

    def take(self, found: pa.Table) -> None:
        """Takes rows ``a, slot, score, id``."""
        found = found.sort_by([("a", "ascending"), ("slot", "ascending")])
        a, slot, score, ids = (found.column(c).to_numpy() for c in ("a", "slot", "score", "id"))
        cuts = np.flatnonzero(np.r_[len(a) > 0, (np.diff(a) != 0) | (np.diff(slot) != 0)]).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(a)]):
            self.put(int(a[i]), int(slot[i]), score[i:j].astype(self.scores.dtype), ids[i:j])

    def beyond(self, known: Wanted) -> list[list[int]]:
        """Anchors, ranges, scores and ids of what is listed here and not in ``known``.  Equal rows make equal entries, so these are counted."""
        out: list[tuple[int, int, int, int]] = []
        changed = ((self.scores != known.scores) | (self.ids != known.ids)).any(axis=2)
        for a, slot in zip(*(x.tolist() for x in np.nonzero(changed))):
            now, before = (Counter(zip(w.scores[a, slot].tolist(), w.ids[a, slot].tolist())) for w in (self, known))
            out += [(a, slot, int(score), i) for (score, i), n in (now - before).items() if score > _FLOOR for _ in range(n)]
        return [list(c) for c in zip(*out)] or [[], [], [], []]


def search(anchors: Tree, labels: np.ndarray, wanted: Wanted, vectors: np.ndarray, ids: np.ndarray, label: int, same: bool) -> int:
    """Holds candidates of one label against the anchors of that label (``same``) or of all others; how many scores were computed."""
    takes = (labels == label) if same else (labels != label)
    if not takes.any() or not len(ids):
        return 0
    found = Tree(vectors, LEAF)
    ids = ids[found.order]
    top = np.where(wanted.low <= wanted.high, wanted.high, -np.inf).max(axis=1).astype(np.float64)
    top[~takes] = -np.inf
    least = wanted.least().min(axis=1).astype(np.float64)
    n_scored = 0
    # Bounds of a node of anchors; those of the least scores rise as rows are found.
    most = [float(top[anchors.order[a:b]].max()) for a, b in zip(anchors.start, anchors.end)]
    stack = [(0, 0)]
    while stack:
        p, q = stack.pop()
        middle = float(anchors.centre[p] @ found.centre[q])
        reach = anchors.radius[p] * found.norm[q] + found.radius[q] * anchors.norm[p] + anchors.radius[p] * found.radius[q]
        reach += 1 + 1e-9 * (abs(middle) + reach + anchors.norm[p] * found.norm[q])  # more than the rounding of floats
        own = anchors.order[anchors.start[p] : anchors.end[p]]
        if middle - reach > most[p] or middle + reach < least[own][takes[own]].min(initial=np.inf):
            continue
        left, right = anchors.children[p], found.children[q]
        if left and (not right or anchors.end[p] - anchors.start[p] > found.end[q] - found.start[q]):
            stack += [(c, q) for c in left]
        elif right:
            stack += [(p, c) for c in sorted(right, key=lambda c: float(anchors.centre[p] @ found.centre[c]))]
        else:
            at = takes[own]
            a, b = found.start[q], found.end[q]
            scores = anchors.vectors[anchors.start[p] : anchors.end[p]][at] @ found.vectors[a:b].T
            n_scored += scores.size
            if wanted.offer(own[at], scores, ids[a:b]):
                least[own] = wanted.least()[own].min(axis=1).astype(np.float64)
    return n_scored


def _matrix(lists: pa.Array, dims: int, dtype: type) -> np.ndarray:
    """Vectors as rows of ``dims`` numbers, filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out.astype(dtype)


def _scan(candidates: DataFrame, held: Broadcast, dims: int, dtype: type, same: bool) -> DataFrame:
    """``a, slot, score, id``: what each task finds for the anchors, beyond what was known before."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, labels, known = held.value
        mine = Wanted(known.low, known.high, known.k)
        mine.scores, mine.ids = known.scores.copy(), known.ids.copy()
        for batch in batches:
            own = batch.column(1).to_numpy()
            ids = batch.column(0).fill_null(_LAST).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:]):
                for s in range(a, b, BLOCK):
                    e = min(b, s + BLOCK)
                    search(tree, labels, mine, _matrix(batch.column(2).slice(s, e - s), dims, dtype), ids[s:e], int(own[a]), same)
        out = mine.beyond(known)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["a", "slot", "score", "id"])

    return candidates.mapInArrow(each, "a int, slot int, score long, id long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("a", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _waves(waves: list[DataFrame], tree: Tree, labels: np.ndarray, wanted: Wanted, dims: int, dtype: type, same: bool) -> list[str]:
    """Feeds the waves one after the other, so that each bounds the next; the tables of what they found."""
    spark, paths = waves[0].sparkSession, []
    for wave in waves:
        held = spark.sparkContext.broadcast((tree, labels, wanted))
        found, path = staged(_first(_scan(wave, held, dims, dtype, same), wanted.k).drop("rank"), "found")
        held.unpersist()
        paths.append(path)
        if same or wave is not waves[-1]:
            wanted.take(found.toArrow())  # at most k rows for each range of a round's anchors
    return paths


def _round(anchors: pa.Table, waves: list[DataFrame], dims: int, dtype: type) -> tuple[DataFrame, list[str]]:
    """All lists of some anchors; and the tables they are read from."""
    spark = waves[0].sparkSession
    ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
    vectors = _matrix(anchors.column("v").combine_chunks(), dims, dtype)
    tree, n = Tree(vectors, ANCHOR_LEAF), len(ids)
    # An anchor is a row of its own label: it may take one of the first places itself.
    own = Wanted(np.full((n, 1), -(2**100), dtype), np.full((n, 1), 2**100, dtype), POSITIVES + 1)
    for path in _waves(waves, tree, labels, own, dims, dtype, True):
        drop_path(spark, path)
    itself = (own.scores[:, 0] == (vectors * vectors).sum(axis=1)[:, None]) & (own.ids[:, 0] == ids[:, None])
    place = np.where(itself.any(axis=1), itself.argmax(axis=1), POSITIVES)
    rest = np.arange(POSITIVES)[None, :] + (np.arange(POSITIVES)[None, :] >= place[:, None])
    scores, positives = np.take_along_axis(own.scores[:, 0], rest, 1), np.take_along_axis(own.ids[:, 0], rest, 1)
    there = scores > _FLOOR
    low, high = np.where(there, -((-LOW * scores) // 100), 1), np.where(there, (HIGH * scores) // 100, 0)
    paths = _waves(waves, tree, labels, Wanted(low.astype(dtype), high.astype(dtype), NEGATIVES), dims, dtype, False)
    found = _first(spark.read.schema("a int, slot int, score long, id long").parquet(*paths), NEGATIVES)
    a, slot = np.nonzero(there)
    named = pa.table({"a": pa.array(a, pa.int32()), "slot": pa.array(slot, pa.int32()), "anchor_id": ids[a], "positive_id": positives[a, slot], "positive_score": pa.array([int(x) for x in scores[a, slot]], pa.int64())})
    out = found.join(spark.createDataFrame(named, "a int, slot int, anchor_id long, positive_id long, positive_score long"), ["a", "slot"])
    real = lambda c: F.when(F.col(c) < F.lit(_LAST), F.col(c))
    return out.select("anchor_id", real("positive_id").alias("positive_id"), "rank", real("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), paths


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    spark = rows.sparkSession
    # The hash decides on the wave, the sum of the components keeps like vectors near each other.
    h = F.xxhash64("vec_id", "v")
    wave = F.coalesce(*[F.when(F.pmod(h, F.lit(WAVE ** (WAVES - 1 - w))) == 0, w) for w in range(WAVES)])
    total = F.aggregate("v", F.lit(0.0), lambda s, c: s + c)
    found = prepared(rows).select("vec_id", "label", "v", wave.alias("wave"), total.alias("total"), h.alias("h"))
    found = found.repartitionByRange(shuffle_partitions(spark), "wave", "label", "total", "h").sortWithinPartitions("wave", "label", "total", "h")
    held, path = staged(found.select("vec_id", "label", "v", "wave"), "vectors")
    dims, most = held.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("decimal(20,0)")))))).first()
    dims, most = max(1, dims or 0), int(most or 0)
    # Every product of a score and a hundredth must be exact.
    dtype = np.float64 if dims * most * most * 100 < 2**53 else object
    waves = [held.where(F.col("wave") == w).select("vec_id", "label", "v") for w in range(WAVES)]
    queries = held.where(F.col("vec_id") % ANCHORS_AT == 0)
    n_rounds = max(1, -(-queries.count() * (8 * dims + 16 * POSITIVES * NEGATIVES) // round_bytes))
    parts, parts_path = staged(queries.repartition(n_rounds).select("vec_id", "label", "v", F.spark_partition_id().alias("part")), "anchors")
    out = new_path(spark, "negatives")
    spark.createDataFrame([], SCHEMA).write.parquet(out)
    for part in range(n_rounds):
        anchors = parts.where(F.col("part") == part).toArrow()  # one round, of bounded bytes
        if len(anchors):
            lists, paths = _round(anchors, waves, dims, dtype)
            lists.write.mode("append").parquet(out)
            for old in paths:
                drop_path(spark, old)
    for old in (path, parts_path):
        drop_path(spark, old)
    return spark.read.schema(SCHEMA).parquet(out)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= 5
)
SELECT * FROM (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
    s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
) WHERE rank <= 10
"""
