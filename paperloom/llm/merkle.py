"""Merkle manifest of a dataset, with an authentication path for every row.

A row's leaf is a SHA-256 of its fields.  The leaves of a source, in order of
doc_id, form a ternary tree, and the tops of the sources form another one.  Places
come from a range partitioning and the counts of its parts, so a source may hold
any share of the rows.

A tree is cut into aligned blocks of ARITY ** HEIGHT nodes.  A block is walked by
fractal traversal: it is a stack of subtrees of height SUBTREE; at each level there
is the subtree over the present leaf and the desired one, which grows by one leaf
a step and takes over when the walk leaves the present one.  So the paths of all
leaves come out one after the other while a few dozen nodes are held.  The tops of
the blocks are the nodes of the next layer, handled in the same way until a tree
has one block; the proofs of these layers are appended to the paths of the blocks.

Defined cases: a null field is ``-``; rows of one doc_id, or of none (they come
first), stand in order of their leaves; rows that are equal in all fields have
places of their own; a null doc_id is not tampered with; a null source is the
first source; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, shuffle_partitions, staged, table

ARITY = 3
#: Height of a block, and of the subtrees it is stacked from.
HEIGHT, SUBTREE = 7, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(nodes: list[bytes]) -> bytes:
    """Of nodes as hex text, one after the other; as hex text."""
    return sha256(b"".join(nodes)).hexdigest().encode()


class Growing:
    """A subtree with its top at height ``top``: takes its leaves from number ``first`` on and keeps its nodes from height ``low`` up, without the top."""

    def __init__(self, first: int, low: int, top: int) -> None:
        self.low, self.top = low, top
        self.nodes: dict[tuple[int, int], bytes] = {}
        self.runs: list[list[bytes]] = [[] for _ in range(top)]
        self.next = [first // ARITY**j for j in range(top + 1)]
        self.root = b""

    def add(self, node: bytes, height: int = 0) -> None:
        if height == self.top:
            self.root = node
            return
        if height >= self.low:
            self.nodes[height, self.next[height]] = node
        self.next[height] += 1
        self.runs[height].append(node)
        if len(self.runs[height]) == ARITY:
            self._close(height)

    def _close(self, height: int) -> None:
        run, self.runs[height] = self.runs[height], []
        self.add(digest(run), height + 1)

    def finish(self) -> Growing:
        for height in range(self.top):
            if self.runs[height]:
                self._close(height)
        return self


def height_of(n: int) -> int:
    """Levels above ``n`` leaves."""
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


def top_of(leaves: list[bytes], height: int) -> bytes:
    tree = Growing(0, height, height)
    for leaf in leaves:
        tree.add(leaf)
    return tree.finish().root


def traverse(leaves: list[bytes], height: int, subtree: int = SUBTREE) -> Iterator[list[tuple[list[bytes], list[bytes]]]]:
    """Of each leaf in turn its path: siblings to the left and to the right, level by level."""
    cuts = [*range(0, height, subtree), height]
    levels = list(zip(cuts, cuts[1:]))
    there = []
    for low, top in levels:
        first = Growing(0, low, top)
        for leaf in leaves[: ARITY**top]:
            first.add(leaf)
        there.append(first.finish().nodes)
    desired = [Growing(ARITY**top, low, top) for low, top in levels]
    sizes = [-(-len(leaves) // ARITY**j) for j in range(height)]
    for x in range(len(leaves)):
        path = []
        for (low, top), nodes in zip(levels, there):
            for j in range(low, top):
                at = x // ARITY**j
                run = at - at % ARITY
                path.append(([nodes[j, q] for q in range(run, at)], [nodes[j, q] for q in range(at + 1, min(run + ARITY, sizes[j]))]))
        yield path
        for i, (low, top) in enumerate(levels):
            span = ARITY**top
            if x + span < len(leaves):
                desired[i].add(leaves[x + span])
            if (x + 1) % span == 0:
                there[i] = desired[i].finish().nodes
                desired[i] = Growing(x + 1 + span, low, top)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, tree, leaf, tampered``: raw digests; the last one is null where the row isn't tampered with."""
    plain = {c: F.col(c) for c in FIELDS}
    torn = plain | {"text": F.replace("text", F.lit("\n"), F.lit(""))}
    leaf, other = (F.unhex(F.sha2(F.concat(*[field(x[c]) for c in FIELDS]), 256)) for x in (plain, torn))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf.alias("leaf"), F.when(hit, other).alias("tampered"))


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, the place in the own tree in order of ``order``, and ``n``, the size of the tree.

    Rows are dealt by ranges of (tree, order), so a tree spreads over as many parts as it needs.
    """
    n = shuffle_partitions(rows.sparkSession)
    dealt = rows.repartitionByRange(n, "tree", *order).sortWithinPartitions("tree", *order)
    dealt, _ = staged(dealt.withColumn("place", F.monotonically_increasing_id()), name)
    dealt = dealt.withColumn("part", F.shiftright("place", 33))
    counts = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c"), F.min("place").alias("first"))
    before = F.sum("c").over(W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(W.partitionBy("tree")).alias("n"))
    starts, _ = staged(starts, f"{name}_starts")  # a row for each tree and one more for each part, at most
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts.hint("merge")
    return dealt.join(starts, ["tree", "part"]).withColumn("pos", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def _in_order(group: pa.Table) -> tuple[pa.Table, list[bytes], int]:
    """A block's rows, its nodes as hex text and its height: that of a whole block, unless it is the only one of its tree."""
    group = group.sort_by("pos")
    n = group.column("n")[0].as_py()
    nodes = [x.as_py().hex().encode() for x in group.column("leaf")]
    return group, nodes, HEIGHT if n > ARITY**HEIGHT else height_of(n)


def _tops(key: tuple, group: pa.Table) -> pa.Table:
    _, nodes, height = _in_order(group)
    return pa.table({"tree": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-group.column("n")[0].as_py() // ARITY**HEIGHT)], pa.int64()), "leaf": pa.array([bytes.fromhex(top_of(nodes, height).decode())], pa.binary())})


_STEP = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
_ABOVE = "tree string, pos long, top binary, above array<struct<l:string,r:string>>"


def _joined(nodes: list[bytes]) -> str:
    return b"".join(nodes).decode()


def _proofs(key: tuple, group: pa.Table, upper: pa.Table) -> pa.Table:
    """Of each node of a block: what lies beside its way to the top of its tree."""
    group, nodes, height = _in_order(group)
    rest, top = upper.column("above")[0].as_py(), upper.column("top")[0].as_py()
    above = [[{"l": _joined(a), "r": _joined(b)} for a, b in path] + rest for path in traverse(nodes, height)]
    return pa.table({"tree": group.column("tree"), "pos": group.column("pos"), "top": pa.array([top] * len(nodes), pa.binary()), "above": pa.array(above, _STEP)})


def tops(nodes: DataFrame, name: str) -> DataFrame:
    """``tree, pos, n, leaf``: the tops of the blocks of ``nodes``, which are the nodes of the next layer."""
    block = F.floor(F.col("pos") / ARITY**HEIGHT)
    done = nodes.select("tree", "pos", "n", "leaf", block.alias("block")).groupBy("tree", "block").applyInArrow(_tops, "tree string, pos long, n long, leaf binary")
    return staged(done, name)[0]


def above(nodes: DataFrame) -> DataFrame:
    """``tree, pos, top, above`` of the block tops ``nodes``: layer after layer, until every tree has one block."""
    if not (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        return nodes.select("tree", "pos", F.col("leaf").alias("top"), F.array().cast("array<struct<l:string,r:string>>").alias("above"))
    upper = above(tops(nodes, "tops"))
    return staged(_beside(nodes, upper, _proofs, _ABOVE), "proofs")[0]


def _beside(nodes: DataFrame, upper: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on each block of ``nodes`` and the row of ``upper`` that stands for it."""
    left = nodes.withColumn("block", F.floor(F.col("pos") / ARITY**HEIGHT)).groupBy("tree", "block")
    right = upper.withColumn("block", F.col("pos")).groupBy("tree", "block")
    return left.cogroup(right).applyInArrow(work, schema)


_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _results(key: tuple, group: pa.Table, upper: pa.Table) -> pa.Table:
    """Of each leaf of a block: its proof, and the root recomputed from it and what the row has become."""
    group, nodes, height = _in_order(group)
    rest = [(s["l"].encode(), s["r"].encode()) for s in upper.column("above")[0].as_py()]
    subroot, root = (upper.column(c)[0].as_py().hex() for c in ("top", "root"))
    tail = b"".join(a + b for a, b in rest)
    proofs, folded = [], []
    for node, torn, path in zip(nodes, group.column("tampered"), traverse(nodes, height)):
        steps = [(b"".join(a), b"".join(b)) for a, b in path]
        proofs.append(sha256(b"".join(a + b for a, b in steps) + tail).hexdigest())
        now = node if not torn.is_valid else torn.as_py().hex().encode()
        for a, b in (*steps, *rest):
            now = digest([a, now, b])
        folded.append(now.decode())
    n = len(nodes)
    columns = {"doc_id": group.column("doc_id"), "leaf": [x.decode() for x in nodes], "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]}
    return pa.table(columns)


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row."""
    found, _ = staged(leaves(docs), "leaves")
    rows, _ = staged(placed(found, ["doc_id", "leaf"], "ordered"), "placed")
    blocks = tops(rows, "block_tops")
    upper, _ = staged(above(blocks), "upper")
    # A source's top is that of its first block, and a leaf of the tree over all sources.
    subroots = upper.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("top").alias("leaf"))
    sources, _ = staged(placed(subroots, ["source"], "sources"), "source_places")
    over = above(tops(sources, "source_tops"))
    roots, _ = staged(_beside(sources.drop("source"), over, _proofs, _ABOVE), "source_proofs")
    named = sources.select("source", "pos").join(roots.select("pos", F.col("above").alias("rest"), F.col("top").alias("root")), "pos")
    upper = upper.join(named.select(F.col("source").alias("tree"), "rest", "root"), "tree").select("tree", "pos", "top", F.concat("above", "rest").alias("above"), "root")
    return _beside(rows, upper, _results, _RESULT)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _field_sql(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(text if c == "text" else c) for c in FIELDS) + ")"


OP11_SQL = rf"""
WITH RECURSIVE
poly AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS t),
d AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf_sql("text")} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS torn,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 2 = 0 AS hit
  FROM documents, poly
), p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS i FROM d
), up AS (
  SELECT 0 AS h, tree, i, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM p
  UNION ALL
  SELECT h + 1, tree, i // 3, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY h, tree, i // 3
), s AS (
  SELECT tree, h AS height, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i FROM up WHERE n = 1
), top AS (
  SELECT 0 AS h, i, subroot AS node, count(*) OVER () AS n FROM s
  UNION ALL
  SELECT h + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY h, i // 3
), root AS (SELECT node AS root FROM top WHERE n = 1
), beside AS (
  SELECT p.doc_id, u.h, u.i < p.i // 3 ** u.h AS lft, u.i, u.node
  FROM p JOIN up u ON u.tree = p.tree AND u.n > 1 AND u.i // 3 = p.i // (3 ** u.h * 3)::BIGINT AND u.i <> p.i // (3 ** u.h)::BIGINT
  UNION ALL
  SELECT p.doc_id, s.height + u.h, u.i < s.i // 3 ** u.h, u.i, u.node
  FROM p JOIN s ON s.tree = p.tree JOIN top u ON u.n > 1 AND u.i // 3 = s.i // (3 ** u.h * 3)::BIGINT AND u.i <> s.i // (3 ** u.h)::BIGINT
), proof AS (
  SELECT doc_id, sha256(string_agg(node, '' ORDER BY h, i)) AS proof_sha256 FROM beside GROUP BY doc_id
), step AS (
  SELECT doc_id, h, coalesce(string_agg(node, '' ORDER BY i) FILTER (lft), '') AS l, coalesce(string_agg(node, '' ORDER BY i) FILTER (NOT lft), '') AS r FROM beside GROUP BY doc_id, h
), levels AS (
  SELECT p.doc_id, s.height + (SELECT max(h) FROM top) AS most FROM p JOIN s ON s.tree = p.tree
), fold AS (
  SELECT doc_id, 0 AS h, CASE WHEN hit THEN torn ELSE leaf END AS node FROM p
  UNION ALL
  SELECT f.doc_id, f.h + 1, sha256(coalesce(l, '') || f.node || coalesce(r, '')) FROM fold f JOIN levels USING (doc_id) LEFT JOIN step ON step.doc_id = f.doc_id AND step.h = f.h WHERE f.h < most
)
SELECT p.doc_id, p.leaf, s.subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = root AS verified
FROM p JOIN s ON s.tree = p.tree JOIN levels ON levels.doc_id = p.doc_id JOIN fold f ON f.doc_id = p.doc_id AND f.h = most LEFT JOIN proof ON proof.doc_id = p.doc_id, root
"""
