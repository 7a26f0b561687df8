"""The manifest against plain trees built level by level."""

import zlib
from hashlib import sha256

import pytest

from paperloom.llm import merkle

from .cases import awkward, repeated, rows


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def beside(tree, i):
    """Siblings of leaf ``i`` to the left and to the right, level by level."""
    out = []
    for nodes in tree[:-1]:
        run = i - i % 3
        out.append((nodes[run:i], nodes[i + 1 : run + 3]))
        i //= 3
    return out


def brute(docs):
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: h(part(r["doc_id"]), part(r["source"]), part(r["lang"]), part(r["n_chars"]), part(text))
    by = {}
    for r in docs:
        text = r["text"]
        torn = text.replace("\n", "") if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 else text
        by.setdefault(r["source"], []).append((r["doc_id"], leaf(r, text), leaf(r, torn)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([x[1] for x in by[s]])
    over = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (doc_id, node, torn) in enumerate(by[s]):
            path = beside(trees[s], i) + beside(over, k)
            now = torn
            for a, b in path:
                now = h(*a, now, *b)
            out.append((doc_id, node, trees[s][-1][0], over[-1][0], h(*(x for a, b in path for x in a + b)), now, now == over[-1][0]))
    return out


@pytest.mark.parametrize("n, subtree", [(1, 2), (2, 1), (3, 2), (4, 2), (28, 1), (81, 3), (100, 2), (250, 2), (730, 2), (730, 3)])
def test_traversal_yields_all_paths_with_few_nodes(n, subtree):
    nodes = [h(str(i)) for i in range(n)]
    tree = levels(nodes)
    got = list(merkle.traverse([x.encode() for x in nodes], merkle.height_of(n), subtree))
    want = [[([x.encode() for x in a], [x.encode() for x in b]) for a, b in beside(tree, i)] for i in range(n)]
    assert got == want
    assert merkle.top_of([x.encode() for x in nodes], merkle.height_of(n)).decode() == tree[-1][0]


def test_equals_brute_force(spark):
    docs = repeated(awkward(spark))
    extra = spark.createDataFrame([(None, "no id\n", "en", "src0", 3, 0, "x", "y"), (None, None, None, None, None, 0, "x", "y"), (-5, "a\nb", "en", "src0", 3, 0, "x", "y"), (-(2**63), "a\nb", "en", "src0", 3, 0, "x", "y"), (2**63 - 1, "a\nb", "日本", "é", None, 0, "x", "y")], docs.schema)
    docs = docs.union(extra).union(extra)
    got = rows(merkle.manifest(docs))
    assert got == sorted(brute(docs.collect()), key=repr)
    assert {r[-1] for r in got} == {True, False}


def test_a_hot_source_of_several_blocks(spark):
    """Whole blocks, a last block of one leaf, and a source of one row."""
    n = 2 * merkle.ARITY**merkle.HEIGHT + 1
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('t\\n', id) AS text", "'en' AS lang", "'hot' AS source", "id AS n_chars")
    docs = docs.union(spark.createDataFrame([(n, "x", "en", "cold", 1)], docs.schema))
    assert rows(merkle.manifest(docs)) == sorted(brute(docs.collect()), key=repr)


def test_empty_table(spark):
    assert merkle.manifest(awkward(spark).limit(0)).count() == 0
