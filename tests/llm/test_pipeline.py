import base64
import hashlib

import public_tokenizers as P
import pyarrow.parquet as pq
import tiktoken

import corpus_pipeline

from . import brute
from .cases import awkward
from .test_neardup import components
from .test_substring import brute as substring


def by_hand(docs, items):
    """docs: rows of doc_id, text, lang, source, n_chars with distinct ids."""
    kept = {r[0] for r in brute.quality([(d[0], d[1], d[3]) for d in docs]) if r[-1]}
    docs = [d for d in docs if d[0] in kept]
    stay = set(components([(d[0], d[1]) for d in docs])[0].values())
    docs = [d for d in docs if d[0] in stay]
    left = {r[0]: r for r in substring([(d[0], d[1]) for d in docs])}
    docs = [(d[0], left[d[0]][3] if left[d[0]][2] else d[1]) for d in docs]
    bad = {r[0] for r in brute.decontaminate(docs, items) if r[-1]}
    return {d: t or "" for d, t in docs if d not in bad}


def test_run_equals_brute_force(spark, tmp_path):
    docs = awkward(spark, 120).select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in docs.collect()]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pq.write_table(pq.read_table("/root/testdata/sf0.001/benchmark.parquet"), f"{tmp_path}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{tmp_path}/benchmark.parquet").to_pylist()]
    want = by_hand(rows, items)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and 0 < len(want) < len(rows)
    for d, text in want.items():
        ids = library.encode_ordinary(text)
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns(spark, tmp_path):
    docs = awkward(spark, 30).select("doc_id", "text", "lang", "source", "n_chars")
    pq.write_table(pq.read_table("/root/testdata/sf0.001/benchmark.parquet"), f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_dedup_keeps_one_row_of_a_repeated_id(spark, tmp_path):
    text = " ".join(f"n{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, text + " tail"), (2, text), (3, "another text of six words"), (3, "another text of six words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3]
