import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm import bpe, dac

from .cases import awkward, repeated


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk", [bpe.CHUNK, 700])
def test_bpe_equals_library_and_decodes(spark, library, chunk):
    docs = repeated(awkward(spark))
    names = ["doc_id", "n_tokens", "ids", "decoded", "ids_sha256"]
    got = bpe.encode(docs, chunk=chunk, overlap=64, decoded=True).select(*names).collect()
    apart = bpe.decode(bpe.encode(docs.limit(20), chunk=chunk, overlap=64))
    assert apart.columns == names and apart.count() == 20
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((r["doc_id"], len(ids), np.array(ids, "<u4").tobytes(), (r["text"] or "").encode(), digest))
    assert sorted((tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for r in got), key=repr) == sorted(want, key=repr)


def test_white_space_classes_agree_with_library(library):
    coder = bpe.Coder.of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = "".join(f"a{chr(c)}{chr(c)}b1{chr(c)}. " for c in [*range(0, 0x250), *range(0x2000, 0x2070), 0x3000, 0xFEFF])
    assert np.frombuffer(coder.encode_pieces(coder.pattern.findall(text)), "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_empty_table(spark):
    assert bpe.decode(bpe.encode(awkward(spark).limit(0))).count() == 0


def test_dac_round_trip_and_offsets(spark, tmp_path):
    docs = repeated(awkward(spark))
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    path = f"file://{tmp_path}/tokens"
    dac.write(docs, path)
    got = dac.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).orderBy("start").collect()
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"], r["text"] or "")):
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_dac_random_access():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 300, 500), rng.integers(0, 1 << 31, 500), np.zeros(70)]).astype(np.uint32)
    segment = dac.Segment(*dac.pack(ids))
    places = rng.permutation(len(ids))
    assert (segment.at(places) == ids[places]).all()
    for begin, end in [(0, len(ids)), (3, 3), (63, 65), (64, 128), (470, 530), (len(ids) - 1, len(ids)), (len(ids), len(ids))]:
        assert (segment.span(begin, end) == ids[begin:end]).all()


def test_dac_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    dac.write(awkward(spark).limit(0), path)
    assert dac.read(spark, path).count() == 0


def test_units_encode_as_whole_texts():
    import random

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    coder = dac.UnitEncoder.of(P.path("byte_bpe_50k.json"))
    rng = random.Random(11)
    parts = ["word", "Éa", "x", " ", "  ", "\n", "\n\n", "\t", ".", ",", "!?", "'s", "'t", "12", "a1", "日本", "ª", "²", " ", " ", "\x1c", "don't", "<|endoftext|>", "\r\n", "_", "🙂"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    got = coder.encode(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)
