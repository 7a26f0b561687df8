"""Byte-level BPE encoding and decoding.

Pre-tokenisation is the serial part of byte-level BPE, so long texts are cut
into overlapping chunks that are pre-tokenised on their own, on any executor.
A pattern match depends only on what follows its start, so two neighbouring
chunks agree from the first boundary that both found: the stitch keeps the left
chunk's boundaries up to there and the right chunk's after it.  Where an overlap
holds no common boundary (one very long run), the two chunks are pre-tokenised
again as one from the last sure boundary.  The pieces are then encoded by rank,
and decoding concatenates the raw bytes of the ids.

Defined cases: null text is empty text, with no ids; repeated rows each keep
their row; special-token strings are ordinary text; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RANKS = "byte_bpe_50k.tiktoken"
#: Texts of more code points than this are pre-tokenised in chunks.
CHUNK = 65_536
OVERLAP = 1_024
#: Distinct pieces remembered by a worker.
REMEMBERED = 200_000
#: Bytes of ids after which a batch is passed on.
BATCH_BYTES = 8 << 20

_coders: dict[tuple[str, str], Coder] = {}


class Coder:
    """Ranks and pattern, loaded once by each worker."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        spaces = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(spaces)
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.raw = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.raw[i] = raw
        self.decimal = [str(i).encode() for i in range(len(self.raw))]
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Coder:
        if (path, pattern) not in _coders:
            _coders[path, pattern] = cls(path, pattern)
        return _coders[path, pattern]

    def encode_pieces(self, pieces: list[str]) -> bytes:
        """Ids as packed little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) >= REMEMBERED:
            known.clear()
        for piece in set(pieces):
            if piece not in known:
                known[piece] = np.asarray(self.merge(piece.encode()), "<u4").tobytes()
        return b"".join(map(known.__getitem__, pieces))

    def decode(self, packed: bytes) -> tuple[bytes, str]:
        """The raw bytes of packed ids, and a digest of the ids in decimal joined by one space."""
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.raw.__getitem__, ids)), hashlib.sha256(b" ".join(map(self.decimal.__getitem__, ids))).hexdigest()

    def ends(self, text: str) -> list[int]:
        return [m.end() for m in self.pattern.finditer(text)]


def stitched(chunks: list[tuple[int, str, list[int]]], ends: Callable[[str], list[int]]) -> list[str]:
    """Pieces of a text from its overlapping chunks (start, text, ends relative to the start), in order."""
    start, text, own = chunks[0]
    pieces: list[str] = []
    for nxt_start, nxt_text, nxt_own in chunks[1:]:
        shift = nxt_start - start
        right = {0, *nxt_own}
        # A match that touches the chunk's end may go on behind it.
        sure = [b for b in own if b < len(text)]
        common = next((b for b in sure if b >= shift and b - shift in right), None)
        used = [b for b in sure if common is None or b <= common]
        pieces += [text[a:b] for a, b in zip([0, *used], used)]
        last = used[-1] if used else 0
        if common is None:
            tail = text[last:]
            text = tail + nxt_text[start + len(text) - nxt_start :]
            start, own = start + last, ends(text)
        else:
            cut = last - shift
            text, own = nxt_text[cut:], [b - cut for b in nxt_own if b > cut]
            start = nxt_start + cut
    return pieces + [text[a:b] for a, b in zip([0, *own], own)]


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
ENCODED = "doc_id long, n_tokens long, ids binary"
_DECODED = pa.schema([*_ENCODED, ("decoded", pa.binary()), ("ids_sha256", pa.string())])
DECODED = ENCODED + ", decoded binary, ids_sha256 string"


def _row(coder: Coder, doc_id: int | None, ids: bytes, decoded: bool) -> tuple:
    return (doc_id, len(ids) // 4, ids, *(coder.decode(ids) if decoded else ()))


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids``: ids as packed little-endian unsigned 32-bit integers, a row for each row of ``docs``.

    ``decoded`` adds what ``decode`` adds, from the ids and in the same worker.
    """
    schema, fields = (_DECODED, DECODED) if decoded else (_ENCODED, ENCODED)
    path, pattern = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, pattern)
        found = coder.pattern.findall

        def each() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield _row(coder, doc_id, coder.encode_pieces(found(text.as_py())), decoded)

        yield from _batches(each(), schema, lambda r: 2 * len(r[2]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, pattern)
        for batch in batches:
            ends = [coder.ends(text.as_py()) for text in batch.column("part")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int32()))], names=[*batch.schema.names, "ends"])

    def join(group: pa.Table) -> pa.Table:
        coder = Coder.of(path, pattern)
        at = group.column("at").to_pylist()
        first = {a: i for i, a in reversed(list(enumerate(at)))}
        parts, ends = group.column("part"), group.column("ends")
        chunks = [(a, parts[i].as_py(), ends[i].as_py()) for a, i in sorted(first.items())]
        row = _row(coder, group.column("doc_id")[0].as_py(), coder.encode_pieces(stitched(chunks, coder.ends)), decoded)
        # Repeated rows bring their chunks as often.
        return pa.Table.from_pylist([dict(zip(schema.names, row))] * (len(at) // len(first)), schema=schema)

    long = F.char_length("text") > chunk
    short = rows.where(~long).mapInArrow(whole, fields)
    starts = F.sequence(F.lit(0), F.char_length("text") - 1, F.lit(chunk))
    parts = rows.where(long).select("doc_id", F.md5(F.col("text").cast("binary")).alias("sum"), "text", F.explode(starts).alias("at"))
    parts = parts.select("doc_id", "sum", "at", F.substring("text", F.col("at") + 1, F.lit(chunk + overlap)).alias("part"))
    parts = parts.repartition("doc_id", "sum", "at").mapInArrow(cut, "doc_id long, sum string, at int, part string, ends array<int>")
    return short.unionByName(parts.groupBy("doc_id", "sum").applyInArrow(join, fields))


def decode(encoded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``decoded``, the raw bytes of the ids, and ``ids_sha256``, a digest of the ids in decimal joined by one space."""
    path, pattern = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, pattern)

        def each() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    yield doc_id, n, packed.as_py(), *coder.decode(packed.as_py())

        yield from _batches(each(), _DECODED, lambda r: len(r[2]) + len(r[3]))

    return encoded.mapInArrow(raw, DECODED)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(table(spark, sf_dir, "documents"), decoded=True)
    return done.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
